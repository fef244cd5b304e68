"""Queries over findings: numbering, counts, grades, gates, order, reports, and the text functions they use."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from wardspark.functions import grading, paths, text
from wardspark.operators import report
from wardspark.operators.detect import describe, scan, scan_files
from wardspark.operators.filters import at_or_above, by_rule_set, chain_eligible, collected, severe
from wardspark.operators.numbering import neighbor_lines, number_findings
from wardspark.plans.scan import scannable
from wardspark.rules import ALL_RULES, DOCUMENTED_RULES, SHIPPED_RULES, rule

from .corpora import CODE_FILES_SQL, code_files, spread, table, text_rows, TEXT_ROWS_SQL
from .detection import flat
from .duck import COLLECTED_SQL, NAME_SQL, findings_ctes, hits_cte, source_ctes

QUERIES, ORACLE = {}, {}
_NUMBERED: dict = {}


def files(spark, sf_dir) -> DataFrame:
    return code_files(spark, sf_dir).select("target", "path", "content")


def table_state(spark, sf_dir) -> int:
    """Changes whenever a file behind the corpus does."""
    names = ("events", "customer")
    parts = [table(spark, sf_dir, n).select(F.col("_metadata.file_path").alias("p"), F.col("_metadata.file_size").alias("s"),
                                            F.col("_metadata.file_modification_time").alias("t")) for n in names]
    return parts[0].unionByName(parts[1]).groupBy("p", "s", "t").count().agg(F.sum(F.xxhash64("p", "s", "t").cast("decimal(38,0)"))).first()[0]


def numbered_findings(spark, sf_dir) -> DataFrame:
    """The findings table all later steps read, written once for a state of the tables in an application."""
    key = (spark.sparkContext.applicationId, sf_dir, table_state(spark, sf_dir))
    if key not in _NUMBERED:
        _NUMBERED[key] = describe(number_findings(scan_files(scannable(files(spark, sf_dir)), ALL_RULES)), ALL_RULES)
    return _NUMBERED[key]


def register(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = lambda spark, sf_dir: flat(fn(spark, sf_dir))
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return keep


F_SQL = f"WITH {findings_ctes()} "
_TARGETS_SQL = "(SELECT DISTINCT target FROM code_files)"
_SEV = ("critical", "high", "medium", "low")
_COUNTS_SQL = ", ".join(f"count(*) FILTER (WHERE severity = '{s}') AS {s}" for s in _SEV) + ", count(*) AS total"
_POINTS = "10 * coalesce(critical, 0) + 4 * coalesce(high, 0) + coalesce(medium, 0)"
_GRADE = (
    f"CASE WHEN {_POINTS} = 0 THEN 'A+' WHEN {_POINTS} <= 2 THEN 'A' WHEN {_POINTS} <= 5 THEN 'B' WHEN {_POINTS} <= 10 THEN 'C' "
    f"WHEN {_POINTS} <= 20 THEN 'D' ELSE 'F' END"
)
_RANK = "CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END"


# --- numbering ------------------------------------------------------------------
@register("finding_index", F_SQL + "SELECT target, path, rule_id, pattern_ord, line_number, finding_index FROM findings")
def _(spark, sf_dir):
    """The whole pipeline up to numbered findings, scanned anew."""
    found = describe(number_findings(scan_files(scannable(files(spark, sf_dir)), ALL_RULES)), ALL_RULES)
    return found.select("target", "path", "rule_id", "pattern_ord", "line_number", "finding_index")


@register("findings_union", F_SQL + "SELECT target, rule_id, pattern_ord, count(*) AS n_findings FROM findings GROUP BY ALL")
def _(spark, sf_dir):
    """The findings of two rule sets of one scan, put together as a bag."""
    found = scan(scannable(files(spark, sf_dir)), ALL_RULES, snippets=False)
    both = by_rule_set(found, {"shipped": [r.rule_id for r in SHIPPED_RULES], "documented": [r.rule_id for r in DOCUMENTED_RULES]})
    return both.groupBy("target", "rule_id", "pattern_ord").agg(F.count("*").alias("n_findings"))


@register("context_snippet", F_SQL + "SELECT target, finding_index, line_number, code_snippet FROM findings")
def _(spark, sf_dir):
    return numbered_findings(spark, sf_dir).select("target", "finding_index", "line_number", "code_snippet")


@register("neighbor_lines", f"WITH {CODE_FILES_SQL}, {source_ctes('code_files')} SELECT path, CAST(line_number AS BIGINT) AS line_number, "
          "array_to_string(ls[greatest(line_number - 3, 1):line_number + 3], chr(10)) AS around FROM lines")
def _(spark, sf_dir):
    """Lines as rows with the three lines before and after."""
    return neighbor_lines(files(spark, sf_dir), 3).withColumn("line_number", F.col("line_number").cast("long"))


# --- counts and grades --------------------------------------------------------------
@register("severity_counts", F_SQL + f"SELECT target, {_COUNTS_SQL} FROM findings GROUP BY target")
def _(spark, sf_dir):
    return report.severity_counts(numbered_findings(spark, sf_dir), "target")


@register("risk_score", F_SQL + f", c AS (SELECT target, {_COUNTS_SQL} FROM findings GROUP BY target) "
          f"SELECT t.target, coalesce(critical, 0) AS critical, coalesce(high, 0) AS high, coalesce(medium, 0) AS medium, coalesce(low, 0) AS low, "
          f"coalesce(total, 0) AS total, {_POINTS} AS points, {_GRADE} AS score FROM "
          "(SELECT target FROM (SELECT DISTINCT target FROM code_files) UNION SELECT 'repo' || n_nationkey FROM nation) t LEFT JOIN c USING (target)")
def _(spark, sf_dir):
    nations = table(spark, sf_dir, "nation").select(F.concat(F.lit("repo"), F.col("n_nationkey").cast("string")).alias("target"))
    targets = files(spark, sf_dir).select("target").unionByName(nations).distinct()
    return report.risk_scores(targets, numbered_findings(spark, sf_dir))


@register("letter_grade", F_SQL + f", c AS (SELECT target, path, {_COUNTS_SQL} FROM findings GROUP BY ALL) SELECT target, path, {_POINTS} AS points, {_GRADE} AS score FROM c")
def _(spark, sf_dir):
    """Grade per file."""
    counts = report.severity_counts(numbered_findings(spark, sf_dir), "target", "path")
    return report.with_grade(counts).select("target", "path", "points", "score")


@register("owasp_coverage", F_SQL + ", u AS (SELECT target, unnest(owasp_ids) AS owasp_id FROM findings) SELECT target, owasp_id, count(*) AS n_findings FROM u GROUP BY ALL")
def _(spark, sf_dir):
    return report.owasp_counts(numbered_findings(spark, sf_dir), "target")


@register("total_checks", f"WITH {CODE_FILES_SQL} SELECT target, CAST(count(*) * 19 AS BIGINT) AS total_checks FROM code_files WHERE {COLLECTED_SQL} GROUP BY 1")
def _(spark, sf_dir):
    picked = code_files(spark, sf_dir).select("target", "path").where(collected(F.col("path"), F.col("target")))
    return report.total_checks(picked, len(SHIPPED_RULES))


@register("ci_gate", F_SQL + f", w AS (SELECT target, max({_RANK}) AS worst, bool_or(severity IN ('critical', 'high')) AS sev FROM findings GROUP BY 1) "
          "SELECT target, threshold, CAST(CASE WHEN worst >= least_rank THEN 2 WHEN sev THEN 1 ELSE 0 END AS BIGINT) AS exit_code "
          "FROM (SELECT DISTINCT target FROM code_files) LEFT JOIN w USING (target), (VALUES ('low', 1), ('high', 3), ('critical', 4), ('bogus', 4)) g(threshold, least_rank)")
def _(spark, sf_dir):
    targets = files(spark, sf_dir).select("target").distinct()
    found = numbered_findings(spark, sf_dir)
    return report.ci_gate(targets, found, "low", "high", "critical", "bogus")


@register("severity_threshold_filter", F_SQL + f"SELECT target, finding_index, severity FROM findings WHERE {_RANK} >= 3")
def _(spark, sf_dir):
    return at_or_above(numbered_findings(spark, sf_dir), "high").select("target", "finding_index", "severity")


@register("severity_rank", F_SQL + f"SELECT severity, CAST({_RANK} AS BIGINT) AS gate_rank, CAST(4 - {_RANK} AS BIGINT) AS display_rank, count(*) AS n FROM findings GROUP BY ALL")
def _(spark, sf_dir):
    sev = F.col("severity")
    return numbered_findings(spark, sf_dir).groupBy(
        "severity", grading.gate_rank(sev).alias("gate_rank"), grading.display_rank(sev).alias("display_rank")
    ).agg(F.count("*").alias("n"))


@register("auditable_filter", F_SQL + "SELECT target, finding_index, rule_id FROM findings WHERE severity IN ('critical', 'high')")
def _(spark, sf_dir):
    return severe(numbered_findings(spark, sf_dir)).select("target", "finding_index", "rule_id")


# eligibility per file, so that both outcomes occur
@register("chain_eligibility", F_SQL + "SELECT path, finding_index FROM findings WHERE severity IN ('critical', 'high') AND path IN "
          "(SELECT path FROM findings WHERE severity IN ('critical', 'high') GROUP BY path HAVING count(*) >= 2)")
def _(spark, sf_dir):
    per_file = numbered_findings(spark, sf_dir).withColumn("target", F.col("path"))
    return chain_eligible(per_file).select("path", "finding_index")


@register("mitigation_rollup", F_SQL + "SELECT rule_id, count(*) AS n_findings, count(DISTINCT path) AS n_files FROM findings WHERE severity IN ('critical', 'high') GROUP BY 1")
def _(spark, sf_dir):
    return report.mitigation_rollup(numbered_findings(spark, sf_dir))


@register("top_rules", F_SQL + ", m AS (SELECT target, rule_id, count(*) AS n_findings FROM findings WHERE severity IN ('critical', 'high') GROUP BY ALL) "
          "SELECT target, rule_id, n_findings, row_number() OVER (PARTITION BY target ORDER BY n_findings DESC, rule_id) AS place FROM m "
          "QUALIFY row_number() OVER (PARTITION BY target ORDER BY n_findings DESC, rule_id) <= 3")
def _(spark, sf_dir):
    """First three fixes per target; the window sees one row per rule."""
    per_rule = severe(numbered_findings(spark, sf_dir)).groupBy("target", "rule_id").agg(F.count("*").alias("n_findings"))
    order = Window.partitionBy("target").orderBy(F.col("n_findings").desc(), "rule_id")
    return per_rule.withColumn("place", F.row_number().over(order)).where("place <= 3")


@register("findings_by_severity", F_SQL + f"SELECT target, finding_index, rule_id, CAST(4 - {_RANK} AS BIGINT) AS display_rank FROM findings ORDER BY 4, 1, 2")
def _(spark, sf_dir):
    return report.by_severity(numbered_findings(spark, sf_dir)).select("target", "finding_index", "rule_id", "display_rank")


@register("group_by_file", F_SQL + "SELECT target, path, count(*) AS n_findings, min(finding_index) AS first_index, max(finding_index) AS last_index, "
          "CAST(sum(finding_index * (file_pos + 1)) AS BIGINT) AS placed FROM findings GROUP BY ALL")
def _(spark, sf_dir):
    """The findings of every file with their order; sums over places, so that no file has to be one list."""
    return numbered_findings(spark, sf_dir).groupBy("target", "path").agg(
        F.count("*").alias("n_findings"), F.min("finding_index").alias("first_index"), F.max("finding_index").alias("last_index"),
        F.sum(F.col("finding_index") * (F.col("file_pos") + 1)).alias("placed"))


# --- reports ----------------------------------------------------------------------
_HEADER_SQL = (
    f", c AS (SELECT target, {_COUNTS_SQL} FROM findings GROUP BY target), "
    f"k AS (SELECT target, CAST(count(*) * 22 AS BIGINT) AS total_checks FROM code_files WHERE {COLLECTED_SQL} GROUP BY 1) "
)


def _documents(spark, sf_dir, page_size):
    src = files(spark, sf_dir)
    found = numbered_findings(spark, sf_dir)
    checks = report.total_checks(src.where(collected(F.col("path"), F.col("target"))), len(ALL_RULES))
    header = report.report_header(src.select("target").distinct(), found, checks)
    return report.report_documents(header, found, page_size=page_size)


@register("report_json_export", F_SQL + _HEADER_SQL + ", p AS (SELECT target, CAST(finding_index // 200 AS BIGINT) AS page, count(*) AS n, "
          "string_agg(rule_id || ':' || line_number, ',' ORDER BY finding_index) AS found FROM findings GROUP BY ALL) "
          f"SELECT target, page, (total + 199) // 200 AS n_pages, {_GRADE} AS score, total_checks, critical, total, n, found FROM p JOIN c USING (target) JOIN k USING (target)")
def _(spark, sf_dir):
    """Documents as JSON text, read back and flattened."""
    docs = _documents(spark, sf_dir, 200)
    as_text = docs.select(F.to_json(F.struct(*docs.columns)).alias("doc"))
    back = as_text.select(F.from_json("doc", docs.schema).alias("d")).select("d.*")
    return back.select(
        "target", "page", "n_pages", "score", "total_checks", F.col("summary.critical").alias("critical"), F.col("summary.total").alias("total"),
        F.size("findings").alias("n"),
        F.array_join(F.transform("findings", lambda f: F.concat_ws(":", f["rule_id"], f["line_number"])), ",").alias("found"))


# --- text functions -------------------------------------------------------------------
@register("split_lines", f"WITH {TEXT_ROWS_SQL} SELECT source, path, unnest(string_split(content, chr(10))) AS line, "
          "CAST(generate_subscripts(string_split(content, chr(10)), 1) AS BIGINT) AS line_number FROM text_rows")
def _(spark, sf_dir):
    rows = text_rows(spark, sf_dir).select("source", "path", F.posexplode(text.split_lines(F.col("content"))).alias("pos", "line"))
    return rows.select("source", "path", "line", (F.col("pos") + 1).alias("line_number"))


@register("offset_to_line", "SELECT doc_id, CAST(length(left(text, n_chars // 2)) - length(replace(left(text, n_chars // 2), chr(10), '')) + 1 AS BIGINT) AS line_at_half FROM documents")
def _(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents"))
    return docs.select("doc_id", text.line_of_offset(F.col("text"), F.expr("cast(n_chars div 2 as int)")).alias("line_at_half"))


@register("truncate_text", F_SQL + "SELECT target, finding_index, left(description, 120) AS short_description, left(title, 60) AS short_title, left(code_snippet, 150) AS short_snippet FROM findings")
def _(spark, sf_dir):
    return numbered_findings(spark, sf_dir).select(
        "target", "finding_index", F.substring("description", 1, 120).alias("short_description"),
        F.substring("title", 1, 60).alias("short_title"), F.substring("code_snippet", 1, 150).alias("short_snippet"))


@register("head_tail_truncate", f"WITH {TEXT_ROWS_SQL} SELECT source, path, md5(CASE WHEN length(content) > 32000 THEN left(content, 16000) || chr(10) || '... [truncated] ...' || chr(10) || right(content, 16000) "
          "ELSE content END) AS cut_md5, length(content) > 32000 AS was_cut FROM text_rows")
def _(spark, sf_dir):
    rows = text_rows(spark, sf_dir)
    return rows.select("source", "path", F.md5(text.head_and_tail(F.col("content")).cast("binary")).alias("cut_md5"),
                       (F.length("content") > 32000).alias("was_cut"))


@register("posix_path_parts", f"WITH {CODE_FILES_SQL}, w AS (SELECT replace(path, '/', '\\') AS win, path FROM code_files) "
          f"SELECT win, replace(win, '\\', '/') AS path, {NAME_SQL} AS name, regexp_replace(path, '/[^/]*$', '') AS parent, "
          "regexp_extract(path, '[^./](\\.[^./]+)$', 1) AS ext FROM w")
def _(spark, sf_dir):
    w = files(spark, sf_dir).select(F.replace("path", F.lit("/"), F.lit("\\")).alias("win")).withColumn("path", paths.posix(F.col("win")))
    p = F.col("path")
    return w.select("win", "path", paths.file_name(p).alias("name"), paths.parent(p).alias("parent"), paths.extension(p).alias("ext"))


@register("round_duration", "SELECT o_orderkey, round(o_totalprice / 1000, 1) AS tenths, round(o_totalprice / 1000, 0) AS whole FROM orders")
def _(spark, sf_dir):
    d = F.col("o_totalprice") / 1000
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(d, 1).alias("tenths"), F.round(d, 0).alias("whole"))


@register("render_finding_text", F_SQL + """SELECT target, finding_index,
  '--- Finding ' || finding_index || ' ---' || chr(10) || 'Rule: ' || rule_id || ' | Severity: ' || severity || chr(10) || 'File: ' || path || ':' || line_number || chr(10)
    || 'Title: ' || title || chr(10) || 'Description: ' || description || chr(10) || 'Code context:' || chr(10) || code_snippet || chr(10) AS triage_text,
  '--- Finding ' || rule_id || ' ---' || chr(10) || 'Severity: ' || upper(severity) || chr(10) || 'File: ' || path || ':' || line_number || chr(10)
    || 'Title: ' || title || chr(10) || 'Description: ' || description || chr(10) || 'Attack demo (if available): Not yet analyzed' || chr(10) AS chain_text
FROM findings""")
def _(spark, sf_dir):
    f = numbered_findings(spark, sf_dir)
    c = F.col
    return f.select(
        "target", "finding_index",
        text.triage_block(c("finding_index"), c("rule_id"), c("severity"), c("path"), c("line_number"), c("title"), c("description"), c("code_snippet")).alias("triage_text"),
        text.chain_block(c("rule_id"), c("severity"), c("path"), c("line_number"), c("title"), c("description"), c("attack_demo")).alias("chain_text"))


_DOCS_SQL = "docs AS (SELECT coalesce(source, '') AS target, CAST(doc_id AS VARCHAR) AS path, text AS content FROM documents)"


@register("secrets_by_source", f"WITH {_DOCS_SQL}, {source_ctes('docs')}, {hits_cte((rule('SEC-003'),), match_globs=False)}, "
          "findings AS (SELECT target, 'high' AS severity FROM hits), "
          f"c AS (SELECT target, {_COUNTS_SQL} FROM findings GROUP BY target), t AS (SELECT target, count(*) AS n_documents FROM docs GROUP BY 1) "
          "SELECT t.target, n_documents, coalesce(critical, 0) AS critical, coalesce(high, 0) AS high, coalesce(medium, 0) AS medium, coalesce(low, 0) AS low, "
          f"coalesce(total, 0) AS total, {_POINTS} AS points, {_GRADE} AS score FROM t LEFT JOIN c USING (target)")
def secrets_by_source(spark, sf_dir):
    """Documents as a corpus: secret rule, severity counts and grade per source."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    corpus = docs.select(F.coalesce("source", F.lit("")).alias("target"), F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"))
    found = scan(corpus, (rule("SEC-003"),), match_globs=False, snippets=False)
    targets = corpus.groupBy("target").agg(F.count("*").alias("n_documents"))
    return report.risk_scores(targets, found)
