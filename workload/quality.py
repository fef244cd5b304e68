"""Quality-gate queries: truth, runs, layers, rule metadata, and user-made rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardspark.operators import evaluate
from wardspark.operators.detect import scan
from wardspark.operators.filters import severe
from wardspark.rules import ALL_RULES, rule
from wardspark.rules.spec import Pattern, RuleSpec, rules_table, usable_rules
from wardspark.sources.tables import as_corpus

from .corpora import TEMPLATES, code_files, spread, table
from .detection import flat
from .duck import hits_cte, source_ctes
from .findings import F_SQL, numbered_findings
from .triage import _BATCHED_SQL, chain_replies, judged
from wardspark.operators.triage import read_chains

QUERIES, ORACLE = {}, {}
KEY = ["target", "finding_index"]


def register(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = lambda spark, sf_dir: flat(fn(spark, sf_dir))
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return keep


# template number, rule, severity, vulnerable
_LABELS = (
    (0, "PI-001", "high", True), (7, "TA-001", "high", True), (10, "TA-003", "high", False), (15, "FW-001", "high", True),
    (17, "FW-002", "critical", True), (20, "SC-001", "critical", True), (24, "SEC-001", "critical", True), (25, "TA-001", "high", False),
)


def truth(spark, sf_dir) -> DataFrame:
    labels = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(r).alias("rule_id"), F.lit(s).alias("severity"), F.lit(v).alias("is_vulnerable")) for t, r, s, v in _LABELS])
    rows = code_files(spark, sf_dir).select("target", "path", (F.col("event_id") % len(TEMPLATES)).alias("n"))
    return rows.select("target", "path", F.explode(F.filter(labels, lambda x: x["t"] == F.col("n"))).alias("x")).select("target", "path", "x.rule_id", "x.severity", "x.is_vulnerable")


_TRUTH_SQL = (
    ", truth AS (SELECT path, l.rule_id, l.severity, l.v AS is_vulnerable FROM code_files JOIN (VALUES "
    + ", ".join(f"({t}, '{r}', '{s}', {str(v).lower()})" for t, r, s, v in _LABELS)
    + f") l(t, rule_id, severity, v) ON event_id % {len(TEMPLATES)} = l.t)"
)


def _matched_sql(findings: str, name: str = "matched") -> str:
    return (
        f", {name} AS (SELECT coalesce(t.path, f.path) AS path, coalesce(t.rule_id, f.rule_id) AS rule_id, t.severity = 'critical' AS is_critical, "
        "CASE WHEN t.path IS NULL THEN 'unlabelled' WHEN is_vulnerable AND f.path IS NOT NULL THEN 'TP' WHEN is_vulnerable THEN 'FN' WHEN f.path IS NOT NULL THEN 'FP' ELSE 'TN' END AS outcome "
        f"FROM truth t FULL JOIN (SELECT DISTINCT path, rule_id FROM {findings}) f ON t.path = f.path AND t.rule_id = f.rule_id) "
    )


_METRICS_SQL = (
    "SELECT *, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, 2 * tp / (2 * tp + fp + fn) AS f1, critical_tp / nullif(critical_tp + critical_fn, 0) AS critical_recall, "
    "tp / (tp + fn) >= 0.9 AND tp / (tp + fp) >= 0.7 AND 2 * tp / (2 * tp + fp + fn) >= 0.78 AND coalesce(critical_tp / nullif(critical_tp + critical_fn, 0), 1) >= 1 AS passed FROM ("
    "SELECT count(*) FILTER (WHERE outcome = 'TP') AS tp, count(*) FILTER (WHERE outcome = 'FP') AS fp, count(*) FILTER (WHERE outcome = 'FN') AS fn, count(*) FILTER (WHERE outcome = 'TN') AS tn, "
    "count(*) FILTER (WHERE outcome = 'TP' AND is_critical) AS critical_tp, count(*) FILTER (WHERE outcome = 'FN' AND is_critical) AS critical_fn FROM matched)"
)


@register("findings_truth", F_SQL + _TRUTH_SQL + _matched_sql("findings") + "SELECT path, rule_id, outcome FROM matched")
def _(spark, sf_dir):
    return evaluate.match_truth(numbered_findings(spark, sf_dir), truth(spark, sf_dir)).select("path", "rule_id", "outcome")


@register("detection_metrics", F_SQL + _TRUTH_SQL + _matched_sql("findings") + _METRICS_SQL)
def _(spark, sf_dir):
    return evaluate.detection_metrics(evaluate.match_truth(numbered_findings(spark, sf_dir), truth(spark, sf_dir)))


_DOCS = "docs AS (SELECT 'documents' AS target, CAST(doc_id AS VARCHAR) AS path, text AS content FROM documents)"


@register("detection_metrics_documents", f"WITH {_DOCS}, {source_ctes('docs')}, {hits_cte((rule('SEC-003'),), match_globs=False)}, "
          "findings AS (SELECT path, 'SEC-003' AS rule_id FROM hits), truth AS (SELECT CAST(doc_id AS VARCHAR) AS path, 'SEC-003' AS rule_id, 'high' AS severity, toxic = 1 AS is_vulnerable FROM labels)"
          + _matched_sql("findings") + "SELECT outcome, count(*) AS n FROM matched GROUP BY 1")
def _(spark, sf_dir):
    """The supplied labels as truth for the secret rule over documents."""
    docs = as_corpus(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), F.col("doc_id"), F.col("text"), "documents")
    found = scan(docs, (rule("SEC-003"),), match_globs=False, snippets=False)
    labels = table(spark, sf_dir, "labels").select(
        F.lit("documents").alias("target"), F.col("doc_id").cast("string").alias("path"), F.lit("SEC-003").alias("rule_id"), F.lit("high").alias("severity"), (F.col("toxic") == 1).alias("is_vulnerable"))
    return evaluate.match_truth(found, labels).groupBy("outcome").agg(F.count("*").alias("n"))


@register("missing_detections", F_SQL + _TRUTH_SQL + "SELECT path, rule_id, severity FROM truth t WHERE is_vulnerable AND NOT EXISTS (SELECT 1 FROM findings f WHERE f.path = t.path AND f.rule_id = t.rule_id)")
def _(spark, sf_dir):
    return evaluate.missing_detections(numbered_findings(spark, sf_dir), truth(spark, sf_dir)).select("path", "rule_id", "severity")


# --- runs ---------------------------------------------------------------------------
def runs(spark, sf_dir) -> DataFrame:
    f = numbered_findings(spark, sf_dir).select(*KEY, "severity")
    r = f.withColumn("run_id", F.explode(F.array(*[F.lit(i) for i in range(1, 6)])))
    r = r.where((F.col("run_id") == 1) | (F.col("finding_index") * F.col("run_id") % 97 != 0))
    return r.withColumn("verdict", F.when(F.col("finding_index") % 50 == F.col("run_id"), F.lit("NOISE")).otherwise(F.lit("REAL")))


_RUNS_SQL = (
    F_SQL + ", runs AS (SELECT target, finding_index, severity, run_id, CASE WHEN finding_index % 50 = run_id THEN 'NOISE' ELSE 'REAL' END AS verdict "
    "FROM findings, range(1, 6) r(run_id) WHERE run_id = 1 OR finding_index * run_id % 97 <> 0) "
)


@register("run_jaccard", _RUNS_SQL + ", s AS (SELECT DISTINCT target, finding_index, run_id FROM runs WHERE severity IN ('critical', 'high')), "
          "p AS (SELECT a.run_id AS run_a, b.run_id AS run_b, (SELECT count(*) FROM s x JOIN s y USING (target, finding_index) WHERE x.run_id = a.run_id AND y.run_id = b.run_id) AS n_both, "
          "(SELECT count(DISTINCT (target, finding_index)) FROM s x WHERE x.run_id IN (a.run_id, b.run_id)) AS n_either FROM range(1, 6) a(run_id), range(1, 6) b(run_id) WHERE a.run_id < b.run_id) "
          "SELECT *, n_both / n_either AS jaccard, n_both / n_either >= 0.85 AS passed FROM p")
def _(spark, sf_dir):
    return evaluate.run_jaccard(runs(spark, sf_dir), [1, 2, 3, 4, 5], KEY)


@register("run_stability", _RUNS_SQL + ", c AS (SELECT run_id, count(*) AS n FROM runs GROUP BY 1) SELECT count(*) AS n_runs, min(n) AS min_findings, max(n) AS max_findings, "
          "(max(n) - min(n)) / avg(n) AS count_spread, (max(n) - min(n)) / avg(n) <= 0.1 AS passed FROM c")
def _(spark, sf_dir):
    return evaluate.run_counts(runs(spark, sf_dir))


@register("verdict_consistency", _RUNS_SQL + ", c AS (SELECT target, finding_index, count(DISTINCT verdict) = 1 AS same FROM runs GROUP BY ALL) "
          "SELECT count(*) AS n_findings, count(*) FILTER (WHERE same) AS n_same, count(*) FILTER (WHERE same) / count(*) AS agreement, count(*) FILTER (WHERE same) / count(*) >= 0.9 AS passed FROM c")
def _(spark, sf_dir):
    return evaluate.verdict_agreement(runs(spark, sf_dir), KEY)


@register("layer_effect", _BATCHED_SQL + _TRUTH_SQL + _matched_sql("findings", "m1") + _matched_sql("(SELECT * FROM verdicts WHERE kept)", "m2")
          + ", s AS (SELECT target FROM findings WHERE severity IN ('critical', 'high') GROUP BY 1 HAVING count(*) >= 2), "
          "x AS (SELECT (SELECT count(*) FROM m1 WHERE outcome = 'FP') AS fp_l1, (SELECT count(*) FROM m2 WHERE outcome = 'FP') AS fp_l2, "
          "(SELECT count(*) FROM s) AS chains_due, (SELECT count(*) FROM s WHERE CAST(substr(target, 5) AS INT) % 4 < 2) AS chains_present) "
          "SELECT *, (fp_l1 - fp_l2) / nullif(fp_l1, 0) AS noise_cut, coalesce((fp_l1 - fp_l2) / nullif(fp_l1, 0) >= 0.3, true) AND chains_due = chains_present AS passed FROM x")
def _(spark, sf_dir):
    """Both layers from one match; truth and judged findings are read once for it."""
    j = judged(spark, sf_dir)
    per_target = severe(j).groupBy("target").agg(F.count("*").alias("n_severe"))
    chains = read_chains(chain_replies(numbered_findings(spark, sf_dir))).where("chain is not null")
    return evaluate.layer_effect(evaluate.match_layers(j, truth(spark, sf_dir)), per_target, chains)


# --- rules and fields ------------------------------------------------------------------
@register("rule_audit", F_SQL + ", c AS (SELECT rule_id, count(*) AS n FROM findings GROUP BY 1) SELECT rule_id, CASE WHEN rule_id = 'x' THEN 'rule_id,title' ELSE '' END AS problems, coalesce(n, 0) AS n_findings "
          "FROM (SELECT rule_id FROM rules UNION ALL SELECT 'x') LEFT JOIN c USING (rule_id)")
def _(spark, sf_dir):
    """Metadata problems next to the findings of each rule; one faulty rule is added to be caught."""
    faulty = RuleSpec("x", "x", 99, "low", ("LLM01",), ("*.py",), "", "A description that is long enough to pass.", "fix")
    audited = evaluate.rule_audit(rules_table(spark, ALL_RULES + (faulty,)))
    counts = numbered_findings(spark, sf_dir).groupBy("rule_id").agg(F.count("*").alias("n"))
    return audited.join(counts, "rule_id", "left").select(
        "rule_id", F.array_join("problems", ",").alias("problems"), F.coalesce("n", F.lit(0)).alias("n_findings"))


@register("finding_completeness", F_SQL + "SELECT count(*) AS n_findings, " + ", ".join(
    f"{'count(*)' if n == 'attack_demo' else '0::BIGINT'} AS lacks_{n}" for n in ("rule_id", "title", "severity", "file_path", "line_number", "description"))
    + ", count(*) FILTER (WHERE code_snippet = '') AS lacks_code_snippet, count(*) AS lacks_attack_demo, count(*) FILTER (WHERE fix = '') AS lacks_fix_suggestion, "
    "count(*) FILTER (WHERE len(owasp_ids) = 0) AS lacks_owasp_ids FROM findings")
def _(spark, sf_dir):
    return evaluate.completeness(numbered_findings(spark, sf_dir))


@register("json_round_trip", F_SQL + "SELECT count(*) AS n_findings, 0::BIGINT AS n_changed FROM findings")
def _(spark, sf_dir):
    f = numbered_findings(spark, sf_dir)
    changed = evaluate.json_round_trip(f).agg(F.count("*").alias("n_changed"))
    return f.agg(F.count("*").alias("n_findings")).withColumn("k", F.lit(1)).join(changed.withColumn("k", F.lit(1)), "k").drop("k")


# --- user-made rules ---------------------------------------------------------------------
ADDRESS_RULE = RuleSpec(
    "NET-001", "dotted_address", 50, "low", ("LLM02",), ("*",), "Dotted address in text", "A literal network address is written into the text.",
    "Use a host name.", (Pattern(r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", "dotted address"), Pattern(r"token", "the word token", anchors=(("token",),))))
BROKEN_RULE = RuleSpec("BAD-001", "broken", 51, "low", ("LLM02",), ("*",), "t", "d", "f", (Pattern("(open", "never compiles"),))
_OWN_SQL = (
    f"WITH {_DOCS}, {source_ctes('docs')}, c AS (SELECT path, line_number, unnest([CASE WHEN regexp_matches(line, '[0-9]{{1,3}}\\.[0-9]{{1,3}}\\.[0-9]{{1,3}}\\.[0-9]{{1,3}}') THEN 0 END, "
    "CASE WHEN regexp_matches(line, '(?i)token') THEN 1 END]) AS pattern_ord FROM lines) "
    "SELECT path, CAST(line_number AS BIGINT) AS line_number, 'NET-001' AS rule_id, CAST(pattern_ord AS BIGINT) AS pattern_ord FROM c WHERE pattern_ord IS NOT NULL"
)


def _own_rule(spark, sf_dir, rules):
    docs = as_corpus(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), F.col("doc_id"), F.col("text"), "documents")
    good, _left_out = usable_rules(spark, rules)
    return scan(docs, good, match_globs=False, snippets=False).select("path", "line_number", "rule_id", "pattern_ord")


@register("custom_rule", _OWN_SQL)
def _(spark, sf_dir):
    return _own_rule(spark, sf_dir, (ADDRESS_RULE,))


@register("fault_isolation", _OWN_SQL)
def _(spark, sf_dir):
    """A rule that does not compile is left out and the others go on."""
    return _own_rule(spark, sf_dir, (ADDRESS_RULE, BROKEN_RULE))
