"""Triage queries: batches, replies, verdicts, audits, chains.

Replies are rendered from the findings themselves, in the shapes a model
service gives: clean, inside prose, with a stray comma, too short, too long,
unreadable, failed, malformed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardspark.functions.replies import repaired_json, verdict_batch
from wardspark.operators import report, triage
from wardspark.operators.detect import describe, scan_files
from wardspark.operators.filters import chain_eligible, severe
from wardspark.operators.numbering import number_findings
from wardspark.plans.scan import run_scan
from wardspark.rules import ALL_RULES, LINE

from .corpora import SESSION_FILES_SQL, session_files
from .detection import flat
from .duck import hits_cte, numbered_ctes
from .findings import _GRADE, F_SQL, files, numbered_findings

QUERIES, ORACLE = {}, {}
N_SHAPES = 9


def register(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = lambda spark, sf_dir: flat(fn(spark, sf_dir))
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return keep


def batched(spark, sf_dir) -> DataFrame:
    return triage.assign_batches(numbered_findings(spark, sf_dir))


def replies(found: DataFrame) -> DataFrame:
    """One reply per batch, its shape chosen by the first finding of the batch."""
    real = F.when(F.col("finding_index") % 3 != 0, F.lit("REAL")).otherwise(F.lit("NOISE"))
    item = F.concat(F.lit('{"index": '), F.col("batch_pos").cast("string"), F.lit(', "verdict": "'), real, F.lit('", "reason": "r'),
                    F.col("finding_index").cast("string"), F.lit('"}'))
    b = found.select(*triage.BATCH, "finding_index", F.struct("batch_pos", item.alias("item")).alias("i")).groupBy(*triage.BATCH).agg(
        F.transform(F.sort_array(F.collect_list("i")), lambda x: x["item"]).alias("items"), (F.min("finding_index") % N_SHAPES).alias("shape"))
    joined = F.array_join("items", ", ")
    clean = F.concat(F.lit('{"results": ['), joined, F.lit("]}"))
    short = F.concat(F.lit('{"results": ['), F.array_join(F.slice("items", 1, F.size("items") - 1), ", "), F.lit("]}"))
    long = F.concat(F.lit('{"results": ['), joined, F.lit(', {"index": 0, "verdict": "real"}]}'))
    shapes = [
        clean,
        F.concat(F.lit("Here you are:\n"), clean, F.lit("\nDone.")),
        F.concat(F.lit('{"results": [ // first\n'), joined, F.lit("],\n}")),
        short, long, F.lit("I cannot say {anything}"), F.lit(None).cast("string"),
        F.concat(F.lit('{"results": [{"index": 0, "verdict": null}, '), joined, F.lit("]}")),
        F.concat(F.lit('{"results": ['), F.array_join(F.transform("items", lambda x: F.lit('{"reason": "none"}')), ", "), F.lit("]}")),
    ]
    reply = F.lit(None).cast("string")
    for k, s in enumerate(shapes):
        reply = F.when(F.col("shape") == k, s).otherwise(reply)
    return b.select(*triage.BATCH, reply.alias("reply"), F.when(F.col("shape") == 6, F.lit("timeout")).alias("error"))


_BATCHED_SQL = (
    F_SQL + ", batched AS (SELECT *, CAST(file_pos // 12 AS BIGINT) AS batch_no, CAST(file_pos % 12 AS BIGINT) AS batch_pos, "
    "min(finding_index) OVER (PARTITION BY target, path, file_pos // 12) % 9 AS shape, count(*) OVER (PARTITION BY target, path, file_pos // 12) AS n, "
    "CASE WHEN finding_index % 3 <> 0 THEN 'REAL' ELSE 'NOISE' END AS v FROM findings), "
    "judged AS (SELECT *, CASE WHEN shape IN (0, 1, 2, 4) THEN v WHEN shape = 3 AND batch_pos < n - 1 THEN v WHEN shape = 8 THEN 'REAL' END AS verdict FROM batched), "
    "named AS (SELECT DISTINCT target FROM batched WHERE shape = 4), "
    "verdicts AS (SELECT j.*, shape IN (6, 7) OR coalesce(verdict = 'REAL', false) OR (finding_index = 0 AND target IN (SELECT target FROM named)) AS kept FROM judged j) "
)


@register("batch_assign", _BATCHED_SQL + "SELECT target, finding_index, batch_no, batch_pos FROM batched")
def _(spark, sf_dir):
    return batched(spark, sf_dir).select("target", "finding_index", "batch_no", "batch_pos")


@register("batch_texts", _BATCHED_SQL + """SELECT target, path, batch_no, count(*) AS n_findings, md5(string_agg(
  '--- Finding ' || finding_index || ' ---' || chr(10) || 'Rule: ' || rule_id || ' | Severity: ' || severity || chr(10) || 'File: ' || path || ':' || line_number || chr(10)
  || 'Title: ' || title || chr(10) || 'Description: ' || description || chr(10) || 'Code context:' || chr(10) || code_snippet || chr(10), chr(10) ORDER BY batch_pos)) AS text_md5
FROM batched GROUP BY ALL""")
def _(spark, sf_dir):
    t = triage.batch_texts(batched(spark, sf_dir))
    return t.select("target", "path", "batch_no", "n_findings", F.md5(F.col("batch_text").cast("binary")).alias("text_md5"))


@register("json_from_reply", _BATCHED_SQL + "SELECT DISTINCT target, path, batch_no, shape NOT IN (5, 6) AS readable, shape = 7 AS failed, "
          "CAST(CASE shape WHEN 5 THEN 0 WHEN 6 THEN NULL WHEN 3 THEN n - 1 WHEN 4 THEN n + 1 WHEN 7 THEN n + 1 ELSE n END AS BIGINT) AS n_items FROM batched")
def _(spark, sf_dir):
    r = replies(batched(spark, sf_dir))
    v = verdict_batch(F.col("reply"))
    return r.select(*triage.BATCH, repaired_json(F.col("reply"), '"results"', False).isNotNull().alias("readable"),
                    F.coalesce(v["failed"], F.lit(False)).alias("failed"), F.when(F.col("reply").isNotNull(), F.size(v["items"])).alias("n_items"))


@register("verdict_normalise", _BATCHED_SQL + "SELECT target, path, batch_no, batch_pos AS pos, batch_pos AS index, verdict, CASE WHEN shape = 8 THEN 'none' ELSE 'r' || finding_index END AS reason "
          "FROM judged WHERE verdict IS NOT NULL UNION ALL SELECT DISTINCT target, path, batch_no, n, 0, 'REAL', '' FROM judged WHERE shape = 4")
def _(spark, sf_dir):
    read = replies(batched(spark, sf_dir)).select(*triage.BATCH, verdict_batch(F.col("reply")).alias("v")).where("not v.failed")
    return read.select(*triage.BATCH, F.explode("v.items").alias("i")).select(*triage.BATCH, "i.*")


def judged(spark, sf_dir) -> DataFrame:
    b = batched(spark, sf_dir)
    return triage.join_verdicts(b, replies(b))


@register("findings_verdicts", _BATCHED_SQL + "SELECT target, finding_index, verdict, kept FROM verdicts")
def _(spark, sf_dir):
    return judged(spark, sf_dir).select("target", "finding_index", "verdict", "kept")


@register("kept_findings", _BATCHED_SQL + "SELECT target, finding_index, rule_id FROM verdicts WHERE kept")
def _(spark, sf_dir):
    return triage.kept(judged(spark, sf_dir)).select("target", "finding_index", "rule_id")


@register("dropped_findings", _BATCHED_SQL + "SELECT target, finding_index, rule_id FROM verdicts WHERE NOT kept")
def _(spark, sf_dir):
    return triage.dropped(judged(spark, sf_dir)).select("target", "finding_index", "rule_id")


def stub_scorer(texts: list[str]) -> list[str]:
    """Deterministic stand-in for a model: even finding numbers are real."""
    import json
    import re

    out = []
    for t in texts:
        numbers = [int(n) for n in re.findall(r"^--- Finding (\d+) ---$", t, re.M)]
        out.append(json.dumps({"results": [{"index": n, "verdict": "REAL" if n % 2 == 0 else "NOISE"} for n in numbers]}))
    return out


@register("batch_scorer", F_SQL + "SELECT target, finding_index, CASE WHEN finding_index % 2 = 0 THEN 'REAL' ELSE 'NOISE' END AS verdict, finding_index % 2 = 0 AS kept FROM findings")
def _(spark, sf_dir):
    """A user-supplied scorer over batch texts, then the same join."""
    b = batched(spark, sf_dir)
    scored = triage.score_batches(triage.batch_texts(b), stub_scorer)
    return triage.join_verdicts(b, scored).select("target", "finding_index", "verdict", "kept")


# --- files with many findings: batches behind the first, verdicts across batches -----
_SESSION_RULES = tuple(r for r in ALL_RULES if r.kind == "regex")


def session_findings(spark, sf_dir) -> DataFrame:
    """Line findings of a user's week as one file: some dozens each."""
    lean = scan_files(session_files(spark, sf_dir), _SESSION_RULES, modes=(LINE,))
    return triage.assign_batches(describe(number_findings(lean), _SESSION_RULES))


def session_replies(found: DataFrame) -> DataFrame:
    """Replies by the first finding of the batch: clean, with an item more that names the finding before the batch, failed, too short."""
    verdict = F.when(F.col("finding_index") % 3 != 0, F.lit("REAL")).otherwise(F.lit("NOISE"))
    item = F.concat(F.lit('{"index": '), F.col("batch_pos").cast("string"), F.lit(', "verdict": "'), verdict, F.lit('"}'))
    b = found.select(*triage.BATCH, "finding_index", F.struct("batch_pos", item.alias("item")).alias("i")).groupBy(*triage.BATCH).agg(
        F.transform(F.sort_array(F.collect_list("i")), lambda x: x["item"]).alias("items"), F.min("finding_index").alias("first"))
    more = F.concat(F.lit('{"index": '), (F.col("first") - 1).cast("string"), F.lit(', "verdict": "REAL"}'))
    shape = F.col("first") % 4
    items = F.when(shape == 1, F.array_append("items", more)).when(shape == 3, F.slice("items", 1, F.size("items") - 1)).otherwise(F.col("items"))
    reply = F.concat(F.lit('{"results": ['), F.array_join(items, ", "), F.lit("]}"))
    return b.select(*triage.BATCH, F.when(shape != 2, reply).alias("reply"), F.when(shape == 2, F.lit("timeout")).alias("error"))


_SESSION_SQL = (
    "WITH " + numbered_ctes(SESSION_FILES_SQL, "session_files", "true", hits_cte(_SESSION_RULES, whole_files=False))
    + ", batched AS (SELECT *, CAST(file_pos // 12 AS BIGINT) AS batch_no, CAST(file_pos % 12 AS BIGINT) AS batch_pos, "
    "min(finding_index) OVER (PARTITION BY target, path, file_pos // 12) AS first, count(*) OVER (PARTITION BY target, path, file_pos // 12) AS n, "
    "CASE WHEN finding_index % 3 <> 0 THEN 'REAL' ELSE 'NOISE' END AS v FROM findings), "
    "named AS (SELECT DISTINCT target, first - 1 AS finding_index, true AS named FROM batched WHERE first % 4 = 1), "
    "said AS (SELECT *, CASE WHEN first % 4 IN (0, 1) OR first % 4 = 3 AND batch_pos < n - 1 THEN v END AS verdict FROM batched) "
)


@register("batch_assign_sessions", _SESSION_SQL + "SELECT target, path, batch_no, count(*) AS n_findings, CAST(sum(batch_pos * (finding_index + 1)) AS BIGINT) AS placed FROM batched GROUP BY ALL")
def _(spark, sf_dir):
    """Batches of files with more than twelve findings."""
    return session_findings(spark, sf_dir).groupBy(*triage.BATCH).agg(
        F.count("*").alias("n_findings"), F.sum(F.col("batch_pos") * (F.col("finding_index") + 1)).alias("placed"))


@register("session_verdicts", _SESSION_SQL + "SELECT target, finding_index, batch_no, verdict, first % 4 = 2 OR coalesce(verdict = 'REAL', false) OR coalesce(named, false) AS kept, "
          "coalesce(named, false) AND first % 4 <> 2 AND coalesce(verdict <> 'REAL', true) AS kept_by_another_batch FROM said LEFT JOIN named USING (target, finding_index)")
def _(spark, sf_dir):
    """Verdicts in which a batch speaks for a finding of the batch before it."""
    found = session_findings(spark, sf_dir)
    judged_ = triage.join_verdicts(found, session_replies(found))
    failed = F.min("finding_index").over(Window.partitionBy(*triage.BATCH)) % 4 == 2
    by_other = F.col("kept") & ~failed & F.coalesce(F.col("verdict") != "REAL", F.lit(True))
    return judged_.select("target", "finding_index", "batch_no", "verdict", "kept", by_other.alias("kept_by_another_batch"))


# --- audits -----------------------------------------------------------------------
def audit_replies(found: DataFrame) -> DataFrame:
    """Replies for severe findings: full, without attack path, inside prose with stray commas, failed, none."""
    i = F.col("finding_index").cast("string")
    kind = F.col("finding_index") % 5
    full = F.concat(F.lit('{"attack_path": "step '), i, F.lit('", "exploit_demo": "demo", "impact": "all", "cvss_vector": "CVSS:3.1/AV:N", "fix": "patch '), i, F.lit('"}'))
    no_path = F.concat(F.lit('{"impact": "some", "fix": "patch '), i, F.lit('"}'))
    prose = F.concat(F.lit('Report:\n{"attack_path": "path '), i, F.lit('",\n "tags": ["a", ],\n}\nEnd'))
    reply = F.when(kind == 0, full).when(kind == 1, no_path).when(kind == 2, prose)
    return severe(found).where(kind != 4).select("target", "finding_index", reply.alias("reply"), F.when(kind == 3, F.lit("timeout")).alias("error"))


_AUDIT_SQL = (
    F_SQL + ", audited AS (SELECT *, CASE WHEN severity NOT IN ('critical', 'high') THEN 'skipped' WHEN finding_index % 5 IN (3, 4) THEN 'failed' ELSE 'audited' END AS audit_status FROM findings), "
    "enriched AS (SELECT *, CASE WHEN audit_status = 'audited' AND finding_index % 5 = 0 THEN '## Attack Path' || chr(10) || 'step ' || finding_index || chr(10) || chr(10) || '## Exploit Demo' || chr(10) || 'demo' "
    "|| chr(10) || chr(10) || '## Impact' || chr(10) || 'all' || chr(10) || chr(10) || '## CVSS' || chr(10) || 'CVSS:3.1/AV:N' "
    "WHEN audit_status = 'audited' AND finding_index % 5 = 2 THEN '## Attack Path' || chr(10) || 'path ' || finding_index || chr(10) || chr(10) || '## Exploit Demo' || chr(10) || '' "
    "|| chr(10) || chr(10) || '## Impact' || chr(10) || '' || chr(10) || chr(10) || '## CVSS' || chr(10) ELSE '' END AS attack_demo, "
    "CASE WHEN audit_status = 'audited' AND finding_index % 5 IN (0, 1) THEN '[L3 DeepSeek Analysis]' || chr(10) || 'patch ' || finding_index || chr(10) || chr(10) || '[L1 Suggestion]' || chr(10) || fix ELSE fix END AS fix_suggestion FROM audited) "
)


@register("findings_audit_enrich", _AUDIT_SQL + "SELECT target, severity, audit_status, count(*) AS n_findings, count(*) FILTER (WHERE attack_demo <> '') AS with_demo FROM enriched GROUP BY ALL")
def _(spark, sf_dir):
    f = numbered_findings(spark, sf_dir)
    e = triage.join_audits(f, audit_replies(f))
    return e.groupBy("target", "severity", "audit_status").agg(F.count("*").alias("n_findings"), F.count_if(F.col("attack_demo") != "").alias("with_demo"))


@register("compose_enrichment", _AUDIT_SQL + "SELECT target, finding_index, attack_demo, fix_suggestion FROM enriched")
def _(spark, sf_dir):
    f = numbered_findings(spark, sf_dir)
    return triage.join_audits(f, audit_replies(f)).select("target", "finding_index", "attack_demo", "fix_suggestion")


@register("findings_file_content", F_SQL + "SELECT f.target, finding_index, md5(c.content) AS text_md5, length(c.content) AS n_chars, length(c.content) > 32000 AS was_cut FROM findings f JOIN code_files c USING (path) WHERE severity IN ('critical', 'high')")
def _(spark, sf_dir):
    p = triage.file_payloads(numbered_findings(spark, sf_dir), files(spark, sf_dir))
    return p.select("target", "finding_index", F.md5(F.col("file_text").cast("binary")).alias("text_md5"), "n_chars", "was_cut")


# --- chains -----------------------------------------------------------------------
_CHAIN_TEXT = (
    "'--- Finding ' || rule_id || ' ---' || chr(10) || 'Severity: ' || upper(severity) || chr(10) || 'File: ' || path || ':' || line_number || chr(10) || 'Title: ' || title || chr(10) "
    "|| 'Description: ' || description || chr(10) || 'Attack demo (if available): Not yet analyzed' || chr(10)"
)
_BUDGET_SQL = (
    F_SQL + f", texts AS (SELECT target, finding_index, {_CHAIN_TEXT} AS t FROM findings WHERE severity IN ('critical', 'high')), "
    "running AS (SELECT *, CAST(sum(length(t)) OVER (PARTITION BY target ORDER BY finding_index) AS BIGINT) AS used_chars, count(*) OVER (PARTITION BY target) AS n_all FROM texts), "
    "fit AS (SELECT *, n_all - count(*) OVER (PARTITION BY target) AS n_omitted FROM running WHERE used_chars <= 48000) "
)


@register("char_budget_cut", _BUDGET_SQL + "SELECT target, finding_index, used_chars, n_omitted FROM fit")
def _(spark, sf_dir):
    b = triage.chain_budget(severe(numbered_findings(spark, sf_dir)))
    return b.select("target", "finding_index", "used_chars", "n_omitted")


# the same cut points in SQL: stretches behind the first part, texts over half the budget by themselves
_PARTS_SQL = (
    F_SQL + f", texts AS (SELECT target, finding_index, {_CHAIN_TEXT} AS t FROM findings WHERE severity IN ('critical', 'high') "
    "AND target IN (SELECT target FROM findings WHERE severity IN ('critical', 'high') GROUP BY 1 HAVING count(*) >= 2)), "
    "running AS (SELECT *, sum(length(t)) OVER (PARTITION BY target ORDER BY finding_index) AS used_chars FROM texts), "
    "bounds AS (SELECT target, coalesce(max(used_chars) FILTER (WHERE used_chars <= 48000), 0) AS base, count(*) FILTER (WHERE used_chars > 48000) AS n_omitted, "
    "coalesce(max(length(t)) FILTER (WHERE used_chars > 48000 AND length(t) <= 24000), 0) AS longest FROM running GROUP BY 1), "
    "cut AS (SELECT *, CASE WHEN used_chars <= 48000 THEN -1 ELSE (used_chars - length(t) - base) // (48000 - longest) END AS stretch, "
    "CASE WHEN used_chars > 48000 AND length(t) > 24000 THEN finding_index ELSE -1 END AS own FROM running JOIN bounds USING (target)), "
    "parts AS (SELECT *, dense_rank() OVER (PARTITION BY target ORDER BY stretch, own) - CASE WHEN min(stretch) OVER (PARTITION BY target) < 0 THEN 1 ELSE 0 END AS part_no FROM cut) "
)


@register("chain_prompt", _PARTS_SQL + "SELECT target, CAST(part_no AS BIGINT) AS part_no, count(*) AS n_included, n_omitted, md5(string_agg(t, chr(10) ORDER BY finding_index) "
          "|| CASE WHEN part_no = 0 AND n_omitted > 0 THEN chr(10) || chr(10) || '[... ' || n_omitted || ' more findings omitted to stay within context window]' ELSE '' END) AS prompt_md5, "
          "sum(length(t)) <= 48000 AS within_budget FROM parts GROUP BY target, part_no, n_omitted")
def _(spark, sf_dir):
    """All parts: every severe finding of a target that can have a chain is in one."""
    parts = triage.chain_parts(chain_eligible(numbered_findings(spark, sf_dir)))
    p = triage.chain_prompts(parts)
    chars = F.length("prompt_text") - F.col("n_included") <= 48000 + 100
    return p.select("target", "part_no", "n_included", "n_omitted", F.md5(F.col("prompt_text").cast("binary")).alias("prompt_md5"), chars.alias("within_budget"))


def chain_replies(found: DataFrame) -> DataFrame:
    """A reply per target: full, with fields missing, empty, or no JSON."""
    t = found.select("target").distinct().withColumn("kind", F.substring("target", 5, 9).cast("int") % 4)
    full = F.concat(F.lit('{"campaign_name": "Drift '), F.col("target"), F.lit(
        '", "executive_summary": "s", "risk_level": "CRITICAL", "attack_chain": [{"stage": 1, "stage_name": "in"}, {"stage": 5, "stage_name": "out"}], '
        '"total_impact": {"data_exposed": "logs"}, "mitigation_priority": [{"order": 1, "action": "pin", "finding_ids": ["TA-001"], "effort": "LOW"}]}'))
    bare = F.lit('ok: {"attack_chain": [{"technique": "x"}, {"stage_name": "two"},]}')
    reply = F.when(F.col("kind") == 0, full).when(F.col("kind") == 1, bare).when(F.col("kind") == 2, F.lit("{}")).otherwise(F.lit("no chain"))
    return t.select("target", reply.alias("reply"))


@register("default_fill_chain", F_SQL + ", t AS (SELECT DISTINCT target, CAST(substr(target, 5) AS INT) % 4 AS kind FROM findings) SELECT target, "
          "CASE kind WHEN 0 THEN 'Drift ' || target WHEN 1 THEN 'Unnamed Campaign' END AS campaign_name, CASE kind WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'HIGH' END AS risk_level, "
          "CASE kind WHEN 0 THEN '1:in,5:out' WHEN 1 THEN '1:,2:two' END AS stages, CASE kind WHEN 0 THEN 'pin' WHEN 1 THEN '' END AS actions FROM t")
def _(spark, sf_dir):
    c = triage.read_chains(chain_replies(numbered_findings(spark, sf_dir)))
    stages = F.array_join(F.transform("chain.stages", lambda s: F.concat_ws(":", s["stage"], s["stage_name"])), ",")
    actions = F.array_join(F.transform(F.slice("chain.mitigation_priority", 1, 3), lambda m: m["action"]), ",")
    return c.select("target", F.col("chain.campaign_name").alias("campaign_name"), F.col("chain.risk_level").alias("risk_level"),
                    stages.alias("stages"), actions.alias("actions"))


@register("tier_summary", _BATCHED_SQL + ", a AS (SELECT target, kept, kept AND severity IN ('critical', 'high') AND finding_index % 5 < 3 AS audited FROM verdicts) "
          "SELECT target, count(*) AS l1_findings, count(*) FILTER (WHERE NOT kept) AS l2_dropped, count(*) FILTER (WHERE audited) AS l3_audited, CAST(substr(target, 5) AS INT) % 4 < 2 AS l4_chain FROM a GROUP BY target")
def _(spark, sf_dir):
    j = judged(spark, sf_dir)
    e = triage.join_audits(j, audit_replies(numbered_findings(spark, sf_dir)))
    chains = triage.read_chains(chain_replies(numbered_findings(spark, sf_dir))).where("chain is not null")
    return report.tier_summary(e, chains)


_COUNTS = "count(*) FILTER (WHERE severity = 'critical') AS critical, count(*) FILTER (WHERE severity = 'high') AS high, count(*) FILTER (WHERE severity = 'medium') AS medium, count(*) AS total"


@register("depth_select", _BATCHED_SQL + ", at_depth AS (SELECT d.depth, v.* FROM verdicts v, (VALUES (1), (2), (3)) d(depth) WHERE d.depth = 1 OR kept), "
          f"c AS (SELECT depth, target, {_COUNTS}, count(*) FILTER (WHERE depth = 3 AND severity IN ('critical', 'high') AND finding_index % 5 < 3) AS audited, "
          "count(*) FILTER (WHERE severity IN ('critical', 'high')) AS severe FROM at_depth GROUP BY ALL) "
          f"SELECT CAST(depth AS BIGINT) AS depth, target, {_GRADE} AS score, total, audited, depth = 3 AND severe >= 2 AND CAST(substr(target, 5) AS INT) % 4 < 2 AS chained FROM c")
def _(spark, sf_dir):
    """The whole pipeline at depth 1, 2 and 3, from one scan whose stages are written once."""
    given = numbered_findings(spark, sf_dir)
    result = run_scan(files(spark, sf_dir), 3, rules=ALL_RULES, verdict_replies=replies(triage.assign_batches(given)),
                      audit_replies=audit_replies(given), chain_replies=chain_replies(given))
    out = None
    for depth in (3, 2, 1):
        view = result.at_depth(depth)
        header = view.header.where("summary.total > 0")
        tiers = view.tiers if depth == 3 else header.select("target", F.lit(0).alias("l3_audited"), F.lit(False).alias("l4_chain"))
        rows = header.join(tiers, "target").select(F.lit(depth).alias("depth"), "target", "score", F.col("summary.total").alias("total"),
                                                   F.col("l3_audited").alias("audited"), F.col("l4_chain").alias("chained"))
        out = rows if out is None else out.unionByName(rows)
    return out


@register("top_mitigations", F_SQL + ", t AS (SELECT DISTINCT target, CAST(substr(target, 5) AS INT) % 4 AS kind FROM findings) "
          "SELECT target, CASE kind WHEN 0 THEN 'pin' END AS action, CAST(1 AS BIGINT) AS place FROM t WHERE kind = 0")
def _(spark, sf_dir):
    """The first three mitigations of every chain."""
    c = triage.read_chains(chain_replies(numbered_findings(spark, sf_dir))).where("chain is not null")
    firsts = F.transform(F.slice("chain.mitigation_priority", 1, 3), lambda m, i: F.struct(m["action"].alias("action"), (i + 1).alias("place")))
    return c.select("target", F.explode(firsts).alias("m")).select("target", "m.action", "m.place")
