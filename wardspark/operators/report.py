"""Counts, grades, gates and reports.  Group aggregates combine before the shuffle, so hot targets are cheap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.grading import count_of, display_rank, gate_rank, grade_points, is_severe, letter_grade, threshold_rank

COUNTED = ("critical", "high", "medium", "low")


def severity_counts(findings: DataFrame, *keys: str) -> DataFrame:
    sev = F.col("severity")
    return findings.groupBy(*keys).agg(*[count_of(sev, s).alias(s) for s in COUNTED], F.count("*").alias("total"))


def risk_scores(targets: DataFrame, findings: DataFrame) -> DataFrame:
    """Grade of every target; one without findings is clean."""
    counts = targets.join(severity_counts(findings, "target"), "target", "left").na.fill(0, [*COUNTED, "total"])
    return with_grade(counts)


def with_grade(counts: DataFrame) -> DataFrame:
    points = grade_points(F.col("critical"), F.col("high"), F.col("medium"))
    return counts.withColumns({"points": points, "score": letter_grade(points)})


def owasp_counts(findings: DataFrame, *keys: str) -> DataFrame:
    """Findings per OWASP id; a finding counts once for each of its ids.

    Severity and ids depend on the rule alone, so findings are counted per rule
    first and only those few rows are exploded.
    """
    per_rule = findings.groupBy(*keys, "rule_id", "owasp_ids").agg(F.count("*").alias("_n"))
    return (
        per_rule.select(*keys, F.explode("owasp_ids").alias("owasp_id"), "_n")
        .groupBy(*keys, "owasp_id")
        .agg(F.sum("_n").alias("n_findings"))
    )


def owasp_coverage(findings: DataFrame) -> DataFrame:
    """``MAP<owasp id, count>`` per target; there are about twenty ids, so the list is short."""
    return (
        owasp_counts(findings, "target")
        .groupBy("target")
        .agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("owasp_id", "n_findings")))).alias("owasp_coverage"))
    )


def total_checks(collected: DataFrame, n_rules: int) -> DataFrame:
    """Rules times collected files, before any content filter and including unreadable files."""
    return collected.groupBy("target").agg((F.count("*") * n_rules).alias("total_checks"))


def tier_summary(judged: DataFrame, chains: DataFrame) -> DataFrame:
    """Funnel per target from findings with ``kept`` and ``audit_status``; ``chains(target)`` lists targets with a chain."""
    has_chain = chains.select("target", F.lit(True).alias("_chain")).distinct()
    return (
        judged.groupBy("target")
        .agg(
            F.count("*").alias("l1_findings"),
            F.count_if(~F.col("kept")).alias("l2_dropped"),
            F.count_if(F.col("kept") & (F.col("audit_status") == "audited")).alias("l3_audited"),
        )
        .join(has_chain, "target", "left")
        .withColumn("l4_chain", F.coalesce("_chain", F.lit(False)))
        .drop("_chain")
    )


def ci_gate(targets: DataFrame, findings: DataFrame, *thresholds: str) -> DataFrame:
    """``target, threshold, exit_code``: 2 at or above the threshold, else 1 with any severe finding, else 0.

    One pass over the findings, whatever the number of thresholds (``high`` if none is given).
    """
    sev = F.col("severity")
    worst = findings.groupBy("target").agg(
        F.max(gate_rank(sev)).alias("worst_rank"), F.max(is_severe(sev).cast("int")).alias("any_severe")
    )
    gates = F.array(*[F.struct(F.lit(t).alias("threshold"), F.lit(threshold_rank(t)).alias("least")) for t in thresholds or ("high",)])
    code = F.when(F.col("worst_rank") >= F.col("g.least"), 2).when(F.col("any_severe") == 1, 1).otherwise(0)
    out = targets.join(worst, "target", "left").withColumn("g", F.explode(gates))
    return out.select("target", "g.threshold", code.alias("exit_code"))


def mitigation_rollup(findings: DataFrame) -> DataFrame:
    """Rules by how many severe findings and files a fix would settle.

    Counted per (rule, file) first, so neither a hot rule nor a hot file lands in one task.
    """
    per_file = findings.where(is_severe(F.col("severity"))).groupBy("rule_id", "target", "path").agg(F.count("*").alias("_n"))
    return per_file.groupBy("rule_id").agg(F.sum("_n").alias("n_findings"), F.count("*").alias("n_files"))


def by_severity(findings: DataFrame, info_known: bool = True) -> DataFrame:
    """Display order: most severe first, then finding order."""
    return findings.withColumn("display_rank", display_rank(F.col("severity"), info_known)).orderBy(
        "display_rank", "target", "finding_index"
    )


def report_header(targets: DataFrame, findings: DataFrame, checks: DataFrame, durations: DataFrame | None = None) -> DataFrame:
    """One row per target: grade, checks, severity counts, OWASP counts."""
    out = risk_scores(targets, findings).join(checks, "target", "left").join(owasp_coverage(findings), "target", "left")
    if durations is not None:
        out = out.join(durations, "target", "left")
    else:
        out = out.withColumn("duration_ms", F.lit(0.0))
    return out.select(
        "target", "score", F.coalesce("total_checks", F.lit(0)).alias("total_checks"), "duration_ms",
        F.struct("critical", "high", "medium", "low", "total").alias("summary"),
        F.coalesce("owasp_coverage", F.create_map().cast("map<string,bigint>")).alias("owasp_coverage"),
    )


FINDING_FIELDS = (
    "rule_id", "title", "severity", "file_path", "line_number", "description", "code_snippet", "attack_demo",
    "fix_suggestion", "owasp_ids",
)


def finding_struct(path: Column) -> Column:
    return F.struct(*[(path if n == "file_path" else F.col(n)).alias(n) for n in FINDING_FIELDS])


def report_documents(header: DataFrame, numbered: DataFrame, chains: DataFrame | None = None, page_size: int = 1000) -> DataFrame:
    """Nested report documents: the header and the findings, in finding order.

    A report of up to ``page_size`` findings is one document.  A longer one
    continues on further pages with the same header, so no document (and no
    task) has to hold an unbounded list; every document says how many pages its report has.
    The tables ``header`` and ``numbered`` are the report itself, one row for each finding.
    """
    pages = (
        numbered.select(
            "target", F.floor(F.col("finding_index") / page_size).cast("int").alias("page"),
            F.struct("finding_index", finding_struct(F.col("path")).alias("finding")).alias("_f"),
        )
        .groupBy("target", "page")
        .agg(F.sort_array(F.collect_list("_f")).alias("_f"))
        .select("target", "page", F.transform("_f", lambda f: f["finding"]).alias("findings"))
    )
    out = header.join(pages, "target", "left").withColumns({
        "page": F.coalesce("page", F.lit(0)),
        "n_pages": F.greatest(F.lit(1), F.ceil(F.col("summary.total") / page_size).cast("int")),
        "findings": F.coalesce("findings", F.array().cast(pages.schema["findings"].dataType)),
    })
    if chains is None:
        return out.withColumn("attack_chain", F.lit(None).cast("string"))
    return out.join(chains.select("target", F.col("chain").alias("attack_chain")), "target", "left")


def write_reports(documents: DataFrame, folder: str) -> None:
    documents.write.mode("overwrite").option("ignoreNullFields", "false").json(folder)


