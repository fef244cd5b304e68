"""History queries: one stored scan per order, one stored finding per line item."""

from __future__ import annotations

import uuid
from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardspark.operators import history
from wardspark.plans.scan import run_scan
from wardspark.rules import ALL_RULES
from wardspark.session import checkpoint_folder

from .corpora import table
from .detection import flat
from .duck import COLLECTED_SQL
from .findings import _COUNTS_SQL, _GRADE, F_SQL, files

QUERIES, ORACLE = {}, {}
_GRADES = ("A+", "A", "B", "C", "D", "F")


def register(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = lambda spark, sf_dir: flat(fn(spark, sf_dir))
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return keep


def scans(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    grade = F.element_at(F.array(*[F.lit(g) for g in _GRADES]), (F.col("o_orderkey") % 6 + 1).cast("int"))
    return history.history_rows(o.select(
        F.concat(F.lit("scan_"), F.col("o_orderkey").cast("string")).alias("id"),
        F.concat(F.lit("target_"), F.col("o_custkey").cast("string")).alias("target"),
        grade.alias("score"), (F.col("o_orderkey") % 500 * 19).alias("total_checks"),
        (F.col("o_totalprice") / 1000).alias("duration_ms"), (F.col("o_orderkey") % 4).alias("finding_count"),
        F.col("o_orderdate").cast("timestamp").alias("created_at")), period="month")


def scan_findings(spark, sf_dir) -> DataFrame:
    kinds = ("critical", "high", "medium", "low", "info", "odd")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return li.select(
        F.concat(F.lit("scan_"), F.col("l_orderkey").cast("string")).alias("id"),
        F.element_at(F.array(*[F.lit(k) for k in kinds]), (F.col("l_linenumber") % 6 + 1).cast("int")).alias("severity"),
        F.when(F.col("l_quantity") > 25, F.lit("demo")).otherwise(F.lit("")).alias("attack_demo"))


_SCANS_SQL = (
    "WITH scans AS (SELECT 'scan_' || o_orderkey AS id, 'target_' || o_custkey AS target, ['A+', 'A', 'B', 'C', 'D', 'F'][o_orderkey % 6 + 1] AS score, "
    "CAST(o_orderkey % 500 * 19 AS BIGINT) AS total_checks, round(o_totalprice / 1000, 1) AS duration_ms, CAST(o_orderkey % 4 AS BIGINT) AS finding_count, "
    "CAST(o_orderdate AS TIMESTAMP) AS created_at FROM orders), "
    "sf AS (SELECT 'scan_' || l_orderkey AS id, ['critical', 'high', 'medium', 'low', 'info', 'odd'][l_linenumber % 6 + 1] AS severity, "
    "CASE WHEN l_quantity > 25 THEN 'demo' ELSE '' END AS attack_demo FROM lineitem) "
)
_TIME = "strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created"


def _with_time(df: DataFrame) -> DataFrame:
    return df.withColumn("created", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss")).drop("created_at", "scan_period")


@register("history_page", _SCANS_SQL + f"SELECT id, target, score, total_checks, duration_ms, finding_count, {_TIME} FROM scans ORDER BY created_at DESC, id LIMIT 20 OFFSET 40")
def _(spark, sf_dir):
    return _with_time(history.page(scans(spark, sf_dir), limit=20, offset=40))


@register("with_findings_count", _SCANS_SQL + "SELECT count(*) AS with_findings FROM (SELECT * FROM scans ORDER BY created_at DESC, id LIMIT 20) WHERE finding_count > 0")
def _(spark, sf_dir):
    return history.with_findings(history.page(scans(spark, sf_dir)))


@register("report_by_id", _SCANS_SQL + f"SELECT id, target, score, total_checks, duration_ms, finding_count, {_TIME} FROM scans WHERE id = 'scan_77'")
def _(spark, sf_dir):
    return _with_time(history.by_id(scans(spark, sf_dir), "scan_77"))


@register("scan_stats", _SCANS_SQL + "SELECT count(*) AS total_scans, round(coalesce(avg(duration_ms), 0), 1) AS avg_duration_ms, "
          "count(*) FILTER (WHERE score IN ('A+', 'A')) AS clean_scans FROM scans")
def _(spark, sf_dir):
    return history.stats(scans(spark, sf_dir))


@register("history_finding_count", _SCANS_SQL + "SELECT s.id, count(sf.id) AS finding_count FROM scans s LEFT JOIN sf USING (id) GROUP BY 1")
def _(spark, sf_dir):
    counts = scan_findings(spark, sf_dir).groupBy("id").agg(F.count("*").alias("n"))
    return scans(spark, sf_dir).select("id").join(counts, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("finding_count"))


@register("stored_report_summary", _SCANS_SQL + "SELECT id, " + ", ".join(
    f"count(*) FILTER (WHERE severity = '{s}') AS {s}" for s in ("critical", "high", "medium", "low", "info"))
    + ", count(*) FILTER (WHERE severity = 'odd') AS other, count(*) AS l1_findings, count(*) FILTER (WHERE attack_demo <> '') AS l3_audited FROM sf GROUP BY 1")
def _(spark, sf_dir):
    return history.stored_summary(scan_findings(spark, sf_dir))


@register("history_append", _SCANS_SQL + "SELECT strftime(created_at, '%Y-%m') AS month, 2 * count(*) AS n_scans, round(2 * sum(duration_ms), 1) AS sum_duration FROM scans GROUP BY 1")
def _(spark, sf_dir):
    """Two appends to the partitioned table in the shared folder, one of them tried twice, then read back."""
    folder = f"{checkpoint_folder(spark)}/history-{uuid.uuid4().hex}"
    rows = scans(spark, sf_dir)
    for key in ("first", "second", "second"):
        history.append(rows, folder, key)
    back = history.read(spark, folder)
    return back.groupBy(F.date_format("scan_period", "yyyy-MM").alias("month")).agg(
        F.count("*").alias("n_scans"), F.round(F.sum("duration_ms"), 1).alias("sum_duration"))


@register("scan_to_history", F_SQL + f", c AS (SELECT target, {_COUNTS_SQL} FROM findings GROUP BY target), "
          f"t AS (SELECT target, CAST(count(*) FILTER (WHERE {COLLECTED_SQL}) * 22 AS BIGINT) AS total_checks FROM code_files GROUP BY 1) "
          f"SELECT target, {_GRADE} AS score, total_checks, coalesce(total, 0) AS finding_count, coalesce(total, 0) AS l1_findings, coalesce(critical, 0) AS critical, "
          "coalesce(high, 0) AS high, coalesce(medium, 0) AS medium, CAST(2 AS BIGINT) AS n_scans FROM t LEFT JOIN c USING (target)")
def _(spark, sf_dir):
    """A scan stored twice under one stamp and once under another; each stored scan has its findings once."""
    folder = f"{checkpoint_folder(spark)}/history-{uuid.uuid4().hex}"
    result = run_scan(files(spark, sf_dir), rules=ALL_RULES)
    first = history.store_scan(result, folder)
    for stamp in (first, first + timedelta(seconds=1)):
        history.store_scan(result, folder, created_at=stamp)
    scans_, found = history.read(spark, folder), history.read(spark, folder, history.FINDINGS)
    summary = history.stored_summary(history.findings_of(scans_, found.drop("scan_period")))
    each = scans_.join(summary, "id", "left").na.fill(0, ["l1_findings", "critical", "high", "medium"])
    columns = ("target", "score", "total_checks", "finding_count", "l1_findings", "critical", "high", "medium")
    return each.groupBy(*columns).agg(F.count("*").alias("n_scans"))


@register("utc_now_iso", _SCANS_SQL + "SELECT target, finding_count, round(duration_ms, 1) AS duration_ms, true AS named, true AS stamped_now FROM scans")
def _(spark, sf_dir):
    """Fresh report headers become history rows: an id made of target and time, and the current UTC time."""
    header = scans(spark, sf_dir).select("target", "score", "total_checks", "duration_ms", F.struct(F.col("finding_count").alias("total")).alias("summary"))
    rows = history.from_report(header)
    now = F.abs(F.unix_timestamp("created_at") - F.unix_timestamp()) < 600
    return rows.select("target", "finding_count", "duration_ms", F.col("id").rlike("^scan_[0-9a-f]{12}$").alias("named"), now.alias("stamped_now"))
