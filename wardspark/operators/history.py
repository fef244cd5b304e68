"""Scan history: two append-only tables, partitioned by period (day or month) and append.

Headers and findings are kept apart so that listing and statistics never read
findings, and no row has to hold all findings of a scan.

Every append has a key and owns the partitions with that key: an append that is tried again,
after a lost driver for example, replaces what it wrote before and counts once.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.grading import count_of
from ..rules.fixed import CLEAN_GRADES, SEVERITY_RANK

SCANS, FINDINGS = "scans", "scan_findings"


def scan_id(target: Column, created_at: Column) -> Column:
    return F.concat(F.lit("scan_"), F.left(F.sha2(F.concat_ws("|", target, created_at.cast("string")), 256), F.lit(12)))


def from_report(header: DataFrame, period: str = "day", created_at: datetime | None = None) -> DataFrame:
    """Rows of the scans table for fresh report headers.

    They are stamped once, here, so that ids stay the same however often the rows are computed.
    """
    stamped = header.withColumn("created_at", F.lit(created_at or datetime.now(timezone.utc)).cast("timestamp"))
    return history_rows(
        stamped.withColumns({
            "id": scan_id(F.col("target"), F.col("created_at")),
            "finding_count": F.col("summary.total"),
        }),
        period,
    )


def from_findings(findings: DataFrame, created_at: datetime, period: str = "day") -> DataFrame:
    """Rows of the findings table: findings of the scan stamped ``created_at``, under its ids.

    The id follows from target and time, so nothing is joined and no other scan of the target is in the way.
    """
    stamp = F.lit(created_at).cast("timestamp")
    return findings.withColumns({"id": scan_id(F.col("target"), stamp), "scan_period": F.to_date(F.date_trunc(period, stamp))})


def findings_of(scans: DataFrame, findings: DataFrame) -> DataFrame:
    """Findings that carry the ``id`` of their scan, with the period of that scan.

    ``scans`` may be the whole stored table: the join is on the scan, so a target that was scanned often
    gets each finding once.  Scans stored in several appends count once.
    """
    return findings.join(scans.select("id", "scan_period").distinct(), "id")


def store_scan(result, folder: str, period: str = "day", created_at: datetime | None = None) -> datetime:
    """Append header and findings of a ``ScanResult`` and return the stamp.

    Pass the stamp of a call that failed to try it again: the ids and the append are the same.
    """
    created_at = created_at or datetime.now(timezone.utc)
    key = created_at.strftime("%Y%m%dT%H%M%S%f")
    append(from_findings(result.findings, created_at, period), folder, key, FINDINGS)
    append(from_report(result.header, period, created_at), folder, key)  # last: a listed scan has its findings
    return created_at


def history_rows(headers: DataFrame, period: str = "day") -> DataFrame:
    """Rows of the scans table from ``(id, target, score, total_checks, duration_ms, finding_count, created_at)``.

    ``period`` sets how much one partition holds; take ``month`` where a day
    has only a handful of scans.
    """
    return headers.select(
        "id", "target", "score", "total_checks", F.round("duration_ms", 1).alias("duration_ms"), "finding_count",
        "created_at", F.to_date(F.date_trunc(period, "created_at")).alias("scan_period"),
    )


def append(rows: DataFrame, folder: str, key: str, table: str = SCANS) -> None:
    """Write rows by period as the append ``key``; whatever that append wrote to these periods before is replaced.

    The rebalance keeps files few per period and splits periods that are very large.
    """
    keyed = rows.withColumn("append_key", F.lit(key)).hint("rebalance", "scan_period")
    writer = keyed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("scan_period", "append_key")
    writer.parquet(f"{folder}/{table}")


def read(spark: SparkSession, folder: str, table: str = SCANS) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}").drop("append_key")


def page(scans: DataFrame, limit: int = 20, offset: int = 0) -> DataFrame:
    """Newest first; the id breaks ties."""
    return scans.orderBy(F.col("created_at").desc(), "id").offset(offset).limit(limit)


def by_id(scans: DataFrame, wanted: str, scan_period: str | None = None) -> DataFrame:
    """One report; a known period prunes the other partitions."""
    found = scans.where(F.col("id") == wanted)
    return found if scan_period is None else found.where(F.col("scan_period") == F.lit(scan_period).cast("date"))


def stored_summary(scan_findings: DataFrame) -> DataFrame:
    """Counts per scan over all severities, unknown ones included, and audited findings."""
    sev = F.col("severity")
    return scan_findings.groupBy("id").agg(
        *[count_of(sev, s).alias(s) for s in reversed(list(SEVERITY_RANK))],
        F.count_if(~sev.isin(*SEVERITY_RANK)).alias("other"),
        F.count("*").alias("l1_findings"),
        F.count_if(F.length("attack_demo") > 0).alias("l3_audited"),
    )


def stats(scans: DataFrame) -> DataFrame:
    return scans.agg(
        F.count("*").alias("total_scans"),
        F.round(F.coalesce(F.avg("duration_ms"), F.lit(0.0)), 1).alias("avg_duration_ms"),
        F.count_if(F.col("score").isin(*CLEAN_GRADES)).alias("clean_scans"),
    )


def with_findings(scans_page: DataFrame) -> DataFrame:
    return scans_page.agg(F.count_if(F.col("finding_count") > 0).alias("with_findings"))
