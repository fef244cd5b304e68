import re

from pyspark.sql import functions as F

from wardspark.operators import history, report
from wardspark.plans.scan import run_scan


def files(spark):
    return spark.createDataFrame(
        [("t1", "t1/a.py", "@tool\nsubprocess.call(x)"), ("t2", "t2/c.py", "x = 1")], "target string, path string, content string")


def test_report_to_history_and_back(spark, tmp_path):
    result = run_scan(files(spark))
    rows = history.from_report(result.header.withColumn("duration_ms", F.lit(12.345)))
    history.append(rows, str(tmp_path), "one")
    history.append(rows, str(tmp_path), "two")
    stored = history.read(spark, str(tmp_path))
    assert stored.count() == 4
    first = history.page(stored, limit=1).first()
    assert re.fullmatch("scan_[0-9a-f]{12}", first.id) and first.duration_ms == 12.3
    assert history.stats(stored).first().clean_scans == 2
    one = history.by_id(stored, first.id, str(first.scan_period))
    assert one.count() >= 1


def test_a_retried_append_counts_once(spark, tmp_path):
    folder, result = str(tmp_path), run_scan(files(spark))
    stamp = history.store_scan(result, folder)
    history.store_scan(result, folder, created_at=stamp)
    scans, found = history.read(spark, folder), history.read(spark, folder, history.FINDINGS)
    assert scans.count() == 2 and found.count() == result.findings.count() == 2
    other = history.store_scan(result, folder)  # the same targets on the same day
    assert other != stamp
    scans, found = history.read(spark, folder), history.read(spark, folder, history.FINDINGS)
    joined = history.findings_of(scans, found.drop("scan_period"))
    summary = history.stored_summary(joined).collect()
    assert scans.count() == 4 and joined.count() == 4
    assert [(r.high, r.critical, r.l1_findings, r.l3_audited) for r in summary] == [(2, 0, 2, 0)] * 2
    assert {r.id for r in summary} < {r.id for r in scans.collect()}


def test_a_retry_replaces_what_a_broken_append_left(spark, tmp_path):
    folder = str(tmp_path)
    whole = history.from_report(run_scan(files(spark)).header).persist()
    history.append(whole.limit(1), folder, "key")
    history.append(whole, folder, "other")
    history.append(whole, folder, "key")
    assert history.read(spark, folder).count() == 4


def test_empty_history(spark):
    empty = spark.createDataFrame([], "score string, duration_ms double")
    assert tuple(history.stats(empty).first()) == (0, 0.0, 0)


def test_report_pages_and_clean_targets(spark, tmp_path):
    files = spark.createDataFrame([("t1", "t1/a.py", "\n".join(["@tool"] * 25)), ("t2", "t2/c.py", "x = 1")], "target string, path string, content string")
    result = run_scan(files)
    docs = report.report_documents(result.header, result.findings, page_size=10)
    got = sorted((r.target, r.page, len(r.findings), r.score, r.summary.total) for r in docs.collect())
    assert got == [("t1", 0, 10, "F", 25), ("t1", 1, 10, "F", 25), ("t1", 2, 5, "F", 25), ("t2", 0, 0, "A+", 0)]
    report.write_reports(docs, str(tmp_path / "reports"))
    back = spark.read.json(str(tmp_path / "reports"))
    assert back.count() == 4 and "attack_chain" in back.columns
