"""Stages of a scan are written once and read by every depth and by a later run."""

from pyspark.sql import functions as F

from wardspark.plans.scan import run_scan
from wardspark.plans.store import StageStore

TEXT = "@tool\nprint(password)\nsubprocess.call(x)\neval(user_input)\n"


def given(spark):
    files = spark.createDataFrame([(f"t{n % 3}", f"t{n % 3}/a{n}.py", TEXT * (n % 4)) for n in range(9)], "target string, path string, content string")
    verdicts = run_scan(files).findings.select("target", "path", F.floor(F.col("file_pos") / 12).cast("int").alias("batch_no")).distinct()
    verdicts = verdicts.select("*", F.lit('{"results": [{"verdict": "REAL"}, {"verdict": "NOISE"}, {"verdict": "REAL"}]}').alias("reply"), F.lit(None).cast("string").alias("error"))
    audits = run_scan(files).findings.select("target", "finding_index", F.lit('{"attack_path": "p", "fix": "f"}').alias("reply"), F.lit(None).cast("string").alias("error"))
    chains = files.select("target").distinct().withColumn("reply", F.lit('{"campaign_name": "c", "attack_chain": [{"stage_name": "s"}]}'))
    return files, dict(verdict_replies=verdicts, audit_replies=audits, chain_replies=chains)


def shown(result):
    header = result.header.drop("duration_ms").select("target", "score", F.to_json("summary"), "total_checks")
    return [sorted(map(str, t.collect())) for t in (header, result.findings.drop("owasp_ids"), result.tiers, result.chain_status)]


def test_all_depths_read_one_scan(spark):
    files, replies = given(spark)
    calls = []

    def detector(source):
        calls.append(1)
        columns = {"rule_ord": 100, "pattern_ord": 0, "line_number": 1, "match_ord": 0}
        return source.limit(0).select("target", "path", *[F.lit(v).alias(k) for k, v in columns.items()], F.lit("").alias("note"), F.lit("").alias("code_snippet"))

    result = run_scan(files, 3, detectors=(detector,), **replies)
    at_once = {d: shown(result.at_depth(d)) for d in (3, 1, 2)}
    assert len(calls) == 1
    for depth, got in at_once.items():
        assert got == shown(run_scan(files, depth, detectors=(detector,), **replies)), depth
    plan = result.at_depth(2).header._jdf.queryExecution().optimizedPlan().toString()
    assert "explode" not in plan and "rlike" not in plan.lower()


def test_a_run_with_the_same_key_goes_on_from_the_stages(spark):
    files, replies = given(spark)
    key = StageStore(spark).key
    first = run_scan(files, 1, scan_key=key)
    want = sorted(map(str, first.findings.collect()))
    broken = files.withColumn("content", F.raise_error(F.lit("read again")).cast("string"))
    again = run_scan(broken, 2, scan_key=key, **replies)
    assert sorted(map(str, again.at_depth(1).findings.collect())) == want
    assert 0 < again.findings.count() < len(want)
    assert again.store.seconds["numbered"] > 0


def test_a_stage_that_was_broken_off_is_made_again(spark):
    store = StageStore(spark)
    spark.range(3).write.parquet(f"{store.folder}/numbers")  # without its mark
    assert not store.has("numbers")
    made = store.table("numbers", lambda: spark.range(5))
    assert made.count() == 5 and store.has("numbers")
    assert StageStore(spark, store.key).table("numbers", lambda: spark.range(9)).count() == 5
    assert store.table("none", lambda: spark.range(0)).count() == 0
