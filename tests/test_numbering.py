import pytest
from pyspark.sql import functions as F

from wardspark.operators.numbering import with_positions
from wardspark.operators.triage import assign_batches


@pytest.fixture(autouse=True)
def many_blocks(spark):
    """Small data would be merged into one block; keep the blocks apart as large data does."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def rows_with_a_hot_group(spark):
    """A third of the rows share one file, another part shares one target."""
    n = F.col("id")
    return spark.range(30_000).select(
        F.when(n % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), n % 7)).alias("target"),
        F.when(n % 3 == 0, "hot/one.py").otherwise(F.concat(F.lit("f"), n % 1000)).alias("path"),
        (F.hash("id") % 5).alias("rule_ord"), n.alias("match_ord"))


def test_positions_equal_row_number(spark):
    df = rows_with_a_hot_group(spark)
    order = ["target", "path", "rule_ord", "match_ord"]
    got = with_positions(df, order, {"in_target": ["target"], "in_file": ["target", "path"]}).toPandas()
    want = df.toPandas().sort_values(order).reset_index(drop=True)
    want["in_target"] = want.groupby("target").cumcount()
    want["in_file"] = want.groupby(["target", "path"]).cumcount()
    got = got.sort_values(order).reset_index(drop=True)[want.columns]
    assert (got == want).all().all()
    assert len(got) == 30_000


def test_hot_group_spreads_over_blocks(spark):
    df = rows_with_a_hot_group(spark)
    ranged = df.repartitionByRange("target", "path", "rule_ord", "match_ord").withColumn("p", F.spark_partition_id())
    assert ranged.where("path = 'hot/one.py'").select("p").distinct().count() > 1


def test_thirteen_findings_make_two_batches(spark):
    df = spark.createDataFrame([("t", "p", i) for i in range(13)], "target string, path string, file_pos bigint")
    got = sorted((r.batch_no, r.batch_pos) for r in assign_batches(df).collect())
    assert got == [(0, i) for i in range(12)] + [(1, 0)]


def test_neighbor_lines_across_blocks(spark):
    from wardspark.operators.numbering import neighbor_lines

    texts = {"a": "\n".join(f"line {n}" for n in range(23)), "b": "", "c": "one\ntwo"}
    got = {(r.path, r.line_number): r.around for r in neighbor_lines(spark.createDataFrame(list(texts.items()), "path string, content string"), 3, block=5).collect()}
    want = {}
    for path, text in texts.items():
        lines = text.split("\n")
        for n in range(len(lines)):
            want[path, n + 1] = "\n".join(lines[max(0, n - 3) : n + 4])
    assert got == want
