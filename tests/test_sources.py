import os

from pyspark.sql import functions as F

from wardspark.functions.text import decode_content
from wardspark.operators.detect import scan
from wardspark.plans.scan import run_scan, scan_tree, scannable
from wardspark.rules import SHIPPED_RULES, rule
from wardspark.sources.tree import list_tree, read_contents, read_tree


def make_tree(root):
    files = {
        "a/__init__.py": b"@tool\n", "a/.cursorrules": b"[SYSTEM] x\r\n[HIDDEN] y\r[OVERRIDE]", "a/deep/er/x.tsx": b"exec(1)",
        "node_modules/m.py": b"@tool", "a/dist/m.py": b"@tool", "foo.egg-info/m.py": b"@tool", "a/skip.md": b"@tool",
        "b/bad.py": b"\xff@tool \xc3(", "top.json": b"{}", "b/Dist/k.py": b"@tool", "b/one.min.js": b"exec(1)",
    }
    for name, data in files.items():
        path = os.path.join(root, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as f:
            f.write(data)
    os.makedirs(os.path.join(root, "folder.py"))


def test_listing_follows_globs_and_pruning(spark, tmp_path):
    root = str(tmp_path)
    make_tree(root)
    got = {os.path.relpath(r.path, root) for r in list_tree(spark, [root]).collect()}
    assert got == {"a/__init__.py", "a/.cursorrules", "a/deep/er/x.tsx", "foo.egg-info/m.py", "b/bad.py", "top.json",
                   "b/Dist/k.py", "b/one.min.js", "folder.py"}
    one = list_tree(spark, [os.path.join(root, "a/skip.md"), os.path.join(root, "gone")]).collect()
    assert [r.path for r in one] == [os.path.join(root, "a/skip.md")]


def test_wide_directories_are_listed_in_parts(spark, tmp_path):
    want = set()
    for i in range(40):
        (tmp_path / f"d{i}" / "in").mkdir(parents=True)
        for name in (f"d{i}/a.py", f"d{i}/in/b.js", f"top{i}.ts"):
            (tmp_path / name).write_text("x")
            want.add(name)
    for shares in (1, 3, 8, 256):
        rows = [os.path.relpath(r.path, tmp_path) for r in list_tree(spark, [str(tmp_path)], shares=shares).collect()]
        assert len(rows) == len(want) and set(rows) == want, shares


def test_contents_decode_and_unreadable_files(spark, tmp_path):
    root = str(tmp_path)
    make_tree(root)
    rows = read_contents(list_tree(spark, [root])).collect()
    assert [os.path.basename(r.path) for r in rows if r.error] == ["folder.py"]
    text = {os.path.relpath(r.path, root): r.content for r in read_tree(spark, [root]).collect()}
    for name in text:
        with open(os.path.join(root, name), encoding="utf-8", errors="replace") as f:
            assert text[name] == f.read()
    found = sorted((os.path.relpath(r.path, root), r.rule_id, r.line_number) for r in scan(scannable(read_tree(spark, [root]).withColumn("target", F.lit(root)))).collect())
    assert ("a/.cursorrules", "PI-004", 3) in found and ("a/__init__.py", "FW-001", 1) in found
    assert not any(f[0].endswith("min.js") for f in found)


def test_single_file_target_bypasses_the_filters(spark, tmp_path):
    root = str(tmp_path)
    make_tree(root)
    one = os.path.join(root, "a/skip.md")
    rules = (rule("SC-001"), rule("FW-001"))
    (tmp_path / "a" / "skip.md").write_text("open('/etc/passwd')")
    result = scan_tree(spark, [one, root + "/", root + "/gone"], rules=rules)
    got = {r.target: (r.total_checks, r.summary.critical) for r in result.header.collect()}
    assert got == {one: (2, 1), root + "/": (2 * 9, 0), root + "/gone": (0, 0)}     # folder.py cannot be read but counts
    assert [r.path for r in result.missing.collect()] == [root + "/gone"]


def test_every_target_has_a_header_row(spark, tmp_path):
    (tmp_path / "full").mkdir()
    (tmp_path / "empty").mkdir()
    (tmp_path / "full" / "a.py").write_text("@tool\nos.system(c)\n")
    (tmp_path / "full" / "b.min.js").write_text("x")
    names = [str(tmp_path / n) for n in ("full", "empty", "gone")]
    result = scan_tree(spark, names)
    got = {r.target: (r.score, r.total_checks, r.summary.total, r.duration_ms > 0) for r in result.header.collect()}
    n = len(SHIPPED_RULES)
    assert got[names[0]][1:] == (2 * n, result.findings.count(), True)
    assert got[names[1]] == ("A+", 0, 0, True) and got[names[2]] == ("A+", 0, 1, True)
    assert [os.path.basename(r.path) for r in result.minified.collect()] == ["b.min.js"]
    assert {r.target: r.status for r in result.chain_status.collect()}[names[1]] == "too few findings"
    assert [r.l1_findings for r in result.tiers.collect()] == [result.findings.count()]


def test_missing_targets(spark, tmp_path):
    from wardspark.sources.tree import missing

    (tmp_path / "empty").mkdir()
    rows = missing(spark, [str(tmp_path / "empty"), str(tmp_path / "gone")]).collect()
    assert [(r.rule_id, r.severity, r.line_number, r.total_checks) for r in rows] == [("engine", "info", 0, 0)]
    assert rows[0].description == f"Path does not exist: {tmp_path / 'gone'}"


def test_decode_matches_python(spark):
    samples = [b"", b"ok\r\n\rx\n", b"\xf0\x9f\x98", b"\xed\xa0\x80z", b"\xc0\xaf", "héé".encode(), b"\xe2\x82", b"a\xffb"]
    df = spark.createDataFrame([(i, bytearray(s)) for i, s in enumerate(samples)], "i int, raw binary")
    for r in df.select("i", decode_content(F.col("raw")).alias("t")).collect():
        want = samples[r.i].decode("utf-8", errors="replace").replace("\r\n", "\n").replace("\r", "\n")
        assert r.t == want


def test_pipeline_depth_one(spark):
    files = spark.createDataFrame(
        [("t1", "t1/a.py", "@tool\nsubprocess.call(x)"), ("t1", "t1/b.md", "x"), ("t2", "t2/c.py", "x = 1"), ("t2", "t2/dist/d.py", "@tool")],
        "target string, path string, content string")
    got = {r.target: r for r in run_scan(files).header.collect()}
    assert got["t1"].score == "C" and got["t1"].summary.high == 2 and got["t1"].total_checks == len(SHIPPED_RULES)
    assert got["t2"].score == "A+" and got["t2"].owasp_coverage == {}
    assert got["t1"].owasp_coverage == {"AG-02": 1, "AG-10": 1, "LLM06": 2}


def test_own_detector_joins_the_pipeline(spark):
    from wardspark.rules.spec import RuleSpec

    long_file = RuleSpec("XX-003", "long_file", 95, "low", ("LLM02",), ("*",), "Long file", "The file is longer than it should be.", "Split it.", kind="custom")

    def detector(files):
        return files.where(F.length("content") > 10).select(
            "target", "path", F.lit(95).alias("rule_ord"), F.lit(0).alias("pattern_ord"), F.lit(1).alias("line_number"),
            F.lit(0).alias("match_ord"), F.lit("long").alias("note"), F.left("content", F.lit(5)).alias("code_snippet"))

    files = spark.createDataFrame([("t", "t/a.py", "@tool\n# padding"), ("t", "t/b.py", "x")], "target string, path string, content string")
    found = run_scan(files, rules=SHIPPED_RULES + (long_file,), detectors=(detector,)).findings
    assert sorted((r.rule_id, r.description, r.finding_index) for r in found.collect()) == [
        ("FW-001", "tool decorator without a confirmation guard", 0), ("XX-003", "long", 1)]


def test_unusable_rules_are_left_out(spark):
    from wardspark.rules.spec import Pattern, RuleSpec, usable_rules

    bad = RuleSpec("XX-001", "broken", 90, "low", (), ("*.py",), "t", "d", "f", (Pattern("(", "open group"),))
    own = RuleSpec("XX-002", "own", 91, "low", ("LLM01",), ("*_spec.py", "[ab]?.js"), "t", "d", "f", (Pattern(r"todo\d", "todo"),))
    good, left_out = usable_rules(spark, [rule("FW-001"), bad, own])
    assert [r.rule_id for r in good] == ["FW-001", "XX-002"] and left_out[0][0] == "XX-001"
    files = spark.createDataFrame([("x_spec.py", "TODO1"), ("x.py", "todo1"), ("a1.js", "todo2"), ("c1.js", "todo2")], "path string, content string")
    assert sorted((r.path, r.rule_id) for r in scan(files, good).collect()) == [("a1.js", "XX-002"), ("x_spec.py", "XX-002")]


def test_rows_of_one_row_group_are_dealt_out(spark, tmp_path):
    """A file cut into many splits is still read by one task if it has one row group."""
    from workload.corpora import TASK_ROWS, code_files, spread

    n = 5 * TASK_ROWS
    spark.range(n).selectExpr("id AS event_id", "id % 1500 AS user_id").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        rows = spark.read.parquet(str(tmp_path / "events.parquet"))
        assert rows.rdd.getNumPartitions() > spark.sparkContext.defaultParallelism
        for df in (spread(rows), code_files(spark, str(tmp_path))):
            sizes = df.rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect()
            assert sum(sizes) == n and max(sizes) < 1.1 * TASK_ROWS
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_small_even_and_empty_tables_are_read_as_they_are(spark):
    from workload.corpora import spread

    cores = spark.sparkContext.defaultParallelism
    assert spread(spark.range(1000, numPartitions=2 * cores)).rdd.getNumPartitions() == 2 * cores
    assert spread(spark.range(0)).count() == 0
