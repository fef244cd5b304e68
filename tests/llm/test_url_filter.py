import random
from pathlib import Path

import duckdb
import pytest

from wardspark.llm import url_filter

SF = Path("/root/testdata/sf0.001")


@pytest.mark.parametrize("shard_keys", [10_000, 70])
def test_cascade_is_exact_over_its_universe(spark, shard_keys):
    keys = [f"k{n}" for n in range(3000)]
    listed = set(random.Random(1).sample(keys, 200))
    frame = lambda x: spark.createDataFrame([(k,) for k in x], "key string")
    built = list(url_filter.build(frame([*listed, None, *list(listed)[:5]]), frame([*keys, None, *keys[:10]]), shard_keys))
    assert len(built) == (1 if shard_keys > 200 else 3)
    rows = spark.createDataFrame([(n, keys[n : n + 7]) for n in range(0, 3000, 7)] + [(-1, None)], "n int, keys array<string>")
    got = {k for r in url_filter.look_up(rows, "keys", built).collect() for k in r["keys"]}
    assert got == listed


def test_no_listed_key(spark):
    none = spark.createDataFrame([], "key string")
    built = url_filter.build(none, spark.createDataFrame([("a",)], "key string"))
    rows = spark.createDataFrame([(["a"],)], "keys array<string>")
    assert url_filter.look_up(rows, "keys", built).first()["keys"] == []


CASES = [
    ("https://Example.ORG/es/x", "example.org", "/es/x", "example.org/es/", "block"),
    ("http://a.b.example.org/en/12?q=/es/", "a.b.example.org", "/en/12", "example.org/en/1", "block"),
    ("http://myexample.org/es/", "myexample.org", "/es/", "org/", "allow"),
    ("http://x.com/fr/#y", "x.com", "/fr/", "com/fr/", "allow"),
    ("http://x.com/FR/", "x.com", "/FR/", None, "allow"),
    ("http://x.com/de/", "x.com", "/de/", "com/de/", "block"),
    ("http://org", "org", "", None, "allow"),
    ("http://org/", "org", "/", "org/", "allow"),
    ("http://a.best-casino.net/x", "a.best-casino.net", "/x", None, "block"),
    ("http://casino.org/x", "casino.org", "/x", "org/", "allow"),
    ("http://casinos.net?x", "casinos.net", "", None, "allow"),
    ("a?b=http://x.com/de/", "x.com", "/de/", "com/de/", "block"),
    ("no scheme.org/es/", "", "", None, "allow"),
    (None, "", "", None, "allow"),
    ("", "", "", None, "allow"),
]


def test_cases(spark):
    rows = [(n, url, "x") for n, (url, *_) in enumerate(CASES)] + [(None, CASES[0][0], ""), (0, CASES[0][0], "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string")
    got = sorted((tuple(r) for r in url_filter.judge_urls(pages).drop("listed_host").collect()), key=str)
    want = [(n, *rest) for n, (_, *rest) in enumerate(CASES)] + [(None, *CASES[0][1:]), (0, *CASES[0][1:])]
    assert got == sorted(want, key=str)
    assert url_filter.judge_urls(pages.limit(0)).collect() == []


@pytest.mark.parametrize("shard_keys", [10_000, 3])
def test_a_list_table_of_hosts_and_paths(spark, shard_keys):
    blocked = spark.createDataFrame(
        [("Bad.net", None), ("half.net", "/x/y"), ("half.net", "/q/"), ("org", "/z"), ("", "/a"), (None, None), ("bad.net", "")], "host string, path string")
    cases = {
        "http://bad.net/a": "block", "http://a.bad.net": "block", "http://notbad.net/": "allow", "http://half.net/x": "allow", "http://half.net/x/y": "block",
        "http://www.half.net/x/y/z?q": "block", "http://half.net/x/yy": "allow", "http://half.net/q": "block", "http://half.net/q/1": "block", "http://half.net": "allow",
        "http://some.org/z/1": "allow", "http://half.net//x/y": "allow", "http://z.net/a": "allow"}  # the rule for org/ counts more than the list
    pages = spark.createDataFrame(list(enumerate(cases)), "page_id long, url string")
    got = {r.page_id: r.verdict for r in url_filter.judge_urls(pages, blocked=blocked, shard_keys=shard_keys).collect()}
    assert [got[n] for n in range(len(cases))] == list(cases.values())
    hosts = url_filter.judge_urls(pages, blocked=blocked.select("host"), shard_keys=shard_keys).where("page_id in (0, 3, 4)").collect()
    assert {r.verdict for r in hosts} == {"block"}


@pytest.mark.skipif(not SF.exists(), reason="test tables not present")
def test_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    got = url_filter.judge_urls(spark.read.parquet(f"{SF}/pages.parquet"))
    want = con.sql(url_filter.ORACLE)
    assert got.columns == want.columns
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(want.fetchall(), key=str)
