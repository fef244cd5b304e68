"""Verdicts, audits, chains and budgets on written-out cases."""

from pyspark.sql import functions as F

from wardspark.functions.replies import audit_fields, chain_fields
from wardspark.operators.triage import assign_batches, chain_budget, chain_parts, chain_prompts, join_audits, join_verdicts, read_chains, score_batches

FULL = "target string, path string, finding_index bigint, file_pos bigint, severity string"


LONG = [f'{{"index": {n}, "verdict": "NOISE"}}' for n in range(12)]

# a reply to the first batch of a file with 14 findings, and which of the 14 stay
# (12 and 13 are in the second batch, whose reply drops both unless the first names them)
REPLIES = [
    ('{"results": [{"verdict": "REAL"}, {"verdict": "NOISE"}, {"verdict": "real"}]}', {0, 2}),
    ('{"results": []}', set()),
    ('{"results": [{"index": 7}, {}]}', {0, 1}),
    ('{"results": [{"verdict": "REAL "}, {"verdict": "Real"}, {"verdict": "unsure"}]}', {1}),
    ('Sure! Here you are:\n{"results": [{"verdict": "REAL"}]}\nHope it helps', {0}),
    ('{"results": [{"verdict": "REAL"},\n{"verdict": "REAL"} // both\n]}', {0, 1}),
    ('{"results": [{"verdict": "REAL"} // first\r\n, {"verdict": "REAL"}]}', {0, 1}),
    ('{"results": [{"verdict": "REAL",\u00a0}]}', {0}),
    ('{"results": [{"verdict": "REAL"}],\n}', {0}),
    ('{"results": [{"verdict": "REAL"},]}', set()),
    ("{'results': [{'verdict': 'REAL'}]}", set()),
    ('{"results": [{"verdict": \'REAL\'}]}', set()),
    ("no JSON at all", set()),
    ("", set()),
    ('{"other": 1}', set()),
    ('{ so {"results": [{"verdict": "REAL"}]}', set()),
    ('{"results": {}}', set()),
    ('{"results": ""}', set()),
    ('{"results": null}', set(range(12))),
    ('{"results": 5}', set(range(12))),
    ('{"results": {"a": 1}}', set(range(12))),
    ('{"results": [{"verdict": "NOISE"}, "REAL"]}', set(range(12))),
    ('{"results": [{"verdict": null}]}', set(range(12))),
    ('{"results": [{"verdict": 3}]}', set(range(12))),
    ('{"results": [' + ", ".join(LONG) + ', {"index": 13, "verdict": "REAL"}]}', {13}),
    ('{"results": [' + ", ".join(LONG) + ', {"index": 4, "verdict": "REAL"}, {"index": 13, "verdict": "NOISE"}]}', {4}),
    ('{"results": [' + ", ".join(LONG) + ', {"verdict": "REAL"}]}', {12}),
    (None, set(range(12))),
]
REPLY = "target string, path string, batch_no int, reply string, error string"


def test_verdicts(spark):
    rows, replies = [], []
    for n, (reply, _) in enumerate(REPLIES):
        rows += [(f"t{n}", "p", i, i, "high") for i in range(14)]
        replies += [(f"t{n}", "p", 0, reply, None if reply is not None else "timeout"), (f"t{n}", "p", 1, '{"results": []}', None)]
    judged = join_verdicts(assign_batches(spark.createDataFrame(rows, FULL)), spark.createDataFrame(replies, REPLY)).collect()
    assert len(judged) == len(rows)
    for n, (reply, stay) in enumerate(REPLIES):
        assert {r.finding_index for r in judged if r.target == f"t{n}" and r.kept} == stay, reply


def test_repeated_replies_do_not_repeat_findings(spark):
    found = assign_batches(spark.createDataFrame([("t", "p", 0, 0, "high"), ("t", "p", 1, 1, "high")], FULL))
    replies = [("t", "p", 0, '{"results": [{"verdict": "REAL"}]}', None), ("t", "p", 0, None, "late"), ("t", "p", 0, '{"results": [{"verdict": "REAL"}]}', None)]
    got = join_verdicts(found, spark.createDataFrame(replies, REPLY)).collect()
    assert sorted((r.finding_index, r.kept) for r in got) == [(0, True), (1, False)]


def test_an_error_is_that_of_its_own_prompt(spark):
    texts = spark.createDataFrame([("t", "p", n, "bad" if n == 7 else f"text {n}") for n in range(50)], "target string, path string, batch_no int, batch_text string").coalesce(1)

    def scorer(batch):
        if "bad" in batch:
            raise RuntimeError("bad text")
        return [t.upper() for t in batch]

    for size in ("5", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        got = {r.batch_no: (r.reply, r.error) for r in score_batches(texts, scorer).collect()}
        assert got == {n: (None, "bad text") if n == 7 else (f"TEXT {n}", None) for n in range(50)}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert all(r.error for r in score_batches(texts, lambda batch: ["one", "two"]).collect())


def test_missing_reply_keeps_the_batch_and_failing_scorer_too(spark):
    found = assign_batches(spark.createDataFrame([("t", "p", 0, 0, "high")], FULL))
    none = spark.createDataFrame([], "target string, path string, batch_no int, reply string, error string")
    assert [r.kept for r in join_verdicts(found, none).collect()] == [True]

    def boom(texts):
        raise RuntimeError("down")

    texts = found.select("target", "path", "batch_no", F.lit("x").alias("batch_text"))
    scored = score_batches(texts, boom)
    assert [r.error for r in scored.collect()] == ["down"]
    assert [r.kept for r in join_verdicts(found, scored).collect()] == [True]


def test_audit_and_chain_replies(spark):
    df = spark.createDataFrame([
        (0, 'x {"attack_path": "a", "impact": "i", "tags": [1, ],} y'), (1, "nothing"), (2, '{"campaign_name": "c", "attack_chain": [{"stage_name": "s"}]}'),
        (3, "{ }"), (4, '{"a": 1} trailing }')], "i int, reply string")
    rows = {r.i: r for r in df.select("i", audit_fields(F.col("reply")).alias("a"), chain_fields(F.col("reply")).alias("c")).collect()}
    assert rows[0].a.attack_path == "a" and rows[0].a.fix == "" and rows[1].a.attack_path == ""
    assert rows[2].c.campaign_name == "c" and rows[2].c.risk_level == "HIGH" and rows[2].c.stages[0].stage == 1
    assert rows[1].c is None and rows[3].c is None and rows[4].c is None
    assert rows[0].c.campaign_name == "Unnamed Campaign" and rows[0].c.stages == []


def test_audit_status_and_old_suggestion(spark):
    f = spark.createDataFrame([("t", 0, "high", "", "old"), ("t", 1, "low", "", "old"), ("t", 2, "critical", "", ""), ("t", 3, "high", "", "old")],
                              "target string, finding_index bigint, severity string, attack_demo string, fix_suggestion string")
    a = spark.createDataFrame([("t", 0, '{"fix": "new"}', None), ("t", 1, '{"fix": "new"}', None), ("t", 2, '{"fix": "new", "attack_path": "p"}', None), ("t", 3, None, "e")],
                              "target string, finding_index bigint, reply string, error string")
    got = {r.finding_index: r for r in join_audits(f, a).collect()}
    assert [got[i].audit_status for i in range(4)] == ["audited", "skipped", "audited", "failed"]
    assert got[0].fix_suggestion == "[L3 DeepSeek Analysis]\nnew\n\n[L1 Suggestion]\nold" and got[0].attack_demo == ""
    assert got[2].fix_suggestion == "[L3 DeepSeek Analysis]\nnew" and got[2].attack_demo.startswith("## Attack Path\np\n\n## Exploit Demo\n")
    assert got[1].fix_suggestion == got[3].fix_suggestion == "old"


def test_budget_boundary_is_exact(spark):
    rows = [("t", i, "R", "high", "p", 1, "", "d" * 10, "") for i in range(5)]
    f = spark.createDataFrame(rows, "target string, finding_index bigint, rule_id string, severity string, path string, line_number int, title string, description string, attack_demo string")
    size = chain_budget(f).select(F.length("chain_text").alias("n")).first().n
    for limit, fit in ((3 * size, 3), (3 * size - 1, 2), (size - 1, 0), (99 * size, 5)):
        got = chain_budget(f, limit).collect()
        assert len(got) == fit and all(r.n_omitted == 5 - fit for r in got)


CHAINABLE = "target string, finding_index bigint, rule_id string, severity string, path string, line_number int, title string, description string, attack_demo string"


def plain_parts(lengths, limit):
    """Part of each text, from the rule in words."""
    ends = [sum(lengths[: i + 1]) for i in range(len(lengths))]
    base = max([e for e in ends if e <= limit], default=0)
    longest = max([n for n, e in zip(lengths, ends, strict=True) if e > limit and n <= limit // 2], default=0)
    places = [(-1, -1) if e <= limit else ((e - n - base) // (limit - longest), i if n > limit // 2 else -1) for i, (n, e) in enumerate(zip(lengths, ends, strict=True))]
    order = sorted(set(places))
    return [order.index(p) + (order[0] != (-1, -1)) for p in places]  # no part 0 where not even the first text fits


def test_parts_hold_every_finding_within_the_budget(spark):
    import random

    r = random.Random(1)
    sizes = {"a": [r.randint(0, 40) for _ in range(300)], "b": [500, 3, 500, 2, 900, 1], "c": [1], "hot": [r.choice((1, 5, 260)) for _ in range(400)]}
    rows = [(t, i, "R", "high", "p", 1, "", "d" * n, "") for t, ns in sizes.items() for i, n in enumerate(ns)]
    f = spark.createDataFrame(rows, CHAINABLE)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # many blocks, as large data has
    try:
        for limit in (400, 1000):
            got = chain_parts(f, limit).collect()
            assert len(got) == len(rows)
            budget = {(x.target, x.finding_index, x.used_chars, x.n_omitted) for x in chain_budget(f, limit).collect()}
            assert {(x.target, x.finding_index, x.used_chars, x.n_omitted) for x in got if x.part_no == 0 and x.used_chars <= limit} == budget
            for target in sizes:
                mine = sorted((x.finding_index, len(x.chain_text), x.part_no) for x in got if x.target == target)
                assert [p for _, _, p in mine] == plain_parts([n for _, n, _ in mine], limit)
                for part in {p for _, _, p in mine}:
                    inside = [n for _, n, p in mine if p == part]
                    assert sum(inside) <= limit or len(inside) == 1
                parts = sorted({p for _, _, p in mine})
                assert parts == list(range(parts[0], parts[-1] + 1)) and parts[0] == (mine[0][1] > limit)
            prompts = chain_prompts(chain_parts(f, limit)).collect()
            assert sum(p.n_included for p in prompts) == len(rows)
            assert all(("omitted" in p.prompt_text) == (p.part_no == 0 and p.n_omitted > 0) for p in prompts)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_reply_is_read_one_time(spark):
    """What the replies say is not worked out again for verdicts that name other findings."""
    found = spark.createDataFrame([("t", "t/a", i, 0, i) for i in range(3)], "target string, path string, finding_index long, batch_no int, batch_pos int")
    reply = '{"results": [{"verdict": "REAL"}, {"verdict": "NOISE"}, {"verdict": "NOISE"}, {"index": 2, "verdict": "REAL"}]}'
    replies = spark.createDataFrame([("t", "t/a", 0, reply, None)], "target string, path string, batch_no int, reply string, error string")
    judged = join_verdicts(found, replies)
    assert _plan(judged).count("from_json") == 0
    assert [r.kept for r in judged.orderBy("finding_index").collect()] == [True, False, True]


def test_chains_are_read_behind_a_distinct(spark):
    """The test for a chain stays above what gave the replies, so repeated rows are not read one by one."""
    rows = spark.range(1000).selectExpr("concat('t', id % 2) AS target").distinct()
    replies = rows.selectExpr("target", "concat('{\"attack_chain\": [{\"stage_name\": \"', target, '\"}]}') AS reply")
    chains = read_chains(replies).where("chain is not null")
    above, below = _plan(chains).split("Aggregate", 1)
    assert "from_json" in above and "from_json" not in below
    assert sorted(r.chain.stages[0].stage_name for r in chains.collect()) == ["t0", "t1"]
    nothing = read_chains(spark.createDataFrame([("t", "no chain"), ("u", None)], "target string, reply string"))
    assert [r.chain for r in nothing.collect()] == [None, None]
