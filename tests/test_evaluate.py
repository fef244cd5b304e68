"""Runs, layers and rule sets against plain counts."""

import random
import time
from itertools import combinations

from wardspark.operators.evaluate import layer_effect, match_layers, run_jaccard
from wardspark.operators.filters import by_rule_set

RUN = "run_id int, target string, finding_index int, severity string"


def plain_jaccard(rows, ids):
    sets = {r: {(t, i) for run, t, i, s in rows if run == r and s in ("high", "critical")} for r in ids}
    out = {}
    for a, b in combinations(sorted(ids), 2):
        both, either = len(sets[a] & sets[b]), len(sets[a] | sets[b])
        out[a, b] = (both, either, both / either if either else 1.0)
    return out


def test_jaccard_of_many_runs_plans_in_seconds(spark):
    r = random.Random(3)
    rows = [(run, "t", i, r.choice(["high", "low", "critical"])) for run in range(1, 201) for i in range(12) if r.random() < 0.8]
    rows += rows[:50]  # repeated rows count once
    ids = list(range(1, 201)) + [300]  # one without findings
    start = time.perf_counter()
    frame = run_jaccard(spark.createDataFrame(rows, RUN), ids, ["target", "finding_index"])
    frame._jdf.queryExecution().executedPlan()
    assert time.perf_counter() - start < 10
    got = {(x.run_a, x.run_b): (x.n_both, x.n_either, x.jaccard) for x in frame.collect()}
    assert got == plain_jaccard(rows, ids) and len(got) == 201 * 200 // 2


def test_jaccard_of_runs_without_findings(spark):
    got = run_jaccard(spark.createDataFrame([], RUN), [2, 1], ["target", "finding_index"]).collect()
    assert [(x.run_a, x.run_b, x.n_both, x.n_either, x.jaccard, x.passed) for x in got] == [(1, 2, 0, 0, 1.0, True)]


def test_both_layers_from_one_match(spark):
    judged = spark.createDataFrame(
        [("t", "a", "R", True), ("t", "a", "R", False), ("t", "b", "R", False), ("t", "c", "R", True), ("t", "d", "Q", True)],
        "target string, path string, rule_id string, kept boolean")
    truth = spark.createDataFrame(
        [("t", "a", "R", True, "high"), ("t", "b", "R", False, "high"), ("t", "c", "R", False, "low"), ("t", "e", "R", False, "low"), ("t", "c", "R", False, "low")],
        "target string, path string, rule_id string, is_vulnerable boolean, severity string")
    matched = match_layers(judged, truth)
    assert {(m.path, m.rule_id): (m.is_vulnerable, m.in_l1, m.in_l2) for m in matched.collect()} == {
        ("a", "R"): (True, True, True), ("b", "R"): (False, True, False), ("c", "R"): (False, True, True),
        ("e", "R"): (False, False, False), ("d", "Q"): (None, True, True)}
    severe = spark.createDataFrame([("t", 2), ("u", 1)], "target string, n_severe int")
    chains = spark.createDataFrame([("t",), ("t",)], "target string")
    row = layer_effect(matched, severe, chains).first()
    assert (row.fp_l1, row.fp_l2, row.chains_due, row.chains_present, row.noise_cut, row.passed) == (2, 1, 1, 1, 0.5, True)


def test_rule_sets_as_a_bag_from_one_read(spark):
    found = spark.createDataFrame([("A", 1), ("B", 2), ("C", 3), ("A", 4)], "rule_id string, n int")
    both = by_rule_set(found, {"x": ["A", "B"], "y": ["B"]})
    assert sorted(map(tuple, both.select("rule_set", "n").collect())) == [("x", 1), ("x", 2), ("x", 4), ("y", 2)]
    assert both._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") <= 1
