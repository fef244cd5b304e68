import random
import zlib
from pathlib import Path

import numpy as np
import pytest

from wardspark.llm import toxicity

SF = Path("/root/testdata/sf0.1")


def test_pairs_that_no_sum_of_weights_can_tell():
    r = random.Random(1)
    filler = [f"w{n}" for n in range(60)]
    rows, labels = [], []
    for _ in range(1500):
        a, b = r.random() < 0.5, r.random() < 0.5
        words = r.sample(filler, 5) + ["insult" if a else "praise"] + ["group" if b else "thing"]
        rows.append(" ".join(words))
        labels.append(float(a and b) if r.random() < 0.98 else 0.0)
    terms = [toxicity.TERMS.of_text(t) for t in rows]
    machine = toxicity.fit(terms, np.array(labels))
    score = lambda t: machine.score(toxicity.TERMS.of_text(t))
    assert score("an insult to a group") > 0.5
    assert max(score("an insult to a thing"), score("praise for a group"), score("praise for a thing")) < 0.5


def test_a_pair_of_terms_that_tell_nothing_alone():
    r = random.Random(5)
    filler = [f"w{n}" for n in range(60)]
    rows, labels = [], []
    for _ in range(3000):
        a, b = r.random() < 0.5, r.random() < 0.5
        rows.append(" ".join(r.sample(filler, 5) + ["insult"] * a + ["group"] * b))
        labels.append(float(a == b))
    labels = np.array(labels)
    terms = [toxicity.TERMS.of_text(t) for t in rows]
    pair = {t for w in ("insult", "group") for t in toxicity.TERMS.of_word(w)}
    assert not pair & set(toxicity.telling(terms, labels).tolist())
    assert set(toxicity.telling_pairs(terms, labels).tolist()) == pair
    machine = toxicity.fit(terms, labels)
    score = lambda t: machine.score(toxicity.TERMS.of_text(t))
    assert min(score("insult w1 group"), score("w1 w2")) > 0.5 > max(score("insult w1"), score("w2 group"))


def test_pairs_by_chance_are_not_taken():
    r = random.Random(6)
    terms = [toxicity.TERMS.of_text(" ".join(r.sample([f"v{n}" for n in range(300)], 40))) for _ in range(2000)]
    assert len(toxicity.telling_pairs(terms, np.array([float(r.random() < 0.2) for _ in terms]))) == 0
    assert len(toxicity.telling_pairs([np.zeros(0, np.int32)] * 5, np.array([1.0, 0, 0, 0, 1]))) == 0


def test_score_is_the_sum_over_pairs():
    r = np.random.default_rng(2)
    machine = toxicity.Machine(0.3, np.arange(toxicity.BUCKETS, dtype=np.int32) % 50, r.normal(size=50), r.normal(size=(50, 4)))
    terms = np.array([3, 9, 17, 41])
    pairs = sum(machine.factors[a] @ machine.factors[b] for n, a in enumerate(terms) for b in terms[n + 1 :])
    want = 1 / (1 + np.exp(-(0.3 + machine.weights[terms].sum() + pairs)))
    assert abs(machine.score(terms) - want) < 1e-12


def tables(spark):
    docs = [(n, ("you idiot " if n % 4 == 0 else "you friend ") + f"word{n % 7}", "x") for n in range(400)]
    docs += [(None, "you idiot", ""), (0, None, ""), (401, "", ""), (401, "", "")]
    labels = [(n, int(n % 4 == 0)) for n in range(400)] + [(None, 1), (5, None), (7, 0), (7, 0), (999, 1)]
    return spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_rows(spark):
    docs, labels = tables(spark)
    rows = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    assert len(rows) == 404
    for r in rows:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    texts = {(i, t) for i, t, _ in docs.collect()}
    wrong = [r for r in rows if r.doc_id and (r.doc_id, None) not in texts and r.doc_id < 400 and r.predicted != int(r.doc_id % 4 == 0)]
    assert not wrong


def test_without_labels_and_rows(spark):
    docs, labels = tables(spark)
    machine = toxicity.train(docs, labels.limit(0))
    assert {r.predicted for r in toxicity.score(docs, machine).collect()} <= {0, 1}
    assert toxicity.score(docs.limit(0), machine).collect() == []


def test_held_out_labels_are_not_learnt_from(spark):
    docs, labels = tables(spark)
    spoilt = labels.withColumn("toxic", toxicity.F.when(toxicity.held_out(toxicity.F.col("doc_id")), 1 - toxicity.F.col("toxic")).otherwise(toxicity.F.col("toxic")))
    a, b = toxicity.train(docs, labels), toxicity.train(docs, spoilt)
    assert a.bias == b.bias and (a.weights == b.weights).all()


@pytest.mark.skipif(not SF.exists(), reason="test tables not present")
def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = toxicity.score(docs, toxicity.train(docs, labels)).where("held_out").join(labels, "doc_id").collect()
    hits = sum(r.predicted and r.toxic for r in rows)
    assert hits / sum(r.predicted for r in rows) >= 0.95
    assert hits / sum(r.toxic for r in rows) >= 0.9
