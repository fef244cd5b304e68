import random

import pytest

from wardspark.llm import near_dedup
from wardspark.llm.components import components

from . import brute


def corpus(seed, copies=40):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    docs = []
    for _ in range(30):
        docs.append([word() for _ in range(r.randint(1, 120))])
    base = [word() for _ in range(100)]
    for _ in range(copies):  # copies of one text, with few to many changes
        w = list(base)
        for _ in range(r.randint(0, 9)):
            w[r.randrange(len(w))] = word()
        docs.append(w)
    chain = [word() for _ in range(80)]
    for _ in range(12):  # each alike to the one before only
        chain = [*chain[3:], *(word() for _ in range(3))]
        docs.append(chain)
    texts = [" ".join(w) for w in docs]
    texts += [texts[3], texts[3].upper(), "", None, " \t", "one two", "One  two", "one two three four five"]
    ids = r.sample(range(1000), len(texts))
    return list(zip(ids, texts, strict=True))


def as_rows(spark, docs):
    return spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, component_id string")


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_pairs(spark, seed):
    docs = corpus(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(as_rows(spark, docs)).collect()}
    assert got == brute.near_duplicates(docs)


def test_members_outside_the_main_component(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 3)
    docs = corpus(7, copies=25)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(as_rows(spark, docs)).collect()}
    assert got == brute.near_duplicates(docs)


def test_no_pair_is_compared_in_two_rounds(spark, monkeypatch):
    tried, confirm = [], near_dedup.confirm

    def spy(pairs, docs):
        pairs = near_dedup.written(pairs, "test-pairs")
        tried.append({(r.a, r.b) for r in pairs.collect()})
        return confirm(pairs, docs)

    monkeypatch.setattr(near_dedup, "confirm", spy)
    docs = corpus(7, copies=60)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(as_rows(spark, docs)).collect()}
    assert got == brute.near_duplicates(docs)
    assert len(tried) == 3 and all(tried[:2]) and sum(map(len, tried)) == len(set().union(*tried))


def test_a_pair_of_two_probes_is_proposed_by_one(spark):
    r = random.Random(2)
    words = [str(r.random()) for _ in range(60)]
    rows = []
    for i in range(4):  # different components, alike enough for the sketch test
        w = [*words, str(i)]
        grams = near_dedup.shingles(" ".join(w))
        bands = [7, *range(100 * i + 100, 100 * i + 99 + near_dedup.BANDS)]
        rows.append((7, i, i, near_dedup.odd_sketch(near_dedup.samples(grams, near_dedup.FINE_SAMPLES), near_dedup.FINE_WORDS).tolist(), bands, i > 0, 3, 4))
    members = spark.createDataFrame(rows, "key long, doc_id long, comp long, sketch array<long>, bands array<long>, outside boolean, n_probe long, n_all long")
    found = near_dedup.block_pairs(members.where("outside"), members, None)
    assert sorted(map(tuple, found.collect())) == [(a, b) for a in range(4) for b in range(a)]
    plain = type(members).distinct
    try:
        type(members).distinct = lambda self: self
        made = near_dedup.block_pairs(members.where("outside"), members, None).collect()
    finally:
        type(members).distinct = plain
    assert len(made) == 6


def test_repeated_rows_and_null_ids(spark):
    text = "a b c d e f g h"
    rows = [(5, text), (5, text), (None, text), (2, text + " "), (9, None), (None, None)]
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in near_dedup.near_duplicates(as_rows(spark, rows)).collect()), key=str)
    assert got == sorted([(5, 2, False), (5, 2, False), (None, None, True), (2, 2, True), (9, 9, True), (None, None, True)], key=str)
    left = near_dedup.one_of_each(as_rows(spark, rows))
    assert left.columns == ["doc_id", "text", "component_id"]
    assert sorted((r.doc_id for r in left.collect()), key=str) == [2, 9, None, None]


def test_empty_table(spark):
    assert near_dedup.near_duplicates(as_rows(spark, [])).collect() == []


def test_sketch_estimates_similarity():
    r = random.Random(3)
    words = [str(r.random()) for _ in range(1500)]
    a, b = near_dedup.shingles(" ".join(words)), near_dedup.shingles(" ".join(words[150:]))
    x, y = (near_dedup.odd_sketch(near_dedup.samples(g)) for g in (a, b))
    bits = sum(bin(int(p) ^ int(q) & (2**64 - 1)).count("1") if p >= 0 and q >= 0 else bin((int(p) ^ int(q)) & (2**64 - 1)).count("1") for p, q in zip(x, y, strict=True))
    assert near_dedup.most_different_bits(1.0) <= bits <= near_dedup.most_different_bits(0.7)


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(n, n + 1) for n in range(60)] + [(100, n) for n in range(101, 160)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(1, 61), 0), **dict.fromkeys(range(101, 160), 100)}
