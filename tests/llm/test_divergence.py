import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from wardspark.llm import divergence

from . import brute

TERM = re.compile("[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+")


def brute_audit(rows, least_docs=3, most=200):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        terms = TERM.findall(brute.lower(text))
        groups[lang].add(source)
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = set()
    for lang, sources in groups.items():
        kept = sorted(t for t, n in docs[lang].items() if n >= least_docs)
        price = {}
        whole = Counter({t: sum(counts[lang, s][t] for s in sources) for t in kept})
        for name, c in [(s, counts[lang, s]) for s in sources] + [(None, whole)]:
            total = sum(c[t] for t in kept)
            price[name] = {t: 1 + 1_000_000_000 * (c[t] + 1) // (total + len(kept)) for t in kept}
        for s in sources:
            pairs = [(o, sum((price[s][t] - price[o][t]) ** 2 // price[o][t] for t in kept)) for o in sources if o != s]
            terms = [(t, (price[s][t] - price[None][t]) ** 2 // price[None][t]) for t in kept if counts[lang, s][t] and price[s][t] > price[None][t]]
            for part, items, bound in (("pair", pairs, None), ("term", terms, most)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:bound]
                out |= {(lang, s, part, item, value, n) for n, (item, value) in enumerate(ranked, 1)}
    return out


def corpus(seed, n=60):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdéß") for _ in range(r.randint(1, 4))) for _ in range(60)] + ["X1y", "don't", "Ünd"]
    rows = []
    for _ in range(n):
        text = " ".join(r.choice(words[: r.choice((5, 20, 63))]) for _ in range(r.randint(0, 80)))
        rows.append((r.choice(["en", "de", None]), r.choice(["a", "b", "é", "z", None]), r.choice([text, text, text.upper()])))
    return [*rows, ("en", "a", None), ("fr", "only", "one two"), ("xx", "p", ""), ("xx", "q", "word"), ("", "a", "x"), rows[0], rows[0]]


def frame(spark, rows):
    return spark.createDataFrame([(n, *row, 1) for n, row in enumerate(rows)], "doc_id long, lang string, source string, text string, term int")


def rows_of(result):
    return [tuple(r) for r in result.collect()]


@pytest.mark.parametrize("small", [False, True])
def test_against_brute_force(spark, monkeypatch, small):
    rows = corpus(1 + small, 60)
    if small:  # every bound is met: blocks of groups and of terms, tables of tasks
        for name, value in {"GROUPS": 2, "TERMS": 7, "COLUMNS": 9, "CELLS": 12, "HELD": 20}.items():
            monkeypatch.setattr(divergence, name, value)
    for most in (200, 3):
        got = rows_of(divergence.audit(frame(spark, rows), most_terms=most))
        assert len(got) == len(set(got))
        assert set(got) == brute_audit(rows, most=most)


def test_products_hold_the_joint_tables():
    r = np.random.default_rng(3)
    table = r.integers(0, 4, (50, 3))
    at, group = np.nonzero(table)
    matrix, of_group, count = divergence.levels(at, group, table[at, group], 50, 3)
    joint = matrix.T @ matrix
    for i, (g, c) in enumerate(zip(of_group, count, strict=True)):
        for j, (h, d) in enumerate(zip(of_group, count, strict=True)):
            assert joint[i, j] == ((table[:, g] == c) & (table[:, h] == d)).sum()


def test_large_counts_stay_exact():
    counts = np.array([0, 7, 10**12, 9 * 10**12])
    n = 10**13 + 3
    assert divergence.prices(counts, n, 5).tolist() == [1 + 10**9 * (c + 1) // (n + 5) for c in counts.tolist()]


def test_very_long_text(spark, monkeypatch):
    monkeypatch.setattr(divergence, "CHUNK", 50)
    text = "alpha beta gamma " * 500
    rows = [("en", s, text + s) for s in "abcd"] + [("en", "a", "word" * 300)] * 3
    assert set(rows_of(divergence.audit(frame(spark, rows)))) == brute_audit(rows)


def test_empty_table(spark):
    assert divergence.audit(frame(spark, []).limit(0)).collect() == []
