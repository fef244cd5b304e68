import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from wardspark.llm import phrases

from . import brute


def brute_mine(rows, least, most):
    totals, counts = Counter(), defaultdict(Counter)
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\\x0A-\\x0D]", brute.lower(text)):
            words = re.findall("[^\\x20\\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, 6):
                counts[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = set()
    for lang, n in totals.items():
        f = counts[lang]
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        rows_ = []
        for p, a in found.items():
            if any(a <= b and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in found.items() if len(q) > len(p)):
                continue
            score, _, l, r = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            rows_.append((" ".join(p), a, l, r, n, score))
        rows_.sort(key=lambda x: (-x[5], -x[1], x[0].encode()))
        out |= {(lang, rank, *row) for rank, row in enumerate(rows_[:most], 1)}
    return out


def corpus(seed):
    r = random.Random(seed)
    words = ["the", "of", "a", "é", "Zz", "b\x01", "b", "b\x00c", "x-y", "\x01"]
    ends = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", " ! ", "\x0b"]
    rows = []
    for _ in range(80):
        text = "".join(r.choice(words[: r.choice((3, 10))]) + r.choice(ends) for _ in range(r.randint(0, 60)))
        rows.append((r.choice(["en", "de", "und", None]), r.choice([text, text + "New York City Hall of Fame. ", "new york " * 3])))
    return [*rows, ("en", None), ("fr", ""), ("fr", "..!"), ("", "a b a b a b a b"), *rows[:3]]


def frame(spark, rows):
    return spark.createDataFrame([(n, *row, "x") for n, row in enumerate(rows)], "doc_id long, lang string, text string, words string")


def rows_of(result):
    return [tuple(r) for r in result.collect()]


@pytest.mark.parametrize("small", [False, True])
def test_against_brute_force(spark, monkeypatch, small):
    if small:  # bursting, spilling, new tables and small arrays
        for name, value in {"BURST": 3, "HELD": 20, "KNOWN": 6, "PLACES": 40, "BITS_EACH": 1, "SEGMENT_BITS": 64, "CHUNK": 16, "RUN_WINDOWS": 5, "RANGE_WINDOWS": 9}.items():
            monkeypatch.setattr(phrases, name, value)
    rows = corpus(small)
    for least, most in ((5, 2000), (2, 7)):
        got = rows_of(phrases.mine(frame(spark, rows), least, most))
        assert len(got) == len(set(got))
        assert set(got) == brute_mine(rows, least, most)


def test_a_full_filter_changes_nothing(spark, monkeypatch):
    rows = corpus(5)
    want = brute_mine(rows, 4, 2000)
    monkeypatch.setattr(phrases, "MOST_BITS", 64)
    monkeypatch.setattr(phrases, "SEGMENT_BITS", 64)
    assert set(rows_of(phrases.mine(frame(spark, rows), 4))) == want


def test_trie_keeps_counts_while_it_bursts_and_spills():
    r = random.Random(4)
    trie, want, got = phrases.HatTrie(4), Counter(), Counter()
    for _ in range(3000):
        ids = tuple(r.choice((1, 2, 3, 9)) for _ in range(r.randint(1, 5)))
        want[ids] += 2
        trie.add(ids, 2)
        if trie.entries > 200:
            for first in trie.largest(100):
                for found, n in trie.spill(first):
                    got[found] += n
            assert trie.entries <= 100 or len(trie.root) == 0
    for first in list(trie.root):
        for found, n in trie.spill(first):
            got[found] += n
    assert got == want and trie.entries == 0


def test_products_beyond_64_bits(spark):
    counts = spark.createDataFrame([("en", ["a"], 4 * 10**12), ("en", ["b"], 3 * 10**12), ("en", ["a", "b"], 2 * 10**12)], "lang string, words array<string>, n long")
    totals = spark.createDataFrame([("en", 9 * 10**13)], "lang string, n long")
    want = 1000 * 2 * 10**12 * 9 * 10**13 // (12 * 10**24)
    assert rows_of(phrases.best(counts, totals, 5)) == [("en", 1, "a b", 2 * 10**12, 4 * 10**12, 3 * 10**12, 9 * 10**13, want)]


def test_a_very_long_text(spark):
    text = "one two three four " * 400_000
    rows = [("en", text), ("en", "one two")]
    got = rows_of(phrases.mine(frame(spark, rows)))
    five = {(" ".join(("one two three four " * 3).split()[i : i + 5]), 399_999) for i in range(4)}
    assert {(p, a) for _, _, p, a, *_ in got} == five | {("one two three four", 400_000), ("one two", 400_001)}


def test_escapes_sort_words_as_wholes():
    words = [b"a", b"a\x01", b"a\x00b", b"\x00", b"\x01\x01"]
    assert [phrases.unescaped(phrases.escaped(w)) for w in words] == words
    assert all(phrases.GAP not in phrases.escaped(w) for w in words)


def test_empty_table(spark):
    assert phrases.mine(frame(spark, []).limit(0)).collect() == []
    assert np.all(~phrases.Filter(np.zeros(8, np.uint8)).has(np.arange(5, dtype=np.uint64)))


def test_rows_of_runs_are_short_and_totals_do_not_read_them(spark, monkeypatch):
    monkeypatch.setattr(phrases, "ROW_WINDOWS", 10)
    text = " ".join(f"so w{n}" for n in range(300)) + "\x00 . so w1 w2"
    every = spark.sparkContext.broadcast(phrases.Filter(np.full(8, 255, np.uint8)))
    runs = phrases.written(phrases.trie_runs(frame(spark, [("en", text)]).select("lang", "text"), [every] * 3), "runs")
    rows = runs.where("n > 0").collect()
    assert max(r.n for r in rows) == 10
    found = []
    for r in rows:
        windows, counts = phrases.unpacked(r.n, r.size, bytes(r.pack))
        assert (windows[0], windows[-1], len(windows)) == (r.first, r.last, r.n)
        assert windows == sorted(windows) and len(counts) == r.n
        found += zip(windows, counts, strict=True)
    want = Counter()
    for piece in text.split("."):
        words = [phrases.escaped(w.encode()) for w in piece.split()]
        want.update(phrases.GAP.join(words[i : i + 5]) for i in range(len(words)))
    assert dict(found) == want and len(found) == len(want)
    totals = phrases.language_totals(runs)
    assert rows_of(totals) == [("en", 603)]
    assert "pack" not in totals._jdf.queryExecution().executedPlan().toString()


def test_hashes_travel_in_packs(spark):
    rows = [("en", " ".join(f"w{n}" for n in range(3000))), ("en", "w1 w2 w3"), ("de", "w1 w2")]
    hashed = phrases.written(phrases.word_hashes(frame(spark, rows).coalesce(1).select("lang", "text")), "words")
    assert phrases.bucket_count(hashed) == phrases.LEAST_BUCKETS
    counts = phrases.hash_counts(hashed, [], 16).collect()
    assert len(counts) == 16  # 6,002 different hashes
    keys = np.concatenate([np.frombuffer(r.hashes, np.uint64) for r in counts])
    sums = np.concatenate([np.frombuffer(r.counts, np.uint8) for r in counts])
    assert len(keys) == len(set(keys.tolist())) == 6002 and sums.sum() == 6007
    assert all((np.frombuffer(r.hashes, np.uint64) >> np.uint64(60) == r.bucket).all() for r in counts)
    often = phrases.frequent_hashes(phrases.hash_counts(hashed, [], 16), 2).collect()
    assert sorted(r.h for r in often) == sorted(keys[sums >= 2].view(np.int64).tolist()) and len(often) == 5


def test_large_counts_and_batches_set_back(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    with phrases.small_batches(spark, 7):
        assert spark.conf.get(key) == "7"
        with phrases.small_batches(spark, 9):
            assert spark.conf.get(key) == "7"
    assert spark.conf.get(key) == before
    hashed = phrases.word_hashes(frame(spark, [("en", "a " * 70_000 + "b"), ("en", "a ! " * 300)]).coalesce(1).select("lang", "text"))
    often = phrases.frequent_hashes(phrases.hash_counts(hashed, [], 256), 70_300)
    assert len(often.collect()) == 1  # 70,300 of the word, 69,999 of the pair
    assert len(phrases.frequent_hashes(phrases.hash_counts(hashed, [], 256), 69_999).collect()) == 2
