import random
import re
import tracemalloc
from collections import Counter

import pytest

from wardspark.llm import repeats

from . import brute


def corpus(seed):
    r = random.Random(seed)
    text = lambda n: "".join(r.choice("abcde é\n") for _ in range(n))
    shared, half = text(900), text(430)
    rows = [(n, text(r.randint(0, 1500))) for n in range(12)]
    for n in range(12):  # a passage in many texts, also cut, at several places
        cut = shared[r.randint(0, 300) : r.randint(500, 900)]
        rows.append((20 + n, text(r.randint(0, 300)) + cut + text(r.randint(0, 200)) + (half if n % 3 == 0 else "")))
    rows += [(50, half + "x" + half), (51, "ab" * 900), (52, "ab" * 210), (53, rows[0][1]), (54, rows[13][1]), (55, "z" * 399), (56, "z" * 400), (57, "z" * 401)]
    near = list(text(1400))
    for n in range(8):
        for _ in range(3):
            near[r.randrange(len(near))] = r.choice("xyz")
        rows.append((60 + n, "".join(near)))
    return [*rows, (90, None), (90, ""), (None, shared), (None, None)]


@pytest.mark.parametrize("most", [repeats.MOST, 2])
@pytest.mark.parametrize(("length", "shorter"), [(400, None), (240, None), (400, 240), (400, 64)])
def test_against_brute_force(spark, most, length, shorter):
    rows = corpus(most)
    docs = spark.createDataFrame([(i, t, b"x") for i, t in rows], "doc_id long, text string, digest binary")
    got = [tuple(r) for r in repeats.digests(repeats.remove_repeats(docs, length, shorter, most)).collect()]
    texts = [t for _, t in rows]
    want = []
    for (i, t), x, y in zip(rows, brute.repeats(texts, length), brute.repeats(texts, shorter or length), strict=True):
        left = brute.left_of(*y).decode("utf-8", "ignore") if y[1].any() else t or ""
        want.append((i, *brute.repeat_row(*x), bool(y[1].any()), left))
    assert sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("length", [63, 100, 488])
def test_lengths_that_cannot_be_ranked(spark, length):
    with pytest.raises(ValueError):
        repeats.remove_repeats(spark.createDataFrame([], "doc_id long, text string"), length)


def test_a_very_long_text(spark):
    r = random.Random(9)
    long = "".join(r.choices("abcdefgh \n", k=5 << 20))  # longer than a segment
    passage = long[(1 << 22) - 200 : (1 << 22) + 260]  # over the border of two segments
    docs = spark.createDataFrame([(1, long), (2, "x" * 30 + passage), (3, passage[:390])], "doc_id long, text string")
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in repeats.remove_repeats(docs).select("doc.doc_id", "spans").collect()}
    assert got == {1: [((1 << 22) - 200, (1 << 22) + 260)], 2: [(30, 490)], 3: []}


def test_every_residue_pair_has_a_shift():
    for i, row in enumerate(repeats.SHIFTS):
        for j, d in enumerate(row):
            assert (i + d) % repeats.PERIOD in repeats.COVER and (j + d) % repeats.PERIOD in repeats.COVER


def test_segments_do_not_change_the_choice(monkeypatch):
    import numpy as np

    data = np.frombuffer(random.Random(1).randbytes(6000), np.uint8)
    whole = repeats.minimisers(data, 400)
    monkeypatch.setattr(repeats, "SEGMENT", 700)
    parts = repeats.minimisers(data, 400)

    def by_window(found):
        return {w: (k, p) for k, p, a, b in zip(*(x.tolist() for x in found), strict=True) for w in range(a, b + 1)}

    assert by_window(parts) == by_window(whole)


def test_cleaned_keeps_columns_and_rows(spark):
    passage = "".join(random.Random(2).choice("abcdefg ") for _ in range(500))
    rows = [(1, "head é" + passage, "en", 506), (2, passage + "tail", "de", 504), (3, "short", None, 5), (4, None, "en", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long")
    got = repeats.cleaned(docs)
    assert got.dtypes == docs.dtypes
    assert sorted(map(tuple, got.collect())) == [(1, "head é", "en", 6), (2, "tail", "de", 4), (3, "short", None, 5), (4, None, "en", None)]


def test_cuts_inside_characters(spark):
    shared = "é" * 300
    rows = [(1, shared + "ü1"), (2, shared + "ö2")]  # ü and ö start with the same byte
    docs = spark.createDataFrame([(i, t, None, len(t)) for i, t in rows], "doc_id long, text string, lang string, n_chars long")
    assert sorted((r.doc_id, r.text, r.n_chars) for r in repeats.cleaned(docs).collect()) == [(1, "1", 1), (2, "2", 1)]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert repeats.digests(repeats.remove_repeats(docs)).collect() == []


def test_a_block_takes_little_memory():
    r = random.Random(31)
    gram = r.randbytes(60)  # one bucket: all places around the gram tie
    bodies = [r.randbytes(120) + gram + r.randbytes(310) for _ in range(1500)]
    bodies += [b"z" * 100 + x[50:] for x in bodies[:300]]
    total = sum(map(len, bodies))
    tracemalloc.start()
    found = repeats.repeated(bodies, [90] * len(bodies), (240, 400))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 26 * total
    for length, hits in zip((240, 400), found, strict=True):
        starts = Counter(x[p : p + length] for x in bodies for p in range(90) if p + length <= len(x))
        assert [h.tolist() for h in hits] == [[p + length <= len(x) and starts[x[p : p + length]] > 1 for p in range(90)] for x in bodies]


def test_text_is_shuffled_once_with_its_row(spark, capsys):
    docs = spark.createDataFrame([(1, "a" * 500), (2, "b" * 500), (3, None)], "doc_id long, text string")
    capsys.readouterr()
    repeats.remove_repeats(docs).explain("formatted")
    plan = capsys.readouterr().out
    shuffled = [re.findall(r"(\w+)#", line) for line in re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*)\]", plan)]
    assert ["doc", "digest"] in shuffled and not any("text" in names for names in shuffled)
