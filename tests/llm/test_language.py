import random
import zlib
from collections import Counter

import numpy as np
import pytest

from wardspark.llm import language


def plain_runs(text):
    spaced = "".join(c if c.isalpha() else " " for c in text.lower())
    words = spaced.split()
    if not words:
        return Counter()
    joined = " " + " ".join(words) + " "
    return Counter(joined[i : i + 3] for i in range(len(joined) - 2))


def plain_vector(run):
    letter = [np.random.default_rng((language.SEED, ord(c))).integers(0, 2, language.SIZE, np.int8).astype(int) * 2 - 1 for c in run]
    return np.roll(letter[0], 2) * np.roll(letter[1], 1) * letter[2]


def plain_bundle(counts):
    return sum((np.sqrt(n) * plain_vector(r) for r, n in counts.items()), np.zeros(language.SIZE))


def held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == 2


SYLLABLES = {"aa": "ka lo mi tu re", "bb": "sch ung der ein", "cc": "eau é oi que"}


def corpus(seed, n=120):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        lang = r.choice(list(SYLLABLES))
        text = " ".join("".join(r.choices(SYLLABLES[lang].split(), k=r.randint(1, 3))) for _ in range(r.randint(1, 60)))
        rows.append((i, r.choice([text, text.title(), text.replace(" ", ". ")]), lang))
    return [*rows, (900, None, "aa"), (901, "", "aa"), (902, "12 !? 　", "bb"), (903, "lomi tu", None), (None, "eauoi que", "cc"), (903, "lomi tu", None)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "s", 1) for r in rows], "doc_id long, text string, lang string, source string, run int")


def test_against_plain_vectors(spark):
    rows = corpus(1)
    sums = {}
    for i, text, lang in rows:
        if lang is not None and not held_out(i):
            sums.setdefault(lang, Counter()).update(plain_runs(text or ""))
    sums = {k: v for k, v in sums.items() if v}
    vectors = np.array([plain_bundle(sums[k]) for k in sorted(sums)])
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    vectors -= vectors.mean(0)
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    got = [tuple(r) for r in language.identify(frame(spark, rows)).select("doc_id", "held_out", "lang_pred", "score").collect()]
    assert len(got) == len(rows)
    want = []
    for i, text, _ in rows:
        runs = plain_runs(text or "")
        if not runs:
            want.append((i, held_out(i), "und", 0.0))
            continue
        bundle = plain_bundle(runs)
        angles = vectors @ bundle / np.linalg.norm(bundle)
        want.append((i, held_out(i), sorted(sums)[int(angles.argmax())], max(0.0, float(angles.max()))))
    key = lambda r: (str(r[0]), r[3])
    for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert a[:3] == b[:3] and a[3] == pytest.approx(b[3], abs=1e-4)


def test_held_out_accuracy(spark):
    rows = corpus(2, 400)
    got = {r.doc_id: r for r in language.identify(frame(spark, rows)).collect() if r.held_out}
    truth = {i: lang for i, text, lang in rows if held_out(i) and lang and text and any(c.isalpha() for c in text)}
    right = sum(got[i].lang_pred == lang for i, lang in truth.items())
    assert len(truth) > 60 and right >= 0.97 * len(truth)


def test_nothing_of_the_held_out_fold_is_learnt(spark):
    rows = corpus(3)
    changed = [(i, t, "zz" if held_out(i) else lang) for i, t, lang in rows]
    a, b = language.learn(frame(spark, rows)), language.learn(frame(spark, changed))
    assert a.langs == b.langs and np.allclose(a.prototypes, b.prototypes)


@pytest.mark.parametrize("part", [1 << 21, 40])
def test_runs_of_long_texts(monkeypatch, part):
    monkeypatch.setattr(language, "PART", part)
    text = "".join(random.Random(5).choices("abc é,Ñ1\n", k=3000))
    unique, counts = language.runs(text)
    named = {"".join(chr((u >> 21 * k) & 0x1FFFFF) for k in (2, 1, 0)): n for u, n in zip(unique.tolist(), counts.tolist(), strict=True)}
    assert named == plain_runs(text)


def test_bounds_do_not_change_bundles(monkeypatch):
    texts = [t for _, t, _ in corpus(4) if t and plain_runs(t)][:20]
    for name, value in {"KEPT": 50, "RUNS": 7}.items():
        monkeypatch.setattr(language, name, value)
    prototypes = np.eye(language.SIZE, dtype=np.float32)
    got = language.cosines([language.runs(t) for t in texts], prototypes)
    for text, row in zip(texts, got, strict=True):
        plain = plain_bundle(plain_runs(text))
        assert np.allclose(row, plain / np.linalg.norm(plain), atol=1e-5)


def test_nothing_learnt_and_empty_tables(spark):
    docs = frame(spark, [(1, "some text", None), (2, None, "aa")])
    assert sorted((r.doc_id, r.lang_pred, r.score) for r in language.identify(docs).collect()) == [(1, "und", 0.0), (2, "und", 0.0)]
    assert language.identify(docs.limit(0)).collect() == []
