import random
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

from wardspark.llm import quality
from wardspark.llm.common import written
from wardspark.session import checkpoint_folder

from . import brute


def corpus(n=400):
    r = random.Random(4)
    vocabulary = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(400)]
    rows = []
    for i in range(n):
        words = [r.choice(vocabulary) for _ in range(r.randint(40, 300))]
        if i % 29 == 0:
            words = [w + "###$$" for w in words]
        lines = [" ".join(words[k : k + 12]) for k in range(0, len(words), 12)]
        if i % 31 == 0:
            lines = lines[:3] * 8
        rows.append((i, "\n".join(lines), r.choice(["en", "de", None]), r.choice(["a", "a", "a", "b", None])))
    return rows + [(None, None, None, None), (900, "", "en", "a"), (901, "it " * 400, "en", "a"), (901, "it " * 400, "en", "a"), (902, " \t\n", "xx", "y"),
                   (903, "a b\na b\n\n \na b", "en", "a"), (904, "x y z x y z x y", "en", "b")]


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, source string, n_words int")


def test_base_counts(spark):
    rows = corpus()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    got = [tuple(r) for r in quality.quality_rules(docs_of(spark, rows)).select("doc_id", *names).collect()]
    assert sorted(got, key=str) == sorted([(i, *brute.base_quality(t)) for i, t, _, _ in rows], key=str)


def bins_cut(bins, share):
    values, counts = np.unique(bins, return_counts=True)
    return values[np.cumsum(counts) >= share * len(bins)][0]


FLOORS = np.array(list(quality.FLOORS.values()))


def squares(x, centre, cov):
    d = x - centre
    return np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d)


def log_bin(d):
    return np.floor(np.log2(d + 1e-9) * quality.BINS)


def concentrate(x, centre, cov):
    """Steps from one start while the determinant falls."""
    best = np.inf
    for _ in range(30):
        bins = log_bin(squares(x, centre, cov))
        near = x[bins <= bins_cut(bins, quality.SHARE)]
        new = near.mean(0), np.cov(near.T, bias=True).reshape(len(FLOORS), -1) + np.diag(FLOORS**2)
        size = np.linalg.slogdet(new[1])[1]
        if size >= best - 1e-12:
            break
        best, (centre, cov) = size, new
    return best, centre, cov


def plain_starts(x):
    middle = np.array([(bins_cut(np.floor(c * 256), 0.5) + 0.5) / 256 for c in x.T])
    apart = np.abs(np.floor(x * 256) - np.floor(middle * 256))
    s = np.sqrt((1.4826 * np.array([(bins_cut(c, 0.5) + 0.5) / 256 for c in apart.T])) ** 2 + FLOORS**2)
    z = (x - middle) / s
    for v in (None, z / np.maximum(np.linalg.norm(z, axis=1), 1e-12)[:, None], np.tanh(z)):
        q = np.eye(len(s)) if v is None else v.T @ v
        size = np.sqrt(np.diag(q))
        r = q / np.maximum(np.outer(size, size), 1e-12)
        np.fill_diagonal(r, 1)
        yield middle, r * np.outer(s, s) + np.diag(FLOORS**2)


def plain_fit(x):
    """The estimate of one group: the smallest determinant over the starts."""
    size, centre, cov = min((concentrate(x, *start) for start in plain_starts(x)), key=lambda e: e[0])
    scale = 2 ** ((bins_cut(log_bin(squares(x, centre, cov)), 0.5) + 0.5) / quality.BINS) / quality.CHI2_MEDIAN
    return size, lambda v: squares(v, centre, cov) / scale


def judged_rows(spark, monkeypatch=None):
    stats = written(quality.with_statistics(docs_of(spark, corpus())), "test-stats")
    fitted = quality.fit(stats, least_rows=60)
    judged = quality.judge(stats, fitted).select(F.col("doc.doc_id").alias("doc_id"), "lang", "source", "base_failed", "distance", "kept", *quality.NAMES)
    return judged.toPandas(), {(r.lang, r.source): r.e for r in fitted.collect()}


def test_distances_against_plain_estimates(spark, monkeypatch):
    monkeypatch.setattr(quality, "LEAST_FALL", 1e-9)
    monkeypatch.setattr(quality, "STEPS", 15)
    rows, fitted = judged_rows(spark)
    good = rows[~rows.base_failed]
    names = list(quality.NAMES)
    r = np.random.default_rng(1)
    levels = set()
    for (lang, source), part in rows.groupby(["lang", "source"]):
        own = good[(good.lang == lang) & (good.source == source)]
        same = good[good.lang == lang]
        fit_on, level = (own, 0) if len(own) >= 60 else (same, 1) if len(same) >= 60 else (good, 2)
        x = fit_on[names].to_numpy()
        size, measure = plain_fit(x)
        e = fitted[lang, source]
        levels.add(e.level)
        assert e.level == level and abs(e.logdet - size) < 1e-6
        assert np.allclose(part.distance, measure(part[names].to_numpy()), rtol=1e-6)
        # random starts, as the fast algorithm takes them, find no set with a much smaller determinant
        found = []
        for _ in range(40):
            few = x[r.choice(len(x), 8, replace=False)]
            found.append(concentrate(x, few.mean(0), np.cov(few.T) + np.diag(FLOORS**2))[0])
        assert e.logdet <= min(found) + 0.1
    assert levels == {0, 1, 2}
    assert (rows.kept == (~rows.base_failed & (rows.distance <= quality.CUTOFF))).all()
    odd = rows[rows.doc_id.isin([29 * k for k in range(14)]) & ~rows.base_failed]
    assert not odd.kept.any()
    clean = rows[(rows.doc_id < 400) & (rows.doc_id % 29 != 0) & (rows.doc_id % 31 != 0) & ~rows.base_failed]
    assert clean.kept.all()


def test_many_groups_are_joined_by_salted_keys(spark, monkeypatch):
    want, _ = judged_rows(spark)
    monkeypatch.setattr(quality, "MOST_SHIPPED", 1)
    got, _ = judged_rows(spark)
    order = ["doc_id", *quality.NAMES, "lang", "source"]
    a, b = (x.sort_values(order).reset_index(drop=True) for x in (want, got))
    assert len(a) == len(b) and np.allclose(a.distance, b.distance) and (a.kept == b.kept).all()


def test_a_very_long_text(spark):
    text = "word other thing " * 200_000
    rows = [(i, t, "en", "a") for i, t, _, _ in corpus(80) if t] + [(7000, text, "en", "a"), (7001, "x" * 3_000_000 + " y", "en", "a")]
    got = {r.doc_id: r for r in quality.quality_rules(docs_of(spark, rows)).collect()}
    assert (got[7000].n_words, got[7000].n_repeat_words, got[7000].base_failed) == (600_000, 600_000, True)
    assert (got[7001].n_words, got[7001].word_chars) == (2, 3_000_001)


def test_kept_rows_have_their_columns(spark):
    docs = docs_of(spark, corpus(60))
    good = quality.keep_good(docs)
    assert good.columns == docs.columns
    kept = {r.doc_id for r in quality.quality_rules(docs).where("kept").collect()}
    assert {r.doc_id for r in good.collect()} == kept


def test_empty_table(spark):
    docs = docs_of(spark, corpus(5)).limit(0)
    assert quality.quality_rules(docs).collect() == [] and quality.keep_good(docs).collect() == []


def test_tables_of_sums_are_few_files_whatever_the_shuffle(spark):
    held = {"spark.sql.shuffle.partitions": "23", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    stats = written(quality.with_statistics(docs_of(spark, corpus())), "test-stats")
    before = {k: spark.conf.get(k) for k in held}
    there = set(Path(checkpoint_folder(spark).removeprefix("file:")).glob("mcd-*"))
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        fitted = quality.fit(stats, least_rows=60).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    made = set(Path(checkpoint_folder(spark).removeprefix("file:")).glob("mcd-*")) - there
    assert fitted and len(made) > 5
    assert max(len(list(d.glob("*.parquet"))) for d in made) <= spark.sparkContext.defaultParallelism
