"""Toxicity by a factorization machine over hashed terms (operator 6).

A text is the set of its hashed terms: lower-case words and their beginnings,
which inflected and compound words share.  The score is a bias, a weight for
each term, and for each pair of terms the product of their factor vectors, so
that an insult together with whom it is aimed at can count for more (or less)
than both alone.  It is fitted here, by AdaGrad on the logistic loss, on a
bounded sample of labelled texts (``TRAIN_ROWS``), and is then shipped as three
arrays of fixed size, whatever the corpus.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import extended, slices, strings

BUCKETS = 1 << 20
FACTORS = 4
#: Bound of the sample a machine is fitted on; which rows it takes is decided by a hash of their ids.
TRAIN_ROWS = 12_000
#: A term takes part if so many texts of the sample have it and it depends on the label by this likelihood ratio.
LEAST_TEXTS, LEAST_RATIO = 4, 12.0
#: The same for pairs of the most frequent terms; about the largest of a million ratios that depend on nothing.
PAIR_TERMS, PAIR_TEXTS, PAIR_RATIO = 1_500, 20, 45.0
#: A text with label 1 counts as so many at most, as many as there are others for each of them.
MOST_WEIGHT = 6.0
PREFIXES = (5, 6, 8)
EPOCHS, BATCH, RATE, DECAY = 12, 64, 0.08, 2e-4
CACHE = 500_000
WORD = re.compile(r"[^\W_]+")


def held_out(doc_id: Column) -> Column:
    """Rows no label is learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


class Terms:
    """Hashed terms of words, kept by worker (up to ``CACHE`` words, then it starts over)."""

    def __init__(self):
        self.known: dict[str, tuple[int, ...]] = {}

    def of_word(self, word: str) -> tuple[int, ...]:
        keys = [word, *(f"{word[:n]}*" for n in PREFIXES if len(word) >= n)]
        terms = tuple(xxhash.xxh3_64_intdigest(k) % BUCKETS for k in keys)
        if len(self.known) >= CACHE:
            self.known.clear()
        self.known[word] = terms
        return terms

    def of_text(self, text: str) -> np.ndarray:
        """Distinct terms, sorted."""
        known = self.known.get
        words = set(WORD.findall(text.lower()))
        return np.array(sorted({t for w in words for t in known(w) or self.of_word(w)}), np.int32)


TERMS = Terms()


@dataclass
class Machine:
    """Bias, weights and factor vectors; ``place`` gives the row of a term, 0 for unused ones."""

    bias: float
    place: np.ndarray
    weights: np.ndarray
    factors: np.ndarray

    def score(self, terms: np.ndarray) -> float:
        rows = self.place[terms]
        rows = rows[rows > 0]
        v = self.factors[rows]
        total = v.sum(0)
        x = self.bias + self.weights[rows].sum() + 0.5 * float(total @ total - (v * v).sum())
        return float(1 / (1 + np.exp(-np.clip(x, -30, 30))))


def telling(rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Terms whose presence depends on the label: those with a likelihood ratio of at least ``LEAST_RATIO``."""
    n, n1 = len(rows), labels.sum()
    every = np.concatenate(rows)
    seen = np.bincount(every, minlength=BUCKETS).astype(float)
    hits = np.bincount(every, np.repeat(labels, [len(r) for r in rows]), BUCKETS)
    return np.flatnonzero((seen >= LEAST_TEXTS) & (likelihood_ratio(seen, hits, n, n1) >= LEAST_RATIO))


def likelihood_ratio(seen: np.ndarray, hits: np.ndarray, n: int, n1: float) -> np.ndarray:
    """How much the label depends on presence: ``seen`` texts of ``n`` have it, ``hits`` of them among the ``n1`` with label 1."""

    def part(count: np.ndarray, of: np.ndarray, total: float) -> np.ndarray:
        return count * np.log(np.maximum(count, 1e-12) * n / np.maximum(of * total, 1e-12))

    miss, rest = seen - hits, n - seen
    return 2 * (part(hits, seen, n1) + part(miss, seen, n - n1) + part(n1 - hits, rest, n1) + part(n - n1 - miss, rest, n - n1))


def telling_pairs(rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Terms of pairs that tell the label together: the ratio of a pair of frequent terms, both present or not.

    The ``PAIR_TERMS`` most frequent terms that no more than four fifths of the texts have are tried, by products of the
    matrix of texts and terms.  A pair counts if its ratio is beyond what the best of so many pairs reaches by chance and well
    above that of either term alone.
    """
    n, n1 = len(rows), labels.sum()
    seen = np.bincount(np.concatenate(rows), minlength=BUCKETS)
    usable = np.flatnonzero((seen >= PAIR_TEXTS) & (seen <= 0.8 * n))
    used = np.sort(usable[np.argsort(-seen[usable], kind="stable")[:PAIR_TERMS]])
    if len(used) < 2:
        return used[:0]
    place = np.full(BUCKETS, -1)
    place[used] = np.arange(len(used))
    has = np.zeros((n, len(used)), np.float32)
    for i, r in enumerate(rows):
        at = place[r]
        has[i, at[at >= 0]] = 1
    both = (has.T @ has).astype(float)
    hits = (has.T @ (has * labels[:, None].astype(np.float32))).astype(float)
    ratio = likelihood_ratio(both, hits, n, n1)
    alone = np.diag(ratio).copy()
    np.fill_diagonal(ratio, 0)
    ratio[both < LEAST_TEXTS] = 0
    strong = (ratio >= PAIR_RATIO) & (ratio >= 1.5 * np.maximum(alone[:, None], alone[None, :]))
    return used[strong.any(1)]


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between neighbouring ``bounds`` along the first axis."""
    total = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0)])
    return total[bounds[1:]] - total[bounds[:-1]]


def fit(rows: list[np.ndarray], labels: np.ndarray, seed: int = 7) -> Machine:
    """A machine for terms of texts and their labels (0 or 1).  Without both labels it scores their share."""
    n = len(rows)
    share = (labels.sum() + 0.5) / (n + 1)
    place = np.zeros(BUCKETS, np.int32)
    bias = float(np.log(share / (1 - share)))
    if n and labels.min() != labels.max():
        used = np.union1d(telling(rows, labels), telling_pairs(rows, labels))
        place[used] = np.arange(1, len(used) + 1)
    size = int(place.max()) + 1
    random = np.random.default_rng(seed)
    weights, factors = np.zeros(size), random.normal(0, 0.01, (size, FACTORS))
    if size == 1:
        return Machine(bias, place, weights, np.zeros((1, FACTORS)))
    heavy = min(MOST_WEIGHT, max(1.0, float((n - labels.sum()) / labels.sum())))
    mapped = [p[p > 0] for p in (place[r] for r in rows)]
    g_bias, g_w, g_v = 1e-8, np.full(size, 1e-8), np.full((size, FACTORS), 1e-8)
    for _ in range(EPOCHS):
        order = random.permutation(n)
        for at in range(0, n, BATCH):
            batch = [mapped[i] for i in order[at : at + BATCH]]
            y = labels[order[at : at + BATCH]]
            bounds = np.cumsum([0, *map(len, batch)])
            terms = np.concatenate(batch)
            v = factors[terms]
            total = sums(v, bounds)
            x = bias + sums(weights[terms], bounds) + 0.5 * ((total**2).sum(1) - sums((v * v).sum(1), bounds))
            error = (1 / (1 + np.exp(-np.clip(x, -30, 30))) - y) * np.where(y > 0, heavy, 1.0) / len(y)
            each = np.repeat(error, np.diff(bounds))
            ids, inverse = np.unique(terms, return_inverse=True)
            d_w = np.bincount(inverse, each, len(ids)) + DECAY * weights[ids]
            pull = each[:, None] * (np.repeat(total, np.diff(bounds), axis=0) - v)
            d_v = np.stack([np.bincount(inverse, pull[:, f], len(ids)) for f in range(FACTORS)], 1) + DECAY * factors[ids]
            g_w[ids] += d_w**2
            g_v[ids] += d_v**2
            weights[ids] -= RATE * d_w / np.sqrt(g_w[ids])
            factors[ids] -= 0.3 * RATE * d_v / np.sqrt(g_v[ids])
            g_bias += error.sum() ** 2
            bias -= RATE * error.sum() / np.sqrt(g_bias)
    factors[0] = weights[0] = 0
    return Machine(float(bias), place, weights.astype(np.float32), factors.astype(np.float32))


def sample(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """``text`` and label of at most about ``most`` labelled rows outside the held-out fold."""
    usable = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    usable = usable.groupBy("doc_id").agg(F.max(label).alias("label"))
    count = usable.count()
    place = F.pmod(F.xxhash64(F.lit("train"), "doc_id"), F.lit(1_000_000))
    chosen = usable.where(place < int(1_000_000 * min(1.0, most / max(1, count))))
    # as many rows as the parameter allows, so its size is bounded
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "label")


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = TRAIN_ROWS) -> Machine:
    """Fit on a sample of the labelled rows.  Tasks make the terms; the driver gets those of the sample only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            terms = [TERMS.of_text(t) for t in strings(batch.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.list_(pa.int32())), batch.column(1)], names=["terms", "label"])

    rows = sample(docs, labels, label, most).mapInArrow(run, "terms array<int>, label int").toArrow()
    offsets = rows["terms"].combine_chunks()
    terms = [np.asarray(x.values, np.int32) for x in offsets]
    y = rows["label"].to_numpy().astype(float)
    order = np.lexsort([[xxhash.xxh3_64_intdigest(t.tobytes()) for t in terms], y]) if len(y) else []
    return fit([terms[i] for i in order], y[order] if len(y) else y)


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``; only the text goes into the score.

    Null and empty texts have no terms and score the bias.  Null ids count as not held out; repeated rows
    score alike; an empty table gives an empty result; other columns are not read.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(machine)
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    schema = extended(rows, ["doc_id", "held_out"], "score double, predicted int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = np.array([shipped.value.score(TERMS.of_text(t)) for t in strings(batch.column(2))], float)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found), pa.array((found >= 0.5).astype(np.int32))], names=schema.names)

    return rows.mapInArrow(run, schema)
