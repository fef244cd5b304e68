"""Language identification by hyperdimensional profiles (operator 13).

Every letter has a random vector of ``SIZE`` signs, drawn from its code point.  Three
letters in a row are bound into one vector: the product of the first one's vector
rotated twice, the second one's rotated once, and the third one's.  Different letters or
another order give a nearly orthogonal vector.  A text is the bundle (sum) of its
3-letter vectors, each weighted by the root of how often it occurs, and so is a
language, of the 3-letter runs of all its texts.  What all languages have in common is
taken off the prototypes, and a text has the language whose prototype makes the
smallest angle with it.

Learning counts 3-letter runs by language in tasks, bundles the sums by blocks of runs,
and ships one vector for each language.  Prediction bundles many texts at once as a
product of a count matrix with the table of vectors, which a worker keeps up to a bound.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import extended, slices, strings

SIZE = 1024
NO_LANG = "und"
SEED = 20_011
#: Vectors of 3-letter runs a worker keeps; texts and different runs that are bundled together.
KEPT, TEXTS, RUNS = 40_000, 256, 16_000
#: Different runs a task counts before it empties its table.
HELD = 400_000
#: Characters of a text that are looked at together.
PART = 1 << 21
BITS = np.uint64(21)
CODE = np.uint64((1 << 21) - 1)


def held_out(doc_id: Column) -> Column:
    """Rows nothing is learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


class Letters:
    """Which code points are letters; filled by pages of 256 as texts ask for them."""

    def __init__(self):
        self.pages = np.zeros(0x110000 >> 8, bool)
        self.is_letter = np.zeros(0x110000, bool)

    def of(self, codes: np.ndarray) -> np.ndarray:
        for page in np.unique(codes >> 8).tolist():
            if not self.pages[page]:
                self.pages[page] = True
                self.is_letter[page << 8 : (page + 1) << 8] = [chr(c).isalpha() for c in range(page << 8, (page + 1) << 8)]
        return self.is_letter[codes]


LETTERS = Letters()


def runs(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The different 3-letter runs of a text, three code points in a number each, and their counts.

    Letters are lower-cased; whatever lies between two words counts as one space, at both ends too.  A text is looked at
    in parts of ``PART`` characters.
    """
    last, found = np.array([32], np.uint64), []
    for at in range(0, len(text) + 1, PART):
        codes = np.frombuffer(text[at : at + PART].lower().encode("utf-32-le", "replace"), np.uint32)
        codes = np.where(LETTERS.of(codes), codes, 32).astype(np.uint64)
        codes = np.concatenate([last, codes, [np.uint64(32)]] if at + PART > len(text) else [last, codes])
        gap = codes == 32
        codes = codes[~(gap & np.concatenate([[False], gap[:-1]]))]
        if len(codes) > 2:
            found.append(np.unique(codes[:-2] << BITS << BITS | codes[1:-1] << BITS | codes[2:], return_counts=True))
        last = codes[-2:]
    return found[0] if len(found) == 1 else summed(found)


def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    every = np.concatenate([np.zeros(0, np.uint64), *(x for x, _ in parts)])
    counts = np.concatenate([np.zeros(0, np.int64), *(n for _, n in parts)])
    unique, inverse = np.unique(every, return_inverse=True)
    return unique, np.bincount(inverse, counts, len(unique)).astype(np.int64)


class Vectors:
    """Vectors of 3-letter runs, made when asked for and kept up to a bound."""

    def __init__(self):
        self.letters: dict[int, np.ndarray] = {}
        self.rows: dict[int, int] = {}
        self.table = np.zeros((1024, SIZE), np.int8)

    def letter(self, code: int) -> np.ndarray:
        if code not in self.letters:
            self.letters[code] = np.random.default_rng((SEED, code)).integers(0, 2, SIZE, np.int8) * 2 - 1
        return self.letters[code]

    def of(self, found: np.ndarray) -> np.ndarray:
        """Vectors of different runs, one a row."""
        if len(self.rows) + len(found) > KEPT:
            self.rows.clear()
        at = []
        for run in found.tolist():
            row = self.rows.get(run)
            if row is None:
                row = self.rows[run] = len(self.rows)
                while row >= len(self.table):
                    self.table = np.concatenate([self.table, np.zeros_like(self.table)])
                first, second, third = (self.letter((run >> 21 * k) & 0x1FFFFF) for k in (2, 1, 0))
                self.table[row] = np.roll(first, 2) * np.roll(second, 1) * third
            at.append(row)
        return self.table[at]


VECTORS = Vectors()


def bundled(found: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Sums of run vectors by the columns of ``weights`` (a row for each run), a few thousand runs at a time."""
    out = np.zeros((weights.shape[1], SIZE), np.float32)
    for at in range(0, len(found), RUNS):
        out += weights[at : at + RUNS].T.astype(np.float32) @ VECTORS.of(found[at : at + RUNS]).astype(np.float32)
    return out


@dataclass
class Profiles:
    """Learnt languages in order, and a prototype of length 1 for each."""

    langs: list[str]
    prototypes: np.ndarray


def learn(docs: DataFrame) -> Profiles:
    """Prototypes from all texts with a language outside the held-out fold.

    Only ``text`` and ``lang`` are used (``doc_id`` tells the fold).  Null texts and texts without letters add nothing.  The
    driver gets ``SIZE`` numbers for each language, whatever the corpus.
    """
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        size = 0

        def emptied() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                unique, counts = summed(parts)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(unique), pa.string()), pa.array(unique.view(np.int64)), pa.array(counts)], names=["lang", "run", "n"])
            held.clear()

        for batch in slices(batches):
            for lang, text in zip(batch.column(0).to_pylist(), strings(batch.column(1)), strict=True):
                unique, counts = runs(text)
                if len(unique):
                    held.setdefault(lang, []).append((unique, counts))
                    size += len(unique)
            if size > 4 * HELD:
                for lang, parts in held.items():
                    held[lang] = [summed(parts)]
                size = sum(len(p[0][0]) for p in held.values())
                if size > HELD:
                    yield from emptied()
                    size = 0
        yield from emptied()

    counted = usable.select("lang", "text").mapInArrow(count, "lang string, run long, n long")
    counted = counted.groupBy("lang", "run").agg(F.sum("n").alias("n"))

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, found, counts = np.array(batch.column(0).to_pylist(), object), batch.column(1).to_numpy().view(np.uint64), batch.column(2).to_numpy()
            for lang in sorted(set(langs)):
                mine = langs == lang
                vector = bundled(found[mine], np.sqrt(counts[mine])[:, None])[0].astype(np.float64)
                total[lang] = total.get(lang, 0) + vector
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64()))], names=["lang", "vector"])

    parts = counted.mapInArrow(bundle, "lang string, vector array<double>")
    by_place = parts.select("lang", F.posexplode("vector")).groupBy("lang", "pos").agg(F.sum("col").alias("x"))
    rows = by_place.groupBy("lang").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("vector")).collect()
    rows.sort(key=lambda r: r.lang)
    vectors = np.array([unit(np.array(r.vector)) for r in rows]).reshape(len(rows), SIZE)
    if len(rows) > 1:
        vectors = np.array([unit(v) for v in vectors - vectors.mean(0)])
    return Profiles([r.lang for r in rows], vectors.astype(np.float32))


def unit(v: np.ndarray) -> np.ndarray:
    return v / max(float(np.sqrt((v * v).sum())), 1e-12)


def cosines(found: list[tuple[np.ndarray, np.ndarray]], prototypes: np.ndarray) -> np.ndarray:
    """Cosine of each text's bundle with each prototype."""
    every, inverse = np.unique(np.concatenate([f for f, _ in found]), return_inverse=True)
    text = np.repeat(np.arange(len(found)), [len(f) for f, _ in found])
    weights = np.zeros((len(every), len(found)), np.float32)
    weights[inverse, text] = np.sqrt(np.concatenate([c for _, c in found]))
    bundles = bundled(every, weights)
    length = np.sqrt((bundles.astype(np.float64) ** 2).sum(1))
    return (bundles @ prototypes.T) / np.maximum(length, 1e-12)[:, None]


def predict(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row of ``docs``; only the text goes into a prediction.

    Null and empty texts and texts without a letter are ``und`` with score 0, and so is everything where nothing was
    learnt.  The score is the cosine, at least 0 and at most 1; of equal ones the first language in order counts.
    Whole texts count, whatever their length.  Null ids count as not held out; repeated rows score alike; an empty table
    gives an empty result; other columns are not read.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(profiles)
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    schema = extended(rows, ["doc_id", "held_out"], "lang_pred string, score double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, prototypes = shipped.value.langs, shipped.value.prototypes
        for batch in slices(batches):
            found = [runs(t) for t in strings(batch.column(2))]
            named, scores = [NO_LANG] * len(found), np.zeros(len(found))
            some = [i for i, (f, _) in enumerate(found) if len(f)] if langs else []
            for at in range(0, len(some), TEXTS):
                part = some[at : at + TEXTS]
                angle = cosines([found[i] for i in part], prototypes)
                best = angle.argmax(1)
                for i, b, x in zip(part, best.tolist(), angle[np.arange(len(part)), best].tolist(), strict=True):
                    named[i], scores[i] = langs[b], min(1.0, max(0.0, x))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(named, pa.string()), pa.array(scores)], names=schema.names)

    return rows.mapInArrow(run, schema)


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the labelled rows outside the held-out fold, predict all rows (see ``predict``)."""
    return predict(docs, learn(docs))
