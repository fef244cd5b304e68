"""Phrase collocation mining by HAT-trie counting (operator 12).

A phrase of up to five words counts as often as it stands within a piece of text.
Where five words begin at a place, all phrases beginning there are prefixes of them,
so one trie of such windows counts phrases of every length.

1. *Pruning.*  A phrase can only be frequent if all shorter phrases in it are.  Texts are written as
   hashes of their words, 8 bytes each, and three passes over these count
   hashes of words and pairs, then of triples of frequent pairs, then of four and five words with frequent
   triples.  Hashes go to where they are added up in packs of one range of hashes, some hundreds a row.
   What reaches ``least`` goes into a bit array of bounded size; a hash that
   two phrases share, or a full array, lets more through and changes no result.
2. *HAT-trie.*  A task puts the window of every place, cut where it stops being frequent, into a
   trie over its own word ids: shallow nodes above hash containers, which burst into nodes
   when they grow.  Beyond ``HELD`` entries the largest subtrees are spilled whole, as sorted runs,
   in packed rows of at most ``ROW_WINDOWS`` windows.
3. *Merge.*  Runs are cut at borders of prefix ranges and dealt by range.  Equal windows of a range are added up as they
   come, and the different ones walked in order.  A prefix is counted when the
   order leaves it; one that begins or ends a range is passed on in parts.  A prefix
   with any share of all windows spreads over as many ranges as it fills.
4. *Scores.*  Parts of a phrase are looked up in the counts by joins, salted because common
   words are parts of very many phrases.  All arithmetic is exact (decimals of 38 digits).
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import slices, written

LEAST = 100
WORDS = 5
MOST_RANKS = 2000
NO_LANG = "und"
#: Entries of a container before it bursts, levels of nodes that may hold containers, entries of a task's tries.
BURST, SHALLOW, HELD = 8192, 3, 150_000
#: Words of the tables a task keeps, and places it looks at together.
KNOWN, PLACES = 150_000, 250_000
#: Bits of the array for a frequent hash, and of the whole array at most (64 MB).
BITS_EACH, MOST_BITS, SEGMENT_BITS = 64, 1 << 29, 1 << 20
#: Windows of a sorted run and of a range of prefixes (about); rows of runs whose first windows tell the borders of the ranges.
RUN_WINDOWS, RANGE_WINDOWS, BORDER_RUNS = 20_000, 100_000, 20_000
#: Windows of a row of a run at most: readers and writers of Parquet hold a hundred rows of a page and more at once.
ROW_WINDOWS = 2_000
#: Places whose hashes are added up together (about), and into how many ranges hashes are dealt at least.
BUCKET_PLACES, LEAST_BUCKETS = 500_000, 256
#: Where in a hash the places of its two bits begin.
PROBES = (3, 34)
#: Parts of phrases are looked up in so many copies of the counts.
SALTS = 8
CHUNK = 4 << 20
#: Rows that go to a Python worker in one batch; an executor holds a batch several times outside its heap, for every task.
BATCH_ROWS = 1_000

#: Fixed values, for ``bytes.translate``: A-Z to a-z, tab to space, and what ends a piece to a byte that UTF-8 never has.
END = b"\xff"
FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else 0xFF if chr(c) in ".,;:!?\n\v\f\r" and c < 0x80 else 0x20 if c == 9 else c for c in range(256))

MIX_A, MIX_B, SHIFT = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(33)
#: Control bytes that ``bytes.split`` does not take for white space need no care; these two order the words of a window.
GAP, ESCAPE = b"\x00", b"\x01"


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> SHIFT)) * MIX_A
    x = (x ^ (x >> SHIFT)) * MIX_B
    return x ^ (x >> SHIFT)


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs that run meanwhile send at most so many rows to Python at once.  No result hangs on it; what was set is set again."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = int(spark.conf.get(key))
    if 0 < before <= rows:
        yield
        return
    spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


class Vocabulary(dict):
    """Ids of a task's words in order of appearance; 0 ends a piece.  ``words`` are as windows are made of, ``hashes`` never 0."""

    def __init__(self):
        super().__init__({END: 0})
        self.words: list[bytes] = [END]
        self.hashes = np.zeros(1024, np.uint64)

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self.words)
        self.words.append(escaped(word))
        if n == len(self.hashes):
            self.hashes = np.concatenate([self.hashes, np.zeros(n, np.uint64)])
        self.hashes[n] = xxhash.xxh3_64_intdigest(word) | 1
        return n

    def ids(self, text: bytes) -> np.ndarray:
        """Ids of the words of a whole text, with ends of pieces between them and behind the last."""
        data = text.translate(FOLD)
        parts, at = [], 0
        while at < len(data):
            cut = data.find(b" ", at + CHUNK) if len(data) - at > CHUNK else -1
            part = data[at : cut if cut >= 0 else len(data)]
            words = part.replace(END, b" \xff ").split()
            parts.append(np.fromiter(map(self.__getitem__, words), np.int32, len(words)))
            at += len(part)
        return np.concatenate([*parts, np.zeros(1, np.int32)])


def escaped(word: bytes) -> bytes:
    """The word without the byte between words, so that windows sort as a trie is walked."""
    return word.replace(ESCAPE, b"\x01\x02").replace(GAP, b"\x01\x01") if ESCAPE in word or GAP in word else word


def unescaped(word: bytes) -> bytes:
    return word.replace(b"\x01\x01", GAP).replace(b"\x01\x02", ESCAPE) if ESCAPE in word else word


class Places:
    """Word arrays of many texts by language, given out on end, about so many places at once or one text."""

    def __init__(self, together: int):
        self.together = together
        self.held: dict[str, list[np.ndarray]] = {}
        self.sizes: dict[str, int] = {}

    def put(self, lang: str, words: np.ndarray) -> Iterator[tuple[str, np.ndarray]]:
        self.held.setdefault(lang, []).append(words)
        self.sizes[lang] = self.sizes.get(lang, 0) + len(words)
        if self.sizes[lang] >= self.together:
            yield lang, self.out(lang)
        if sum(self.sizes.values()) >= 2 * self.together:
            yield from self.rest()

    def out(self, lang: str) -> np.ndarray:
        del self.sizes[lang]
        return np.concatenate(self.held.pop(lang))

    def rest(self) -> Iterator[tuple[str, np.ndarray]]:
        for lang in list(self.held):
            yield lang, self.out(lang)


def word_hashes(texts: DataFrame) -> DataFrame:
    """``lang, words, places``: the hashes of the words of every text, 0 where a piece ends, as bytes, and how many these are."""
    most_words = KNOWN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary()
        for batch in slices(batches, 2 << 20):
            ids = [vocabulary.ids(t) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            words = [vocabulary.hashes[i].tobytes() for i in ids]  # the table grows while ids are given
            places = pa.array([len(i) for i in ids], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.binary()), places], names=["lang", "words", "places"])
            if len(vocabulary) > most_words:
                vocabulary = Vocabulary()

    return texts.mapInArrow(run, "lang string, words binary, places long")


def gram_hashes(lang: str, words: np.ndarray) -> list[np.ndarray]:
    """Hashes of the one to five words that begin at each place, and 0 where a piece ends before."""
    word = np.where(words != 0, mixed(words ^ np.uint64(xxhash.xxh3_64_intdigest(lang))) | np.uint64(1), np.uint64(0))
    out = [word]
    for n in range(1, WORDS):
        later = ahead(word, n)
        both = (out[-1] != 0) & (later != 0)
        out.append(np.where(both, mixed(out[-1] + later * MIX_B) | np.uint64(1), np.uint64(0)))
    return out


class Filter:
    """A bit array with two bits for each frequent hash."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.mask = bits, np.uint64(8 * len(bits) - 1)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        out = hashes != 0
        for shift in PROBES:
            at = (hashes >> np.uint64(shift)) & self.mask
            out &= (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return out


def added_up(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """All different hashes in order, and the sums of their counts."""
    keys = np.concatenate([np.zeros(0, np.uint64), *(k for k, _ in held)])
    counts = np.concatenate([np.zeros(0, np.int64), *(c for _, c in held)])
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts[order], first) if len(keys) else counts


def frequent_hashes(counts: DataFrame, least: int) -> DataFrame:
    """``h``: the hashes with sums of at least ``least``.  Packs of one range of hashes meet in one task and are added up there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []

        def often() -> pa.RecordBatch:
            keys, sums = added_up(held)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(keys[sums >= least].view(np.int64))], names=["h"])

        for batch in slices(batches, 4 << 20):
            for bucket, hashes, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and bucket != last:
                    yield often()
                last = bucket
                keys = np.frombuffer(hashes, np.uint64)
                held.append((keys, np.frombuffer(n, f"u{len(n) // len(keys)}").astype(np.int64)))
        if held:
            yield often()

    return counts.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "h long")


def frequent(counts: DataFrame, least: int) -> Broadcast:
    """The hashes with sums of at least ``least``, as a shipped ``Filter``.  Tasks make its segments; the size has a bound."""
    spark = counts.sparkSession
    often = written(frequent_hashes(counts, least), "often")
    wanted = max(SEGMENT_BITS, min(MOST_BITS, often.count() * BITS_EACH))
    size = 1 << (wanted - 1).bit_length()
    probes = F.array(*[F.shiftrightunsigned("h", shift).bitwiseAND(F.lit(size - 1)) for shift in PROBES])
    bits = often.select(F.explode(probes).alias("at")).withColumn("segment", F.floor(F.col("at") / SEGMENT_BITS).cast("int")).repartition("segment").sortWithinPartitions("segment")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, marks = None, np.zeros(SEGMENT_BITS, np.uint8)

        def segment() -> pa.RecordBatch:
            packed = np.packbits(marks, bitorder="little").tobytes()
            marks[:] = 0
            return pa.RecordBatch.from_pydict({"segment": pa.array([last], pa.int32()), "bits": pa.array([packed], pa.binary())})

        for batch in batches:
            at, of = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for n in np.unique(of).tolist():
                if last is not None and n != last:
                    yield segment()
                last = n
                marks[at[of == n] - n * SEGMENT_BITS] = 1
        if last is not None:
            yield segment()

    array = np.zeros(size // 8, np.uint8)
    for row in bits.mapInArrow(run, "segment int, bits binary").collect():  # as many bytes as the array has, at most
        start = row.segment * (SEGMENT_BITS // 8)
        array[start : start + SEGMENT_BITS // 8] = np.frombuffer(row.bits, np.uint8)
    return spark.sparkContext.broadcast(Filter(array))


def ahead(x: np.ndarray, n: int) -> np.ndarray:
    return np.concatenate([x[n:], np.zeros(n, x.dtype)])[: len(x)]


def may_be_frequent(grams: list[np.ndarray], filters: list[Filter]) -> list[np.ndarray]:
    """For each length, at which places it can begin a frequent phrase, as far as there are filters.

    The filters hold words and pairs, triples, and four and five words.  One length more than they
    know is judged by the shorter phrases in it.
    """
    out = [filters[0].has(grams[0])]
    for n in range(1, WORDS):
        inside = out[-1] & ahead(out[-1], 1)
        known = (0, 0, 1, 2, 2)[n]
        out.append(inside & (filters[known].has(grams[n]) if known < len(filters) else grams[n] != 0))
    return out


def bucket_count(hashed: DataFrame) -> int:
    """Into how many ranges hashes are dealt: as many as hold about ``BUCKET_PLACES`` each, a power of two."""
    places = hashed.agg(F.sum("places")).first()[0] or 0
    return 1 << (max(LEAST_BUCKETS, places // BUCKET_PLACES) - 1).bit_length()


def hash_counts(hashed: DataFrame, filters: list[Broadcast], buckets: int) -> DataFrame:
    """``bucket, hashes, counts``: counts of words and pairs, with one filter of triples, with two of four and five words.

    These are partial sums; a row has those of one of ``buckets`` equal ranges of hashes, as bytes, its counts in as few as they need.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered, held = Places(PLACES), []
        shift = np.uint64(65 - buckets.bit_length())

        def places() -> Iterator[tuple[str, np.ndarray]]:
            for batch in slices(batches):
                for lang, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    yield from gathered.put(lang, np.frombuffer(words, np.uint64))
            yield from gathered.rest()

        def rows() -> Iterator[pa.RecordBatch]:
            all_keys, all_counts = added_up(held)
            held.clear()
            for at in range(0, len(all_keys), 100_000):
                keys, counts = all_keys[at : at + 100_000], all_counts[at : at + 100_000]
                bucket, first = np.unique(keys >> shift, return_index=True)
                starts = pa.py_buffer((np.append(first, len(keys)) * 8).astype(np.int32))
                hashes = pa.Array.from_buffers(pa.binary(), len(bucket), [None, starts, pa.py_buffer(keys)])
                narrow = pa.array([c.astype(np.min_scalar_type(c.max())).tobytes() for c in np.split(counts, first[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(bucket.astype(np.int32)), hashes, narrow], names=["bucket", "hashes", "counts"])

        for lang, words in places():
            grams = gram_hashes(lang, words)
            if filters:
                fine = may_be_frequent(grams, [f.value for f in filters])
                more = [np.where(fine[n], grams[n], np.uint64(0)) for n in ((2,), (3, 4))[len(filters) - 1]]
            else:
                more = grams[:2]
            held += [np.unique(m[m != 0], return_counts=True) for m in more]
            if sum(len(k) for k, _ in held) > 4 * PLACES:
                held[:] = [added_up(held)]
                if len(held[0][0]) > 2 * PLACES:
                    yield from rows()
        yield from rows()

    return hashed.select("lang", "words").mapInArrow(run, "bucket int, hashes binary, counts binary")


class HatTrie:
    """Counts of id sequences: nodes over hash containers.  A container maps the rest of a sequence to its count."""

    def __init__(self, most: int = BURST):
        self.root: dict[int, list] = {}  # first id -> entries, table, whether the table is a node
        self.entries, self.most = 0, most

    def add(self, ids: tuple[int, ...], n: int) -> None:
        subtree = self.root.get(ids[0])
        if subtree is None:
            subtree = self.root[ids[0]] = [0, {}, False]
        holder, depth = subtree, 1
        while holder[2]:  # a node: one holder for each next id, and the count of what ends here under -1
            step = ids[depth] if depth < len(ids) else -1
            below = holder[1].get(step)
            if below is None:
                below = holder[1][step] = [0, {}, False]
            holder, depth = below, depth + 1
        rest = ids[depth:]
        table = holder[1]
        if rest in table:
            table[rest] += n
            return
        table[rest] = n
        subtree[0] += 1
        self.entries += 1
        if len(table) > self.most and depth <= SHALLOW:
            self.burst(holder)

    @staticmethod
    def burst(holder: list) -> None:
        node: dict[int, list] = {}
        for rest, n in holder[1].items():
            below = node.setdefault(rest[0] if rest else -1, [0, {}, False])
            below[1][rest[1:]] = n
        holder[1], holder[2] = node, True

    def largest(self, left: int) -> list[int]:
        """First ids of the largest subtrees, so many that at most ``left`` entries stay."""
        out, stay = [], self.entries
        for first in sorted(self.root, key=lambda i: -self.root[i][0]):
            if stay <= left:
                break
            out.append(first)
            stay -= self.root[first][0]
        return out

    def spill(self, first: int) -> list[tuple[tuple[int, ...], int]]:
        """All sequences of a subtree, which goes."""
        subtree = self.root.pop(first)
        self.entries -= subtree[0]
        if not subtree[2]:
            return [((first, *rest), n) for rest, n in subtree[1].items()]
        out, stack = [], [((first,), subtree)]
        while stack:
            ids, (_, table, is_node) = stack.pop()
            if is_node:
                stack += [(ids if step < 0 else (*ids, step), below) for step, below in table.items()]
            else:
                out += [((*ids, *rest), n) for rest, n in table.items()]
        return out


#: Numbers of windows and of bytes before packing, and the pack.
PACK = [("n", pa.int64()), ("size", pa.int64()), ("pack", pa.binary())]
RUN = pa.schema([("lang", pa.string()), ("total", pa.int64()), ("first", pa.binary()), ("last", pa.binary()), *PACK])
RUN_DDL = "lang string, total long, first binary, last binary, n long, size long, pack binary"


def packed(found: list[bytes], counts: list[int]) -> tuple[int, int, bytes]:
    """Windows and their counts, as the columns ``PACK``."""
    raw = np.array(counts, np.int64).tobytes() + END.join(found)
    return len(found), len(raw), pa.compress(raw, codec="zstd", asbytes=True)


def unpacked(n: int, size: int, pack: bytes) -> tuple[list[bytes], list[int]]:
    raw = pa.decompress(pack, decompressed_size=size, codec="zstd", asbytes=True)
    return raw[8 * n :].split(END), np.frombuffer(raw, np.int64, n).tolist()


def windows(lang: str, ids: np.ndarray, hashes: np.ndarray, filters: list[Filter]) -> tuple[np.ndarray, np.ndarray]:
    """Different windows of the places whose word is frequent (rows of ids, 0 behind the end) and their counts."""
    go_on = may_be_frequent(gram_hashes(lang, hashes[ids]), filters)
    begins = go_on[0]
    columns = [np.where(ok, ahead(ids, n), 0) for n, ok in enumerate(go_on)]
    rows = np.stack([c[begins] for c in columns], 1).astype(np.int64)
    if not len(rows):
        return rows, np.zeros(0, np.int64)
    keys = (rows[:, 4], rows[:, 2] << 32 | rows[:, 3], rows[:, 0] << 32 | rows[:, 1])
    order = np.lexsort(keys)
    new = np.zeros(len(rows), bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[order[1:]] != k[order[:-1]]
    first = np.flatnonzero(new)
    return rows[order[first]], np.diff(np.concatenate([first, [len(rows)]]))


def trie_runs(texts: DataFrame, filters: list[Broadcast]) -> DataFrame:
    """``lang, total, first, last, n, size, pack``: sorted runs of spilled subtrees, a stretch of one a row.

    A row without windows tells in ``total`` the words of a task.  ``first`` and ``last`` windows can be read without the others.
    """
    run_windows, row_windows = RUN_WINDOWS, ROW_WINDOWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, tries, totals = Vocabulary(), {}, {}
        gathered, most_words = Places(PLACES), KNOWN

        def spilled(lang: str, trie: HatTrie, left: int) -> Iterator[pa.RecordBatch]:
            held: list[tuple[bytes, int]] = []
            words = vocabulary.words

            def sorted_run() -> pa.RecordBatch:
                held.sort()
                stretches = [list(zip(*held[at : at + row_windows], strict=True)) for at in range(0, len(held), row_windows)]
                held.clear()
                rows = [(lang, 0, found[0], found[-1], *packed(found, counts)) for found, counts in stretches]
                return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), RUN, strict=True)], schema=RUN)

            # in the order of words, so that a run covers a narrow range of prefixes
            for first in sorted(trie.largest(left) if left else trie.root, key=words.__getitem__):
                held += [(GAP.join([words[i] for i in ids]), n) for ids, n in trie.spill(first)]
                if len(held) >= run_windows:
                    yield sorted_run()
            if held:
                yield sorted_run()

        def count(lang: str, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
            totals[lang] = totals.get(lang, 0) + int(np.count_nonzero(ids))
            rows, counts = windows(lang, ids, vocabulary.hashes, [f.value for f in filters])
            trie = tries.setdefault(lang, HatTrie(BURST))
            for window, n in zip(rows.tolist(), counts.tolist(), strict=True):
                trie.add(tuple(window[: window.index(0)] if 0 in window else window), n)
                if trie.entries > HELD:
                    yield from spilled(lang, trie, HELD // 2)
            if sum(t.entries for t in tries.values()) > HELD:
                for known, held in tries.items():
                    yield from spilled(known, held, 0)

        for batch in slices(batches):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                for ready, ids in gathered.put(lang, vocabulary.ids(text)):
                    yield from count(ready, ids)
            if len(vocabulary) > most_words:  # nothing may refer to its ids any more
                for ready, ids in gathered.rest():
                    yield from count(ready, ids)
                for known, trie in tries.items():
                    yield from spilled(known, trie, 0)
                vocabulary.clear()
                vocabulary.__init__()
        for ready, ids in gathered.rest():
            yield from count(ready, ids)
        for lang, trie in tries.items():
            yield from spilled(lang, trie, 0)
        yield pa.RecordBatch.from_pylist([{"lang": x, "total": n, "n": 0} for x, n in totals.items()], schema=RUN)

    return texts.mapInArrow(run, RUN_DDL)


PHRASE = pa.schema([("lang", pa.string()), ("words", pa.list_(pa.string())), ("n", pa.int64())])


def language_totals(runs: DataFrame) -> DataFrame:
    """``lang, n``: the words of every language."""
    return runs.where("n = 0").groupBy("lang").agg(F.sum("total").alias("n"))


def borders(runs: DataFrame) -> list[tuple[str, bytes]]:
    """Where ranges of prefixes begin, from the first windows of rows (of a bounded number of them: only balance hangs on it).

    Rows are short, so one common prefix that fills many runs has many of them.
    """
    firsts = runs.where("n > 0").select("lang", "first", "n")
    rows, total = firsts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    share = int(1_000_000 * min(1.0, BORDER_RUNS / max(1, rows)))
    found = firsts.where(F.pmod(F.xxhash64("lang", "first"), F.lit(1_000_000)) < share).collect()
    keys = sorted((r["lang"], bytes(r["first"]), r["n"]) for r in found)
    ranges = min(len(keys), int(total // RANGE_WINDOWS) + 1)
    before = np.cumsum([0, *(n for _, _, n in keys)])
    wanted = np.searchsorted(before, [before[-1] * i // ranges for i in range(1, ranges)])
    return sorted({keys[i][:2] for i in wanted.tolist() if i < len(keys)})


def dealt_runs(runs: DataFrame) -> DataFrame:
    """``part, lang, n, size, pack``: the runs cut at the borders, all of one range of prefixes together."""
    at = borders(runs)
    schema = pa.schema([("part", pa.int32()), ("lang", pa.string()), *PACK])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1 << 20):
            rows = []
            for lang, first, last, *pack in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                part = bisect_right(at, (lang, first))
                if part == bisect_right(at, (lang, last)):
                    rows.append((part, lang, *pack))
                    continue
                start, (found, counts) = 0, unpacked(*pack)
                while start < len(found):
                    # the windows before the next border, if that lies in this language
                    end = bisect_left(found, at[part][1]) if part < len(at) and at[part][0] == lang else len(found)
                    if end > start:
                        rows.append((part, lang, *packed(found[start:end], counts[start:end])))
                    start, part = end, part + 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    pieces = runs.select("lang", "first", "last", "n", "size", "pack").mapInArrow(run, "part int, lang string, n long, size long, pack binary")
    return pieces.repartition(len(at) + 1, "part").sortWithinPartitions("part", "lang")


def merged_runs(runs: DataFrame, least: int) -> DataFrame:
    """``lang, words, n`` of all phrases that occur at least ``least`` times, single words included."""

    def phrases(lang: str, found: list[tuple[bytes, int]]) -> Iterator[tuple[str, list[bytes], int]]:
        """Prefixes of the sorted, different windows of a range that are frequent, or that another range may have more of."""
        path: list[bytes] = []  # words of the window at hand
        sums: list[int] = []  # counts of its prefixes
        first = found[0][0].split(GAP)
        for window, n in [*found, (None, 0)]:
            words = window.split(GAP) if window is not None else []
            same = 0
            while same < len(path) and same < len(words) and path[same] == words[same]:
                same += 1
            while len(path) > same:
                total = sums.pop()
                if total >= least or window is None or path == first[: len(path)]:
                    yield lang, [unescaped(w) for w in path], total
                path.pop()
            path += words[same:]
            sums += [0] * (len(path) - len(sums))
            for i in range(len(path)):
                sums[i] += n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, {}

        def rows() -> pa.RecordBatch:
            langs, words, counts = list(zip(*phrases(key[1], sorted(held.items())), strict=True))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(words, pa.list_(pa.binary())).cast(pa.list_(pa.string())), pa.array(counts, pa.int64())], schema=PHRASE)

        for batch in slices(batches, 4 << 20):
            for part, lang, *pack in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (part, lang) != key:
                    yield rows()
                key = part, lang
                for window, n in zip(*unpacked(*pack), strict=True):  # runs have many windows in common
                    held[window] = held.get(window, 0) + n
        if held:
            yield rows()

    parts = dealt_runs(runs.where("n > 0")).mapInArrow(run, "lang string, words array<string>, n long")
    return parts.groupBy("lang", "words").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def mine(docs: DataFrame, least: int = LEAST, most: int = MOST_RANKS) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the ``most`` best phrases of every language of ``docs``.

    Null texts are empty, null languages are ``und`` and count together with documents that say so.  A language without
    a frequent phrase has no row, and an empty table gives an empty result.  Whole texts count, whatever their length;
    repeated rows count as often as they stand there.  Equal scores rank by count, then by phrase.  Other columns are not read.
    """
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANG)).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    with small_batches(docs.sparkSession, BATCH_ROWS):
        hashed = written(word_hashes(texts), "words")
        filters: list[Broadcast] = []
        buckets = bucket_count(hashed)
        for _ in range(3):
            filters.append(frequent(hash_counts(hashed, list(filters), buckets), least))
        runs = written(trie_runs(texts, filters), "runs")
        counts = written(merged_runs(runs, least), "phrases")
    return best(counts, language_totals(runs), most)


def best(counts: DataFrame, totals: DataFrame, most: int) -> DataFrame:
    """Scores, superseded phrases and ranks from the counts of all frequent phrases and the words of each language."""
    size = F.size("words")
    phrases = counts.where(size > 1).withColumnRenamed("n", "a")
    known = counts.select("lang", F.col("words").alias("part"), "n").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), size - 1))).withColumn("salt", F.pmod(F.xxhash64("words"), F.lit(SALTS)).cast("int"))
    cuts = cuts.withColumns({"first": F.slice("words", F.lit(1), F.col("k")), "rest": F.slice("words", F.col("k") + 1, size - F.col("k"))})
    for name, part in (("l", "first"), ("r", "rest")):
        cuts = cuts.join(known.withColumnsRenamed({"part": part, "n": name}), ["lang", "salt", part])
    wide = {c: f"cast({c} as decimal(17,0))" for c in ("a", "n", "l", "r")}
    score = F.expr(f"cast((1000 * {wide['a']} * {wide['n']}) div ({wide['l']} * {wide['r']}) as bigint)")
    scored = cuts.join(totals, "lang").withColumn("score", score)
    cut = F.min(F.struct("score", "k", "l", "r", "n")).alias("cut")
    lowest = scored.groupBy("lang", "words", "a").agg(cut).select("lang", "words", "a", "cut.l", "cut.r", "cut.n", "cut.score")
    # whatever holds a phrase holds one that is a word longer and at least as frequent
    longer = phrases.where(size > 2).select("lang", F.col("a").alias("longer"), F.explode(F.array(
        F.slice("words", F.lit(1), size - 1), F.slice("words", F.lit(2), size - 1))).alias("words"))
    longer = longer.groupBy("lang", "words").agg(F.max("longer").alias("longer"))
    kept = lowest.join(longer, ["lang", "words"], "left").where("longer is null or longer < a")
    named = kept.withColumn("phrase", F.array_join("words", " "))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = named.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ORACLE = rf"""
WITH pieces AS (SELECT coalesce(lang, '{NO_LANG}') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w)) AS n FROM words GROUP BY lang),
starts AS (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, (SELECT unnest(range(1, {WORDS + 1})) AS k) WHERE len(w) >= k),
counts AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM starts GROUP BY ALL HAVING count(*) >= {LEAST}),
split AS (SELECT lang, k, phrase, f, string_split(phrase, ' ') AS w FROM counts WHERE k > 1),
cuts AS (SELECT *, unnest(range(1, k)) AS c FROM split),
scored AS (SELECT p.lang, p.k, p.phrase, p.f AS a, p.c, x.f AS l, y.f AS r, t.n, 1000::HUGEINT * p.f * t.n // (x.f::HUGEINT * y.f) AS score
  FROM cuts p JOIN totals t ON p.lang = t.lang
  JOIN counts x ON x.lang = p.lang AND x.phrase = array_to_string(p.w[1:p.c], ' ') JOIN counts y ON y.lang = p.lang AND y.phrase = array_to_string(p.w[p.c + 1:p.k], ' ')),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
inner_ AS (SELECT lang, f, array_to_string(w[i:i + m - 1], ' ') AS phrase FROM (
  SELECT lang, f, w, m, unnest(range(1, k - m + 2)) AS i FROM split, (SELECT unnest(range(2, {WORDS})) AS m) WHERE m < k)),
kept AS (SELECT * FROM lowest c WHERE NOT EXISTS (SELECT 1 FROM inner_ i WHERE i.lang = c.lang AND i.phrase = c.phrase AND i.f >= c.a)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM ranked WHERE rank <= {MOST_RANKS}
"""
