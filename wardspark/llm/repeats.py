"""Suffix-array dedup of long repeated strings (operator 10).

A byte goes if a string of ``length`` bytes over it also starts anywhere else.

1. *Suffix buckets.*  A window of ``length`` bytes belongs to the bucket of its
   minimiser, the gram (a quarter as long) of smallest hash in it.  Equal windows have
   equal minimisers at the same distance, so a bucket is complete in itself.
   The neighbouring windows of one minimiser form a stretch of text.  A bucket
   with one stretch holds no repeat.  Equal stretches (by 128-bit hash) are
   repeats in all their windows; one of them is sorted for all, marked as not single.
2. *Blockwise construction.*  Tasks get whole buckets of different stretches and
   suffix-sort them about a megabyte at a time: first by the leading ``PERIOD``
   bytes, then, where these tie, by the ranks of the difference-cover sample.
   For any two places there is a shift below ``PERIOD`` that brings both into the
   sample, so one look at two ranks settles a tie of any length.  Neighbours in
   this order with a common prefix of ``length`` bytes are repeats.
3. *Very large buckets* (more than ``MOST`` different stretches) would not fit one
   task.  They are split by what neighbouring windows have in common into smaller
   buckets, which are sorted in the same way; only what is still too large is split
   further, in the end by single windows.  The same answer, at any size.

With ``shorter`` the same sort answers for a second, smaller length: buckets and
stretches are those of the shorter windows, each stretch carries as many bytes more
as the longer strings need, and every group of neighbours is read at both lengths.

Texts that occur more than once as a whole stand in the buckets once.  They are
known by their digest everywhere, so ids may be null or repeat.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cmp_to_key

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import extended, list_column, slices, spread_join, strings, written

LENGTH = 400
#: Fewer bytes than 51 words take; the lengths are multiples of 8 from 64 to 480.
PASSAGE = 240
#: Different stretches of one minimiser that a task sorts itself: at most 14 MB of text.
MOST = 20_000
#: Neighbouring windows that stay together when larger buckets are split, step by step.
STEPS = (64, 13, 3, 1)
BLOCK_BYTES = 1 << 20
PERIOD = 32
#: Bytes that the ranks of the cover sample tell apart.
DEPTH = 512
#: A difference cover modulo 32; every residue is a difference of two of them.
COVER = (0, 1, 2, 3, 7, 11, 19)
SEGMENT = 1 << 22

MIX_A, MIX_B, SHIFT = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(33)
BASE = np.uint64(0x9E3779B97F4A7C15)
LOW = np.uint64((1 << 24) - 1)


def shifts() -> list[list[int]]:
    """For two residues the smallest shift that brings both into the cover."""
    inside = [r in COVER for r in range(PERIOD)]
    return [[next(d for d in range(PERIOD) if inside[(i + d) % PERIOD] and inside[(j + d) % PERIOD]) for j in range(PERIOD)]
            for i in range(PERIOD)]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> SHIFT)) * MIX_A
    x = (x ^ (x >> SHIFT)) * MIX_B
    return x ^ (x >> SHIFT)


class Rolling:
    """Hashes of all substrings of one length, by prefix sums of a polynomial modulo 2**64."""

    def __init__(self, base: np.uint64):
        self.base, self.inverse = base, np.uint64(pow(int(base), -1, 1 << 64))
        self.powers = self.backs = np.ones(1, np.uint64)

    def grow(self, n: int) -> None:
        if len(self.powers) < n:
            n = max(n, 1 << 17)
            self.powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, self.base)]), dtype=np.uint64)
            self.backs = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, self.inverse)]), dtype=np.uint64)

    def hashes(self, data: np.ndarray, length: int) -> np.ndarray:
        self.grow(len(data))
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.powers[: len(data)], out=sums[1:])
        n = len(data) - length + 1
        return mixed((sums[length:] - sums[:n]) * self.backs[:n])


ROLLING = Rolling(BASE)


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, by running minima from both sides of blocks."""
    n = len(x)
    blocks = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    blocks[:n] = x
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def minimisers(data: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one minimiser: its hash and place, and the first and last start of the run."""
    keys, places_, firsts, lasts = [], [], [], []
    gram = length // 4
    for at in range(0, len(data) - length + 1, SEGMENT):
        part = data[at : at + SEGMENT + length - 1]
        grams = ROLLING.hashes(part, gram)
        places = (grams & ~LOW) | np.arange(len(grams), dtype=np.uint64)  # the leftmost of equal ones
        chosen = (sliding_least(places, length - gram + 1) & LOW).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], chosen[1:] != chosen[:-1]]))
        keys.append(grams[chosen[first]].view(np.int64))
        places_.append(chosen[first] + at)
        firsts.append(first + at)
        lasts.append(np.concatenate([first[1:], [len(chosen)]]) - 1 + at)
    if not keys:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    return tuple(map(np.concatenate, (keys, places_, firsts, lasts)))


def raw(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-8", "replace"), np.uint8)


def with_digest(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.withColumn("text", text).withColumn("digest", F.unhex(F.md5(text)))


def anchors(docs: DataFrame, base: int, reach: int) -> DataFrame:
    """``digest`` and the stretches of every text that has a window of ``base`` bytes: hash and place of the minimiser,
    first and last window, hash of the bytes up to ``reach`` from the last window's start."""
    schema = extended(docs, ["digest"], "gram array<long>, at array<int>, low array<int>, high array<int>, body array<binary>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found, bodies = [], []
            for text in strings(batch.column(1)):
                data = raw(text)
                found.append(minimisers(data, base))
                view = memoryview(data)
                bodies += [xxhash.xxh3_128_digest(view[a : b + reach]) for a, b in zip(found[-1][2].tolist(), found[-1][3].tolist(), strict=True)]
            sizes, none = [len(f[0]) for f in found], np.zeros(0, np.int64)
            columns = [np.concatenate([none, *(f[i] for f in found)]) for i in range(4)]
            lists = [list_column(c if i == 0 else c.astype(np.int32), sizes) for i, c in enumerate(columns)]
            lists.append(list_column(pa.array(bodies, pa.binary()), sizes))
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists], names=schema.names)

    return docs.where(F.octet_length("text") >= base).select("digest", "text").mapInArrow(run, schema)


STRETCH = "gram long, digest binary, at int, low int, high int, single boolean, large boolean, bytes binary"
STRETCH_TYPES = (pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_(), pa.binary())
STRETCH_NAMES = ["gram", "digest", "at", "low", "high", "single", "large", "bytes"]


def arrow_rows(rows: list[tuple], types: tuple, names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def stretches(texts: DataFrame, wanted: DataFrame, reach: int) -> DataFrame:
    """The bytes of the wanted stretches, once each although texts may repeat."""
    listed = wanted.groupBy("digest").agg(F.collect_list(F.struct("gram", "at", "low", "high", "single", "large")).alias("runs"))
    joined = texts.select("digest", "text").join(listed.hint("shuffle_hash"), "digest").select("digest", "text", "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in slices(batches, 2 << 20):
            rows = []
            for digest, text, found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if digest != last:
                    last, data = digest, raw(text)
                    rows += [(r["gram"], digest, r["at"], r["low"], r["high"], r["single"], r["large"], data[r["low"] : r["high"] + reach].tobytes()) for r in found]
            yield arrow_rows(rows, STRETCH_TYPES, STRETCH_NAMES)

    return joined.mapInArrow(run, STRETCH)


def eight_bytes(data: bytes) -> np.ndarray:
    """A view: for every place the next 8 bytes as a number that sorts like them (zeros behind the end)."""
    padded = data + bytes(DEPTH + PERIOD + 8)
    return np.ndarray(len(padded) - 7, ">u8", padded, strides=(1,))


def cover_ranks(look: np.ndarray, n: int) -> np.ndarray:
    """Ranks of the sample suffixes of ``n`` bytes by their first ``DEPTH`` bytes, at their places (elsewhere -1)."""
    places = (np.arange(0, n, PERIOD, dtype=np.int32)[:, None] + np.array(COVER, np.int32)).ravel()
    places = places[: np.searchsorted(places, n)]
    keys = [look[places + 8 * i].astype(np.uint64) for i in range(PERIOD // 8)]
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(places), bool)
    for k in keys:
        k = k[order]
        new[1:] |= k[1:] != k[:-1]
    del keys, k
    ranks = np.full(n + DEPTH + PERIOD, -1, np.int32)
    ranks[places[order]] = np.cumsum(new)
    del order, new
    depth = PERIOD
    while depth < DEPTH:
        both = (ranks[places].astype(np.int64) << 32) | (ranks[places + depth] + 1)
        ranks[places] = np.unique(both, return_inverse=True)[1]
        depth *= 2
    return ranks


def repeated(bodies: list[bytes], counts: list[int], lengths: tuple[int, ...]) -> list[list[np.ndarray]]:
    """For each (rising) length and each stretch, which of its first ``counts`` places start a string that another place starts too.

    But for the bytes and the ranks, only places that may start a string take memory.
    """
    sizes, number = np.array([len(x) for x in bodies]), np.array(counts)
    starts = np.cumsum(sizes) - sizes
    total = int(sizes.sum())
    look = eight_bytes(b"".join(bodies))
    suffixes = (np.arange(number.sum()) + np.repeat(starts - (np.cumsum(number) - number), number)).astype(np.int32)
    keys = [look[suffixes + 8 * i].astype(np.uint64) for i in range(PERIOD // 8)]
    order = np.lexsort(keys[::-1])
    sorted_ = suffixes[order]
    new = np.zeros(len(sorted_) + 1, bool)
    new[0] = new[-1] = True
    for k in keys:
        k = k[order]
        new[1:-1] |= k[1:] != k[:-1]
    del keys, k, order, suffixes
    edges = np.flatnonzero(new)
    wide = np.flatnonzero(np.diff(edges) > 2)  # of two alike the order does not matter
    if len(wide):
        ranks, shift = memoryview(cover_ranks(look, total)), SHIFTS

        def order_of(p: int, q: int) -> int:
            d = shift[p % PERIOD][q % PERIOD]
            return ranks[p + d] - ranks[q + d]

        key = cmp_to_key(order_of)
        for n in wide.tolist():
            a, b = edges[n], edges[n + 1]
            sorted_[a:b] = sorted(sorted_[a:b].tolist(), key=key)
        del ranks
    same = np.zeros(len(sorted_) + 1, bool)
    same[1:-1] = ~new[1:-1]
    left = (starts + sizes)[np.searchsorted(starts, sorted_, "right") - 1] - sorted_  # bytes up to the end of the own stretch
    near, known, out = np.flatnonzero(same), PERIOD, []
    for length in lengths:
        for i in range(known, length, 8):
            near = near[look[sorted_[near] + i] == look[sorted_[near - 1] + i]]
        known = length
        alike = np.zeros(len(sorted_), bool)
        alike[near] = True
        group = np.cumsum(~alike, dtype=np.int32)  # neighbours with a common prefix; what ends before is none of them
        whole = left >= length
        many = np.bincount(group[whole], minlength=len(sorted_) + 1) > 1
        hit = np.zeros(total + 1, bool)
        hit[sorted_[whole & many[group]]] = True
        out.append([hit[s : s + c] for s, c in zip(starts.tolist(), counts, strict=True)])
    return out


SHIFTS = shifts()
COVERED = pa.schema([("length", pa.int32()), ("digest", pa.binary()), ("start", pa.int32()), ("end", pa.int32())])
COVERED_DDL = "length int, digest binary, start int, end int"


def sort_buckets(buckets: DataFrame, lengths: tuple[int, ...]) -> DataFrame:
    """``length, digest, start, end`` of the repeats in buckets that a task can hold: ``gram, digest, low, windows, single, bytes``."""
    dealt = buckets.select("gram", "digest", "low", "windows", "single", "bytes").repartition("gram").sortWithinPartitions("gram")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[bytes, int, int, bool, bytes]] = []
        size, last, seen = 0, None, set()

        def flush() -> pa.RecordBatch:
            out = []
            found = repeated([x[4] for x in held], [x[2] for x in held], lengths) if len(held) > 1 else []
            for length, hits in zip(lengths, found, strict=False):
                for (digest, low, _, single, _), hit in zip(held, hits, strict=True):
                    if single and hit.any():  # all windows of the others are known to be repeats
                        edge = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
                        out += [{"length": length, "digest": digest, "start": low + s, "end": low + e - 1 + length} for s, e in edge.reshape(-1, 2).tolist()]
            return pa.RecordBatch.from_pylist(out, schema=COVERED)

        for batch in slices(batches, 1 << 20):
            for gram, digest, low, windows, single, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if gram != last:
                    last, seen = gram, set()
                    if size >= BLOCK_BYTES:
                        yield flush()
                        held, size = [], 0
                if (digest, low) not in seen:
                    seen.add((digest, low))
                    held.append((digest, low, windows, single, body))
                    size += len(body)
        yield flush()

    return dealt.mapInArrow(run, COVERED_DDL)


PIECE = ["digest", "low", "a", "b", "n", "common", "bytes"]
PIECE_TYPES = (pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())


def split_large(stretched: DataFrame, length: int, most: int) -> DataFrame:
    """``length, digest, start, end`` for larger buckets, split into ones that can be sorted.

    Windows are named by their distance from the minimiser, equal in equal windows, so a piece of neighbouring
    windows can only meet pieces with the same place and the same bytes common to its windows.
    """
    large = written(stretched.where("large").select("digest", "at", "low", "high", "bytes").distinct(), "large")
    last = F.least(F.col("high"), F.col("low") + F.octet_length("bytes") - length) - F.col("at")
    left = large.select("digest", "low", (F.col("low") - F.col("at")).alias("a"), last.alias("b")).where("a <= b")
    found = []
    for step in STEPS:

        def run(batches: Iterator[pa.RecordBatch], step: int = step) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, 1 << 18):  # a stretch becomes up to 30 pieces of the string length
                rows = []
                for digest, low, a, b, at, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    base = at - low
                    for n in range(a // step, b // step + 1):
                        common = xxhash.xxh3_128_digest(body[base + n * step + step - 1 : base + n * step + length])
                        first, last = max(a, n * step), min(b, n * step + step - 1)
                        rows.append((digest, low, first, last, n, common, body[base + first : base + last + length] if step > 1 else b""))
                yield arrow_rows(rows, PIECE_TYPES, PIECE)

        joined = left.join(large, ["digest", "low"]).select("digest", "low", "a", "b", "at", "bytes")
        parts = written(joined.mapInArrow(run, "digest binary, low int, a int, b int, n int, common binary, bytes binary"), "parts")
        several = written(parts.groupBy("n", "common").agg(F.count("*").alias("pieces")).where("pieces > 1"), "several")
        if step == 1:
            found.append(parts.join(several, ["n", "common"]).select("digest", "low", "a", "b"))
            break
        held = parts.join(several.where(F.col("pieces") <= most), ["n", "common"])
        # windows of other minimisers of the text may be in the same piece; their starts differ by ``low``
        buckets = held.select(F.xxhash64("n", "common").alias("gram"), F.struct("digest", "low").alias("digest"), F.col("a").alias("low"),
                              (F.col("b") - F.col("a") + 1).alias("windows"), F.lit(True).alias("single"), "bytes")
        packed = buckets.withColumn("digest", F.concat("digest.digest", F.unhex(F.lpad(F.hex("digest.low"), 8, "0"))))
        hits = sort_buckets(packed, (length,))
        found.append(hits.select(F.expr("substring(digest, 1, 16)").alias("digest"), F.expr("cast(conv(hex(substring(digest, 17, 4)), 16, 10) as int)").alias("low"),
                                 F.col("start").alias("a"), (F.col("end") - length).alias("b")))
        left = written(parts.join(several.where(F.col("pieces") > most), ["n", "common"]).select("digest", "low", "a", "b"), "left")
        if left.isEmpty():
            break
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    placed = out.join(large.select("digest", "low", "at"), ["digest", "low"])
    return placed.select(F.lit(length).alias("length"), "digest", (F.col("at") + F.col("a")).alias("start"), (F.col("at") + F.col("b") + length).alias("end"))


def covered(docs: DataFrame, lengths: tuple[int, ...], most: int = MOST) -> DataFrame:
    """``digest, whole, spans`` for every text with something to remove at one of the (rising) lengths; ``docs`` has text and digest."""
    base, reach = lengths[0], lengths[-1]
    anchored = written(anchors(docs, base, reach), "anchors")
    copies = anchored.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest", F.lit(True).alias("whole"))
    each = anchored.select("digest", F.inline(F.arrays_zip("gram", "at", "low", "high", "body")))
    place = F.xxhash64("digest", "low")
    ends = [F.min(place).alias("x"), F.max(place).alias("y")]
    # a common line gives all its texts one gram, and a common passage one stretch: such keys are not dealt to one task
    count = F.count("*").alias("n")
    shared = written(each.groupBy("gram").agg(*ends, count).where("x <> y").select("gram", "n"), "shared")
    wanted = written(spread_join(each, shared, ["gram"], "n").distinct(), "wanted")
    bodies = wanted.groupBy("gram", "body").agg(*ends, count, F.min(F.struct("digest", "low", "high", "at")).alias("one"))
    bodies = written(bodies.select("gram", "body", (F.col("x") == F.col("y")).alias("single"), "n", "one.*"), "bodies")
    equal = spread_join(wanted, bodies.where("not single").select("gram", "body", "n"), ["gram", "body"], "n")
    several = bodies.groupBy("gram").agg(count).where("n > 1")
    several = written(several.select("gram", "n", (F.col("n") > most).alias("large")), "several")
    stretched = written(stretches(docs, spread_join(bodies.drop("n"), several, ["gram"], "n"), reach), "stretches")
    # a stretch near the end of a text may be too short for the longer strings; the union of spans is cut to the text later
    ranges = equal.select(F.explode(F.array(*map(F.lit, lengths))).alias("length"), "digest", F.col("low").alias("start"), F.col("high").alias("last"))
    ranges = ranges.select("length", "digest", "start", (F.col("last") + F.col("length")).alias("end"))
    small = stretched.where("not large").withColumn("windows", F.col("high") - F.col("low") + 1)
    ranges = ranges.unionByName(sort_buckets(small, lengths))
    if not stretched.where("large").isEmpty():
        for length in lengths:
            ranges = ranges.unionByName(split_large(stretched, length, most))
    spans = ranges.groupBy("digest").agg(F.collect_list(F.struct("length", "start", "end")).alias("spans"))
    return written(spans.join(copies, "digest", "full_outer"), "repeats")


SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def remove_repeats(docs: DataFrame, length: int = LENGTH, shorter: int | None = None, most: int = MOST) -> DataFrame:
    """Every row of ``docs`` with ``doc`` (the row as it was), ``n_bytes``, ``spans`` (removed), ``kept`` (bytes) and ``kept_text``.

    ``kept_text`` is what is left of a text that lost something, without characters that a cut has broken.
    With ``shorter`` it is what is left when strings of so many bytes go, and ``short_spans`` are those; without, they
    are as ``spans``.

    Texts are judged as UTF-8 bytes, null as empty, whole and without a limit of length; matches never cross
    documents.  A text of ``length`` bytes or more that stands in two rows goes wholly in both, whatever their ids.
    An empty table gives an empty result; columns of any name pass through in ``doc``.
    """
    lengths = tuple(sorted({length, shorter or length}))
    if lengths[0] < 64 or lengths[-1] > DEPTH - PERIOD or any(n % 8 for n in lengths) or lengths[-1] != length:
        raise ValueError("lengths are multiples of 8 from 64 to 480, the shorter one first")
    packed = with_digest(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), "text"))
    found = covered(packed.select("text", "digest"), lengths, most)
    # the text travels in the row alone, not a second time beside it
    joined = packed.select("doc", "digest").join(found.hint("shuffle_hash"), "digest", "left")
    joined = joined.select("doc", F.coalesce("doc.text", F.lit("")).alias("text"), "spans", "whole")
    schema = extended(joined, ["doc"], "n_bytes long, spans array<struct<start:int,end:int>>, short_spans array<struct<start:int,end:int>>, kept binary, kept_text string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sizes, removed, short, kept, texts = [], [], [], [], []
            rows = zip(strings(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
            for text, spans, whole in rows:
                data = text.encode("utf-8", "replace")
                gone = [removed_runs(len(data), n, whole, spans or ()) for n in (length, lengths[0])]
                sizes.append(len(data))
                removed.append([{"start": s, "end": e} for s, e in gone[0]])
                short.append([{"start": s, "end": e} for s, e in gone[1]])
                kept.append(without(data, gone[0]))
                texts.append(without(data, gone[1]).decode("utf-8", "ignore") if gone[1] else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, SPANS), pa.array(short, SPANS), pa.array(kept, pa.binary()), pa.array(texts, pa.string())], names=schema.names)

    return joined.mapInArrow(run, schema)


def removed_runs(n_bytes: int, length: int, whole: bool | None, spans) -> list[tuple[int, int]]:
    """Maximal runs of the spans of one length, as far as strings of that length fit the text."""
    if n_bytes < length:
        return []
    if whole:
        return [(0, n_bytes)]
    out: list[tuple[int, int]] = []
    for start, end in sorted((s["start"], min(s["end"], n_bytes)) for s in spans if s["length"] == length):
        if end - start < length:
            continue
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def without(data: bytes, gone: list[tuple[int, int]]) -> bytes:
    ends = [0, *(e for _, e in gone)]
    heads = [*(s for s, _ in gone), len(data)]
    return b"".join(data[a:b] for a, b in zip(ends, heads, strict=True))


def digests(result: DataFrame) -> DataFrame:
    """The columns of the query; ``text`` is what is left without the shorter repeats, ``has_passage`` tells whether there were any."""
    length = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    had = F.size("short_spans") > 0
    return result.select(
        F.col("doc.doc_id").alias("doc_id"), "n_bytes", length.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"), had.alias("has_passage"), F.when(had, F.col("kept_text")).otherwise(F.coalesce("doc.text", F.lit(""))).alias("text"))


def cleaned(docs: DataFrame, length: int = PASSAGE) -> DataFrame:
    """``docs`` with the repeats cut out of ``text`` (broken characters at the cuts go too) and ``n_chars`` counted anew.

    All rows stay, with all their columns.  Null and empty texts, texts below ``length`` bytes and texts without a
    repeat stay as they are (null stays null), with their ``n_chars``; an empty table stays empty.
    """
    result = remove_repeats(docs, length)
    text = F.when(F.size("spans") == 0, F.col("doc.text")).otherwise(F.col("kept_text"))
    columns = {c: F.col("doc").getField(c).alias(c) for c in docs.columns}
    columns["text"] = text.alias("text")
    if "n_chars" in columns:
        columns["n_chars"] = F.when(F.size("spans") == 0, F.col("doc.n_chars")).otherwise(F.length(text)).cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return result.select(*columns.values())
