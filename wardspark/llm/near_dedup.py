"""MinHash near-dedup with odd sketches (operator 1).

A text's shingles are hashed and give ``BANDS * ROWS`` MinHash samples.  ``ROWS``
samples together are a band key; texts that share a key are candidates.  The same
samples are folded into an odd sketch: each flips one bit, so the XOR of two
sketches shows the samples in which they differ, and its population count
estimates the similarity precisely where it is high.  Candidates that pass
that estimate (with slack) are confirmed on their full shingle sets.

Groups of any size stay spread out.  Texts with one shingle set are one class.
In a bucket each class is first compared with the smallest only; what is then
connected needs no further comparison.  Where a bucket still holds several
components, the members outside the smallest one's component are compared with
the others, block by block, on finer sketches: first each with its few nearest in
other components, which connects most, and what then is still apart with all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import extended, list_column, slices, strings, written
from .components import components

SHINGLE = 5
SIMILARITY = (75, 100)
#: A pair at similarity 0.75 shares no band with probability (1 - 0.75 ** 4) ** 40 = 2.5e-7.
BANDS, ROWS = 40, 4
SAMPLES = BANDS * ROWS
SKETCH_WORDS = 8
#: The estimate's standard deviation at 0.75 is 0.034 from the samples and 0.02 from the folding; five of them.
SLACK = 0.20
BLOCK = 256
#: Finer sketches for members of buckets that the first round leaves apart: standard deviation 0.014 at 0.75.
FINE_SAMPLES, FINE_WORDS, FINE_SLACK = 1024, 64, 0.075
#: Partners that each such member proposes first.
NEAREST = 3

#: Multipliers of a 64-bit mixing step.
MIX_A, MIX_B = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
SHIFT = np.uint64(33)
_RANDOM = np.random.default_rng(20)
FACTORS = _RANDOM.integers(0, 2**63, FINE_SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ADDENDS = _RANDOM.integers(0, 2**63, FINE_SAMPLES, dtype=np.uint64) * np.uint64(2)
SALTS = _RANDOM.integers(0, 2**63, FINE_SAMPLES, dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> SHIFT)) * MIX_A
    x = (x ^ (x >> SHIFT)) * MIX_B
    return x ^ (x >> SHIFT)


def shingles(text: str) -> np.ndarray:
    """Hashes of the distinct word shingles, sorted; a text of fewer words is one shingle."""
    words = text.encode("utf-8", "replace").lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(SHINGLE, len(words))
    out = np.full(len(words) - width + 1, width, np.uint64)
    for i in range(width):
        out = mixed(out + h[i : len(h) - width + 1 + i]) + MIX_B
    return np.unique(out)


def samples(grams: np.ndarray, count: int = SAMPLES) -> np.ndarray:
    least = np.full(count, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(grams), 256):
        np.minimum(least, (grams[at : at + 256, None] * FACTORS[:count] + ADDENDS[:count]).min(0), out=least)
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    rows = least.reshape(BANDS, ROWS)
    key = SALTS[:BANDS].copy()
    for i in range(ROWS):
        key = mixed(key + rows[:, i]) + MIX_A
    return key.view(np.int64)


def odd_sketch(least: np.ndarray, words: int = SKETCH_WORDS) -> np.ndarray:
    """Parity of the number of samples that fall on each bit."""
    at = (mixed(least + SALTS[: len(least)]) % np.uint64(64 * words)).astype(np.int64)
    odd = np.bincount(at, minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def most_different_bits(similarity: float, count: int = SAMPLES, words: int = SKETCH_WORDS) -> int:
    """Population count of the XOR of two sketches that estimates this similarity."""
    bits = 64 * words
    return int(bits / 2 * (1 - np.exp(-4 * count * (1 - similarity) / bits)))


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """At least 75 of 100 shingles of the union are common (exact, on sorted distinct hashes)."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return SIMILARITY[1] * common >= SIMILARITY[0] * (len(a) + len(b) - common)


def features(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, digest, bands, sketch`` of every row; no digest without words."""
    schema = extended(docs, ["doc_id"], "n_shingles long, digest binary, bands array<long>, sketch array<long>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            counts, digests, bands, sketches = [], [], [], []
            for text in strings(batch.column(1)):
                grams = shingles(text)
                counts.append(len(grams))
                if len(grams):
                    least = samples(grams)
                    digests.append(hashlib.blake2b(grams.tobytes(), digest_size=16).digest())
                    bands.append(band_keys(least))
                    sketches.append(odd_sketch(least))
                else:
                    digests.append(None)
                    bands.append(np.zeros(0, np.int64))
                    sketches.append(np.zeros(0, np.int64))
            none = np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()),
                list_column(np.concatenate([none, *bands]), [len(x) for x in bands]),
                list_column(np.concatenate([none, *sketches]), [len(x) for x in sketches]),
            ], names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def different_bits(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)


def confirm(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Of a written table of pairs ``(a, b)`` those whose full shingle sets are alike.  ``b`` may be the same in very many pairs."""
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))).distinct()
    texts = written(docs.select("doc_id", "text").join(written(ids, "pair-ids"), "doc_id", "left_semi"), "pair-texts")
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, grams = None, None
        for batch in slices(batches):
            keep = []
            for text_a, text_b in zip(strings(batch.column(2)), strings(batch.column(3)), strict=True):
                if text_b != last:
                    last, grams = text_b, shingles(text_b)
                keep.append(alike(shingles(text_a), grams))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
    return joined.mapInArrow(run, "a long, b long")


def fine_sketches(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """``doc_id, sketch`` with finer sketches of the texts of these ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            made = [odd_sketch(samples(shingles(t), FINE_SAMPLES), FINE_WORDS) for t in strings(batch.column(1))]
            flat = np.concatenate([np.zeros(0, np.int64), *made])
            yield pa.RecordBatch.from_arrays([batch.column(0), list_column(flat, [FINE_WORDS] * len(made))], names=["doc_id", "sketch"])

    texts = docs.select("doc_id", "text").join(written(ids, "open-ids"), "doc_id", "left_semi")
    return written(texts.mapInArrow(run, "doc_id long, sketch array<long>"), "fine-sketches").dropDuplicates(["doc_id"])


def block_pairs(probe: DataFrame, members: DataFrame, nearest: int | None) -> DataFrame:
    """Pairs ``(a, b)`` of a probe and a member of one bucket in different components that pass the sketch test.

    Both sides are dealt by hash into blocks of about ``BLOCK`` rows, and each pair of blocks is one small group.
    With ``nearest`` a probe proposes only so many of a block; without, of two members that are both probes
    (``outside``) the larger proposes the smaller.  A pair that shares several buckets is looked at
    in the first of them, by the order of bands.
    """
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    block = lambda n: F.pmod(F.xxhash64("doc_id"), blocks(n)).cast("int")
    cols = ["key", "doc_id", "comp", "sketch", "bands", "outside"]
    left = probe.withColumn("i", block("n_probe")).withColumn("j", F.explode(F.sequence(F.lit(0), blocks("n_all") - 1)))
    right = members.withColumn("j", block("n_all")).withColumn("i", F.explode(F.sequence(F.lit(0), blocks("n_probe") - 1)))
    both = left.select(*cols, "i", "j", F.lit(True).alias("probing")).unionByName(
        right.select(*cols, "i", "j", F.lit(False).alias("probing")))
    limit = most_different_bits(SIMILARITY[0] / SIMILARITY[1] - FINE_SLACK, FINE_SAMPLES, FINE_WORDS)

    def compare(group: pa.Table) -> pa.Table:
        side = np.array(group["probing"].to_pylist(), bool)
        ids, comp = group["doc_id"].to_numpy(), group["comp"].to_numpy()
        sketch = np.asarray(group["sketch"].combine_chunks().flatten()).reshape(-1, FINE_WORDS).view(np.uint64)
        bands = np.asarray(group["bands"].combine_chunks().flatten()).reshape(-1, BANDS)
        others, their, names, keys = sketch[~side], comp[~side], ids[~side], bands[~side]
        each, key = np.arange(len(names)), group["key"][0].as_py()
        both_ways = np.array(group["outside"].to_pylist(), bool)[~side] if nearest is None else np.zeros(len(names), bool)
        out_a, out_b = [], []
        for n in np.flatnonzero(side):
            bits = np.bitwise_count(others ^ sketch[n]).sum(1, dtype=np.int64)
            here = keys[each, (keys == bands[n]).argmax(1)] == key
            near = np.flatnonzero((bits <= limit) & (their != comp[n]) & here & ~(both_ways & (names > ids[n])))
            if nearest is not None and len(near) > nearest:
                near = near[np.lexsort((names[near], bits[near]))[:nearest]]
            out_a.append(np.maximum(names[near], ids[n]))
            out_b.append(np.minimum(names[near], ids[n]))
        none = np.zeros(0, np.int64)
        return pa.table({"a": np.concatenate([none, *out_a]), "b": np.concatenate([none, *out_b])})

    return both.groupBy("key", "i", "j").applyInArrow(compare, "a long, b long").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs``.

    ``doc_id`` is an integer.  A text without words (null, empty, white space) has no shingles and is linked with
    nothing.  A row without an id cannot be linked: its component is null and it is kept.  Rows that share an id are
    one document; should their texts differ, each row is placed by its own.  Equal texts are linked
    whatever their number; an empty table gives an empty result; other columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    feats = written(features(docs), "minhash")
    named = feats.where(F.col("doc_id").isNotNull() & F.col("digest").isNotNull())
    classes = written(named.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "classes")
    reps = named.join(classes.select("digest", F.col("rep").alias("doc_id")), ["digest", "doc_id"], "left_semi")
    reps = written(reps.select("doc_id", "bands", "sketch"), "representatives")

    rows = reps.select("doc_id", F.explode("bands").alias("key"))
    shared = rows.groupBy("key").agg(F.min("doc_id").alias("center"), F.count("*").alias("n_all")).where("n_all > 1")
    hits = written(rows.join(shared, "key"), "buckets")

    sketches = reps.select("doc_id", "sketch")
    limit = most_different_bits(SIMILARITY[0] / SIMILARITY[1] - SLACK)
    first = hits.where("doc_id <> center").select(F.col("doc_id").alias("a"), F.col("center").alias("b")).distinct()
    first = first.join(sketches.select(F.col("doc_id").alias("a"), F.col("sketch").alias("sa")), "a")
    first = first.join(sketches.select(F.col("doc_id").alias("b"), F.col("sketch").alias("sb")), "b")
    tried = written(first.where(different_bits(F.col("sa"), F.col("sb")) <= limit).select("a", "b"), "pairs")
    edges = written(confirm(tried, docs), "links")
    roots, fine = components(edges), None
    for nearest in (NEAREST, None):
        placed = hits.join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("comp", F.coalesce("root", "doc_id"))
        placed = written(placed.select("key", "doc_id", "center", "n_all", "comp"), "placed")
        at_center = placed.where("doc_id = center").select("key", F.col("comp").alias("main")).distinct()
        placed = placed.join(at_center, "key").withColumn("outside", F.col("comp") != F.col("main")).drop("main")
        outside = placed.where("outside")
        sizes = written(outside.groupBy("key").agg(F.count("*").alias("n_probe")), "open")
        members = placed.join(sizes, "key")
        if fine is None:
            fine = fine_sketches(members.select("doc_id").distinct(), docs).join(reps.select("doc_id", "bands").dropDuplicates(["doc_id"]), "doc_id")
            fine = written(fine, "fine-bands")
        pairs = block_pairs(outside.join(sizes, "key").join(fine, "doc_id"), members.join(fine, "doc_id"), nearest)
        # a pair that was no link in an earlier round is none now
        pairs = written(pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
        tried = tried.unionByName(pairs)
        more = written(confirm(pairs, docs), "links")
        if not more.isEmpty():
            edges = edges.unionByName(more)
            roots = components(edges)
    return labelled(feats, classes, roots)


def labelled(feats: DataFrame, classes: DataFrame, roots: DataFrame) -> DataFrame:
    out = feats.select("doc_id", "n_shingles", "digest")
    out = out.join(classes.where("n > 1").select("digest", "rep"), "digest", "left")
    out = out.withColumn("rep", F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")))
    out = out.join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    component = F.coalesce("root", "rep")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of each group of near copies the one of smallest id.

    Every row is judged by its own text: of rows that repeat an id with an equal text one stays, and a row stays that
    only shares its id with a near copy.  Rows without an id are not linked, but of those with equal texts one stays,
    and none if a row with an id stays that has this text.  Texts without words are equal only within one id.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.monotonically_increasing_id().alias("row"))
    rows = written(rows, "rows")
    keys = rows.select("row", F.col("doc.doc_id").cast("long").alias("doc_id"), F.unhex(F.md5(F.coalesce("doc.text", F.lit("")))).alias("same_text"))
    has_id = F.col("doc_id").isNotNull()
    named = rows.where(F.col("doc.doc_id").cast("long").isNotNull()).select(F.col("row").alias("doc_id"), F.col("doc.text").alias("text"))
    placed = near_duplicates(named).select(F.col("doc_id").alias("row"), F.col("n_shingles") > 0, "component_id").toDF("row", "worded", "component")
    single = [F.when(F.col("worded"), F.col("component")).alias("group"), *(F.when(~F.col("worded"), F.col(c)).alias(f"own_{c}") for c in ("doc_id", "same_text"))]
    first = keys.where(has_id).join(placed, "row").groupBy(*single).agg(F.min(F.struct("doc_id", "same_text", "row")).alias("first"))
    first = written(first.select("first.row", "first.same_text", F.col("group").isNotNull().alias("worded")), "first-of-each")
    nameless = keys.where(~has_id).groupBy("same_text").agg(F.min("row").alias("row"))
    nameless = nameless.join(first.where("worded").select("same_text").distinct(), "same_text", "left_anti").select("row")
    return rows.join(first.select("row").union(nameless), "row", "left_semi").select("doc.*")


#: ``near_duplicates`` of documents with distinct ids.
ORACLE = r"""
WITH RECURSIVE doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingle AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: list_slice(w, i, i + 4))) AS s FROM doc WHERE len(w) > 0
), size AS (
  SELECT doc_id, count(*) AS n FROM shingle GROUP BY 1
), pair AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
), link AS (
  SELECT a, b FROM pair JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * common >= 75 * (x.n + y.n - common)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM doc UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b
), root AS (
  SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM doc LEFT JOIN size USING (doc_id) JOIN root USING (doc_id)
"""
