"""Source divergence audit by one-hot level products (operator 11).

Every (language, source) group gives each kept term a price from its count there,
so two terms of one count in a group cost the same in it.  For the divergence of
one group from another it is therefore enough to know how many terms have count
``c`` in the one and ``d`` in the other: their joint table.

1. *Counts.*  Tasks count terms by group, with bounded tables that are emptied when
   full, so a source with a third of all rows arrives as a few rows for each term.
2. *Blocks.*  Kept terms, sorted by total, are cut into blocks of terms with few
   different counts: at most ``TERMS`` terms, ``CELLS`` counts and ``COLUMNS`` columns.
3. *Products.*  In a block, column (group, count level) of the indicator matrix is 1
   where the term has that count in the group, the level 0 included.  The matrix
   times its transpose holds every joint table of the block.  Entries are numbers of
   at most ``TERMS`` terms, exact in single precision.  Groups are taken in blocks
   too, so a product has a bounded size however many sources a language has.
4. *Pricing.*  An entry times the price of its two levels, in 64-bit integers, summed
   by pair of groups; only these sums are shuffled.  (Prices of a group add up to about
   10**9, so no sum of squares over them passes 10**18; levels beyond 64 bits are
   priced with Python's integers.)

The list of terms above their language comes from the same blocks.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, written

SCALE = 1_000_000_000
LEAST_DOCS = 3
MOST_TERMS = 200
#: Bounds of a block of terms: rows, counts that are not zero, and different (group, count) columns.
TERMS, CELLS, COLUMNS = 4096, 100_000, 1024
#: Groups of a block of groups.
GROUPS = 64
#: The blocks of one language are dealt to so many tasks.
SALTS = 64
#: Terms and groups a task counts before it empties its tables.
HELD = 1_000_000
CHUNK = 4 << 20

#: For ``bytes.translate``: A-Z to a-z, and every ASCII byte that is no letter to a space.
FOLD_LETTERS = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))

COUNTED = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def chunks(data: bytes, size: int = CHUNK) -> Iterator[bytes]:
    """The text in parts of about ``size`` bytes, cut at spaces."""
    at = 0
    while len(data) - at > size:
        cut = data.find(b" ", at + size)
        if cut < 0:
            break
        yield data[at:cut]
        at = cut
    yield data[at:]


def named(docs: DataFrame) -> DataFrame:
    empty = F.lit("")
    return docs.select(*[F.coalesce(F.col(c).cast("string"), empty).alias(c) for c in ("lang", "source", "text")])


def group_counts(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n, docs``: occurrences and documents, in partial sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def emptied() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, among) in held.items():
                terms = pa.array(list(n), pa.binary()).cast(pa.string())
                columns = [pa.array([x] * len(n), pa.string()) for x in (lang, source)]
                columns += [terms, pa.array(list(n.values()), pa.int64()), pa.array([among[t] for t in n], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, schema=COUNTED)
            held.clear()

        for batch in slices(batches):
            langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lang, source, text in zip(langs, sources, batch.column(2).cast(pa.binary()).to_pylist(), strict=True):
                n, among = held.setdefault((lang, source), (Counter(), Counter()))
                seen = set()
                for part in chunks(text.translate(FOLD_LETTERS)):
                    words = part.split()
                    n.update(words)
                    seen.update(words)
                among.update(seen)
            if sum(len(n) for n, _ in held.values()) > HELD:
                yield from emptied()
        yield from emptied()

    return docs.select("lang", "source", "text").mapInArrow(run, "lang string, source string, term string, n long, docs long")


def kept_terms(docs: DataFrame, least_docs: int) -> DataFrame:
    """``lang, term, total, cells`` (source and count) of every term in enough documents of its language."""
    dealt = group_counts(docs).repartition("lang", "term")  # also clusters the finer grouping below
    counts = dealt.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    terms = counts.groupBy("lang", "term").agg(
        F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("cells"))
    return written(terms.where(F.col("docs") >= least_docs).drop("docs"), "terms")


BLOCK = "lang string, salt int, terms array<string>, starts array<int>, totals array<long>, sources array<string>, source_at array<int>, counts array<long>"


def blocks(terms: DataFrame) -> DataFrame:
    """Runs of terms of one language with few different counts, one row each."""
    ranged = terms.repartitionByRange("lang", "total", "term").sortWithinPartitions("lang", "total", "term")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lang, rows, columns, cells = None, [], set(), 0

        def block() -> pa.RecordBatch:
            nonlocal rows, columns, cells
            starts = np.cumsum([0, *(len(c) for _, _, c in rows)]).tolist()
            names = sorted({s for _, _, c in rows for s, _ in c})
            place = {s: i for i, s in enumerate(names)}
            flat = [x for _, _, c in rows for x in c]
            row = {"lang": lang, "salt": crc32(rows[0][0].encode()) % SALTS, "terms": [t for t, _, _ in rows], "starts": starts, "totals": [n for _, n, _ in rows],
                   "sources": names, "source_at": [place[s] for s, _ in flat], "counts": [n for _, n in flat]}
            rows, columns, cells = [], set(), 0
            return pa.RecordBatch.from_pylist([row], schema=BLOCK_SCHEMA)

        for batch in slices(batches, 1 << 20):
            for language, term, total, found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = [(x["source"], x["n"]) for x in found]
                more = sum(x not in columns for x in found)
                if rows and (language != lang or len(rows) == TERMS or len(columns) + more > COLUMNS or cells + len(found) > CELLS):
                    yield block()
                lang, cells = language, cells + len(found)
                columns.update(found)
                rows.append((term, total, found))
        if rows:
            yield block()

    return ranged.select("lang", "term", "total", "cells").mapInArrow(run, BLOCK)


BLOCK_SCHEMA = pa.schema([
    ("lang", pa.string()), ("salt", pa.int32()), ("terms", pa.list_(pa.string())), ("starts", pa.list_(pa.int32())), ("totals", pa.list_(pa.int64())),
    ("sources", pa.list_(pa.string())), ("source_at", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64()))])


def group_blocks(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """Pairs of blocks of groups of a language, each for every salt: names and sums of counts, number and sum of the kept terms."""
    sums = terms.select("lang", F.inline("cells")).groupBy("lang", "source").agg(F.sum("n").alias("n"))
    groups = docs.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("source"))  # one row a group
    packed = groups.withColumn("b", F.floor((place - 1) / GROUPS).cast("int")).groupBy("lang", "b")
    packed = packed.agg(F.sort_array(F.collect_list(F.struct("source", "n"))).alias("groups"))
    whole = terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("all"))
    packed = written(packed.join(whole, "lang", "left").na.fill(0, ["v", "all"]), "groups")
    other = packed.select("lang", F.col("b").alias("b2"), F.col("groups").alias("groups2"))
    pairs = packed.join(other, "lang").where("b <= b2")
    return pairs.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def prices(counts: np.ndarray, n: int, v: int) -> np.ndarray:
    """``1 + floor(SCALE * (count + 1) / (n + v))``, exact."""
    if n + v < 1 << 33:
        return 1 + SCALE * (counts + 1) // max(1, n + v)
    return np.array([1 + SCALE * (int(c) + 1) // (n + v) for c in counts], np.int64)


def differences(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def levels(at: np.ndarray, group: np.ndarray, counts: np.ndarray, n_terms: int, n_groups: int) -> tuple[np.ndarray, ...]:
    """The indicator matrix of a block: columns, with the group and the count each stands for (0 wherever a term is not named)."""
    table = np.zeros((n_terms, n_groups), np.int64)
    table[at, group] = counts
    order = np.argsort(table, axis=0, kind="stable")
    ranked = np.take_along_axis(table, order, 0)
    new = np.ones_like(ranked, bool)
    new[1:] = ranked[1:] != ranked[:-1]
    column = np.empty_like(table)
    np.put_along_axis(column, order, np.cumsum(new.T.ravel()).reshape(new.T.shape).T - 1, 0)
    of_group = np.nonzero(new.T)[0]
    matrix = np.zeros((n_terms, len(of_group)), np.float32)
    matrix[np.arange(n_terms)[:, None], column] = 1
    return matrix, of_group, ranked.T[new.T]


def folded(values: np.ndarray, rows: np.ndarray, n_rows: int, columns: np.ndarray, n_columns: int) -> np.ndarray:
    """Sums of a matrix over runs of rows and of columns of one group; every group has a column."""
    first = np.searchsorted(rows, np.arange(n_rows))
    return np.add.reduceat(np.add.reduceat(values, first, 0), np.searchsorted(columns, np.arange(n_columns)), 1)


PRICED = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])


def best_terms(block: dict, groups: list[dict], v: int, whole: int, most: int) -> list[tuple[str, str, int]]:
    """``source, term, value`` of the block's dearest terms of each group that cost more there than in the language."""
    out = []
    base = prices(np.array(block["totals"], np.int64), whole, v)
    at = np.repeat(np.arange(len(block["terms"])), np.diff(block["starts"]))
    source_at, counts = np.array(block["source_at"]), np.array(block["counts"], np.int64)
    for g in groups:
        if g["source"] not in block["sources"]:
            continue
        mine = np.flatnonzero(source_at == block["sources"].index(g["source"]))
        p, q = prices(counts[mine], g["n"], v), base[at[mine]]
        value, mine = differences(p, q)[p > q], at[mine[p > q]]
        if len(value) > most:  # ties at the border stay, the rank decides
            keep = value >= np.partition(value, -most)[-most]
            value, mine = value[keep], mine[keep]
        out += [(g["source"], block["terms"][t], int(x)) for t, x in zip(mine.tolist(), value.tolist(), strict=True)]
    return out


def price_pairs(block: dict, left: list[dict], right: list[dict], v: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Sums over the block's terms of what each group of ``left`` costs against each of ``right``, and the reverse."""
    at = np.repeat(np.arange(len(block["terms"])), np.diff(block["starts"]))
    source_at, counts = np.array(block["source_at"], np.int64), np.array(block["counts"], np.int64)

    def side(groups: list[dict]):
        place = {g["source"]: i for i, g in enumerate(groups)}
        group = np.array([place.get(s, -1) for s in block["sources"]])[source_at]
        there = group >= 0
        matrix, of_group, count = levels(at[there], group[there], counts[there], len(block["terms"]), len(groups))
        price = np.empty(len(count), np.int64)
        for i, g in enumerate(groups):
            price[of_group == i] = prices(count[of_group == i], g["n"], v)
        return matrix, of_group, price

    x, gx, px = side(left)
    y, gy, py = (x, gx, px) if same else side(right)
    joint = (x.T @ y).astype(np.int64)  # every joint table of the block
    there = folded(joint * differences(px[:, None], py[None, :]), gx, len(left), gy, len(right))
    back = there.T if same else folded(joint * differences(py[None, :], px[:, None]), gx, len(left), gy, len(right)).T
    return there, back


def priced(blocked: DataFrame, pairs: DataFrame, most: int) -> DataFrame:
    """``lang, source, part, item, value`` in partial sums (pairs) and with more than the first ``most`` (terms)."""
    # a block without terms for each language, so that every pair of its groups has a row
    none = pairs.where("salt = 0 and b = 0 and b2 = 0").select("lang", "salt")
    empty = none.selectExpr("lang", "salt", "array() terms", "array(0) starts", "array() totals", "array() sources", "array() source_at", "array() counts")
    joined = blocked.unionByName(empty).join(pairs, ["lang", "salt"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int, int], list] = {}

        def emptied() -> Iterator[pa.RecordBatch]:
            for (lang, b, b2), (left, right, there, back) in sums.items():
                names, others = [g["source"] for g in left], [g["source"] for g in right]
                rows = [(s, o, int(there[i, j])) for i, s in enumerate(names) for j, o in enumerate(others) if s != o]
                if b != b2:
                    rows += [(o, s, int(back[j, i])) for i, s in enumerate(names) for j, o in enumerate(others)]
                yield as_batch(lang, "pair", rows)
            sums.clear()

        for batch in slices(batches, 4 << 20):
            for row in batch.to_pylist():
                key = row["lang"], row["b"], row["b2"]
                left, right = row["groups"], row["groups2"]
                if key not in sums:
                    if len(sums) >= 64:
                        yield from emptied()
                    sums[key] = [left, right, np.zeros((len(left), len(right)), np.int64), np.zeros((len(right), len(left)), np.int64)]
                if row["terms"]:
                    there, back = price_pairs(row, left, right, row["v"], key[1] == key[2])
                    sums[key][2] += there
                    sums[key][3] += back
                    if key[1] == key[2]:
                        yield as_batch(row["lang"], "term", best_terms(row, left, row["v"], row["all"], most))
        yield from emptied()

    return joined.mapInArrow(run, "lang string, source string, part string, item string, value long")


def as_batch(lang: str, part: str, rows: list[tuple[str, str, int]]) -> pa.RecordBatch:
    sources, items, values = list(zip(*rows, strict=True)) or [(), (), ()]
    columns = [pa.array([lang] * len(rows), pa.string()), pa.array(sources, pa.string()), pa.array([part] * len(rows), pa.string()), pa.array(items, pa.string())]
    return pa.RecordBatch.from_arrays([*columns, pa.array(values, pa.int64())], schema=PRICED)


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, most_terms: int = MOST_TERMS) -> DataFrame:
    """``lang, source, part, item, value, rank`` of every (lang, source) of ``docs``.

    Part ``pair`` compares with each other source of the language, part ``term`` lists the ``most_terms`` dearest terms
    above the language's price.  Null texts, languages and sources are empty strings and count like those.  Documents
    without terms still make their group.  A language without a kept term has value 0 in every pair and no term; one
    with a single source has no pair.  Repeated rows count as often as they stand there, and each is a document.  Ties rank by
    item.  An empty table gives an empty result; other columns are not read.
    """
    docs = named(docs)
    terms = kept_terms(docs, least_docs)
    found = written(priced(written(blocks(terms), "blocks"), group_blocks(docs, terms), most_terms), "priced")
    pairs = found.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = [pairs.withColumn("rank", F.row_number().over(order)),
              found.where("part = 'term'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most_terms)]
    return ranked[0].unionByName(ranked[1])


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ORACLE = rf"""
WITH docs AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS text, row_number() OVER () AS doc FROM documents),
words AS (SELECT lang, source, doc, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS total FROM words GROUP BY lang, term HAVING count(DISTINCT doc) >= {LEAST_DOCS}),
counts AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM words w JOIN kept k ON w.lang = k.lang AND w.term = k.term GROUP BY ALL),
groups AS (SELECT DISTINCT lang, source FROM docs),
langs AS (SELECT g.lang, (SELECT count(*) FROM kept k WHERE k.lang = g.lang) AS v, (SELECT coalesce(sum(total), 0) FROM kept k WHERE k.lang = g.lang) AS n FROM (SELECT DISTINCT lang FROM groups) g),
sums AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS n FROM groups g LEFT JOIN counts c ON g.lang = c.lang AND g.source = c.source GROUP BY ALL),
priced AS (SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n, (1 + {SCALE} * (coalesce(c.n, 0) + 1)::HUGEINT // (s.n + l.v))::BIGINT AS p,
    (1 + {SCALE} * (k.total + 1)::HUGEINT // (l.n + l.v))::BIGINT AS q
  FROM sums s JOIN langs l ON s.lang = l.lang JOIN kept k ON s.lang = k.lang LEFT JOIN counts c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p)::HUGEINT * (a.p - b.p) // b.p) AS value
  FROM priced a JOIN priced b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
parts AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0) AS value
    FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q)::HUGEINT * (p - q) // q FROM priced WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM parts)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM ranked WHERE part = 'pair' OR rank <= {MOST_TERMS}
"""
