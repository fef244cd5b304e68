"""URL filters by a Bloom filter cascade (operator 5).

A cascade answers "is this key listed?" exactly for every key of a known
universe.  Level 1 is a Bloom filter of the listed keys; level 2 one of the
unlisted keys of the universe that level 1 lets through; level 3 one of the
listed keys that level 2 lets through; and so on until nothing is wrongly let
through.  A key is listed if the first level that refuses it is an even one.
The universe are all keys that the pages to be judged can ask for, so a page is
judged by looking into bit arrays, without a join.

Levels are built by Spark: tasks set the bits of their keys, and pieces of the
bit arrays are combined.  Keys are dealt into shards of at most ``SHARD_KEYS``
listed keys by hash, and each shard is shipped to executors by itself, so that
no broadcast grows with the list.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import extended, slices, strings, written

#: Listed keys of a shard; its levels take about 2.5 bytes a key.
SHARD_KEYS = 8_000_000
BITS_A_KEY, PROBES = 12, 6
LEVELS = 40
PIECE = 1 << 16

#: The filter's own list: hosts with one of these words between dots and hyphens.
BLOCKED_WORDS = ("casino", "bets", "ads", "track", "porn", "xxx", "viagra", "pills", "payday", "escort")

#: The rules of the contract: verdict, host, start of the path.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (after the first ``://``, A-Z lower-cased) and path; both empty for null or without ``://``."""
    url = F.coalesce(url, F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "(?s)^[^/?#]*", 0)
    path = F.regexp_extract(rest, "(?s)^[^/?#]*([^?#]*)", 1)
    return lower_ascii(host), path


def suffixes(host: Column) -> Column:
    """The host and every parent domain: ``a.b.c``, ``b.c``, ``c``."""
    parts = F.split(host, "\\.", -1)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def rule_keys(host: Column, path: Column, lengths: list[int]) -> Column:
    """Every key a rule could have that fits: a suffix of the host and a start of the path of a rule's length."""
    starts = F.array_compact(F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths]))
    none = F.array().cast("array<string>")
    pairs = F.flatten(F.transform(suffixes(host), lambda h: F.transform(starts, lambda p: F.concat(F.lit("r:"), h, p))))
    return F.when(host == "", none).otherwise(pairs)


def host_keys(host: Column) -> Column:
    none = F.array().cast("array<string>")
    return F.when(host == "", none).otherwise(F.transform(suffixes(host), lambda h: F.concat(F.lit("h:"), h)))


def shard_of(key: str, shards: int) -> int:
    return xxhash.xxh3_64_intdigest(key.encode("utf-8", "replace"), 77) % shards


def places(keys: list[str], level: int, size: int) -> np.ndarray:
    """The bits of each key in the array of a level, a row for each key: one hash a key, the rest side by side."""
    digests = b"".join([xxhash.xxh3_128_digest(k.encode("utf-8", "replace"), level) for k in keys])
    halves = np.frombuffer(digests, ">u8").astype(np.uint64).reshape(-1, 2)
    steps = np.arange(PROBES, dtype=np.uint64)
    return (halves[:, 1, None] + steps * (halves[:, 0, None] | np.uint64(1))) % np.uint64(size)


@dataclass
class Cascade:
    """The levels of one shard."""

    sizes: list[int]
    bits: list[bytes]

    def passes(self, keys: list[str], level: int) -> np.ndarray:
        array = np.frombuffer(self.bits[level], np.uint8)
        at = places(keys, level, self.sizes[level])
        return (array[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).all(1)

    def listed(self, keys: list[str]) -> np.ndarray:
        """Whether each key is listed: the first level that refuses it tells."""
        out = np.full(len(keys), len(self.sizes) % 2 == 1)
        left = np.arange(len(keys))
        for level in range(len(self.sizes)):
            passed = self.passes([keys[i] for i in left], level)
            out[left[~passed]] = level % 2 == 1
            left = left[passed]
            if not len(left):
                break
        return out


def set_bits(keys: DataFrame, level: int, shard: int, shards: int, size: int) -> bytes:
    """One level's bit array: pieces set by tasks, combined by piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(-(-size // 8), np.uint8)
        for batch in slices(batches):
            at = places(batch.column(0).to_pylist(), level, size).ravel()
            np.bitwise_or.at(bits, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        for n in range(0, len(bits), PIECE):
            if bits[n : n + PIECE].any():
                yield pa.RecordBatch.from_pylist([{"piece": n, "bits": bits[n : n + PIECE].tobytes()}])

    def combine(group: pa.Table) -> pa.Table:
        parts = [np.frombuffer(b, np.uint8) for b in group["bits"].to_pylist()]
        return pa.table({"piece": group["piece"][:1], "bits": [np.bitwise_or.reduce(parts).tobytes()]})

    out = bytearray(-(-size // 8))
    pieces = keys.mapInArrow(run, "piece long, bits binary").groupBy("piece").applyInArrow(combine, "piece long, bits binary")
    for row in pieces.toLocalIterator():
        out[row["piece"] : row["piece"] + len(row["bits"])] = row["bits"]
    return bytes(out)


def of_shard(keys: DataFrame, shard: int, shards: int) -> DataFrame:
    if shards == 1:
        return keys

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mine = [shard_of(k, shards) == shard for k in batch.column(0).to_pylist()]
            yield batch.filter(pa.array(mine, pa.bool_()))

    return keys.mapInArrow(run, keys.schema)


def let_through(keys: DataFrame, shipped: Broadcast, level: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield batch.filter(pa.array(shipped.value.passes(batch.column(0).to_pylist(), level), pa.bool_()))

    return keys.mapInArrow(run, keys.schema)


def build(listed: DataFrame, universe: DataFrame, shard_keys: int = SHARD_KEYS) -> Iterator[tuple[int, int, Cascade]]:
    """Number of a shard, number of all, and its cascade, one after the other.  ``listed(key)`` and ``universe(key)`` may
    repeat keys; null keys are left out.

    Exact for every key of the universe and every listed key.  The one anti-join here sees only what the first level
    lets through, and is made when the list or the corpus changes, not when pages are judged.
    """
    context = listed.sparkSession.sparkContext
    listed = written(listed.where("key is not null").select("key").distinct(), "listed")
    universe = universe.where("key is not null").select("key")
    shards = max(1, math.ceil(listed.count() / shard_keys))
    for shard in range(shards):
        inside, outside = of_shard(listed, shard, shards), of_shard(universe, shard, shards)
        cascade = Cascade([], [])
        count = inside.count()
        for level in range(LEVELS):
            if not count:
                break
            size = max(64, BITS_A_KEY * count)
            cascade.sizes.append(size)
            cascade.bits.append(set_bits(inside, level, shard, shards, size))
            # the other side's keys that this level lets through are the next level's content
            shipped = context.broadcast(cascade)
            through = let_through(outside, shipped, level)
            if level == 0:  # of the corpus's keys only what passed, about one in a hundred and the listed ones, is compared with the list
                through = through.distinct().join(inside, "key", "left_anti")
            inside, outside = written(through, "cascade"), inside
            shipped.destroy()
            count = inside.count()
        else:
            raise RuntimeError(f"cascade of shard {shard} not settled after {LEVELS} levels")
        yield shard, shards, cascade


def look_up(rows: DataFrame, keys: str, cascades: Iterable[tuple[int, int, Cascade]]) -> DataFrame:
    """Replace the array column ``keys`` by those of its keys that are listed, in their order.

    Each shard has a pass of its own; all but the last are written, and their arrays freed on driver and workers.
    """
    schema, at = rows.schema, rows.columns.index(keys)
    for shard, shards, cascade in cascades:
        shipped = rows.sparkSession.sparkContext.broadcast(cascade)

        def run(batches: Iterator[pa.RecordBatch], shard=shard, shards=shards, shipped=shipped) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                lists = [row or () for row in batch.column(at).to_pylist()]
                asked = list({k for row in lists for k in row if shards == 1 or shard_of(k, shards) == shard})
                refused = {k for k, is_listed in zip(asked, shipped.value.listed(asked).tolist(), strict=True) if not is_listed}
                # keys of other shards wait for their own pass
                kept = pa.array([[k for k in row if k not in refused] for row in lists], pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([kept if i == at else c for i, c in enumerate(batch.columns)], names=schema.names)

        rows = rows.mapInArrow(run, schema)
        if shard + 1 < shards:
            rows = written(rows, "looked-up")
            shipped.destroy()
    return rows


def listed_keys(hosts: DataFrame) -> DataFrame:
    """Keys of a list table ``host, path``: without a path (null or empty) the whole host, else what begins with the path at a slash."""
    path = F.coalesce("path", F.lit("")) if "path" in hosts.columns else F.lit("")
    name = lower_ascii(F.col("host"))
    key = F.when(path == "", F.concat(F.lit("h:"), name)).otherwise(F.concat(F.lit("b:"), name, F.regexp_replace(path, "/$", "")))
    return hosts.where(F.col("host") != "").select(key.alias("key"))


def path_keys(host: Column, path: Column) -> Column:
    """Every key a listed path could have that fits: a suffix of the host and a start of the path that ends before a slash, or all of it."""
    parts = F.split(F.regexp_replace(path, "/$", ""), "/", -1)
    starts = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    pairs = F.flatten(F.transform(suffixes(host), lambda h: F.transform(starts, lambda p: F.concat(F.lit("b:"), h, p))))
    return F.when((host == "") | (F.size(parts) < 2), F.array().cast("array<string>")).otherwise(pairs)


def judge_urls(pages: DataFrame, rules=RULES, blocked_words=BLOCKED_WORDS, shard_keys: int = SHARD_KEYS, blocked: DataFrame | None = None) -> DataFrame:
    """``page_id, host, path, rule, verdict, listed_host`` for every row of ``pages``.

    The longest fitting rule decides (the longer host among rules of one length).  Without a rule a page is
    blocked if its host or a parent domain is on the host list, which are the hosts of the corpus with a
    blocked word between dots and hyphens, and those of ``blocked``, a table of any length with ``host`` and, if it has
    one, ``path``: an entry with a path blocks what lies under it on the host and its subdomains.  Rules and lists are
    looked up in one cascade over all keys that any url of ``pages`` asks for.  A null url, or one without ``://``, has empty host and path, fits no rule
    and is allowed.  Repeated rows and null ids pass through; an empty table gives an empty result; other
    columns are not read.
    """
    spark = pages.sparkSession
    verdicts = {h + p: (v, h, p) for v, h, p in rules}
    lengths = sorted({len(p) for _, _, p in rules})
    host, path = split_url(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    keys = [rule_keys(F.col("host"), F.col("path"), lengths), host_keys(F.col("host"))]
    if blocked is not None and "path" in blocked.columns:
        keys.append(path_keys(F.col("host"), F.col("path")))
    asked = rows.withColumn("keys", F.concat(*keys))
    universe = written(asked.select(F.explode("keys").alias("key")).distinct(), "universe")
    word = F.exists(F.split(F.expr("substring(key, 3)"), "[.-]"), lambda w: w.isin(*blocked_words))
    hosts = universe.where(F.col("key").startswith("h:") & word)
    listed = spark.createDataFrame([("r:" + h + p,) for _, h, p in rules], "key string").unionByName(hosts)
    if blocked is not None:
        listed = listed.unionByName(listed_keys(blocked))
    found = look_up(asked, "keys", build(listed, universe, shard_keys))

    of_rules = F.transform(F.filter("keys", lambda k: k.startswith("r:")), lambda k: k.substr(F.lit(3), F.length(k)))
    by_rule = F.create_map(*[F.lit(x) for key, (v, _, _) in verdicts.items() for x in (key, v)])
    host_size = F.create_map(*[F.lit(x) for key, (_, h, _) in verdicts.items() for x in (key, len(h))])
    best = F.array_max(F.transform(of_rules, lambda k: F.struct(F.length(k).alias("a"), host_size[k].alias("b"), k.alias("rule"))))["rule"]
    on_list = F.filter("keys", lambda k: ~k.startswith("r:"))
    found = found.select("page_id", "host", "path", best.alias("rule"), F.when(F.size(on_list) > 0, F.expr("substring(keys[size(keys) - 1], 3)")).alias("listed_host"))
    verdict = F.coalesce(by_rule[F.col("rule")], F.when(F.col("listed_host").isNotNull(), "block").otherwise("allow"))
    return found.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "listed_host")


def words_sql(blocked_words=BLOCKED_WORDS) -> str:
    return ", ".join(f"'{w}'" for w in blocked_words)


ORACLE = f"""
WITH parts AS (
  SELECT page_id, coalesce(url, '') AS u, strpos(coalesce(url, ''), '://') AS mark FROM pages
), rest AS (
  SELECT page_id, CASE WHEN mark > 0 THEN substr(u, mark + 3) ELSE '' END AS r FROM parts
), urls AS (
  SELECT page_id,
         translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path
  FROM rest
), ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule,
    list_filter(
      list_transform(range(1, len(string_split(host, '.')) + 1), lambda i: array_to_string(list_slice(string_split(host, '.'), i, len(string_split(host, '.'))), '.')),
      lambda h: host <> '' AND len(list_intersect(regexp_split_to_array(h, '[.-]'), [{words_sql()}])) > 0) AS on_list
  FROM urls
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN len(on_list) > 0 THEN 'block' ELSE 'allow' END AS verdict,
       on_list[len(on_list)] AS listed_host
FROM ruled
"""
