"""Benchmark decontamination (operator 3).

The windows of all benchmark items stand in one Aho-Corasick automaton.  Every
word of the benchmark is one private character there, so a text becomes a
string of as many characters as it has words (a common one for words that no
item has), and one scan of that string finds all windows.  Word places map back
to character offsets of the original text.

The automaton is shipped to the executors, so its size is bounded: items fill
parts of at most ``part_words`` words.  A benchmark with more than one part takes one
pass over the documents for each: what a pass found is written, and its part is
freed on driver and workers before the next one is read.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FOLD_WORDS, extended, slices, strings, written

WINDOW = 10
PART_WORDS = 1_000_000

#: Words of a text as characters of the original, A-Z included.
ORIGINAL_WORD = re.compile("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")
#: Characters for words: private planes and all above, then what is left below the surrogates.
FIRST, LAST, SKIP_FROM, SKIP_TO = 1, 0x10FFFF, 0xD800, 0xE000
OTHER = "\x00"


def words_of(text: str) -> list[bytes]:
    """Lower-case words (A-Z only is folded) as UTF-8."""
    return text.encode("utf-8", "replace").translate(FOLD_WORDS).split()


def benchmark_parts(items: DataFrame, part_words: int = PART_WORDS, window: int = WINDOW) -> Iterator[list[tuple[object, str]]]:
    """Items with a word, in parts of at most ``part_words`` words (``PART_WORDS`` at most, fewer than there are characters to stand for them).

    An item of more words comes in pieces that share ``window - 1`` words, so that they have its windows and no others.  Items come
    one partition at a time; the driver holds one part.
    """
    most = max(2 * window, min(part_words, PART_WORDS))
    part, size = [], 0
    for row in items.select("item_id", "text").toLocalIterator():
        words = words_of(row[1] or "")
        if len(words) <= most:
            pieces = [(len(words), row[1])] if words else []
        else:
            starts = range(0, len(words) - window + 1, most - window + 1)
            pieces = [(len(words[at : at + most]), b" ".join(words[at : at + most]).decode("utf-8", "replace")) for at in starts]
        for n, text in pieces:
            if part and size + n > most:
                yield part
                part, size = [], 0
            part.append((row[0], text))
            size += n
    if part:
        yield part


class Automaton:
    """Windows of one part of the benchmark."""

    def __init__(self, part: list[tuple[object, str]], window: int):
        self.chars: dict[bytes, str] = {}
        self.items = [item_id for item_id, _ in part]
        owners: dict[str, list[int]] = {}
        for n, (_, text) in enumerate(part):
            line = "".join(self.char(w) for w in words_of(text))
            for at in range(max(1, len(line) - window + 1)):
                of = owners.setdefault(line[at : at + window], [])
                if not of or of[-1] != n:
                    of.append(n)
        self.find = ahocorasick.Automaton()
        for key, of in owners.items():
            self.find.add_word(key, (len(key), of))
        self.find.make_automaton()

    def char(self, word: bytes) -> str:
        found = self.chars.get(word)
        if found is None:
            code = FIRST + len(self.chars)
            found = self.chars[word] = chr(code if code < SKIP_FROM else code + SKIP_TO - SKIP_FROM)
        return found

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Spans of words inside occurrences, merged where they meet, and the items found."""
        known = self.chars.get
        line = "".join([known(w, OTHER) for w in words])
        spans: list[tuple[int, int]] = []
        items: set[int] = set()
        for end, (length, of) in self.find.iter(line):
            items.update(of)
            spans.append((end + 1 - length, end + 1))
        return merged(spans), items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


@lru_cache(maxsize=1)
def built(name: str, window: int, part: Broadcast) -> Automaton:
    """The automaton of the part at hand, made once in a worker; the one before it goes."""
    return Automaton(part.value, window)


def passes(rows: DataFrame, items: DataFrame, window: int, part_words: int, one: Callable[[DataFrame, str, Broadcast], DataFrame]) -> DataFrame:
    """``one`` pass over ``rows`` for each part; all but the last are written and their parts freed."""
    sc = rows.sparkSession.sparkContext
    parts = benchmark_parts(items, part_words, window)
    part = next(parts, None)
    while part is not None:
        later = next(parts, None)
        shipped = sc.broadcast(part)
        rows = one(rows, uuid.uuid4().hex, shipped)
        if later is not None:
            rows = written(rows, "contamination")
            shipped.destroy()
        part = later
    return rows


def scan(docs: DataFrame, items: DataFrame, window: int = WINDOW, part_words: int = PART_WORDS) -> DataFrame:
    """``doc_id, n_words, word_spans, char_spans, item_ids`` for every row of ``docs``.

    ``word_spans`` and ``char_spans`` are lists of [start, end) of what stands in an occurrence of a
    benchmark window, counted in words and in characters of the original text; ``item_ids`` the items
    with an occurring window, as strings in order, each once.  An item of fewer words than ``window`` is
    one window; one without words occurs nowhere.  Null texts have no words.  An item without an id
    still covers words but is not listed.  Equal items, repeated rows and null doc_ids pass through row
    by row; with an empty benchmark nothing is found; other columns are not read.
    """
    span = "array<struct<start:int,end:int>>"
    found = extended(docs, ["doc_id", "text"], f"word_spans {span}, item_ids array<string>")
    rows = docs.select("doc_id", "text", F.array().cast(span).alias("word_spans"), F.array().cast("array<string>").alias("item_ids"))

    def one(rows: DataFrame, name: str, shipped: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = built(name, window, shipped)
            for batch in slices(batches):
                word_spans, ids = [], []
                texts = strings(batch.column(1))
                for text, before, listed in zip(texts, batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                    spans, items_found = automaton.scan(words_of(text))
                    more = {str(i) for i in map(automaton.items.__getitem__, items_found) if i is not None}
                    spans = merged([(s["start"], s["end"]) for s in before] + spans)
                    word_spans.append([{"start": s, "end": e} for s, e in spans])
                    ids.append(sorted(more.union(listed)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(word_spans, SPANS), pa.array(ids, pa.list_(pa.string()))], names=found.names)

        return rows.mapInArrow(run, found)

    rows = passes(rows, items, window, part_words, one)
    schema = extended(docs, ["doc_id"], f"n_words long, word_spans {span}, char_spans {span}, item_ids array<string>")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = strings(batch.column(1))
            counts = [len(words_of(t)) for t in texts]
            chars = [original(t, [(s["start"], s["end"]) for s in spans]) for t, spans in zip(texts, batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), batch.column(2), pa.array(chars, SPANS), batch.column(3)], names=schema.names)

    return rows.mapInArrow(place, schema)


def without_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, part_words: int = PART_WORDS) -> DataFrame:
    """The rows of ``docs``, with all their columns, in which no benchmark window occurs.

    Null and empty texts have no words and stay; with an empty benchmark all rows stay; an empty table stays empty.
    """
    at = docs.columns.index("text")

    def one(rows: DataFrame, name: str, shipped: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = built(name, window, shipped)
            for batch in slices(batches):
                texts = map(words_of, strings(batch.column(at)))
                yield batch.filter(pa.array([not automaton.scan(words)[0] for words in texts], pa.bool_()))

        return rows.mapInArrow(run, docs.schema)

    return passes(docs, items, window, part_words, one)


SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def original(text: str, spans: list[tuple[int, int]]) -> list[dict[str, int]]:
    """Character offsets of spans of words."""
    if not spans:
        return []
    at = [m.span() for m in ORIGINAL_WORD.finditer(text)]
    return [{"start": at[s][0], "end": at[e - 1][1]} for s, e in spans]


def digests(found: DataFrame) -> DataFrame:
    covered = F.aggregate("word_spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id",
        "n_words",
        covered.alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "item_ids").cast("binary"), 256).alias("items_sha256"),
        (F.size("word_spans") > 0).alias("contaminated"),
    )


_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)
#: ``digests`` of a scan with the default window, for items with ids.
ORACLE = f"""
WITH item AS (
  SELECT item_id, {_WORDS} AS w FROM benchmark
), windows AS (
  SELECT item_id, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda i: array_to_string(list_slice(w, i, i + 9), ' '))) AS win,
         least(len(w), 10) AS n
  FROM item WHERE len(w) > 0
), known AS (
  SELECT DISTINCT win, n FROM windows
), doc AS (
  SELECT doc_id, {_WORDS} AS w FROM documents
), place AS (
  SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS place_at, w FROM doc, (SELECT DISTINCT n FROM known) WHERE len(w) >= n
), hit AS (
  SELECT doc_id, place_at, p.n, k.win FROM (SELECT doc_id, place_at, n, array_to_string(list_slice(w, place_at, place_at + n - 1), ' ') AS win FROM place) p JOIN known k ON k.win = p.win AND k.n = p.n
), covered AS (
  SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(place_at, place_at + n)) AS pos FROM hit) GROUP BY 1
), items AS (
  SELECT doc_id, list_sort(list_distinct(list(CAST(item_id AS VARCHAR)))) AS ids FROM (SELECT DISTINCT doc_id, win, n FROM hit) JOIN windows USING (win, n) GROUP BY 1
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(ids), 0) AS n_items,
       sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""
