"""Token ids as Arrow stream files of equal-length sequences (operator 8).

Documents in ascending id order are dealt by range, one file for each range.
A file is an Arrow IPC stream whose record batches hold ``ROWS`` sequences as
fixed-size lists: ``tokens`` (uint16 if the vocabulary fits, else uint32) and
``mask`` (one bit: false behind the end).  Memory-mapped, sequence ``i`` is a view of
batch ``i // ROWS``: nothing is copied or decoded.  An index file beside it (an
Arrow stream too) holds id, start and length of each document.

Ids of a word depend on the word alone, so a worker encodes each once with the
tokenizers library and keeps the ids (up to ``CACHE``, then of the first half).
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ..session import checkpoint_folder
from .common import slices, strings

LENGTH = 2048
ROWS = 64
CACHE = 1_000_000  # words, and those of a slice of texts more

#: A space and the run of text behind it belong to no other word; white space is cut as the vocabulary file does.
CHUNK = re.compile(r" ?[^\s]+|\s+(?!\S)|\s+")
SPACE = re.compile(r"\s")
#: White space for some Unicode tables and not for others: such texts go to the library whole.
UNSURE = re.compile("[\\x1c-\\x1f\\x85\\u180e\\u200b\\ufeff]")

MANIFEST = "part int, path string, n_docs long, n_tokens long, n_sequences long"


class Words(dict):
    """Numbers of words, given as they come: ``w`` with the space before it, ``\\nw`` with the line end, a space and then anything alone.

    What white space may belong to is not a word (-1): such a text is cut by ``CHUNK``.
    """

    def __init__(self, known=(("", -1), ("\n", -1))):
        super().__init__(known)
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        if key[0] != " " and SPACE.search(key, key[0] == "\n"):
            return -1
        self.new.append(key)
        self[key] = n = len(self) - 2
        return n


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks fill the cores; threads of the library would only wait
        self.library = Tokenizer.from_file(path)
        self.special = re.compile("|".join(re.escape(t.content) for t in self.library.get_added_tokens_decoder().values()) or "(?!)")
        # a character of the vocabulary file stands for a byte
        self.widths = np.zeros(self.library.get_vocab_size(), np.int64)
        for token, i in self.library.get_vocab().items():
            self.widths[i] = len(token)
        # word ``n`` has the ids from ``ends[n]`` up to ``ends[n + 1]``
        self.known, self.ids, self.ends = Words(), np.zeros(0, "<u4"), np.zeros(1, np.int64)

    def forget(self) -> None:
        """Keep the words that came first: frequent ones are among them."""
        n = CACHE // 2
        self.known = Words(islice(self.known.items(), n + 2))
        self.ids, self.ends = self.ids[: self.ends[n]].copy(), self.ends[: n + 1].copy()

    def raw(self, texts: list[str]) -> list[bytes]:
        found = self.library.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", x.ids).tobytes() for x in found]

    def learn(self) -> None:
        """Encode new words.  Those behind a space or line end go to the library side by side as running text."""
        new, self.known.new = self.known.new, []
        running = [k if k[0] == "\n" else " " + k for k in new if k[0] != " "]
        alone = [k[1:] for k in new if k[0] == " "]
        ids = np.frombuffer(b"".join(self.raw(["".join(running[i : i + 64]) for i in range(0, len(running), 64)])), "<u4")
        bytes_ = np.cumsum([len(c.encode()) for c in running], dtype=np.int64)
        last = np.searchsorted(np.cumsum(self.widths[ids]), bytes_) + 1
        single = self.raw(alone)
        is_alone = np.array([k[0] == " " for k in new], bool)
        sizes = np.zeros(len(new), np.int64)
        sizes[~is_alone] = np.diff(last, prepend=0)
        sizes[is_alone] = [len(x) // 4 for x in single]
        # the ids of both kinds in the order of the words
        found = np.zeros(int(sizes.sum()), "<u4")
        of_alone = np.repeat(is_alone, sizes)
        found[~of_alone] = ids
        found[of_alone] = np.frombuffer(b"".join(single), "<u4")
        self.ends = np.concatenate([self.ends, len(self.ids) + np.cumsum(sizes)])
        self.ids = np.concatenate([self.ids, found])

    def numbers(self, text: str) -> np.ndarray:
        get, keys = self.known.__getitem__, []
        lines = text.split("\n")
        for n, line in enumerate(lines):
            words = line.split(" ")
            if n:
                words[0] = "\n" + words[0] if line or n < len(lines) - 1 else " \n"
            elif words[0]:
                words[0] = " " + words[0]
            else:
                del words[0]
            keys += words
        found = np.fromiter(map(get, keys), np.int64, len(keys))
        if len(found) and found.min() < 0:
            cut = CHUNK.findall(text)
            keys = [c[1:] if c[0] == " " and len(c) > 1 and not c.isspace() else " " + c for c in cut]
            found = np.fromiter(map(get, keys), np.int64, len(keys))
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts as little-endian 32-bit integers."""
        if len(self.known) > CACHE:
            self.forget()
        found = [None if UNSURE.search(t) or self.special.search(t) else self.numbers(t) for t in texts]
        self.learn()
        words = np.concatenate([np.zeros(0, np.int64), *(f for f in found if f is not None)])
        starts, sizes = self.ends[words], self.ends[words + 1] - self.ends[words]
        ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])
        ids = self.ids[np.repeat(starts - ends[:-1], sizes) + np.arange(ends[-1])]
        out, at = [], 0
        for t, f in zip(texts, found, strict=True):
            if f is None:
                out.append(self.raw([t])[0])
            else:
                out.append(ids[ends[at] : ends[at + len(f)]].tobytes())
                at += len(f)
        return out


@lru_cache(maxsize=2)
def loaded(path: str) -> Encoder:
    return Encoder(path)


def sequence_schema(length: int, ids: pa.DataType) -> pa.Schema:
    return pa.schema([("tokens", pa.list_(ids, length)), ("mask", pa.list_(pa.bool_(), length))])


INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


def place(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


class SequenceWriter:
    """Packs ids on end into sequences; holds one record batch."""

    def __init__(self, sink, length: int, rows: int, ids: pa.DataType):
        self.schema, self.length, self.most, self.type = sequence_schema(length, ids), length, length * rows, ids
        self.writer = pa.ipc.new_stream(sink, self.schema)
        self.ids, self.held, self.sequences = [], 0, 0

    def add(self, ids: np.ndarray) -> None:
        at = 0
        while at < len(ids):
            step = min(len(ids) - at, self.most - self.held)
            self.ids.append(ids[at : at + step])
            self.held += step
            at += step
            if self.held == self.most:
                self.flush()

    def flush(self) -> None:
        if not self.held:
            return
        pad = -self.held % self.length
        tokens = np.concatenate([*self.ids, np.zeros(pad, self.ids[0].dtype)])
        mask = np.arange(len(tokens)) < self.held
        lists = [pa.FixedSizeListArray.from_arrays(x, self.length) for x in (pa.array(tokens, self.type), pa.array(mask))]
        self.writer.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))
        self.sequences += len(tokens) // self.length
        self.ids, self.held = [], 0

    def close(self) -> None:
        self.flush()
        self.writer.close()


def write_sequences(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 0, length: int = LENGTH,
                    rows: int = ROWS) -> DataFrame:
    """Encode every text, append ``end_id``, write the files under ``folder``; returns the manifest.

    ``folder`` is a URI or path that all executors can write (``pyarrow.fs`` must know its scheme).  A task
    writes under names of its own attempt, so that a repeated or speculative one disturbs nothing; only
    files that the manifest names count.  A null text is empty and has the end id alone.  Rows that share
    an id stand next to each other, nulls first; an empty table gives an empty manifest.
    """
    ordered = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        encoder, sink = loaded(tokenizer), None
        end = np.array([end_id], "<u4").tobytes()
        total = n_docs = 0
        for batch in slices(batches, 1 << 20):
            if sink is None:
                system, base = place(folder)
                name = f"part-{part:06d}-{uuid.uuid4().hex}"
                system.create_dir(base, recursive=True)
                sink = system.open_output_stream(f"{base}/{name}.arrows")
                index = system.open_output_stream(f"{base}/{name}.index.arrows")
                narrow = encoder.library.get_vocab_size() <= 1 << 16
                out = SequenceWriter(sink, length, rows, pa.uint16() if narrow else pa.uint32())
                listed = pa.ipc.new_stream(index, INDEX)
            starts, sizes = [], []
            for found in encoder.encode(strings(batch.column(1))):
                ids = np.frombuffer(found + end, "<u4")
                out.add(ids.astype("<u2") if narrow else ids)
                starts.append(total)
                sizes.append(len(ids))
                total += len(ids)
            n_docs += batch.num_rows
            listed.write_batch(pa.RecordBatch.from_arrays([batch.column(0), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64())], schema=INDEX))
        if sink is not None:
            out.close()
            listed.close()
            sink.close()
            index.close()
            yield pa.RecordBatch.from_pylist([{"part": part, "path": f"{folder}/{name}", "n_docs": n_docs, "n_tokens": total, "n_sequences": out.sequences}], schema=MANIFEST_ARROW)

    return ordered.mapInArrow(run, MANIFEST)


MANIFEST_ARROW = pa.schema([("part", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("n_sequences", pa.int64())])


class Sequences:
    """Random access to the sequences of a file without copying them."""

    def __init__(self, uri: str):
        system, path = place(uri + ".arrows")
        local = isinstance(system, fs.LocalFileSystem)
        self.source = pa.memory_map(path) if local else system.open_input_file(path)
        with pa.ipc.open_stream(self.source) as reader:
            self.batches = list(reader)
        self.rows = self.batches[0].num_rows if self.batches else 1
        self.length = reader.schema.field("tokens").type.list_size

    def __len__(self) -> int:
        return sum(b.num_rows for b in self.batches)

    def _view(self, i: int, column: int) -> pa.Array:
        batch = self.batches[i // self.rows]
        return batch.column(column).values.slice((i % self.rows) * self.length, self.length)

    def tokens(self, i: int) -> np.ndarray:
        return self._view(i, 0).to_numpy(zero_copy_only=True)

    def mask(self, i: int) -> pa.BooleanArray:
        return self._view(i, 1)

    def span(self, start: int, size: int) -> Iterator[np.ndarray]:
        """Ids from place ``start`` on, as views of the sequences they stand in."""
        while size > 0:
            i, at = divmod(start, self.length)
            view = self.tokens(i)[at : at + size]
            yield view
            start, size = start + len(view), size - len(view)


def read_documents(manifest: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, read back from the files of a written manifest.

    ``start`` counts the ids of all files before and of the documents before it in its own.  The window
    runs over one row for each file.
    """
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0))).select("path", "base")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sequences = Sequences(uri)
                system, path = place(uri + ".index.arrows")
                with system.open_input_stream(path) as source, pa.ipc.open_stream(source) as reader:
                    for docs in reader:
                        starts, sizes = docs.column(1).to_numpy(), docs.column(2).to_numpy()
                        sums = [crc(sequences, s, n) for s, n in zip(starts.tolist(), sizes.tolist(), strict=True)]
                        yield pa.RecordBatch.from_arrays([docs.column(0), pa.array(starts + base), docs.column(2), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    # a number given by hand is kept: rows this small would otherwise be put together in one task
    return files.repartition(max(1, manifest.count()), "path").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def crc(sequences: Sequences, start: int, size: int) -> int:
    value = 0
    for view in sequences.span(start, size):
        value = zlib.crc32(view.astype("<u4"), value)
    return value


def default_folder(docs: DataFrame) -> str:
    return f"{checkpoint_folder(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
