"""BPE encoding and decoding (operator 2).

A word starts as a doubly linked list of character symbols.  All mergeable
neighbours stand in a priority queue by merge rank and place; an entry whose
symbols have changed since it was pushed is stale and skipped.  Decoding
concatenates vocabulary strings.

Words are the unit of work, and text repeats its words, so a task keeps the
ids of those it has seen (up to ``CACHE`` entries, then it starts over).  A worker
outlives its task, so they go with the task: other steps need the memory.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import extended, list_column, slices, strings

CACHE = 500_000
#: Texts are encoded in pieces of so many bytes: ids and decoded texts of a piece stand in memory several times over.
PIECE_BYTES = 1 << 20

#: Fixed values of the vocabulary file's format: White_Space, and how bytes appear as printable characters.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
#: str.split() also splits at these, which are not White_Space.
ODD_SPLITS = regex.compile("[\\x1c-\\x1f]")
#: Every code point below is assigned, so that all Unicode versions agree on it.
LATE = regex.compile("[^\\x00-\\u0377]")


def byte_characters() -> list[str]:
    """For each byte its character: itself if printable, else the next one from U+0100 on."""
    out = [""] * 256
    for b in PRINTABLE:
        out[b] = chr(b)
    for n, b in enumerate(b for b in range(256) if not out[b]):
        out[b] = chr(0x100 + n)
    return out


class WordBpe:
    """A vocabulary whose words end in a suffix: lower case, white space dropped."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.path = path
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.merges = {
            (self.vocab[a], self.vocab[b]): (rank, self.vocab[a + b]) for rank, (a, b) in enumerate(model["merges"])
        }
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = [""] * (1 + max([*self.vocab.values(), *self.special.values()]))
        for token, i in [*self.vocab.items(), *self.special.items()]:
            self.strings[i] = token
        self.cut_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"]
        self.pieces = regex.compile(split.replace("\\s", SPACE))
        self.byte_chars = byte_characters()
        self.by_piece: dict[str, tuple[int, ...]] = {}
        self.by_chunk: dict[str, bytes] = {}

    @cached_property
    def library(self) -> Tokenizer:
        """Few texts need it, so most workers never load it."""
        return Tokenizer.from_file(self.path)

    def forget(self) -> None:
        """Drop the ids of words, and what Arrow holds back of freed memory."""
        self.by_piece.clear()
        self.by_chunk.clear()
        pa.default_memory_pool().release_unused()

    def merge(self, symbols: list[int]) -> list[int]:
        """Apply the merges of lowest rank first, leftmost among equals."""
        n, merges = len(symbols), self.merges
        queue = []
        for at in range(n - 1):
            found = merges.get((symbols[at], symbols[at + 1]))
            if found:
                queue.append((found[0], at, found[1]))
        if not queue:
            return symbols
        heapq.heapify(queue)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        while queue:
            rank, at, made = heapq.heappop(queue)
            right = after[at]
            if symbols[at] < 0 or right >= n:
                continue
            if merges.get((symbols[at], symbols[right]), (-1,))[0] != rank:
                continue  # stale: one of the two has been merged meanwhile
            symbols[at], symbols[right] = made, -1
            beyond = after[at] = after[right]
            if beyond < n:
                before[beyond] = at
                found = merges.get((made, symbols[beyond]))
                if found:
                    heapq.heappush(queue, (found[0], at, found[1]))
            left = before[at]
            if left >= 0:
                found = merges.get((symbols[left], made))
                if found:
                    heapq.heappush(queue, (found[0], left, found[1]))
        return [s for s in symbols if s >= 0]

    def merged(self, chars: str) -> tuple[int, ...]:
        vocab = self.vocab
        return tuple(self.merge([*map(vocab.__getitem__, chars[:-1]), vocab[chars[-1] + self.suffix]]))

    def piece(self, piece: str) -> tuple[int, ...]:
        ids = self.by_piece.get(piece)
        if ids is None:
            ids = self.merged("".join([self.byte_chars[b] for b in piece.encode()]))
            if len(self.by_piece) >= CACHE:
                self.by_piece.clear()
            self.by_piece[piece] = ids
        return ids

    def chunk(self, chunk: str) -> bytes:
        """Ids, as 32-bit integers, of a run of text without white space."""
        ids = np.array([i for p in self.pieces.findall(chunk) for i in self.piece(p)], "<i4").tobytes()
        if len(self.by_chunk) >= CACHE:
            self.by_chunk.clear()
        self.by_chunk[chunk] = ids
        return ids

    def plain(self, text: str) -> list[bytes]:
        if not text.isascii():
            if any(unicodedata.category(c) == "Cn" for c in set(LATE.findall(text))):
                # Unicode versions differ on such a code point, and the library's own tables decide
                pieces = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
                return [np.array(self.merged(p), "<i4").tobytes() for p, _ in pieces]
            text = unicodedata.normalize("NFC", text)
        # the file lower-cases each character by itself; a word-final sigma is no exception there
        text = text.lower() if "Σ" not in text else "".join(c.lower() for c in text)
        chunks = regex.split(f"[{SPACE}]+", text) if ODD_SPLITS.search(text) else text.split()
        known = self.by_chunk.get
        return [known(c) or self.chunk(c) for c in chunks]

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text.  Special tokens that occur in it as text become their ids."""
        if self.cut_special is None or not self.cut_special.search(text):
            return np.frombuffer(b"".join(self.plain(text)), "<i4")
        parts: list[bytes] = []
        for part in self.cut_special.split(text):
            parts += [np.array([self.special[part]], "<i4").tobytes()] if part in self.special else self.plain(part)
        return np.frombuffer(b"".join(parts), "<i4")

    def decode(self, ids: np.ndarray) -> str:
        """Vocabulary strings, special ones too, with a space between (the file names no decoder)."""
        return " ".join(map(self.strings.__getitem__, ids.tolist()))


@lru_cache(maxsize=2)
def loaded(path: str) -> WordBpe:
    return WordBpe(path)


def encode_decode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, ids array<int>, decoded string``: every text encoded, and its ids decoded again.

    ``tokenizer`` is the path of a vocabulary file that every executor has.  A null text counts as
    empty and has no ids and an empty decoded text.  Rows are independent: ties, repeated rows and null
    ids pass through, an empty table gives an empty result, and other columns are not read.
    """
    schema = extended(docs, [id_col], "ids array<int>, decoded string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(tokenizer)
        try:
            for batch in slices(batches, PIECE_BYTES):
                ids = [bpe.encode(t) for t in strings(batch.column(1))]
                flat = np.concatenate([np.zeros(0, "<i4"), *ids])
                decoded = pa.array([bpe.decode(x) for x in ids], pa.string())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), list_column(flat, [len(x) for x in ids]), decoded], names=schema.names
                )
        finally:
            bpe.forget()

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def digests(encoded: DataFrame, *columns: str) -> DataFrame:
    """The named columns, the number of ids, and digests of ids and decoded text."""
    return encoded.select(
        *columns,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
