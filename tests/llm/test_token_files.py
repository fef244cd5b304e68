import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from wardspark.llm import token_files
from wardspark.llm.common import written

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = "aAbé'sΣ  \n\t\x1c\x85 　<19,.—𝒜\r"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_ids_are_those_of_the_library(library):
    r = random.Random(6)
    texts = ["".join(r.choice(ODD) for _ in range(r.randint(0, 60))).replace("<", "<|endoftext|>" if r.random() < 0.3 else "<") for _ in range(3000)]
    found = token_files.loaded(PATH).encode(texts)
    for text, ids, want in zip(texts, found, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == want.ids, text


def test_files(spark, library, tmp_path):
    r = random.Random(8)
    rows = [(n, " ".join(r.choice(["some", "words", "zxq", "é!"]) for _ in range(r.randint(0, 90))), "x") for n in r.sample(range(500), 120)]
    rows += [(500, "long " * 5000, ""), (501, None, ""), (502, "", ""), (502, "", ""), (None, "no id", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string")
    manifest = written(token_files.write_sequences(docs, PATH, str(tmp_path / "out"), length=16, rows=4), "test-manifest")
    got = sorted((tuple(x) for x in token_files.read_documents(manifest).collect()), key=lambda x: x[1])
    want, at = [], 0
    for i, text, _ in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0)):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == want
    for row in manifest.collect():
        file = token_files.Sequences(row.path)
        before = pa.total_allocated_bytes()
        views = [file.tokens(i) for i in range(len(file))]
        masks = [file.mask(i) for i in range(len(file))]
        assert pa.total_allocated_bytes() == before  # nothing was copied
        assert len(file) == row.n_sequences and all(len(v) == 16 and v.dtype == np.uint16 for v in views)
        assert sum(sum(m.to_pylist()) for m in masks) == row.n_tokens


def test_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    manifest = written(token_files.write_sequences(docs, PATH, str(tmp_path / "none")), "test-manifest")
    assert token_files.read_documents(manifest).collect() == []


def test_a_full_cache_keeps_the_first_words(monkeypatch):
    monkeypatch.setattr(token_files, "CACHE", 40)
    encoder, library = token_files.Encoder(PATH), Tokenizer.from_file(PATH)
    for i in range(30):
        texts = [f"the word{i} of\nline{i}", f" w{i}\n\nx", f"tab{i}\tand  two ", "", "end\n", "\n", " \n", f"\nfirst {i}", "a b c　d"]
        got = [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)]
        assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]
        assert len(encoder.known) <= 40 + 60 and encoder.known["of"] < 20


def test_words_are_not_looked_up_twice():
    encoder = token_files.Encoder(PATH)
    encoder.encode(["some words that stand here\nand there"] * 3)
    looked = []

    class Counting(type(encoder.known)):
        def __getitem__(self, key):
            looked.append(key)
            return super().__getitem__(key)

    encoder.known = Counting(encoder.known.items())
    encoder.encode(["some words that stand here\nand there"])
    assert len(looked) == 7
