import hashlib
import random

import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from wardspark.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = "aAbé'sΣİ \n\t\x1c\x85　<1९,.—𝒜́՘Ɤ"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_ids_and_text_are_those_of_the_library(library):
    r = random.Random(5)
    own = bpe.loaded(PATH)
    for _ in range(1500):
        text = "".join(r.choice(ODD) for _ in range(r.randint(0, 50))).replace("<", "<|endoftext|>" if r.random() < 0.3 else "<")
        ids = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text).tolist() == ids
        assert own.decode(own.encode(text)) == library.decode(ids, skip_special_tokens=False)


def test_stale_entries_are_skipped():
    own = bpe.loaded(PATH)
    for word in ("aaaaaaaaaaaaaaaaaaaaaaaaa", "abababababab" * 50, "thethethethe", "x"):
        ids = list(own.merged(word))
        assert "".join(own.strings[i] for i in ids) == word + "</w>"


def test_rows(spark, library):
    rows = [(1, "Hello hello, it's 12", "x"), (None, None, "y"), (3, "", None), (3, "", None), (4, "w" * 30_000, ""), (5, " \n", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = bpe.digests(bpe.encode_decode(docs, PATH), "doc_id").collect()
    want = []
    for i, text, _ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert bpe.encode_decode(docs.limit(0), PATH).collect() == []


def test_a_worker_keeps_no_words_of_a_task(spark):
    docs = spark.range(0, 200, 1, 4).selectExpr("id AS doc_id", "concat('word', id, ' other', id) AS text")
    bpe.encode_decode(docs, PATH).write.format("noop").mode("overwrite").save()

    def held(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(bpe.loaded(PATH).by_chunk) + len(bpe.loaded(PATH).by_piece)], pa.int64())], names=["n"])

    assert {r.n for r in spark.range(0, 4, 1, 4).mapInArrow(held, "n long").collect()} == {0}
