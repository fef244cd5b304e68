import hashlib
from pathlib import Path

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from wardspark.llm import quality

from . import brute

SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="test tables not present")


def test_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    kept = {r.doc_id for r in quality.quality_rules(docs).where("kept").collect()}
    rows = {r.doc_id: r for r in docs.collect()}
    left = {i: r.text for i, r in rows.items() if i in kept}
    left = {i: left[i] for i, (_, root) in brute.near_duplicates(list(left.items())).items() if i == root}
    cut = brute.repeats(list(left.values()), corpus_pipeline.PASSAGE_BYTES)
    texts = {i: bytes(b for b, g in zip(data, gone, strict=True) if not g).decode("utf-8", "ignore") for i, (data, gone) in zip(left, cut, strict=True)}
    found = brute.contamination(list(texts.items()), items)
    library = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    want = set()
    for i, text in texts.items():
        if not found[i][1]:
            ids = library.encode(text, add_special_tokens=False).ids
            want.add((i, len(text), len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()))
    got = corpus_pipeline.run(spark, str(SF))
    assert {(r.doc_id, r.n_chars, r.n_tokens, r.ids_sha256) for r in got.collect()} == want
    assert 0 < len(want) < len(rows)


def test_stages_pass_the_columns_on(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(SF)).columns == docs.columns, name
        assert stage(spark, docs.limit(0), str(SF)).collect() == [], name


def test_repeated_rows_and_null_ids_keep_one_text(spark):
    import random

    def text(seed):
        r = random.Random(seed)
        return " ".join("".join(r.choice("abcdefghijklmno") for _ in range(6)) for _ in range(120))

    near = text(1) + " end"
    rows = [(1, text(1)), (2, text(2)), (2, text(2)), (None, text(3)), (None, text(3)), (5, near), (5, text(4)), (None, text(2)),
            (6, text(6)), (7, text(6)), (7, text(7)), (8, ""), (8, ""), (9, ""), (10, None)]
    docs = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, row int")
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["MinHash near-dedup"](spark, docs, str(SF))
    assert kept.columns == docs.columns
    want = [(1, text(1)), (2, text(2)), (None, text(3)), (5, text(4)), (6, text(6)), (7, text(7)), (8, ""), (9, ""), (10, None)]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(want, key=str)
    after = stages["suffix-array dedup"](spark, kept, str(SF))
    assert sorted(((r.doc_id, r.text) for r in after.collect()), key=str) == sorted(want, key=str)


def test_extra_columns_with_clashing_names_and_long_texts(spark):
    import random

    r = random.Random(8)
    text = lambda n: " ".join("".join(r.choices("abcdefghijklmno", k=r.randint(2, 9))) for _ in range(n))
    passage = text(60)
    texts = [text(150) + " " + passage, passage + " " + text(150), text(100_000), text(120), None, "", text(30)]
    names = ["doc", "text_a", "digest", "e", "es", "n", "salt", "gram", "spans", "kept", "level", "bands"]
    rows = [(i, t, "en", "s", len(t or ""), *[f"{n}{i}" for n in names]) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names))
    (_, first), *others = corpus_pipeline.STAGES[:-1]
    good = first(spark, docs, str(SF))
    assert good.columns == docs.columns and {r.doc_id for r in good.collect()} <= {0, 1, 2, 3}
    for name, stage in others:  # on all rows: of six texts the very long one is an outlier
        docs = stage(spark, docs, str(SF))
        assert docs.columns == good.columns, name
    got = {x.doc_id: x for x in docs.collect()}
    assert set(got) == set(range(7))
    assert all(got[i][n] == f"{n}{i}" for i in got for n in names)
    assert passage not in got[0].text and passage not in got[1].text and got[2].text == texts[2]
    assert got[0].n_chars == len(got[0].text) < len(texts[0])


def test_workers_that_cannot_import_are_told_of_at_the_start(spark, monkeypatch):
    from pyspark.errors import PySparkException

    def broken(self):
        raise PySparkException("No module named 'wardspark'")

    monkeypatch.setattr(type(spark.range(1)), "collect", broken)
    with pytest.raises(RuntimeError, match="py-files"):
        corpus_pipeline.check_workers(spark)
