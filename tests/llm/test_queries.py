"""The registered queries on the smallest tables, and their SQL."""

from pathlib import Path

import duckdb
import pytest

import corpus_pipeline
from wardspark.llm import queries

SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="test tables not present")

COLUMNS = {
    "op1": ["doc_id", "n_shingles", "component_id", "kept"],
    "op2": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op3": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
    "op4": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op5": ["page_id", "host", "path", "rule", "verdict"],
    "op6": ["doc_id", "held_out", "score", "predicted"],
    "op7": ["page_id", "url", "text", "n_chars"],
    "op8": ["doc_id", "start", "n_tokens", "ids_crc32"],
    "op9": ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
    "op10": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "has_passage", "text"],
    "op11": ["lang", "source", "part", "item", "value", "rank"],
    "op12": ["lang", "rank", "phrase", "a", "l", "r", "n", "score"],
    "op13": ["doc_id", "held_out", "lang_pred", "score"],
}


def test_one_query_for_each_operator():
    assert sorted(q.split("_")[0] for q in queries.QUERIES) == sorted(COLUMNS)
    assert set(queries.ORACLE) <= set(queries.QUERIES) and set(corpus_pipeline.QUERIES) == {"pipeline"}
    assert len(corpus_pipeline.STAGES) == 5


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    frame = queries.QUERIES[name](spark, str(SF))
    assert set(COLUMNS[name.split("_")[0]]) <= set(frame.columns)
    got = [tuple(r) for r in frame.collect()]
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    if name.split("_")[0] not in ("op11", "op12"):
        assert len(got) == con.execute(f"SELECT count(*) FROM {'pages' if name[:3] in ('op5', 'op7') else 'documents'}").fetchone()[0]
    if name in queries.ORACLE:
        want = con.execute(queries.ORACLE[name])
        names, rows = [d[0] for d in want.description], want.fetchall()
        assert sorted(frame.columns) == sorted(names)
        order = [names.index(c) for c in frame.columns]
        assert sorted(got, key=str) == sorted((tuple(row[i] for i in order) for row in rows), key=str)
