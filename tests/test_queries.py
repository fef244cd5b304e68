"""Every registered query against its SQL on the smallest tables, and the entry point."""

from pathlib import Path

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

SF = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
LIBRARY = {name: query for m in entry.LIBRARY for name, query in m.QUERIES.items()}
LIBRARY_SQL = {name: sql for m in entry.LIBRARY for name, sql in m.ORACLE.items()}
pytestmark = pytest.mark.skipif(not SF.exists(), reason="test tables not present")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def comparable(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if str(df[c].dtype).startswith("float"):
            df[c] = df[c].round(6)
        df[c] = df[c].map(lambda v: "~" if v is None or pd.isna(v) else str(v))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(LIBRARY))
def test_query(spark, duck, name):
    got = LIBRARY[name](spark, str(SF)).toPandas()
    sql = LIBRARY_SQL.get(name)
    if sql is None:
        assert len(got) > 0
        return
    want = duck.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want)
    assert comparable(got).equals(comparable(want))


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(LIBRARY) == set(LIBRARY_SQL)
