"""Any table with an id and a text is a corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_corpus(df: DataFrame, id_column: Column, text_column: Column, source: str) -> DataFrame:
    """``target, path, content`` of a table; scan it with ``match_globs=False``."""
    return df.select(F.lit(source).alias("target"), id_column.cast("string").alias("path"), text_column.alias("content"))
