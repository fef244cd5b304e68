"""Helpers shared by the operators: written tables, Arrow columns, distributed id sets."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import checkpoint_folder

#: Shared fixed values: what separates words, by its two definitions.
ASCII_SPACE = "\\x20\\x09-\\x0D"
NOT_WORD = "\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F"

#: For ``bytes.translate``: A-Z to a-z, and every ASCII byte that is no digit or letter to a space.
FOLD_WORDS = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20
    for c in range(256)
)


def written(df: DataFrame, label: str, small: bool = False) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and go on from that copy.

    Lost executors then cost the stages after the write only, and later reads are pruned.  A ``small`` table, which
    comes out of a shuffle of sums, is written by as many tasks as run at once, not by one for each shuffle partition.
    """
    spark = df.sparkSession
    if small:
        df = df.coalesce(spark.sparkContext.defaultParallelism)
    path = f"{checkpoint_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def extended(docs: DataFrame, columns: list[str], ddl: str) -> StructType:
    """The schema of the named columns of ``docs`` followed by those of ``ddl``."""
    return StructType(docs.select(*columns).schema.fields + StructType.fromDDL(ddl).fields)


def strings(column: pa.ChunkedArray | pa.Array) -> list[str]:
    """Python strings of an Arrow column, null as empty."""
    return [x or "" for x in column.to_pylist()]


def list_column(flat, lengths) -> pa.Array:
    """An Arrow list column from the values of all rows on end and the length of each row."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def slices(batches, most_bytes: int = 8 << 20):
    """Cut record batches so that no piece holds more than ``most_bytes`` (or one row)."""
    for batch in batches:
        rows = max(1, int(batch.num_rows * most_bytes / max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


#: A key with more rows than this, and than a part in so many of all rows, is not dealt to one task.
HOT_ROWS, HOT_PARTS = 5_000, 100_000


def spread_join(many: DataFrame, few: DataFrame, keys: list[str], count: str) -> DataFrame:
    """Inner join with a written table of one row for each key, which says in ``count`` how many rows of ``many`` have it.

    Rows of very frequent keys stay where they are and those keys are shipped: by the bound there are at most
    ``HOT_PARTS`` of them.  All others are joined as usual.
    """
    total = few.agg(F.sum(count)).first()[0] or 0
    hot = few.where(F.col(count) > max(HOT_ROWS, total // HOT_PARTS)).drop(count)
    if hot.isEmpty():
        return many.join(few.drop(count), keys)
    rest = few.where(F.col(count) <= max(HOT_ROWS, total // HOT_PARTS)).drop(count)
    others = many.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(rest, keys)
    return many.join(F.broadcast(hot), keys).unionByName(others)
