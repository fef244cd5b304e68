"""Source trees on a shared file system: a listing data source and a content reader.

Spark's own file sources leave out names that start with ``_`` or ``.``, which
would lose ``__init__.py`` and editor rule files, so listing is a small Python
data source.  Listing is split by directory and only moves names and sizes;
the files themselves are read by tasks after the list has been spread evenly.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from fnmatch import fnmatchcase
from itertools import islice
from zlib import crc32

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.text import decode_content
from ..operators.filters import not_found
from ..rules.fixed import DEFAULT_GLOBS, SKIPPED_DIRS

LISTING = "target string, path string, size bigint"
_READ_CHUNK_BYTES = 32 << 20
_PARTITION_BYTES = 128 << 20


class _Share(InputPartition):
    """One directory to list: alone, with everything below it, or one part of a very wide one."""

    def __init__(self, target: str, folder: str, below: bool, part: int = 0, parts: int = 1):
        self.target, self.folder, self.below, self.part, self.parts = target, folder, below, part, parts

    def takes(self, name: str) -> bool:
        return self.parts == 1 or crc32(name.encode("utf-8", "surrogateescape")) % self.parts == self.part


class TreeReader(DataSourceReader):
    def __init__(self, options):
        self.targets = options["targets"].split("\n")
        self.globs = tuple(options.get("globs", "\n".join(DEFAULT_GLOBS)).split("\n"))
        self.shares = int(options.get("shares", "256"))

    def partitions(self):
        """Open directories level by level until there is enough to share out.

        Only a bounded number of names is looked at here: a directory with very
        many subdirectories is not opened but given out in parts by name.
        """
        ready, open_ = [], []
        for target in self.targets:
            if os.path.isdir(target):
                open_.append((target, target))
            elif os.path.exists(target):
                ready.append(_Share(target, "", False))
        while open_ and len(open_) < self.shares:
            deeper = []
            for target, folder in open_:
                found = list(islice(_folders(folder), 4 * self.shares + 1))
                if len(found) > 4 * self.shares:
                    ready += [_Share(target, folder, True, k, self.shares) for k in range(self.shares)]
                else:
                    ready.append(_Share(target, folder, False))
                    deeper += [(target, d) for d in found]
            open_ = deeper
        return ready + [_Share(t, f, True) for t, f in open_] or [_Share("", "", False)]

    def read(self, share: _Share) -> Iterator[tuple]:
        if not share.target:
            return
        if not share.folder:
            yield share.target, share.target, _size(share.target)
            return
        todo, top = [share.folder], True
        while todo:
            folder = todo.pop()
            for name in _names(folder):
                if any(fnmatchcase(name, g) for g in self.globs) and (not top or share.takes(name)):
                    path = os.path.join(folder, name)
                    yield share.target, path, _size(path)
            if share.below:
                todo += [d for d in _folders(folder) if not top or share.takes(os.path.basename(d))]
            top = False


def _names(folder: str) -> list[str]:
    try:
        return os.listdir(folder)
    except OSError:
        return []


def _folders(folder: str) -> Iterator[str]:
    try:
        with os.scandir(folder) as entries:
            for e in entries:
                if e.name not in SKIPPED_DIRS and e.is_dir(follow_symlinks=False):
                    yield e.path
    except OSError:
        return


def _size(path: str) -> int | None:
    try:
        return os.path.getsize(path)
    except OSError:
        return None


class SourceTree(DataSource):
    """``spark.read.format("source_tree").option("targets", "dir\\nfile")``"""

    @classmethod
    def name(cls):
        return "source_tree"

    def schema(self):
        return LISTING

    def reader(self, schema):
        return TreeReader(self.options)


def list_tree(spark: SparkSession, targets: list[str], globs=DEFAULT_GLOBS, shares: int = 256) -> DataFrame:
    """Files of the targets: directories are pruned and matched, a single file is taken as it is."""
    spark.dataSource.register(SourceTree)
    return (
        spark.read.format("source_tree")
        .option("targets", "\n".join(targets))
        .option("globs", "\n".join(globs))
        .option("shares", str(shares))
        .load()
    )


def missing(spark: SparkSession, targets: list[str]) -> DataFrame:
    """INFO findings for the listed targets that do not exist (an empty directory does)."""

    def gone(frames):
        for pdf in frames:
            yield pdf[[not os.path.exists(t) for t in pdf["request"]]]

    asked = spark.createDataFrame([(t,) for t in targets], "request string")
    return not_found(asked.mapInPandas(gone, "request string"))


def read_contents(listing: DataFrame, partitions: int | None = None) -> DataFrame:
    """Add ``raw`` bytes and ``error`` to a listing.

    Only paths are shuffled, so a hot directory is read by all tasks.  Without ``partitions`` there is one
    for every ``_PARTITION_BYTES`` of listed sizes, and as many as cores at least.
    """

    def read(frames):
        import pandas as pd

        for pdf in frames:
            rows, held = [], 0
            for row in pdf.itertuples(index=False):
                raw, error = None, None
                try:
                    with open(row.path, "rb") as f:
                        raw = f.read()
                except OSError as err:
                    error = str(err)
                rows.append((row.target, row.path, raw, error))
                held += len(raw or b"")
                if held > _READ_CHUNK_BYTES:
                    yield pd.DataFrame(rows, columns=["target", "path", "raw", "error"])
                    rows, held = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=["target", "path", "raw", "error"])

    n = partitions
    if n is None:
        listed = listing.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
        n = max(listing.sparkSession.sparkContext.defaultParallelism, -(-listed // _PARTITION_BYTES))
    return listing.repartition(n).select("target", "path").mapInPandas(
        read, "target string, path string, raw binary, error string"
    )


def read_listed(listing: DataFrame) -> DataFrame:
    """``target, path, content`` of the readable files of a listing."""
    return (
        read_contents(listing)
        .where(F.col("error").isNull())
        .select("target", "path", decode_content(F.col("raw")).alias("content"))
    )


def read_tree(spark: SparkSession, targets: list[str], globs=DEFAULT_GLOBS) -> DataFrame:
    """``target, path, content`` of all readable files."""
    return read_listed(list_tree(spark, targets, globs))
