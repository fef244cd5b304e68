"""The stages of one scan as tables under its key, each written once."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.types import StructType

from ..session import checkpoint_folder

_DONE = "schema string, seconds double"


class StageStore:
    """Tables by name below ``{spark.checkpoint.dir}/scan-{key}``.

    A table is made when it is first asked for and read from then on, by every depth of the scan and by a later run
    that names the same key, after a failure for example: a stage counts as there once its ``.done`` table is written,
    so one that was broken off is made again.  The key stands for the inputs; take another one for other inputs.
    """

    def __init__(self, spark: SparkSession, key: str | None = None):
        self.spark, self.key = spark, key or uuid.uuid4().hex
        self.folder = f"{checkpoint_folder(spark)}/scan-{self.key}"
        self.seconds: dict[str, float] = {}
        self._tables: dict[str, DataFrame] = {}

    def has(self, name: str) -> bool:
        return name in self._tables or self._done(name) is not None

    def table(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        if name not in self._tables:
            done = self._done(name)
            if done is None:
                start = time.perf_counter()
                rows = make()
                rows.write.mode("overwrite").parquet(f"{self.folder}/{name}")
                done = Row(schema=rows.schema.json(), seconds=time.perf_counter() - start)
                self.spark.createDataFrame([tuple(done)], _DONE).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/{name}.done")
            self.seconds[name] = done.seconds
            schema = StructType.fromJson(json.loads(done.schema))
            self._tables[name] = self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")
        return self._tables[name]

    def _done(self, name: str) -> Row | None:
        try:
            return self.spark.read.schema(_DONE).parquet(f"{self.folder}/{name}.done").first()
        except AnalysisException as err:
            if err.getCondition() != "PATH_NOT_FOUND":
                raise
            return None
