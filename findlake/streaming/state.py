"""Keyed state between micro-batches as versioned files.

Every batch writes the keys it changed under ``batch=<id>``; every ``SNAPSHOT_EVERY``-th batch
writes all keys. The state before a batch is the newest version of each key from the last
snapshot on, so running a batch again reads the same state and replaces the same folder: a
retried batch changes nothing. Versions older than the snapshot before the newest are deleted.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SNAPSHOT_EVERY = 20


def prune(spark: SparkSession, path: str, below: int) -> None:
    """Delete the folders of batches before ``below``."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    for found in files.listStatus(root):
        name = found.getPath().getName()
        if name.startswith("batch=") and int(name.removeprefix("batch=")) < below:
            files.delete(found.getPath(), True)


@dataclass(frozen=True)
class StateTable:
    path: str
    keys: Sequence[str]
    schema: str

    def before(self, spark: SparkSession, batch_id: int) -> DataFrame:
        """State left by the batches before ``batch_id``."""
        if batch_id <= 0:
            return spark.createDataFrame([], self.schema)
        first = ((batch_id - 1) // SNAPSHOT_EVERY) * SNAPSHOT_EVERY
        rows = spark.read.schema(f"{self.schema}, batch long").parquet(self.path)
        rows = rows.where((F.col("batch") >= first) & (F.col("batch") < batch_id))
        newest = rows.groupBy(*self.keys).agg(F.max("batch").alias("batch"))
        return rows.join(newest, [*self.keys, "batch"], "left_semi").drop("batch")

    def write(self, spark: SparkSession, batch_id: int, changed: DataFrame, full: DataFrame) -> None:
        """``changed``: rows of the keys this batch touched; ``full``: the whole next state."""
        rows = full if batch_id % SNAPSHOT_EVERY == 0 else changed
        names = [f.name for f in spark.createDataFrame([], self.schema).schema]
        rows.select(*names).write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")
        if batch_id % SNAPSHOT_EVERY == 0:
            prune(spark, self.path, batch_id - SNAPSHOT_EVERY)
