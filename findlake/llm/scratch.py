"""Tables between the steps of a job: written once under the shared folder, deleted when no longer read."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from findlake.session import checkpoint_root

#: Rows of a batch handed to Python; texts are long, so batches are kept short.
BATCH_ROWS = 500


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings of the operators that hand batches of texts to Python."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def folder(spark: SparkSession, label: str) -> str:
    """A new path under the shared folder."""
    return f"{checkpoint_root(spark)}/findlake/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows written once and read back: a lost executor costs a re-read, not a re-run."""
    path = folder(df.sparkSession, label)
    df.write.mode("errorifexists").parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.scratch_path = path
    return back


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def drop(*tables: DataFrame) -> None:
    """Delete tables that ``written`` made, after their last reader has run."""
    for table in tables:
        delete(table.sparkSession, table.scratch_path)


def ascii_lower(text: Column) -> Column:
    """A to Z in lower case, every other character as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
