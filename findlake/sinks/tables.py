"""Ledger and baseline tables, replaced by repository."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A repository's rows are spread over this many files, so one that holds most of the table is
# not written by a single task.
SPREAD = 32


def save(df: DataFrame, path: str) -> None:
    """Replace only the partitions of the repositories in ``df``; readers never see a mix of old
    and new files of one repository because the job commits once."""
    spread = df.withColumn("__salt", F.pmod(F.xxhash64(*[c for c in df.columns if c not in ("history",)]), F.lit(SPREAD)))
    spread.repartition("repo", "__salt").drop("__salt").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("repo").parquet(path)


def clear(df: DataFrame, path: str) -> None:
    """Drop everything a table holds, keeping its schema."""
    df.limit(0).write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(path)
