"""Session settings and the one way this package cuts lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime SQL settings every job here expects. AQE splits hot join keys even when the split costs
# one more shuffle. Sizes estimated from files miss what paths, keys and exploded arrays add, so no
# estimate may make the driver collect a table: joins broadcast only what a shuffle has measured.
SQL_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "10MB",
    "spark.sql.session.timeZone": "UTC",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings; cluster sizing (executors, shuffle partitions) stays the user's."""
    for key, value in SQL_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder; on a cluster a machine-local
    folder would not survive a lost executor, so an unset folder is an error there.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder before running iterative jobs")
    folder = tempfile.mkdtemp(prefix="findlake-checkpoint-")
    context.setCheckpointDir(folder)
    return folder


def materialize(df: DataFrame, label: str = "step") -> DataFrame:
    """Write ``df`` once under the checkpoint folder and read it back.

    The rows are computed a single time, the new plan starts at a file scan with exact
    statistics, and a lost executor only re-reads files.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/findlake/{label}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)

