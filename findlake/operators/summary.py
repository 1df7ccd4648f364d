"""Counts over findings and ledger entries, zero-filled where the dimension is fixed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findlake.functions.fixed import LEDGER_ACTIVE, LEDGER_STATES
from findlake.functions.severity import severity_dimension


def finding_summary(findings: DataFrame) -> DataFrame:
    """``(kind, key, findings)``: the total, every severity, every category seen; one scan."""
    cube = (
        findings.groupingSets([[], ["severity"], ["category"]], "severity", "category")
        .agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("gid"))
        .select(
            F.when(F.col("gid") == 3, "total").when(F.col("gid") == 1, "severity").otherwise("category").alias("kind"),
            F.coalesce("severity", "category", F.lit("")).alias("key"),
            "n",
        )
    )
    spark = findings.sparkSession
    fixed = severity_dimension(spark).select(F.lit("severity").alias("kind"), F.col("severity").alias("key"), F.lit(0).cast("long").alias("n"))
    return cube.unionByName(fixed).groupBy("kind", "key").agg(F.sum("n").alias("findings"))


def ledger_summary(ledger: DataFrame) -> DataFrame:
    """Entries by status (all five), and active entries by severity (all five) and category."""
    active = F.col("status").isin(*LEDGER_ACTIVE)
    counted = (
        ledger.groupingSets([["status"], ["severity"], ["category"]], "status", "severity", "category")
        .agg(
            F.count(F.lit(1)).alias("entries"),
            F.count_if(active).alias("active"),
            F.grouping_id().alias("gid"),
        )
        .select(
            F.when(F.col("gid") == 3, "status").when(F.col("gid") == 5, "active_severity").otherwise("active_category").alias("kind"),
            F.coalesce("status", "severity", "category").alias("key"),
            F.when(F.col("gid") == 3, F.col("entries")).otherwise(F.col("active")).alias("n"),
        )
        .where("kind <> 'active_category' OR n > 0")
    )
    spark = ledger.sparkSession
    states = spark.range(len(LEDGER_STATES)).select(
        F.lit("status").alias("kind"),
        F.element_at(F.array(*[F.lit(s) for s in LEDGER_STATES]), (F.col("id") + 1).cast("int")).alias("key"),
    )
    levels = severity_dimension(spark).select(F.lit("active_severity").alias("kind"), F.col("severity").alias("key"))
    zero = states.unionByName(levels).withColumn("n", F.lit(0).cast("long"))
    return counted.unionByName(zero).groupBy("kind", "key").agg(F.sum("n").alias("entries"))


def distinct_files_first_seen(findings: DataFrame) -> DataFrame:
    """Files a review touches, numbered by first appearance through ``min(ord)``."""
    return findings.groupBy("repo", "file").agg(F.min("ord").alias("first_ord"))
