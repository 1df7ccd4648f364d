"""Severity ranks: most serious first, so "at or above the bar" is ``rank <= bar``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from findlake.functions.fixed import SEVERITIES


def _ranked(values: tuple[str, ...], column: Column) -> Column:
    chain = F.lit(None).cast("int")
    for rank, value in reversed(list(enumerate(values))):
        chain = F.when(column == value, rank).otherwise(chain)
    return chain


def severity_rank(column: Column) -> Column:
    return _ranked(SEVERITIES, column)


def severity_name(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in SEVERITIES]), (rank + 1).cast("int"))


def threshold_rank(bar: Column) -> Column:
    """Rank a fail bar stands for: ``none`` has no rank, an unknown word is the lowest bar."""
    return F.when(bar == "none", F.lit(None).cast("int")).otherwise(
        F.coalesce(severity_rank(bar), F.lit(len(SEVERITIES) - 1))
    )


def severity_dimension(spark: SparkSession) -> DataFrame:
    """Five fixed rows, for zero-filled summaries."""
    return spark.range(len(SEVERITIES)).select(
        F.col("id").cast("int").alias("rank"), severity_name(F.col("id").cast("int")).alias("severity")
    )


def severity_from_score(score: Column) -> Column:
    """CVSS-style scores onto the five-step scale."""
    return (
        F.when(score >= 9.0, "critical").when(score >= 7.0, "high").when(score >= 4.0, "medium").otherwise("low")
    )


def severity_from_level(level: Column) -> Column:
    """SARIF ``level``; a style tool's ``error`` is an enforced rule, not a defect."""
    return F.when(level == "error", "medium").when(level.isin("note", "none"), "informational").otherwise("low")
