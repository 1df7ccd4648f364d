"""How good a model's verdicts and claims are against labeled truth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def verification_scores(outcomes: DataFrame) -> DataFrame:
    """``outcomes`` (category, real, verdict) scored per category and overall (category null)."""
    real, doubtful = F.col("real"), F.col("verdict") == "doubtful"
    rolled = outcomes.rollup("category").agg(
        F.count(F.lit(1)).alias("cases"),
        F.count_if(real).alias("real"),
        F.count_if(~real).alias("false_positive"),
        F.count_if(F.col("verdict") == "confirmed").alias("confirmed"),
        F.count_if(doubtful).alias("doubtful"),
        F.count_if(F.col("verdict") == "unsure").alias("unsure"),
        F.count_if(~F.col("verdict").isin("confirmed", "doubtful", "unsure")).alias("failed"),
        F.count_if(doubtful & ~real).alias("doubted_right"),
        F.count_if(doubtful & real).alias("real_doubted"),
    )
    return rolled.select(
        "*",
        F.try_divide("doubted_right", "doubtful").alias("doubt_precision"),
        F.try_divide("doubted_right", "false_positive").alias("false_positive_recall"),
        F.try_divide(F.col("real") - F.col("real_doubted"), "real").alias("real_retained"),
    )


def _near(points: DataFrame, line: str, radius: int) -> DataFrame:
    """Every line within ``radius`` of a point: 2r+1 rows each, for an equi join."""
    return points.withColumn("at", F.explode(F.sequence(F.col(line) - radius, F.col(line) + radius)))


def detection_scores(planted: DataFrame, claims: DataFrame, radius: int = 2) -> DataFrame:
    """``planted`` (case_id, planted_id, category, line), ``claims`` (case_id, claim_id, line):
    recall per category and, where category is null, precision over all claims."""
    near = _near(claims.select("case_id", F.col("line").alias("claim_line")).distinct(), "claim_line", radius).select("case_id", F.col("at").alias("line")).distinct()
    found = planted.join(near.withColumn("hit", F.lit(True)), ["case_id", "line"], "left")
    recall = found.groupBy("category").agg(F.count(F.lit(1)).alias("whole"), F.count_if(F.col("hit")).alias("part"))
    close = _near(planted.select("case_id", F.col("line").alias("planted_line")).distinct(), "planted_line", radius).select("case_id", F.col("at").alias("line")).distinct()
    met = claims.join(close.withColumn("hit", F.lit(True)), ["case_id", "line"], "left")
    precision = met.agg(F.count(F.lit(1)).alias("whole"), F.count_if(F.col("hit")).alias("part")).select(F.lit(None).cast("string").alias("category"), "whole", "part")
    return recall.unionByName(precision).select("category", "whole", "part", F.try_divide("part", "whole").alias("ratio"))


def clean_file_alarms(cases: DataFrame, planted: DataFrame, claims: DataFrame) -> DataFrame:
    """Claims on cases nothing was planted in."""
    clean = cases.select("case_id").distinct().join(planted.select("case_id").distinct(), "case_id", "left_anti")
    return claims.join(clean, "case_id", "left_semi").agg(F.count(F.lit(1)).alias("alarms"))


def pass_counters(verdicts: DataFrame, claims: DataFrame) -> DataFrame:
    """What a semantic pass did, per repository. ``verdicts``: repo, verdict (null = failed).
    ``claims``: repo, status (detected, rejected, failed)."""
    v = verdicts.groupBy("repo").agg(
        F.count_if(F.col("verdict").isNotNull()).alias("verified"),
        F.count_if(F.col("verdict") == "confirmed").alias("confirmed"),
        F.count_if(F.col("verdict") == "doubtful").alias("doubtful"),
        F.count_if(F.col("verdict") == "unsure").alias("unsure"),
        F.count_if(F.col("verdict").isNull()).alias("unusable"),
    )
    c = claims.groupBy("repo").agg(
        F.count_if(F.col("status") == "detected").alias("detected"), F.count_if(F.col("status") == "rejected").alias("rejected"), F.count_if(F.col("status") == "failed").alias("broken")
    )
    both = v.join(c, "repo", "full_outer").fillna(0)
    return both.withColumn("failed", F.col("unusable") + F.col("broken")).drop("unusable", "broken")
