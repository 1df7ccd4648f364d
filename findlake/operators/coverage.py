"""What a review covered and what it left out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findlake.operators.ordered import top_per_key

STATUSES = ("checked", "partial", "parsed-only", "not-covered")


def skips_by_reason(skipped: DataFrame, examples: int) -> DataFrame:
    """Skipped files per reason with the first few paths: rows (path, ord, reason)."""
    counts = skipped.groupBy("reason").agg(F.count(F.lit(1)).alias("files"))
    shown = (
        top_per_key(skipped.select("reason", "ord", "path"), ["reason"], [F.col("ord"), F.col("path")], examples)
        .groupBy("reason")
        .agg(F.sort_array(F.collect_list(F.struct("position", "path"))).alias("e"))
    )
    return counts.join(shown, "reason").select("reason", "files", F.transform("e", lambda x: x["path"]).alias("examples"))


def language_coverage(files: DataFrame) -> DataFrame:
    """Per language: files, files with errors, the worst status and its reason.

    ``files``: repo, language, has_errors, status (position in ``STATUSES``; later is worse), reason.
    """
    rank = F.array_position(F.array(*[F.lit(s) for s in STATUSES]), F.col("status"))
    return files.groupBy("repo", "language").agg(
        F.count(F.lit(1)).alias("files"),
        F.count_if("has_errors").alias("files_with_errors"),
        F.max_by("status", rank).alias("status"),
        F.max_by("reason", F.struct(rank, F.col("reason"))).alias("reason"),
    )


def checked_rules(policy_rules: DataFrame, registry: DataFrame) -> DataFrame:
    """Rules a detector checked, per pack and version: policy rules met by the registry."""
    met = policy_rules.join(registry.select("rule_id").distinct(), "rule_id", "left_semi")
    return met.groupBy("repo", "pack", "version").agg(F.sort_array(F.collect_set("rule_id")).alias("rules"))


def rule_gaps(policy_rules: DataFrame, registry: DataFrame) -> DataFrame:
    """Policy rules no detector checks."""
    return policy_rules.join(registry.select("rule_id").distinct(), "rule_id", "left_anti")


def languages_without_binding(rules: DataFrame, bindings: DataFrame, languages: DataFrame) -> DataFrame:
    """Languages a repository uses that a rule's concept has no entry for.

    ``rules``: repo, rule_id, concept. ``bindings``: concept, language. ``languages``: repo, language.
    """
    wanted = rules.join(languages, "repo").select("repo", "rule_id", "concept", "language")
    missing = wanted.join(bindings.select("concept", "language").distinct(), ["concept", "language"], "left_anti")
    return missing.groupBy("repo", "rule_id").agg(F.sort_array(F.collect_set("language")).alias("languages"))


def complete(gaps: DataFrame, skips: DataFrame, runs: DataFrame, repos: DataFrame) -> DataFrame:
    """A review is complete when no rule was left out, no file skipped and every analyzer ran."""
    faults = gaps.select("repo").unionByName(skips.select("repo")).unionByName(runs.where("status = 'failed'").select("repo")).distinct()
    marked = repos.select("repo").distinct().join(faults.withColumn("fault", F.lit(True)), "repo", "left")
    return marked.select("repo", F.col("fault").isNull().alias("complete"))
