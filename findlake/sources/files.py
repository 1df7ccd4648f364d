"""Source files: scan listing and the gate in front of their content."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from findlake.functions.fixed import MAX_FILE_BYTES, SCAN_EXTENSIONS
from findlake.functions.paths import extension, is_ignored_path


def read_tree(spark: SparkSession, root: str, repo_depth: int = 1) -> DataFrame:
    """Files under ``root`` as (repo, path, size, modified, content): the first ``repo_depth``
    directories name the repository. Listing columns are filtered before content is read."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = F.regexp_replace(F.lit(root), r"^(?:[a-z0-9]+:/*)?/*|/+$", "")
    inside = F.substring(F.col("path"), F.instr(F.col("path"), base) + F.length(base) + 1, F.length("path"))
    parts = F.split(inside, "/")
    return raw.select(
        F.array_join(F.slice(parts, 1, repo_depth), "/").alias("repo"),
        F.array_join(F.slice(parts, F.lit(repo_depth + 1), F.size(parts)), "/").alias("path"),
        F.col("length").alias("size"),
        F.col("modificationTime").alias("modified"),
        "content",
    ).where("path <> ''")


def listing(files: DataFrame, extensions: Sequence[str] = SCAN_EXTENSIONS) -> DataFrame:
    """Owned files of the scanned languages, one row each."""
    kept = files.where(~is_ignored_path(F.col("path")) & extension(F.col("path")).isin(*extensions))
    return kept.dropDuplicates(["repo", "path"])


def gate(files: DataFrame, limit: int = MAX_FILE_BYTES) -> tuple[DataFrame, DataFrame]:
    """``(text, skipped)`` of binary files: unreadable or not UTF-8 is left out with its reason.
    Every other file is read, whatever its size; ``large`` says that it is over ``limit``."""
    reason = F.when(F.col("content").isNull(), "unreadable").when(~F.is_valid_utf8(F.col("content").cast("string")), "not-utf8")
    marked = files.withColumn("reason", reason).withColumn("large", F.col("size") > limit)
    text = marked.where("reason IS NULL").withColumn("content", F.col("content").cast("string")).drop("reason")
    return text, marked.where("reason IS NOT NULL").drop("content")


def changed_since(files: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Files whose (path, size, modified) stamp is not in the previous snapshot."""
    return files.join(snapshot.select("repo", "path", "size", "modified"), ["repo", "path", "size", "modified"], "left_anti")


def lines(files: DataFrame) -> DataFrame:
    """One row per line, 1-based, with a trailing carriage return dropped."""
    split = F.posexplode(F.split("content", "\n")).alias("pos", "raw")
    keep = [c for c in files.columns if c != "content"]
    return files.select(*keep, split).select(*keep, (F.col("pos") + 1).alias("line"), F.regexp_replace("raw", r"\r\z", "").alias("text"))
