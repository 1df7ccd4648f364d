"""Exact duplicates by distributed most-significant-digit radix partitioning.

The digits are the bytes of the normalised text. Round by round every open group is split by its
documents' next bytes, compared as bytes; a group of one document, or one whose texts have ended,
is closed. No digest decides equality. The width of a digit grows eightfold a round, so the number
of rounds is the logarithm of the longest text, while each byte of an open text is compared once.

A group's members are counted and their smallest id found by partial aggregation before the
shuffle; the result returns to the documents through a join whose hot keys adaptive execution may
split, because both sides are freshly exchanged. Only texts that still have a twin are carried to
the next round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findlake.llm.scratch import drop, written

FIRST_WIDTH = 64
GROWTH = 8


def normalised(text: Column) -> Column:
    """Null as the empty text; each run of ASCII white space as one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", " ")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after ``normalised``; null and empty texts are equal. Of equal
    texts the row with the smallest id stays. Rows that repeat id and text share their decision and
    count in ``group_size``. A null id stays only where no equal text has an id. An empty table
    gives an empty result; other columns are not read.
    """
    # one struct, so that names of other columns can't clash with the ones used here
    rows = docs.select(F.col(id_col).alias("doc_id"), F.encode(normalised(F.col(text_col)), "UTF-8").alias("rest"))
    state = rows.select("doc_id", F.lit(0).cast("long").alias("node"), F.unhex(F.sha2("rest", 256)).alias("sha"), "rest")
    closed, width = [], FIRST_WIDTH
    previous = []
    while True:
        split = state.select("doc_id", "node", "sha", F.substring("rest", 1, width).alias("digit"), F.substring("rest", width + 1, 2**31 - 1 - width).alias("rest"))
        groups = split.groupBy("node", "digit").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"))
        twins = written(groups.where("n > 1").select("node", "digit", "n", "first", F.monotonically_increasing_id().alias("next")), "radix-groups")
        ended = F.length("digit") < width
        step = split.join(twins.hint("merge"), ["node", "digit"], "left").select(
            "doc_id",
            "sha",
            F.coalesce("next", F.lit(-1)).alias("node"),
            F.coalesce("n", F.lit(1)).alias("n"),
            F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("first")).alias("first"),
            F.when(F.col("n").isNotNull() & ~ended, F.col("rest")).alias("rest"),
        )
        step = written(step, "radix-rows")
        for old in previous:
            drop(old)
        closed.append(step.where("rest is null").select("doc_id", "first", "n", "sha"))
        state = step.where("rest is not null").select("doc_id", "node", "sha", "rest")
        previous = [twins]
        if state.isEmpty():
            break
        width *= GROWTH
    out = closed[0]
    for rows in closed[1:]:
        out = out.unionByName(rows)
    return out.select(
        "doc_id",
        F.col("first").alias("keep_id"),
        F.col("n").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("first")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )
