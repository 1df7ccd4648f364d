"""Proportional stratified interleaving: every shard holds the mixture of the sources.

Rows are shuffled within their source by a seeded hash and ranked; a row's fractional rank is
``(rank - 1/2) / rows of the source``. Sorted by it, the sources lie evenly mixed, and equal cuts of
that order give shards whose row counts differ by at most one and in which each source has its
share. Only DataFrame functions run.

No source is ranked in one task: a rank is the number of rows in the earlier bins of the hash plus
the rank inside the bin, and the position in the merged order is found the same way over bins of
the fractional rank. Both bin tables have at most ``BINS`` rows for a source or in all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from findlake.llm.scratch import written

BIN_DIGITS = 3
BINS = 16**BIN_DIGITS


def stratified_shards(
    docs: DataFrame, shards: int = 24, seed: int = 1, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "source"
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, stratum, size, text_crc32, rank, stratum_rows, position, shard, slot``.

    ``size`` is the UTF-8 length of the text plus 8; a null text has none. ``stratum`` is the source
    behind a ``=``, so that a null source is a stratum of its own (``-``). Rows that share an id are
    ordered by checksum and size; rows equal in all of these are interchangeable. Fewer rows than
    shards leave shards empty; an empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.concat(F.lit("="), F.col(stratum_col).cast("string")), F.lit("-")).alias("stratum"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary")).alias("mark"),
    ).withColumn("bin", F.conv(F.substring("mark", 1, BIN_DIGITS), 16, 10).cast("int"))

    within = Window.partitionBy("stratum")
    bins = rows.groupBy("stratum", "bin").agg(F.count(F.lit(1)).alias("n")).select(
        "stratum",
        "bin",
        (F.sum("n").over(within.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"),
        F.sum("n").over(within).alias("stratum_rows"),
    )
    order = Window.partitionBy("stratum", "bin").orderBy("mark", "doc_id", "text_crc32", "size")
    rank = F.col("before") + F.row_number().over(order)
    ranked = rows.join(bins, ["stratum", "bin"]).withColumn("rank", rank).withColumn("part", (2 * F.col("rank") - 1) / (2 * F.col("stratum_rows")))
    ranked = written(ranked.drop("before", "bin").withColumn("cut", F.floor(F.col("part") * BINS).cast("int")), "interleave")

    cuts = ranked.groupBy("cut").agg(F.count(F.lit(1)).alias("n"))
    everywhere = Window.partitionBy(F.lit(0))
    cuts = cuts.select(
        "cut",
        (F.sum("n").over(everywhere.orderBy("cut").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"),
        F.sum("n").over(everywhere).alias("rows"),
    )
    merged = Window.partitionBy("cut").orderBy("part", "stratum", "rank")
    position = F.col("before") + F.row_number().over(merged) - 1
    placed = ranked.join(cuts, "cut").withColumn("position", position).withColumn("shard", F.expr(f"cast(position * {shards} div rows as int)"))
    first = F.expr(f"(shard * rows + {shards - 1}) div {shards}")
    return placed.select("doc_id", "stratum", "size", "text_crc32", "rank", "stratum_rows", "position", "shard", (F.col("position") - first).alias("slot"))
