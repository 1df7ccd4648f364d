"""Connected components of a graph of links, with written tables between rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findlake.llm.scratch import drop, written


def _least(edges: DataFrame) -> DataFrame:
    """``u, low``: the least of each ``u`` and its neighbours ``v``. It is written, so that its join
    with the edges exchanges both sides and a node of many edges can be split."""
    return written(edges.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low")), "least")


def components(links: DataFrame) -> DataFrame:
    """``node, root`` of every node of ``links`` (``u, v``, either way round): its component's least node.

    Edges are turned towards lower nodes by two alternating star operations until nothing changes.
    A node of many edges never meets them in one task: its least neighbour is found by partial
    aggregation and returns through a join that may be split. No link gives an empty result.
    """
    edges = written(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _least(both)
        large = both.join(least.hint("merge"), "u").where("v > u and v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
        large = written(large.distinct(), "edges")
        lower = _least(large)
        down = large.join(lower.hint("merge"), "u")
        small = down.where("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v")).unionByName(down.select("u", F.col("low").alias("v")))
        turned = written(small.distinct(), "edges")
        drop(edges, least, large, lower)
        edges = turned
        now = tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == seen:
            break
        seen = now
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
