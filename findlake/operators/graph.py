"""Graph iteration over edge tables ``(repo, src, dst)``.

Every round writes its result under the checkpoint folder and reads it back, so a round's plan
starts at a file scan, is computed once, and survives a lost executor. Only row counts reach
the driver. Joins put the unique node side against the edges, so a hot node's edges are split by
AQE, and every regrouping is a min or max that combines map-side.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findlake.session import materialize


# Propagation steps per written round: fewer writes, at most this many steps too many at the end.
HOPS = 2


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def reachable(edges: DataFrame, starts: DataFrame, keys: Sequence[str] = ("repo",)) -> DataFrame:
    """Nodes reached from ``starts`` (keys, node) along ``src -> dst``, starts excluded, with the
    round (``depth``) each was first reached in."""
    keys = list(keys)
    steps = materialize(edges.select("repo", "src", "dst").where("src <> dst").distinct(), "edges")
    frontier = materialize(starts.select(*keys, "node").distinct(), "starts")
    seen = [frontier]
    found: list[DataFrame] = []
    depth = 0
    while True:
        depth += 1
        reached = (
            frontier.join(steps.withColumnRenamed("src", "node"), ["repo", "node"])
            .select(*keys, F.col("dst").alias("node"))
            .distinct()
            .join(_union(seen).select(*keys, "node"), [*keys, "node"], "left_anti")
        )
        frontier = materialize(reached, "frontier")
        if frontier.isEmpty():
            break
        seen.append(frontier)
        found.append(frontier.withColumn("depth", F.lit(depth)))
    if not found:
        return frontier.withColumn("depth", F.lit(0))
    return _union(found)


def dependents(edges: DataFrame, starts: DataFrame, keys: Sequence[str] = ("repo",)) -> DataFrame:
    """Modules that depend, transitively, on a start: reachability over reversed edges."""
    return reachable(edges.select("repo", F.col("dst").alias("src"), F.col("src").alias("dst")), starts, keys)


def _spread_max(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Largest ``color`` that reaches each node, to a fixpoint."""
    current = nodes.select("repo", "node", "color")
    while True:
        before = current
        for _ in range(HOPS):
            offered = (
                edges.join(current.select("repo", F.col("node").alias("src"), "color"), ["repo", "src"])
                .groupBy("repo", F.col("dst").alias("node"))
                .agg(F.max("color").alias("offer"))
            )
            current = current.join(offered, ["repo", "node"], "left").select("repo", "node", F.greatest("color", "offer").alias("color"))
        old = before.select("repo", "node", F.col("color").alias("old"))
        current = materialize(current.join(old, ["repo", "node"]).withColumn("moved", F.col("color") > F.col("old")), "color")
        done = current.where("moved").isEmpty()
        current = current.select("repo", "node", "color")
        if done:
            return current


def components(edges: DataFrame) -> DataFrame:
    """Strongly connected components as ``(repo, node, component)``; ``component`` names a member.

    Forward colouring gives each node the largest node that reaches it; walking back from that
    node inside its colour yields exactly its component. What is left goes round again. Nodes
    without an incoming or outgoing edge cannot be on a cycle and are trimmed first each time.
    """
    left = materialize(edges.select("repo", "src", "dst").where("src <> dst").distinct(), "edges")
    done: list[DataFrame] = []
    held = left.count()
    while held:
        while True:
            sources = left.select("repo", F.col("src").alias("node")).distinct()
            targets = left.select("repo", F.col("dst").alias("node")).distinct()
            inner = sources.intersect(targets)
            kept = left.join(inner.withColumnRenamed("node", "src"), ["repo", "src"], "left_semi").join(
                inner.withColumnRenamed("node", "dst"), ["repo", "dst"], "left_semi"
            )
            trimmed = materialize(kept.select("repo", "src", "dst"), "trimmed")
            left, before, held = trimmed, held, trimmed.count()
            if before == held:
                break
        if not held:
            break
        nodes = left.select("repo", F.col("src").alias("node")).distinct().withColumn("color", F.col("node"))
        colored = _spread_max(nodes, left)
        src = colored.select("repo", F.col("node").alias("src"), F.col("color").alias("src_color"))
        dst = colored.select("repo", F.col("node").alias("dst"), F.col("color").alias("dst_color"))
        same = left.join(src, ["repo", "src"]).join(dst, ["repo", "dst"]).where("src_color = dst_color")
        roots = colored.where("node = color").select("repo", "color", "node")
        inside = same.select(
            "repo",
            F.concat_ws("\u0000", "src_color", "dst").alias("src"),
            F.concat_ws("\u0000", "src_color", "src").alias("dst"),
        )
        tagged = roots.select("repo", F.concat_ws("\u0000", "color", "node").alias("node"))
        back = reachable(inside, tagged).select("repo", "node").unionByName(tagged)
        part = materialize(
            back.select("repo", F.split("node", "\u0000").alias("p")).select("repo", F.col("p")[1].alias("node"), F.col("p")[0].alias("component")),
            "component",
        )
        done.append(part)
        left = materialize(
            left.join(part.select("repo", F.col("node").alias("src")), ["repo", "src"], "left_anti")
            .join(part.select("repo", F.col("node").alias("dst")), ["repo", "dst"], "left_anti")
            .select("repo", "src", "dst"),
            "edges",
        )
        held = left.count()
    if not done:
        return edges.select("repo", F.col("src").alias("node"), F.col("src").alias("component")).limit(0)
    return _union(done)


def cycles(edges: DataFrame) -> DataFrame:
    """Components of two or more modules, named by their first module: ``(repo, component, node)``."""
    parts = materialize(components(edges), "components")
    sized = parts.groupBy("repo", "component").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("first")).where("size >= 2")
    return parts.join(sized, ["repo", "component"]).select("repo", F.col("first").alias("component"), "node", "size")


def cycle_impact(size):
    return F.when(size <= 2, "low").when(size == 3, "medium").otherwise("high")


def shortest_cycles(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Per component the shortest way from its first module back to it; among equals the
    lexicographically smallest path. Layered search keeping one smallest path per node."""
    inside_src = members.select("repo", F.col("node").alias("src"), "component")
    inside_dst = members.select("repo", F.col("node").alias("dst"), "component")
    links = materialize(
        edges.select("repo", "src", "dst").where("src <> dst").distinct().join(inside_src, ["repo", "src"]).join(inside_dst, ["repo", "dst", "component"]),
        "links",
    )
    layer = materialize(
        members.select("repo", "component").distinct().select("repo", "component", F.col("component").alias("node"), F.array("component").alias("path")),
        "layer",
    )
    visited = [layer.select("repo", "component", "node")]
    closed: list[DataFrame] = []
    while True:
        step = layer.join(links.withColumnRenamed("src", "node"), ["repo", "component", "node"])
        best = step.groupBy("repo", "component", "dst").agg(F.min(F.concat("path", F.array("dst"))).alias("path"))
        best = materialize(best, "paths")
        back = best.where("dst = component").select("repo", "component", "path")
        closed.append(back)
        layer = materialize(
            best.withColumnRenamed("dst", "node")
            .join(back.select("repo", "component"), ["repo", "component"], "left_anti")
            .join(_union(visited), ["repo", "component", "node"], "left_anti"),
            "layer",
        )
        if layer.isEmpty():
            return _union(closed)
        visited.append(layer.select("repo", "component", "node"))


def value_flow(seeds: DataFrame, links: DataFrame) -> DataFrame:
    """Certainty of input reaching each name: the weaker link along a path, the best over paths.

    ``seeds``: repo, file, name, certainty. ``links``: repo, file, source, name, certainty (a
    binding whose value mentions ``source`` outside a sanitizer). Certainty is a small integer,
    so the fixpoint is reached after at most levels x longest path rounds.
    """
    keys = ["repo", "file", "name"]
    start = seeds.groupBy(*keys).agg(F.max("certainty").alias("certainty"))
    steps = materialize(links.groupBy("repo", "file", "source", "name").agg(F.max("certainty").alias("link")), "links")
    current = materialize(start, "flow")
    while True:
        carried = (
            steps.join(current.select("repo", "file", F.col("name").alias("source"), "certainty"), ["repo", "file", "source"])
            .groupBy(*keys)
            .agg(F.max(F.least("link", "certainty")).alias("offer"))
        )
        merged = current.select(*keys, "certainty").join(carried, keys, "full_outer").select(
            *keys,
            F.greatest("certainty", "offer").alias("certainty"),
            (F.coalesce("offer", F.lit(-1)) > F.coalesce("certainty", F.lit(-1))).alias("moved"),
        )
        current = materialize(merged, "flow")
        if current.where("moved").isEmpty():
            return current.drop("moved")
