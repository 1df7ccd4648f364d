"""Architectural layers from names, and dependencies that go against them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: layers from the inside out, and the words that name them ---
LAYER_WORDS = {
    "domain": ("domain", "domains", "core", "entities", "model", "models"),
    "application": ("application", "app", "use-cases", "usecases", "services"),
    "adapter": ("adapter", "adapters", "gateways", "repositories"),
    "infrastructure": ("infrastructure", "infra", "persistence", "data"),
    "presentation": ("presentation", "ui", "web", "views", "components", "pages"),
}


def layer_of(name: Column) -> Column:
    """The one layer whose vocabulary has a whole word of the name; none or several is unknown."""
    lower = F.lower(name)
    words = F.filter(F.split(lower, r"[^\p{L}\p{N}]+"), lambda w: w != "")
    hits = []
    for layer, vocabulary in LAYER_WORDS.items():
        hit = F.arrays_overlap(words, F.array(*[F.lit(w) for w in vocabulary]))
        dashed = [lower.contains(w) for w in vocabulary if "-" in w]
        hits.append(F.when(reduce(lambda a, b: a | b, dashed, hit), F.lit(layer)))
    found = F.array_compact(F.array(*hits))
    return F.when(F.size(found) == 1, F.element_at(found, 1)).otherwise("unknown")


def assign(modules: DataFrame) -> DataFrame:
    """``modules`` (repo, module, name) with the layer of the name, or of the id without one."""
    return modules.select("repo", "module", layer_of(F.coalesce("name", "module")).alias("layer"))


def violations(edges: DataFrame, assigned: DataFrame) -> DataFrame:
    """Edges from an inner layer to an outer one, one row per pair of modules."""
    order = list(LAYER_WORDS)

    def position(layer: Column) -> Column:
        return F.array_position(F.array(*[F.lit(name) for name in order]), layer)

    known = assigned.where("layer <> 'unknown'").select("repo", "module", "layer", position(F.col("layer")).alias("pos"))
    src = known.select("repo", F.col("module").alias("src"), F.col("layer").alias("src_layer"), F.col("pos").alias("src_pos"))
    dst = known.select("repo", F.col("module").alias("dst"), F.col("layer").alias("dst_layer"), F.col("pos").alias("dst_pos"))
    crossing = edges.join(src, ["repo", "src"]).join(dst, ["repo", "dst"]).where("src_pos < dst_pos")
    return crossing.groupBy("repo", "src", "dst", "src_layer", "dst_layer").agg(F.sum("evidence_count").alias("evidence"))
