"""What a change reaches: its modules, their dependents, and the public names it touches."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findlake.operators.graph import dependents


@dataclass(frozen=True)
class Impact:
    modules: DataFrame
    unmapped: DataFrame
    public: DataFrame
    on_changed_lines: DataFrame
    summary: DataFrame


def estimate(
    changed: DataFrame,
    module_files: DataFrame,
    edges: DataFrame,
    symbols: DataFrame,
    touched_lines: DataFrame | None = None,
    unread: DataFrame | None = None,
    unresolved: DataFrame | None = None,
) -> Impact:
    """``changed``: repo, change, file, deleted. ``symbols``: repo, module, file, name, line,
    def_file. ``touched_lines``: repo, change, file, line. Each change is estimated on its own."""
    keys = ["repo", "change"]
    files = changed.groupBy(*keys, "file").agg(F.bool_or("deleted").alias("deleted"))
    owned = files.join(module_files.select("repo", "module", F.col("path").alias("file")), ["repo", "file"], "left")
    unmapped = owned.where("module IS NULL").select(*keys, "file")
    affected = owned.where("module IS NOT NULL").select(*keys, "module").distinct()
    below = dependents(edges, affected.select(*keys, F.col("module").alias("node")), keys)
    modules = affected.select(*keys, "module", F.lit("affected").alias("role")).unionByName(
        below.select(*keys, F.col("node").alias("module"), F.lit("downstream").alias("role"))
    )
    # Symbols meet the change by file first, so a module's whole surface is never listed per change.
    by_file = symbols.join(files.select(*keys, "file"), ["repo", "file"])
    by_definition = symbols.join(files.select(*keys, F.col("file").alias("def_file")), ["repo", "def_file"])
    met = by_file.unionByName(by_definition.select(*by_file.columns)).distinct()
    public = met.join(affected, [*keys, "module"], "left_semi")
    if touched_lines is None:
        touched = public.limit(0)
    else:
        touched = public.join(touched_lines.select(*keys, "file", "line").distinct(), [*keys, "file", "line"], "left_semi")
    counts = files.groupBy(*keys).agg(F.count(F.lit(1)).alias("changed_files"), F.count_if("deleted").alias("deleted_files"))
    counts = counts.join(affected.groupBy(*keys).agg(F.count(F.lit(1)).alias("affected_modules")), keys, "left")
    counts = counts.join(below.groupBy(*keys).agg(F.count(F.lit(1)).alias("downstream_modules")), keys, "left")
    counts = counts.join(unmapped.groupBy(*keys).agg(F.count(F.lit(1)).alias("unmapped_files")), keys, "left")
    counts = counts.join(public.groupBy(*keys).agg(F.count(F.lit(1)).alias("public_names")), keys, "left")
    if unread is None:
        counts = counts.withColumn("unread_files", F.lit(0).cast("long"))
    else:
        seen = files.join(unread.select("repo", "file").distinct(), ["repo", "file"], "left_semi")
        counts = counts.join(seen.groupBy(*keys).agg(F.count(F.lit(1)).alias("unread_files")), keys, "left")
    if unresolved is None:
        counts = counts.withColumn("computed_imports", F.lit(0).cast("long"))
    else:
        open_imports = unresolved.where("specifier IS NULL").groupBy("repo").agg(F.count(F.lit(1)).alias("computed_imports"))
        counts = counts.join(open_imports, "repo", "left")
    counts = counts.fillna(0)
    return Impact(modules, unmapped, public, touched, with_confidence(counts))


def _phrase(count: Column, text: str) -> Column:
    return F.when(count > 0, F.concat(count.cast("string"), F.lit(text)))


def with_confidence(counts: DataFrame) -> DataFrame:
    """High only when nothing was left out; never high when a file was removed."""
    reasons = F.array_compact(
        F.array(
            _phrase(F.col("deleted_files"), " removed file(s) are not in the graph"),
            _phrase(F.col("unmapped_files"), " changed file(s) belong to no module"),
            _phrase(F.col("unread_files"), " changed file(s) could not be read into the graph"),
            _phrase(F.col("computed_imports"), " import(s) name a computed path"),
            _phrase(F.col("public_names"), " changed name(s) are part of a public surface"),
        )
    )
    none = F.col("affected_modules") == 0
    confidence = F.when(none, "low").when(F.size(reasons) > 0, "medium").otherwise("high")
    rationale = (
        F.when(none, "none of the changed files belongs to a known module")
        .when(F.size(reasons) > 0, F.array_join(reasons, "; "))
        .otherwise("every changed file belongs to a module and the graph was read in full")
    )
    return counts.withColumn("confidence", confidence).withColumn("rationale", rationale)
