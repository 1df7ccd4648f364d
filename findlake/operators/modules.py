"""Module boundaries, module files and the dependency edges between modules."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findlake.functions import fixed
from findlake.functions.paths import ancestors, basename, dirname, is_ignored_path, join

# --- fixed values: directory names and the kind of module they suggest ---
WORKSPACE_GROUPS = {"packages": "package", "apps": "workspace"}
KIND_WORDS = {
    "adapter": ("adapters", "infrastructure", "infra", "gateways", "clients"),
    "layer": ("layers", "core", "application", "presentation", "ui"),
    "feature": ("features", "modules", "services", "components"),
}
NPM_LIKE = ("npm", "cargo", "none")


def kind_of(name):
    chain = F.lit("domain")
    for kind, words in reversed(list(KIND_WORDS.items())):
        chain = F.when(name.isin(*words), kind).otherwise(chain)
    return chain


def infer_boundaries(
    files: DataFrame, manifests: DataFrame, module_roots: Mapping[str, Sequence[str]] | None = None
) -> DataFrame:
    """``(repo, module, kind, name, manifest)``.

    Workspace groups, declared members and nested manifests come first; a repository with none
    of them is read as ``src/*``; one without those either is its root manifest and the inner
    directories of that ecosystem. ``manifests``: repo, dir (empty = root), ecosystem, name, member.
    """
    path = F.col("path")
    grouped = files.select("repo", F.regexp_extract(path, r"^((?:packages|apps)/[^/]+)/", 1).alias("module")).where("module <> ''").distinct()
    groups = F.when(F.col("module").startswith("packages/"), "package").otherwise("workspace")
    nested = manifests.where("dir <> '' AND (member OR ecosystem NOT IN ('npm', 'cargo'))").select("repo", F.col("dir").alias("module"))
    sources = files.where(~is_ignored_path(path)).select("repo", F.regexp_extract(path, r"^(src/[^/]+)/", 1).alias("module")).where("module <> ''").distinct()
    roots = manifests.where("dir = ''").groupBy("repo").agg(F.min("ecosystem").alias("ecosystem"))
    inner = None
    for ecosystem, directories in (module_roots or {}).items():
        named = [d for d in directories if d]
        for directory in directories:
            prefix = f"{directory}/" if directory else ""
            child = F.regexp_extract(path, rf"^{prefix}([^/]+)/", 1)
            part = files.where(~is_ignored_path(path)).select("repo", child.alias("child")).where("child <> '' AND NOT child RLIKE '^[._]'")
            if not directory and named:
                part = part.where(~F.col("child").isin(*{d.split("/")[0] for d in named}))
            part = part.distinct().join(roots.where(F.col("ecosystem") == ecosystem), "repo", "left_semi")
            part = part.select("repo", F.concat(F.lit(prefix), "child").alias("module"))
            inner = part if inner is None else inner.unionByName(part)
    stages = [
        grouped.select("repo", "module", groups.alias("kind"), F.lit(0).alias("stage"), F.lit(0).alias("priority")),
        nested.select("repo", "module", F.lit("package").alias("kind"), F.lit(0).alias("stage"), F.lit(1).alias("priority")),
        sources.select("repo", "module", kind_of(basename(F.col("module"))).alias("kind"), F.lit(1).alias("stage"), F.lit(0).alias("priority")),
        roots.select("repo", F.lit(".").alias("module"), F.lit("package").alias("kind"), F.lit(2).alias("stage"), F.lit(0).alias("priority")),
    ]
    if inner is not None:
        stages.append(inner.select("repo", "module", kind_of(basename(F.col("module"))).alias("kind"), F.lit(2).alias("stage"), F.lit(1).alias("priority")))
    found = stages[0]
    for stage in stages[1:]:
        found = found.unionByName(stage)
    modules = found.groupBy("repo", "module").agg(F.min(F.struct("stage", "priority", "kind")).alias("m"))
    first = modules.groupBy("repo").agg(F.min("m.stage").alias("stage"))
    kept = modules.join(first, "repo").where("m.stage = stage").select("repo", "module", "m.kind")
    rank = F.when(F.col("ecosystem") == "npm", 0).when(F.col("ecosystem") == "cargo", 1).otherwise(2)
    named = manifests.groupBy("repo", F.when(F.col("dir") == "", ".").otherwise(F.col("dir")).alias("module")).agg(
        F.min(F.struct(rank.alias("rank"), "ecosystem", "name")).alias("n")
    )
    return kept.join(named, ["repo", "module"], "left").select(
        "repo", "module", "kind", F.col("n.name").alias("name"), F.coalesce("n.ecosystem", F.lit("none")).alias("manifest")
    )


def _containing(files: DataFrame, modules: DataFrame) -> DataFrame:
    """Every (file, module) containment, by exploding the file's own prefixes: an equi join."""
    path = F.col("path")
    keys = F.array_union(ancestors(path), F.array(F.lit("."), F.regexp_replace(path, r"\.rs\z", "")))
    asked = files.select("repo", "path").distinct().select("repo", "path", F.explode(keys).alias("module"))
    return asked.join(modules, ["repo", "module"])


def boundary_of(files: DataFrame, modules: DataFrame) -> DataFrame:
    """The module with the longest directory that contains each file."""
    found = _containing(files, modules.select("repo", "module"))
    best = found.groupBy("repo", "path").agg(F.max(F.struct(F.length("module").alias("n"), "module")).alias("b"))
    return best.select("repo", "path", "b.module")


def module_files(files: DataFrame, modules: DataFrame) -> DataFrame:
    """Files of each module. A directory with its own manifest owns its files, not the manifest
    above it; the root owns what no other module does; npm and Cargo modules may overlap."""
    found = _containing(files, modules.select("repo", "module", "manifest"))
    marked = found.withColumn("declared", ~F.col("manifest").isin(*NPM_LIKE))
    deepest = marked.groupBy("repo", "path").agg(
        F.max(F.when(F.col("declared") & (F.col("module") != "."), F.length("module"))).alias("deepest"),
        F.bool_or(F.col("module") != ".").alias("elsewhere"),
    )
    joined = marked.join(deepest, ["repo", "path"])
    keep = (
        F.when(F.col("module") == ".", ~F.col("elsewhere"))
        .when(F.col("declared"), F.length("module") == F.col("deepest"))
        .otherwise(F.lit(True))
    )
    return joined.where(keep).select("repo", "module", "path")


def declared_edges(dependencies: DataFrame, modules: DataFrame) -> DataFrame:
    """Manifest dependencies on another module: by path, else by normalised name.

    ``dependencies``: repo, module, ecosystem, name, path (null = by name), manifest_file.
    """
    plain = F.regexp_replace(F.lower("name"), "[-_.]+", "_")
    by_name = modules.where("name IS NOT NULL").select("repo", F.col("manifest").alias("ecosystem"), plain.alias("plain"), F.col("module").alias("named")).groupBy(
        "repo", "ecosystem", "plain"
    ).agg(F.min("named").alias("named"))
    ids = modules.select("repo", "module").distinct()
    base = F.when(F.col("module") == ".", "").otherwise(F.col("module"))
    asked = dependencies.withColumn("plain", plain).withColumn("at", F.when(F.col("path").isNotNull(), join(base, F.col("path"))))
    asked = asked.withColumn("above", dirname(F.col("at")))
    hit = (
        asked.join(ids.select("repo", F.col("module").alias("at"), F.lit(True).alias("is_at")), ["repo", "at"], "left")
        .join(ids.select("repo", F.col("module").alias("above"), F.lit(True).alias("is_above")), ["repo", "above"], "left")
        .join(by_name, ["repo", "ecosystem", "plain"], "left")
    )
    target = F.when(F.col("is_at"), F.col("at")).when(F.col("is_above"), F.col("above")).otherwise(F.col("named"))
    return hit.select(
        "repo",
        F.col("module").alias("src"),
        target.alias("dst"),
        F.lit("declared").alias("kind"),
        F.col("manifest_file").alias("file"),
        F.lit(None).cast("int").alias("line"),
        F.concat(F.lit('declares dependency on "'), F.coalesce("path", "name"), F.lit('"')).alias("detail"),
    ).where("dst IS NOT NULL AND src <> dst")


def import_edges(resolved: DataFrame, modules: DataFrame) -> DataFrame:
    """Resolved imports as edge evidence between the modules of the two files.

    ``resolved``: repo, file, line, specifier, outcome, target, target_module.
    """
    places = resolved.select("repo", F.col("file").alias("path")).unionByName(resolved.where("target IS NOT NULL").select("repo", F.col("target").alias("path")))
    owner = boundary_of(places, modules)
    src = owner.select("repo", F.col("path").alias("file"), F.col("module").alias("src"))
    dst = owner.select("repo", F.col("path").alias("target"), F.col("module").alias("file_module"))
    joined = resolved.join(src, ["repo", "file"]).join(dst, ["repo", "target"], "left")
    return joined.select(
        "repo",
        "src",
        F.coalesce("target_module", "file_module").alias("dst"),
        F.lit("import").alias("kind"),
        "file",
        "line",
        F.concat(F.lit('imports "'), "specifier", F.lit('"')).alias("detail"),
    ).where("dst IS NOT NULL AND src <> dst")


def unresolved_imports(resolved: DataFrame) -> DataFrame:
    """Imports that could not be followed, with the reason; a computed one has no specifier."""
    return resolved.where(F.col("outcome").isin("not-found", "alias-target-not-found", "unknown-alias", "computed")).select(
        "repo", "file", "line", "specifier", F.col("outcome").alias("reason")
    )


def edges(evidence: DataFrame) -> DataFrame:
    """One edge per ``(repo, src, dst, kind)`` with its evidence count and first evidence. The
    evidence itself stays in rows: a popular edge may have any number of them."""
    return (
        evidence.where("src <> dst")
        .groupBy("repo", "src", "dst", "kind")
        .agg(F.count(F.lit(1)).alias("evidence_count"), F.min(F.struct("file", "line", "detail")).alias("first"))
        .select("repo", "src", "dst", "kind", "evidence_count", F.col("first.file").alias("file"), F.col("first.line").alias("line"), F.col("first.detail").alias("detail"))
    )


def computed_imports(resolved: DataFrame, files_of: DataFrame) -> DataFrame:
    """Computed imports per module."""
    counted = resolved.where("specifier IS NULL").groupBy("repo", F.col("file").alias("path")).agg(F.count(F.lit(1)).alias("n"))
    return files_of.join(counted, ["repo", "path"]).groupBy("repo", "module").agg(F.sum("n").alias("computed"))


def drop_ignored(files: DataFrame) -> DataFrame:
    """Files a review owns. ``bin`` and ``obj`` directories are output only beside a build tool:
    an anti join between the directories of each file and the directories holding a marker."""
    path = F.col("path")
    kept = files.where(~is_ignored_path(path))
    name = basename(path)
    marker = name.isin(*fixed.BUILD_MARKERS) | name.rlike(fixed.PROJECT_FILE_PATTERN)
    marked = files.where(marker).select("repo", dirname(path).alias("parent")).distinct()
    output = kept.select("repo", "path", F.explode(ancestors(dirname(path))).alias("dir")).where(
        basename(F.col("dir")).isin(*fixed.BUILD_OUTPUT_DIRS)
    )
    hidden = output.select("repo", "path", dirname(F.col("dir")).alias("parent")).join(marked, ["repo", "parent"], "left_semi")
    return kept.join(hidden.select("repo", "path").distinct(), ["repo", "path"], "left_anti")
