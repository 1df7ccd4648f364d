"""CODEOWNERS: the last matching rule decides, and a rule without owners removes ownership."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findlake.functions.globs import owner_rule_columns, path_lookups
from findlake.functions.text import trim_space

# --- fixed values: where the file is looked for, first place wins ---
PLACES = (".github/CODEOWNERS", "CODEOWNERS", "docs/CODEOWNERS")


def parse_rules(files: DataFrame) -> DataFrame:
    """``files`` (repo, path, content) to rules (repo, rule_ord, pattern, owners, regex, lookup)."""
    place = F.array_position(F.array(*[F.lit(p) for p in PLACES]), F.col("path"))
    chosen = files.where(F.col("path").isin(*PLACES)).groupBy("repo").agg(F.min_by("content", place).alias("content"))
    lines = chosen.select("repo", F.posexplode(F.split("content", r"\r?\n")).alias("rule_ord", "raw"))
    line = trim_space(F.col("raw"))
    kept = lines.withColumn("line", line).where("line <> '' AND NOT line RLIKE '^(#|\\\\^?\\\\[)'")
    tokens = F.split("line", r"\s+")
    comment = F.array_position(F.transform(tokens, lambda t: t.startswith("#")), F.lit(True))
    end = F.when(comment == 0, F.size(tokens)).otherwise(comment - 1).cast("int")
    rules = kept.select(
        "repo", "rule_ord", F.element_at(tokens, 1).alias("pattern"), F.slice(tokens, F.lit(2), F.greatest(end - 1, F.lit(0))).alias("owners")
    )
    return compile_rules(rules)


def compile_rules(rules: DataFrame) -> DataFrame:
    columns = owner_rule_columns(F.col("pattern"))
    compiled = rules.withColumn("__segments", columns["segments"]).where("size(__segments) > 0").drop("__segments")
    return compiled.withColumn("regex", columns["regex"]).withColumn("lookup", columns["lookup"])


def owners_of(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """Owners per path, empty when no rule matches. A rule meets only the paths that hold its
    literal key, and the regular expression decides among those."""
    asked = paths.select("repo", "path").distinct()
    keyed = asked.select("repo", "path", F.explode(F.array_distinct(path_lookups(F.col("path")))).alias("lookup"))
    met = keyed.join(rules.select("repo", "lookup", "regex", "rule_ord", "owners"), ["repo", "lookup"])
    hits = met.where(F.expr("path RLIKE regex")).groupBy("repo", "path").agg(F.max(F.struct("rule_ord", "owners")).alias("last"))
    nobody = F.array().cast("array<string>")
    return asked.join(hits, ["repo", "path"], "left").select("repo", "path", F.coalesce("last.owners", nobody).alias("owners"))


def module_owners(module_files: DataFrame, owners: DataFrame) -> DataFrame:
    """Per module: owners in first-named order, owned and total files, and whether all files
    agree. Owner order needs one row per distinct owner, never the module's file list."""
    rows = module_files.join(owners, ["repo", "path"])
    counts = rows.groupBy("repo", "module").agg(
        F.count_if(F.size("owners") > 0).alias("owned_files"),
        F.count(F.lit(1)).alias("total_files"),
        (F.min("owners") == F.max("owners")).alias("uniform"),
    )
    named = rows.select("repo", "module", "path", F.posexplode("owners").alias("pos", "owner"))
    first = named.groupBy("repo", "module", "owner").agg(F.min(F.struct("path", "pos")).alias("at"))
    listed = first.groupBy("repo", "module").agg(F.sort_array(F.collect_list(F.struct("at", "owner"))).alias("o"))
    names = F.transform("o", lambda x: x["owner"])
    joined = counts.join(listed, ["repo", "module"], "left")
    return joined.select("repo", "module", F.coalesce(names, F.array().cast("array<string>")).alias("owners"), "owned_files", "total_files", "uniform")
