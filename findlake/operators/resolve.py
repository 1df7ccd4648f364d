"""What an import names: ranked candidate paths met with the file table by equi joins.

Requests are reduced to distinct ``(repo, base)`` pairs before probing, so a specifier a third
of all files repeat is probed once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findlake.functions.paths import ancestors, dirname, join, normalize, suffixes

# --- fixed values: extensions tried, in order, and the TypeScript twin of a JavaScript one ---
EXTENSIONS = (".ts", ".tsx", ".d.ts", ".js", ".jsx", ".mts", ".cts", ".mjs", ".cjs", ".json")
JS_TO_TS = {".js": (".ts", ".tsx"), ".jsx": (".tsx",), ".mjs": (".mts",), ".cjs": (".cts",)}


def _flat_candidates(base: Column) -> list[Column]:
    swaps = []
    for js, twins in JS_TO_TS.items():
        stem = F.regexp_replace(base, rf"\{js}\z", "")
        swaps += [F.when(base.endswith(js), F.concat(stem, F.lit(t))) for t in twins]
    return [*swaps, base, *[F.concat(base, F.lit(e)) for e in EXTENSIONS]]


def _index_candidates(base: Column) -> list[Column]:
    folder = F.when(base == "", F.lit("")).otherwise(F.concat(base, F.lit("/")))
    return [F.concat(folder, F.lit(f"index{e}")) for e in EXTENSIONS]


def first_existing(requests: DataFrame, files: DataFrame, keys: Sequence[str], candidates: str = "candidates") -> DataFrame:
    """First candidate (array order) that is a file; requests without one are left out."""
    exploded = requests.select(*keys, F.posexplode(candidates).alias("probe", "path")).where("path IS NOT NULL")
    existing = files.select("repo", "path").distinct()
    hits = exploded.join(existing, ["repo", "path"])
    return hits.groupBy(*keys).agg(F.min(F.struct("probe", "path")).alias("hit")).select(*keys, F.col("hit.path").alias("target"))


def probe(bases: DataFrame, files: DataFrame, entries: DataFrame | None = None) -> DataFrame:
    """``bases`` (repo, base): as written, with a TypeScript twin, with an extension, through a
    package entry (``entries``: repo, base, entry), then as a directory index."""
    base = F.col("base")
    asked = bases.select("repo", "base").distinct()
    if entries is None:
        through: list[Column] = []
    else:
        asked = asked.join(entries.groupBy("repo", "base").agg(F.min("entry").alias("entry")), ["repo", "base"], "left")
        through = _flat_candidates(join(base, F.col("entry")))
    ranked = asked.withColumn("candidates", F.array(*_flat_candidates(base), *through, *_index_candidates(base)))
    return first_existing(ranked, files, ["repo", "base"])


def _is_relative(specifier: Column) -> Column:
    return specifier.rlike(r"^\.\.?(/|\z)")


def _lookup_heads(text: Column, mark: str) -> Column:
    """Every beginning of ``text`` that ends behind ``mark``, and the empty one: the keys under
    which a pattern with a literal head can be found."""
    parts = F.split(text, F.lit(f"\\Q{mark}\\E"))
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.concat(F.array_join(F.slice(parts, F.lit(1), n), mark), F.when(n > 0, F.lit(mark)).otherwise("")))


def _lookup_head(head: Column, mark: str) -> Column:
    return F.regexp_extract(head, f"(?s)^(.*\\Q{mark}\\E)", 1)


def _from_roots(paths: DataFrame, roots: DataFrame, upwards: bool = True) -> DataFrame:
    """``repo, root_ord, rel, path``: each path as a name seen from each root that can reach it, with
    ``upwards`` also by ``..``. Roots meet paths by their own directories, never by repository alone;
    of the roots that give a path the same name, the first stands for all."""
    clean = normalize(F.col("root"))
    parts = F.split(clean, "/")
    depth = F.when(clean == "", 0).otherwise(F.size(parts))
    ups = F.sequence(F.lit(0), depth) if upwards else F.array(F.lit(0))
    steps = roots.select("repo", "root_ord", parts.alias("parts"), depth.alias("depth"), F.explode(ups).alias("up"))
    steps = steps.select("repo", "root_ord", F.array_join(F.slice("parts", F.lit(1), F.col("depth") - F.col("up")), "/").alias("head"), F.repeat(F.lit("../"), F.col("up")).alias("climb"))
    steps = steps.groupBy("repo", "head", "climb", F.isnull("root_ord").alias("unordered")).agg(F.min("root_ord").alias("root_ord")).drop("unordered")
    placed = paths.select("repo", "path").distinct().select("repo", "path", F.explode(F.array_distinct(F.concat(F.array(F.lit("")), ancestors(dirname(F.col("path")))))).alias("head"))
    below = F.when(F.col("head") == "", F.col("path")).otherwise(F.substring(F.col("path"), F.length("head") + 2, F.length("path")))
    return placed.join(steps, ["repo", "head"]).select("repo", "root_ord", F.concat("climb", below).alias("rel"), "path")


def _longest_under_roots(asked: DataFrame, rooted: DataFrame, extensions: Sequence[str], package_init: bool) -> DataFrame:
    """Per ``(repo, specifier)`` with ``names``: the file of the longest leading part of the names,
    then of the first root, then of the first extension."""
    takes = F.reverse(F.sequence(F.lit(1), F.size("names")))
    parts = asked.where("size(names) > 0").select("repo", "specifier", F.posexplode(F.transform(takes, lambda n: F.array_join(F.slice("names", F.lit(1), n), "/"))).alias("take", "name"))
    options = parts.select("repo", "specifier", "take", F.posexplode(_source_candidates(F.col("name"), extensions, package_init)).alias("option", "rel"))
    hits = options.join(rooted, ["repo", "rel"]).groupBy("repo", "specifier").agg(F.min(F.struct("take", "root_ord", "option", "path")).alias("hit"))
    return hits.select("repo", "specifier", F.col("hit.path").alias("target"))


def through_aliases(imports: DataFrame, aliases: DataFrame, files: DataFrame, entries: DataFrame | None = None) -> DataFrame:
    """Alias outcome per distinct ``(repo, scope, specifier)``: ``target`` of the first matching
    pattern's first existing target, or null when the pattern's targets are all missing.

    ``aliases``: repo, scope, ord, pattern, target_ord, target.
    """
    asked = imports.where(F.col("scope").isNotNull()).select("repo", "scope", "specifier").distinct()
    star = F.instr("pattern", "*")
    head = F.when(star > 0, F.substring(F.col("pattern"), F.lit(1), star - 1)).otherwise(F.col("pattern"))
    tail = F.when(star > 0, F.substring(F.col("pattern"), star + 1, F.length("pattern"))).otherwise("")
    spec = F.col("specifier")
    keyed = aliases.withColumn("head", head).withColumn("tail", tail).withColumn("starred", star > 0)
    keyed = keyed.withColumn("key", F.when(F.col("starred"), _lookup_head(F.col("head"), "/")).otherwise(F.col("pattern")))
    keys = F.array_distinct(F.concat(_lookup_heads(spec, "/"), F.array(spec)))
    joined = asked.withColumn("key", F.explode(keys)).join(keyed, ["repo", "scope", "key"]).drop("key").distinct()
    fits = (
        F.when(
            F.col("starred"),
            spec.startswith(F.col("head")) & spec.endswith(F.col("tail")) & (F.length(spec) >= F.length("head") + F.length("tail")),
        ).otherwise(spec == F.col("pattern"))
    )
    matched = joined.where(fits)
    first = matched.groupBy("repo", "scope", "specifier").agg(F.min("ord").alias("ord"))
    captured = F.substring(spec, F.length("head") + 1, F.length(spec) - F.length("head") - F.length("tail"))
    at = F.instr("target", "*")
    filled = F.when(
        F.col("starred") & (at > 0),
        F.concat(F.substring(F.col("target"), F.lit(1), at - 1), captured, F.substring(F.col("target"), at + 1, F.length("target"))),
    ).otherwise(F.col("target"))
    chosen = matched.join(first, ["repo", "scope", "specifier", "ord"]).withColumn("base", normalize(filled))
    hits = probe(chosen, files, entries)
    found = chosen.join(hits.withColumnRenamed("target", "hit"), ["repo", "base"], "left")
    return found.groupBy("repo", "scope", "specifier").agg(
        F.min_by("hit", F.when(F.col("hit").isNotNull(), F.col("target_ord"))).alias("alias_target"), F.lit(True).alias("aliased")
    )


def resolve_scripts(
    imports: DataFrame,
    files: DataFrame,
    packages: DataFrame,
    aliases: DataFrame | None = None,
    entries: DataFrame | None = None,
) -> DataFrame:
    """JavaScript and TypeScript specifiers: ``outcome`` (file, package, external, not-found,
    alias-target-not-found, unknown-alias, computed), ``target`` and ``target_module``.

    ``imports``: repo, file, line, specifier (null = computed), scope (config directory or null).
    ``packages``: repo, name, module.
    """
    spec = F.regexp_replace("specifier", r"(?s)\?.*\z", "")
    rows = imports.withColumn("specifier", spec) if "scope" in imports.columns else imports.withColumn("specifier", spec).withColumn("scope", F.lit(None).cast("string"))
    relative = _is_relative(F.col("specifier"))
    rows = rows.withColumn("base", F.when(relative, join(dirname(F.col("file")), F.col("specifier"))))
    hits = probe(rows.where("base IS NOT NULL"), files, entries)
    rows = rows.join(hits, ["repo", "base"], "left")
    bare = rows.where(F.col("base").isNull() & F.col("specifier").isNotNull())
    if aliases is None:
        rows = rows.withColumn("alias_target", F.lit(None).cast("string")).withColumn("aliased", F.lit(None).cast("boolean"))
    else:
        rows = rows.join(through_aliases(bare, aliases, files, entries), ["repo", "scope", "specifier"], "left")
    leading = bare.select("repo", "specifier").distinct().select("repo", "specifier", F.explode(ancestors(F.col("specifier"))).alias("name"))
    named = (
        leading.join(packages.select("repo", "name", "module"), ["repo", "name"])
        .groupBy("repo", "specifier")
        .agg(F.max_by("module", F.length("name")).alias("package_module"))
    )
    rows = rows.join(named, ["repo", "specifier"], "left")
    outcome = (
        F.when(F.col("specifier").isNull(), "computed")
        .when(F.coalesce("target", "alias_target").isNotNull(), "file")
        .when(F.col("base").isNotNull(), "not-found")
        .when(F.col("package_module").isNotNull(), "package")
        .when(F.col("aliased"), "alias-target-not-found")
        .when(F.col("specifier").rlike(r"^([#~$]|@/)"), "unknown-alias")
        .otherwise("external")
    )
    return rows.select(
        "repo",
        "file",
        "line",
        "specifier",
        outcome.alias("outcome"),
        F.coalesce("target", "alias_target").alias("target"),
        F.when(F.coalesce("target", "alias_target").isNull(), F.col("package_module")).alias("target_module"),
    )


def _outcome(rows: DataFrame, missing: Column) -> DataFrame:
    return rows.withColumn("outcome", F.when(F.col("target").isNotNull(), "file").otherwise(missing))


def module_path(imports: DataFrame, manifests: DataFrame, files: DataFrame) -> DataFrame:
    """Go: the longest module name that prefixes the import, then the first non-test file of the
    package directory. ``manifests``: repo, name, dir."""
    asked = imports.select("repo", "specifier").distinct()
    named = asked.select("repo", "specifier", F.explode(ancestors(F.col("specifier"))).alias("name")).join(manifests.select("repo", "name", "dir"), ["repo", "name"])
    best = named.groupBy("repo", "specifier").agg(F.max_by(F.struct("name", "dir"), F.length("name")).alias("m"))
    rest = F.regexp_replace(F.substring(F.col("specifier"), F.length("m.name") + 1, F.length("specifier")), r"^/+", "")
    placed = best.select("repo", "specifier", join(F.col("m.dir"), rest).alias("dir"))
    first = (
        files.where(F.col("path").endswith(".go") & ~F.col("path").endswith("_test.go"))
        .groupBy("repo", dirname(F.col("path")).alias("dir"))
        .agg(F.min("path").alias("target"))
    )
    found = placed.join(first, ["repo", "dir"], "left").withColumn("known", F.lit(True))
    joined = imports.join(found.select("repo", "specifier", "target", "known"), ["repo", "specifier"], "left")
    return _outcome(joined, F.when(F.col("known"), "not-found").otherwise("external")).select(*imports.columns, "outcome", "target")


def _source_candidates(base: Column, extensions: Sequence[str], package_init: bool) -> Column:
    options = [F.concat(base, F.lit(f".{e}")) for e in extensions]
    if package_init:
        options.append(F.concat(base, F.lit("/__init__.py")))
    return F.array(*options)


def dotted_path(
    imports: DataFrame, roots: DataFrame, files: DataFrame, extensions: Sequence[str] = ("py", "pyi"), package_init: bool = True
) -> DataFrame:
    """Python-style names: leading dots climb from the file's directory; otherwise the longest
    existing dotted prefix over the source roots. A name in the repository's own directories
    without a file is broken, any other is external. ``roots``: repo, root, root_ord."""
    keys = ["repo", "file", "specifier"]
    asked = imports.select(*keys).distinct()
    dots = F.length(F.regexp_extract("specifier", r"^(\.*)", 1))
    names = F.filter(F.split(F.regexp_replace("specifier", r"^\.+", ""), r"\."), lambda s: s != "")
    asked = asked.withColumn("dots", dots).withColumn("names", names)
    climb = F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.col("dots"), F.lit(1))), lambda i: F.when(i == 1, F.lit(".")).otherwise("..")), "/")
    near = asked.where("dots > 0").withColumn("base", join(join(dirname(F.col("file")), climb), F.array_join("names", "/")))
    near = near.withColumn("candidates", _source_candidates(F.col("base"), extensions, package_init))
    near_hits = first_existing(near, files, keys)

    far = imports.select("repo", "specifier").distinct().withColumn("names", names).where("NOT startswith(specifier, '.') AND size(names) > 0")
    far_hits = _longest_under_roots(far, _from_roots(files, roots, upwards=False), extensions, package_init)
    width = F.least(F.greatest(F.size("names") - 1, F.lit(1)), F.lit(3))
    own = far.where("size(names) > 1").select("repo", "specifier", F.array_join(F.slice("names", F.lit(1), width), "/").alias("rel"))
    directories = files.select("repo", F.explode(ancestors(dirname(F.col("path")))).alias("path")).distinct()
    owned = own.join(_from_roots(directories, roots, upwards=False), ["repo", "rel"], "left_semi").select("repo", "specifier", F.lit(True).alias("own")).distinct()
    joined = (
        imports.join(near_hits.withColumnRenamed("target", "near"), keys, "left")
        .join(far_hits.withColumnRenamed("target", "far"), ["repo", "specifier"], "left")
        .join(owned, ["repo", "specifier"], "left")
        .withColumn("target", F.coalesce("near", "far"))
    )
    missing = F.when(F.col("specifier").startswith(".") | F.col("own"), "not-found").otherwise("external")
    return _outcome(joined, missing).select(*imports.columns, "outcome", "target")


def by_package_directory(imports: DataFrame, files: DataFrame, extensions: Sequence[str] = ("java", "kt")) -> DataFrame:
    """Java and Kotlin: a file whose path ends with the name, else a file of the package's own
    directory; never reported as broken."""
    asked = imports.select("repo", "specifier").distinct().withColumn("names", F.filter(F.split("specifier", r"\."), lambda s: s != ""))
    takes = F.reverse(F.sequence(F.lit(1), F.size("names")))
    direct = F.flatten(
        F.transform(takes, lambda n: F.array(*[F.concat(F.array_join(F.slice("names", F.lit(1), n), "/"), F.lit(f".{e}")) for e in extensions]))
    )
    sources = files.where(F.col("path").rlike(rf"\.({'|'.join(extensions)})\z"))
    ends = sources.select("repo", "path", F.explode(suffixes(F.col("path"))).alias("ending")).groupBy("repo", "ending").agg(F.min("path").alias("target"))
    exact = (
        asked.select("repo", "specifier", F.posexplode(direct).alias("probe", "ending"))
        .join(ends, ["repo", "ending"])
        .groupBy("repo", "specifier")
        .agg(F.min(F.struct("probe", "target")).alias("e"))
    )
    places = (
        sources.withColumn("dir", dirname(F.col("path")))
        .where("dir <> ''")
        .select("repo", "path", F.explode(suffixes(F.col("dir"))).alias("ending"))
        .groupBy("repo", "ending")
        .agg(F.min("path").alias("target"))
    )
    inside = (
        asked.where("size(names) > 1")
        .select("repo", "specifier", F.posexplode(F.transform(F.reverse(F.sequence(F.lit(1), F.size("names") - 1)), lambda n: F.array_join(F.slice("names", F.lit(1), n), "/"))).alias("probe", "ending"))
        .join(places, ["repo", "ending"])
        .groupBy("repo", "specifier")
        .agg(F.min(F.struct("probe", "target")).alias("i"))
    )
    joined = imports.join(exact, ["repo", "specifier"], "left").join(inside, ["repo", "specifier"], "left").withColumn("target", F.coalesce("e.target", "i.target"))
    return _outcome(joined, F.lit("external")).select(*imports.columns, "outcome", "target")


def package_uri(imports: DataFrame, manifests: DataFrame, files: DataFrame) -> DataFrame:
    """Dart: ``package:name/path`` is ``lib/path`` of that package; a bare path is relative."""
    spec = F.col("specifier")
    name = F.regexp_extract(spec, r"^package:([^/]+)", 1)
    rest = F.regexp_extract(spec, r"^package:[^/]+/?(.*)\z", 1)
    is_package = spec.startswith("package:")
    known = manifests.select("repo", F.col("name").alias("package"), "dir").dropDuplicates(["repo", "package"])
    rows = imports.withColumn("package", F.when(is_package, name)).join(known, ["repo", "package"], "left")
    path = F.when(is_package, join(F.concat_ws("/", "dir", F.lit("lib")), rest)).when(~spec.contains(":"), join(dirname(F.col("file")), spec))
    rows = rows.withColumn("path", F.when(is_package & F.col("dir").isNull(), F.lit(None).cast("string")).otherwise(path))
    existing = files.select("repo", "path").distinct().withColumn("target", F.col("path"))
    joined = rows.join(existing, ["repo", "path"], "left")
    return _outcome(joined, F.when(F.col("path").isNull(), "external").otherwise("not-found")).select(*imports.columns, "outcome", "target")


def psr4(imports: DataFrame, namespaces: DataFrame, files: DataFrame) -> DataFrame:
    """PHP: the longest namespace prefix first, trailing parts dropped until a file exists; a
    string with a slash or ``.php`` is a path. ``namespaces``: repo, namespace, dir."""
    keys = ["repo", "specifier"]
    spec = F.col("specifier")
    as_path = spec.contains("/") | F.lower(spec).endswith(".php")
    rows = imports.withColumn("path", F.when(as_path, join(dirname(F.col("file")), spec)))
    existing = files.select("repo", "path").distinct().withColumn("direct", F.col("path"))
    rows = rows.join(existing, ["repo", "path"], "left")
    bare = F.regexp_replace(spec, r"^\\+", "")
    prefix = F.regexp_replace("namespace", r"^\\+", "")
    asked = imports.where(~as_path).select(*keys).distinct().withColumn("bare", bare)
    plain = namespaces.select("repo", prefix.alias("prefix"), "dir").where("prefix <> ''").withColumn("key", _lookup_head(F.col("prefix"), "\\"))
    both = asked.select(*keys, "bare", F.explode(_lookup_heads(F.col("bare"), "\\")).alias("key")).join(plain, ["repo", "key"])
    both = both.where(F.startswith("bare", F.col("prefix"))).drop("key")
    parts = F.filter(F.split(F.substring(F.col("bare"), F.length("prefix") + 1, F.length("bare")), r"\\"), lambda p: p != "")
    both = both.withColumn("parts", parts).where("size(parts) > 0")
    tries = F.transform(
        F.reverse(F.sequence(F.lit(1), F.size("parts"))), lambda n: F.concat(join(F.col("dir"), F.array_join(F.slice("parts", F.lit(1), n), "/")), F.lit(".php"))
    )
    probes = both.select(*keys, F.length("prefix").alias("width"), F.posexplode(tries).alias("probe", "path"))
    hits = (
        probes.join(files.select("repo", "path").distinct(), ["repo", "path"])
        .groupBy(*keys)
        .agg(F.min(F.struct((-F.col("width")).alias("w"), "probe", "path")).alias("h"))
    )
    claimed = both.select(*keys, F.lit(True).alias("claimed")).distinct()
    joined = rows.join(hits, keys, "left").join(claimed, keys, "left").withColumn("target", F.coalesce("direct", "h.path"))
    missing = F.when(as_path | F.col("claimed"), "not-found").otherwise("external")
    return _outcome(joined, missing).select(*imports.columns, "outcome", "target")


def snake(name: Column) -> Column:
    """``MyApp`` is ``my_app`` and ``HTTPServer`` is ``http_server``."""
    split = F.regexp_replace(name, r"([\p{Ll}0-9])(\p{Lu})", "$1_$2")
    return F.lower(F.regexp_replace(split, r"(\p{Lu})(\p{Lu}\p{Ll})", "$1_$2"))


def snake_path(imports: DataFrame, roots: DataFrame, files: DataFrame, extensions: Sequence[str] = ("ex", "exs")) -> DataFrame:
    """Elixir: ``MyApp.Foo`` is ``my_app/foo.ex`` under a root; a miss is external."""
    asked = imports.select("repo", "specifier").distinct().withColumn("names", F.transform(F.split("specifier", r"\."), snake))
    hits = _longest_under_roots(asked, _from_roots(files, roots, upwards=False), extensions, False)
    return _outcome(imports.join(hits, ["repo", "specifier"], "left"), F.lit("external")).select(*imports.columns, "outcome", "target")


def namespace_prefix(imports: DataFrame, manifests: DataFrame) -> DataFrame:
    """C# and Swift: the project whose name is the longest dotted prefix of the namespace."""
    parts = F.split("specifier", r"\.")
    heads = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))
    asked = imports.select("repo", "specifier").distinct().select("repo", "specifier", F.explode(heads).alias("name"))
    best = (
        asked.join(manifests.select("repo", "name", "dir"), ["repo", "name"])
        .groupBy("repo", "specifier")
        .agg(F.max_by(F.when(F.col("dir") == "", ".").otherwise(F.col("dir")), F.length("name")).alias("target_module"))
    )
    joined = imports.join(best, ["repo", "specifier"], "left")
    outcome = F.when(F.col("target_module").isNotNull(), "package").otherwise("external")
    return joined.select(*imports.columns, outcome.alias("outcome"), "target_module")


def require_path(imports: DataFrame, roots: DataFrame, files: DataFrame) -> DataFrame:
    """Ruby: relative to the file, then under each load root."""
    keys = ["repo", "file", "specifier"]
    name = F.regexp_replace("specifier", r"\.rb\z", "")
    asked = imports.select(*keys).distinct().withColumn("candidates", F.array(F.concat(join(dirname(F.col("file")), name), F.lit(".rb"))))
    near = first_existing(asked, files, keys).withColumnRenamed("target", "near")
    named = imports.select("repo", "specifier").distinct().withColumn("rel", F.concat(normalize(name), F.lit(".rb")))
    far = named.join(_from_roots(files, roots), ["repo", "rel"]).groupBy("repo", "specifier").agg(F.min_by("path", "root_ord").alias("far"))
    joined = imports.join(near, keys, "left").join(far, ["repo", "specifier"], "left").withColumn("target", F.coalesce("near", "far"))
    return _outcome(joined, F.when(F.col("specifier").startswith("."), "not-found").otherwise("external")).select(*imports.columns, "outcome", "target")
