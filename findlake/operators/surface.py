"""Public names, re-export chains, and names nothing reads."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findlake.functions.paths import basename, dirname, is_test_path, join
from findlake.operators.resolve import probe
from findlake.session import materialize

# --- fixed values: manifest conditions in the order tools pick them, and build directories ---
CONDITIONS = ("types", "import", "module", "default", "require")
BUILD_DIRS = ("dist", "build", "lib", "out", "esm", "cjs")


def dead_declarations(declarations: DataFrame, mentions: DataFrame, dynamic_calls: DataFrame | None = None) -> DataFrame:
    """Declarations no mention of the name can reach, by visibility.

    ``declarations``: repo, file, language, name, line, visibility, member, decorated,
    entry_point. ``mentions``: repo, file, name. A name's mentions are reduced to its first and
    last file, which answers "some file" and "another file" without listing them.
    """
    named = mentions.groupBy("repo", "name").agg(F.min("file").alias("lo"), F.max("file").alias("hi"))
    own = mentions.select("repo", "name", "file").distinct().withColumn("in_file", F.lit(True))
    near = mentions.select("repo", "name", dirname(F.col("file")).alias("dir")).distinct().withColumn("in_dir", F.lit(True))
    asked = declarations.where(~is_test_path(F.col("file")) & ~F.col("decorated") & ~F.col("entry_point")).withColumn("dir", dirname(F.col("file")))
    joined = asked.join(named, ["repo", "name"], "left").join(own, ["repo", "name", "file"], "left").join(near, ["repo", "name", "dir"], "left")
    visibility = F.col("visibility")
    used = (
        F.when(visibility == "private", F.col("in_file"))
        .when(visibility == "module", F.col("lo").isNotNull())
        .when(visibility == "package", F.col("in_dir"))
        .when(F.col("member"), True)
        .otherwise((F.col("lo") != F.col("file")) | (F.col("hi") != F.col("file")))
    )
    public = visibility == "public"
    dead = joined.where(~F.coalesce(used, F.lit(False))).withColumn("kind", F.when(public, "exported-but-unused").otherwise("unreferenced"))
    if dynamic_calls is None:
        dead = dead.withColumn("computed", F.lit(0).cast("long"))
    else:
        counts = dynamic_calls.groupBy("repo", "language").agg(F.sum("calls").alias("computed"))
        dead = dead.join(counts, ["repo", "language"], "left").withColumn("computed", F.coalesce("computed", F.lit(0)))
    confidence = F.when(public | (F.col("computed") > 0), "low").otherwise("medium")
    return dead.select("repo", "file", "name", "line", "kind", confidence.alias("confidence"))


def mention_files(mentions: DataFrame) -> DataFrame:
    """How many files mention each name."""
    return mentions.select("repo", "name", "file").distinct().groupBy("repo", "name").agg(F.count(F.lit(1)).alias("files"))


def definitions(requests: DataFrame, exports: DataFrame, stars: DataFrame) -> DataFrame:
    """Where each exported name is declared, re-exports followed.

    ``exports``: repo, file, name, target (null = local), imported (``*`` = namespace).
    ``stars``: repo, file, star_ord, target. Named exports win over ``export *``; stars are tried
    in order, so the smallest path of star positions decides. A state is revisited only when a
    smaller path reaches it, which also ends re-export cycles.
    """
    keys = ["repo", "key_file", "key_name"]
    start = requests.select("repo", F.col("file").alias("key_file"), F.col("name").alias("key_name"), "file", "name", F.array().cast("array<int>").alias("path")).distinct()
    best = materialize(start, "definitions")
    frontier = best
    entry = exports.select("repo", "file", "name", F.struct(F.col("target").alias("target"), F.col("imported").alias("imported")).alias("e"))
    while True:
        looked = frontier.select(*keys, "file", "name", "path").join(entry, ["repo", "file", "name"], "left")
        named = looked.where("e.target IS NOT NULL AND e.imported <> '*'").select(
            *keys, F.col("e.target").alias("file"), F.col("e.imported").alias("name"), "path"
        )
        through = (
            looked.where("e IS NULL AND name <> 'default'")
            .join(stars.select("repo", "file", F.col("star_ord").cast("int").alias("star_ord"), F.col("target").alias("next")), ["repo", "file"])
            .select(*keys, F.col("next").alias("file"), "name", F.concat("path", F.array("star_ord")).alias("path"))
        )
        offered = named.unionByName(through).groupBy(*keys, "file", "name").agg(F.min("path").alias("offer"))
        merged = best.select(*keys, "file", "name", "path").join(offered, [*keys, "file", "name"], "full_outer")
        better = F.col("offer").isNotNull() & (F.col("path").isNull() | (F.col("offer") < F.col("path")))
        best = materialize(
            merged.select(*keys, "file", "name", F.when(better, F.col("offer")).otherwise(F.col("path")).alias("path"), better.alias("moved")), "definitions"
        )
        frontier = best.where("moved")
        if frontier.isEmpty():
            break
    ends = best.drop("moved").join(entry, ["repo", "file", "name"]).where("e.target IS NULL OR e.imported = '*'")
    return ends.groupBy(*keys).agg(F.min(F.struct("path", "file", "name")).alias("d")).select(
        "repo", F.col("key_file").alias("file"), F.col("key_name").alias("name"), F.col("d.file").alias("def_file"), F.col("d.name").alias("def_name")
    )


def star_names(files: DataFrame, exports: DataFrame, stars: DataFrame) -> DataFrame:
    """Every name each file publishes, ``export *`` followed to a fixpoint (never ``default``)."""
    rest = materialize(exports.select("repo", "file", "name").distinct(), "names")
    known, frontier = [rest], rest
    while True:
        carried = (
            stars.select("repo", F.col("file").alias("above"), F.col("target").alias("file"))
            .join(frontier.where("name <> 'default'"), ["repo", "file"])
            .select("repo", F.col("above").alias("file"), "name")
            .distinct()
        )
        frontier = materialize(carried.join(reduce(DataFrame.unionByName, known), ["repo", "file", "name"], "left_anti"), "names")
        if frontier.isEmpty():
            break
        known.append(frontier)
    return reduce(DataFrame.unionByName, known).join(files.select("repo", "file").distinct(), ["repo", "file"], "left_semi")


def exported_names(entrypoints: DataFrame, exports: DataFrame, stars: DataFrame) -> DataFrame:
    """Names the entrypoints publish: direct ones, then ``export *`` names they do not shadow;
    the first per file and name, unstable when it starts with an underscore."""
    eps = entrypoints.select("repo", "module", "file").distinct()
    direct = eps.join(exports.select("repo", "file", "name", "line"), ["repo", "file"]).withColumn("form", F.lit("direct"))
    targets = stars.select("repo", F.col("target").alias("file")).distinct()
    published = star_names(targets, exports, stars).where("name <> 'default'").select("repo", F.col("file").alias("target"), "name")
    starred = (
        eps.join(stars.select("repo", "file", "target", F.col("line"), "star_ord"), ["repo", "file"])
        .join(published, ["repo", "target"])
        .join(exports.select("repo", "file", "name").distinct(), ["repo", "file", "name"], "left_anti")
        .groupBy("repo", "module", "file", "name")
        .agg(F.min_by("line", "star_ord").alias("line"))
        .withColumn("form", F.lit("star"))
    )
    first = direct.groupBy("repo", "module", "file", "name", "form").agg(F.min("line").alias("line"))
    stability = F.when(F.col("name").startswith("_"), "unstable").otherwise("stable")
    return first.unionByName(starred.select(*first.columns)).withColumn("stability", stability)


def loaded_by_convention(path: Column) -> Column:
    """Files a tool loads by name or place: nobody imports them, which says nothing about them."""
    name = basename(path)
    lower = F.lower(name)
    directories = F.split(path, "/")
    marks = r"\.(config|setup|stories|story|test|spec|bench|e2e|remote|tst)\."
    stem = F.element_at(F.split(lower, r"\."), 1)
    app = F.array_contains(directories, "app") & stem.isin(
        "page", "route", "layout", "loading", "error", "not-found", "template", "sitemap", "robots", "manifest", "default"
    )
    placed = F.arrays_overlap(directories, F.array(*[F.lit(d) for d in ("pages", "routes", "test", "tests", "__tests__", "__mocks__", "fixtures", "e2e")]))
    return name.startswith("+") | lower.rlike(marks) | lower.rlike(r"^(hooks|middleware|instrumentation)\.") | app | placed


def unexpectedly_exposed(exports: DataFrame, entrypoints: DataFrame, defined: DataFrame, public: DataFrame) -> DataFrame:
    """Names exported by a file that is no entrypoint and not loaded by convention, neither
    re-exported through one, forwarded, nor ``default``. ``public``: repo, def_file, def_name."""
    own = exports.where("target IS NULL AND name <> 'default'").where(~loaded_by_convention(F.col("file")))
    hidden = own.join(entrypoints.select("repo", "file").distinct(), ["repo", "file"], "left_anti")
    placed = hidden.join(defined, ["repo", "file", "name"], "left")
    return placed.join(public.select("repo", "def_file", "def_name").distinct(), ["repo", "def_file", "def_name"], "left_anti").select(
        "repo", "file", "name", "line", "def_file", "def_name"
    )


def unused_exports(exported: DataFrame, used: DataFrame, used_files: DataFrame, loose: DataFrame, context: DataFrame | None = None) -> DataFrame:
    """Exported names no file imports.

    ``exported``: repo, module, file, name, line, def_file, def_name. ``used``: repo, def_file,
    def_name. ``used_files``: files whose every name counts as used. ``loose``: names imported
    through an alias nobody resolves. ``context``: repo, module, library, computed.
    """
    keyed = exported.withColumn("def_file", F.coalesce("def_file", "file")).withColumn("def_name", F.coalesce("def_name", "name"))
    left = (
        keyed.join(used.select("repo", "def_file", "def_name").distinct(), ["repo", "def_file", "def_name"], "left_anti")
        .join(used_files.select("repo", F.col("file").alias("def_file")).distinct(), ["repo", "def_file"], "left_anti")
        .join(loose.select("repo", "name").distinct(), ["repo", "name"], "left_anti")
    )
    if context is None:
        left = left.withColumn("library", F.lit(False)).withColumn("computed", F.lit(0))
    else:
        left = left.join(context, ["repo", "module"], "left")
    low = F.coalesce("library", F.lit(False)) | (F.coalesce("computed", F.lit(0)) > 0)
    return left.select("repo", "module", "file", "name", "line", F.lit("exported-but-unused").alias("kind"), F.when(low, "low").otherwise("medium").alias("confidence"))


def declared_surface(declarations: DataFrame, module_files: DataFrame, internal_dirs: Sequence[str] = ("internal",)) -> DataFrame:
    """Public declarations outside tests and internal directories, by module."""
    inside = F.arrays_overlap(F.split("file", "/"), F.array(*[F.lit(d) for d in internal_dirs]))
    public = declarations.where((F.col("visibility") == "public") & ~is_test_path(F.col("file")) & ~inside)
    placed = public.join(module_files.select("repo", "module", F.col("path").alias("file")), ["repo", "file"])
    stability = F.when(F.col("name").startswith("_"), "unstable").otherwise("stable")
    return placed.select("repo", "module", "file", "name", "line", stability.alias("stability"))


def one_surface_per_module(surfaces: DataFrame) -> DataFrame:
    """``surfaces`` rows carry ``priority``; a module keeps the rows of its best one."""
    best = surfaces.groupBy("repo", "module").agg(F.min("priority").alias("best"))
    return surfaces.join(best, ["repo", "module"]).where("priority = best").drop("best")


def manifest_targets(manifests: DataFrame) -> DataFrame:
    """``exports`` of each package manifest (repo, module, content) as ranked targets per subpath:
    conditions a tool picks first come first, nested conditions and listed alternatives inside
    their parent's place, to any depth: a level is opened until none is nested.
    Without ``exports``: types, typings, module, main."""
    text = F.get_json_object("content", "$.exports")
    rows = manifests.select("repo", "module", "content", text.alias("exports"))
    kind = "map<string,string>"
    as_map = F.from_json("exports", kind)
    dotted = F.col("exports").startswith("{") & F.exists(F.map_keys(as_map), lambda k: k.startswith("."))
    listed = rows.where("exports IS NOT NULL")
    by_path = listed.where(dotted).select("repo", "module", F.explode(as_map).alias("subpath", "value"))
    single = listed.where(~dotted).select("repo", "module", F.lit(".").alias("subpath"), F.col("exports").alias("value"))
    names = F.array(*[F.lit(c) for c in CONDITIONS])

    open_rows = by_path.unionByName(single).where("NOT subpath LIKE '%*%'").withColumn("rank", F.array().cast("array<struct<place:int,name:string>>"))
    leaves = None
    nested, listing = F.col("value").startswith("{"), F.col("value").startswith("[")
    while True:
        level = materialize(open_rows.select("repo", "module", "subpath", "rank", "value"), "targets")
        done = level.where(~nested & ~listing)
        leaves = done if leaves is None else leaves.unionByName(done)
        if level.where(nested | listing).isEmpty():
            break
        keys = ("repo", "module", "subpath", "rank")
        inner = level.where(nested).select(*keys, F.explode(F.from_json("value", kind)).alias("condition", "value"))
        place = F.array_position(names, F.col("condition"))
        position = F.struct(F.when(place == 0, 100).otherwise(place).cast("int").alias("place"), F.col("condition").alias("name"))
        inner = inner.select("repo", "module", "subpath", "value", F.concat("rank", F.array(position)).alias("rank"))
        members = level.where(listing).select(*keys, F.posexplode(F.from_json("value", "array<string>")).alias("at", "value"))
        turn = F.struct(F.col("at").cast("int").alias("place"), F.lit("").alias("name"))
        open_rows = inner.unionByName(members.select("repo", "module", "subpath", "value", F.concat("rank", F.array(turn)).alias("rank")))
    plain = rows.where("exports IS NULL").select(
        "repo",
        "module",
        F.lit(".").alias("subpath"),
        F.posexplode(F.array(*[F.get_json_object("content", f"$.{k}") for k in ("types", "typings", "module", "main")])).alias("place", "value"),
    ).where("value IS NOT NULL")
    fallback = plain.select("repo", "module", "subpath", "value", F.array(F.struct(F.col("place").cast("int").alias("place"), F.lit("").alias("name"))).alias("rank"))
    return leaves.unionByName(fallback).select("repo", "module", "subpath", "rank", F.col("value").alias("target"))


def entrypoints(manifests: DataFrame, module_files: DataFrame) -> DataFrame:
    """``(repo, module, subpath, file)``: the first target that is a source file of the module; a
    build path stands for its source; a main entry declared nowhere is guessed."""
    targets = manifest_targets(manifests)
    bare = F.regexp_replace("target", r"^(\./)+", "")
    head = F.regexp_extract(bare, r"^([^/]+)/", 1)
    rest = F.regexp_replace(bare, r"^[^/]+/", "")
    built = head.isin(*BUILD_DIRS)
    options = F.array_compact(F.array(bare, F.when(built, F.concat(F.lit("src/"), rest)), F.when(built, rest)))
    asked = targets.select("repo", "module", "subpath", "rank", F.posexplode(options).alias("option", "spec"))
    has_exports = manifests.select("repo", "module", F.get_json_object("content", "$.exports").alias("exports"))
    dotted = F.col("exports").startswith("{") & F.col("exports").rlike(r'"\.(/[^"]*)?"\s*:')
    open_main = has_exports.where(F.col("exports").isNull() | ~dotted | F.col("exports").rlike(r'"\."\s*:'))
    last = F.array(F.struct(F.lit(1000).cast("int").alias("place"), F.lit("").alias("name")))
    guesses = open_main.select(
        "repo", "module", F.lit(".").alias("subpath"), last.alias("rank"), F.posexplode(F.array(F.lit("src/index"), F.lit("index"))).alias("option", "spec")
    )
    home = F.when(F.col("module") == ".", "").otherwise(F.col("module"))
    every = asked.unionByName(guesses).withColumn("base", join(home, F.col("spec")))
    files = module_files.select("repo", "path").distinct()
    hits = probe(every, files)
    found = every.join(hits, ["repo", "base"]).join(module_files.select("repo", "module", F.col("path").alias("target")), ["repo", "module", "target"], "left_semi")
    return found.groupBy("repo", "module", "subpath").agg(F.min(F.struct("rank", "option", "target")).alias("f")).select("repo", "module", "subpath", F.col("f.target").alias("file"))
