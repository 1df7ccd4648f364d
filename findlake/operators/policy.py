"""Review policy: pack versions, dependencies, applicable rules and conflicts between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findlake.functions import semver
from findlake.functions.identity import canonical_hash
from findlake.functions.text import trim_space
from findlake.session import materialize

LAST = 2**31 - 1


def best_versions(requests: DataFrame, packs: DataFrame) -> DataFrame:
    """The highest version of each requested pack inside its range; ties keep the one registered
    first. ``requests``: pack, range (null = any). ``packs``: pack, version, pack_ord."""
    wanted = requests.select("pack", F.coalesce("range", F.lit("*")).alias("range")).distinct()
    known = packs.groupBy("pack", "version").agg(F.min("pack_ord").alias("pack_ord"))

    # The best version of a range is the best of its pack, major or minor line, if it reaches the
    # range's base: each line's best is found once, and a request looks up one line.
    def lines(parsed: Column) -> list[Column]:
        parts = [parsed[n].cast("string") for n in ("major", "minor", "patch")]
        return [F.concat_ws(".", *parts[:n]) for n in (1, 2, 3)]

    parsed = semver.parse(F.col("version"))
    keys = F.when(parsed.isNull(), F.array(F.lit("*"))).otherwise(F.array(F.lit("*"), *lines(parsed)))
    order = F.struct(semver.sort_key(F.col("version")).alias("v"), (-F.col("pack_ord")).alias("o"))
    best = known.select("pack", "version", order.alias("order"), F.explode(keys).alias("line")).groupBy("pack", "line").agg(
        F.max_by("version", "order").alias("version"), F.max("order.v").alias("top")
    )
    text = trim_space(F.col("range"))
    base_text = F.regexp_replace(text, r"^[\^~]", "")
    base = semver.parse(base_text)
    major, minor, exact = lines(base)
    line = (
        F.when(text.isin("*", ""), F.lit("*")).when(base.isNull(), F.lit(None)).when(text.startswith("^"), major).when(text.startswith("~"), minor).otherwise(exact)
    )
    asked = wanted.select("pack", "range", line.alias("line"), semver.sort_key(base_text).alias("base"))
    found = asked.join(best, ["pack", "line"], "left")
    reached = (F.col("line") == "*") | (F.col("top") >= F.col("base"))
    return found.select("pack", "range", F.when(reached, F.col("version")).alias("version"))


def resolve_dependencies(requested: DataFrame, packs: DataFrame, dependencies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requested packs and all they depend on, in the order a depth-first walk reaches them, and
    what is missing.

    ``requested``: repo, pack, request_ord. ``dependencies``: pack, version, dep_ord, dep_pack,
    range. A pack reached at several versions keeps its first place and the last version. The
    walk's order is the order of its paths, so each (pack, range) keeps its smallest path.
    """
    state = requested.groupBy("repo", "pack").agg(F.min("request_ord").alias("o")).select("repo", "pack", F.lit("*").alias("range"), F.array(F.col("o").cast("int")).alias("path"))
    best = materialize(state, "packs")
    frontier = best
    edges = dependencies.select("pack", "version", F.col("dep_ord").cast("int").alias("dep_ord"), "dep_pack", F.col("range").alias("dep_range"))
    while True:
        placed = frontier.join(best_versions(frontier, packs), ["pack", "range"]).where("version IS NOT NULL")
        step = placed.join(edges, ["pack", "version"]).select(
            "repo", F.col("dep_pack").alias("pack"), F.coalesce("dep_range", F.lit("*")).alias("range"), F.concat("path", F.array("dep_ord")).alias("path")
        )
        offered = step.groupBy("repo", "pack", "range").agg(F.min("path").alias("offer"))
        merged = best.select("repo", "pack", "range", "path").join(offered, ["repo", "pack", "range"], "full_outer")
        better = F.col("offer").isNotNull() & (F.col("path").isNull() | (F.col("offer") < F.col("path")))
        best = materialize(
            merged.select("repo", "pack", "range", F.when(better, F.col("offer")).otherwise(F.col("path")).alias("path"), better.alias("moved")), "packs"
        )
        frontier = best.where("moved").drop("moved")
        if frontier.isEmpty():
            break
    reached = best.drop("moved").join(best_versions(best, packs), ["pack", "range"])
    missing = reached.where("version IS NULL").select("repo", "pack", "range")
    resolved = (
        reached.where("version IS NOT NULL")
        .groupBy("repo", "pack")
        .agg(F.min("path").alias("position"), F.max_by("version", "path").alias("version"))
    )
    return resolved, missing


def applicable_rules(rules: DataFrame, capabilities: DataFrame) -> DataFrame:
    """``rules``: repo, rule_id, scope (always, language, framework, glob), wanted. A language or
    framework rule needs a capability with that id, compared as lower-case letters and digits."""
    plain = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    open_rules = rules.where(F.col("scope").isin("always", "glob"))
    have = capabilities.select("repo", plain(F.col("capability")).alias("__plain")).distinct()
    bound = rules.where(F.col("scope").isin("language", "framework")).withColumn("__plain", plain(F.col("wanted")))
    return open_rules.unionByName(bound.join(have, ["repo", "__plain"], "left_semi").drop("__plain"))


def conflicts(candidates: DataFrame) -> DataFrame:
    """Every conflict once per unordered pair, with winner and loser.

    ``candidates``: repo, idx, rule_id, origin (pack, criteria), request_index (null = not
    requested), contradicts (array). Criteria beat packs, then the pack requested first, then
    the lower rule id in root collation.
    """
    rows = candidates.select("repo", "idx", "rule_id", "origin", F.coalesce("request_index", F.lit(LAST)).alias("request_index"), "contradicts")
    other = rows.select(
        "repo", F.col("idx").alias("j"), F.col("rule_id").alias("other_id"), F.col("origin").alias("other_origin"), F.col("request_index").alias("other_request")
    )
    declared = rows.select("*", F.posexplode("contradicts").alias("pos", "other_id")).drop("contradicts").join(other, ["repo", "other_id"]).where("idx <> j")
    declared = declared.withColumn("phase", F.lit(0)).withColumn(
        "reason", F.concat(F.lit('rule "'), "rule_id", F.lit('" explicitly declares a contradiction with "'), "other_id", F.lit('"'))
    )
    packs = rows.where("origin = 'pack'").drop("contradicts").withColumn("pos", F.lit(0)).withColumn("other_id", F.col("rule_id"))
    shared = packs.join(other.where("other_origin = 'criteria'"), ["repo", "other_id"]).where("idx <> j")
    shared = shared.withColumn("phase", F.lit(1)).withColumn(
        "reason", F.concat(F.lit('pack rule "'), "rule_id", F.lit('" shares its id with a repository criteria rule of the same id'))
    )
    both = declared.unionByName(shared)
    a_wins = (
        F.when((F.col("origin") == "criteria") & (F.col("other_origin") == "pack"), True)
        .when((F.col("origin") == "pack") & (F.col("other_origin") == "criteria"), False)
        .when(F.col("request_index") != F.col("other_request"), F.col("request_index") < F.col("other_request"))
        .otherwise(F.collate(F.col("rule_id"), "UNICODE") <= F.collate(F.col("other_id"), "UNICODE"))
    )
    picked = both.groupBy("repo", F.least("idx", "j").alias("a"), F.greatest("idx", "j").alias("b")).agg(
        F.min_by(
            F.struct(
                F.when(a_wins, F.col("idx")).otherwise(F.col("j")).alias("winner"),
                F.when(a_wins, F.col("j")).otherwise(F.col("idx")).alias("loser"),
                F.when(a_wins, F.col("rule_id")).otherwise(F.col("other_id")).alias("winning_rule"),
                F.when(a_wins, F.col("other_id")).otherwise(F.col("rule_id")).alias("losing_rule"),
                "reason",
            ),
            F.struct("phase", "idx", "pos", "j"),
        ).alias("c")
    )
    return picked.select("repo", "c.*")


def survivors(candidates: DataFrame, found: DataFrame) -> DataFrame:
    """Candidates no conflict removed; callers order by ``rule_order``."""
    losers = found.select("repo", F.col("loser").alias("idx")).distinct()
    return candidates.join(losers, ["repo", "idx"], "left_anti")


def rule_order(rule_id: Column) -> Column:
    """Root collation, the order policies are listed in."""
    return F.collate(rule_id, "UNICODE")


def requested_packs(explicit: DataFrame, registered: DataFrame) -> DataFrame:
    """Explicit requests, then registered packs not among them, order kept: (repo, pack, ord)."""
    both = explicit.select("repo", "pack", F.struct(F.lit(0).alias("g"), "ord").alias("o")).unionByName(
        registered.select("repo", "pack", F.struct(F.lit(1).alias("g"), "ord").alias("o"))
    )
    return both.groupBy("repo", "pack").agg(F.min("o").alias("order"))


def policy_ids(contributing: DataFrame, context: DataFrame) -> DataFrame:
    """Deterministic policy id per repository from its packs and its criteria. ``contributing``:
    repo, pack, version (bounded by the pack registry). ``context``: repo, generated_at, criteria."""
    refs = contributing.distinct().groupBy("repo").agg(F.sort_array(F.collect_set(F.struct("pack", "version"))).alias("packRefs"))
    joined = context.join(refs, "repo", "left")
    body = F.struct(F.sha2("criteria", 256).alias("criteriaFingerprint"), "packRefs", F.col("generated_at").cast("string").alias("repositoryGeneratedAt"), F.lit(1).alias("schemaVersion"))
    return joined.select("repo", canonical_hash(body).alias("policy_id"))


def validate_packs(rules: DataFrame, packs: DataFrame, knowledge: DataFrame) -> DataFrame:
    """Quality faults: duplicate rule ids in a pack, rules citing knowledge the pack lacks, and
    versions that are not semantic. ``rules``: pack, version, rule_id, knowledge_id."""
    twice = rules.groupBy("pack", "version", "rule_id").count().where("count > 1").select("pack", "version", F.col("rule_id").alias("subject"), F.lit("duplicate-rule").alias("fault"))
    cites = rules.where("knowledge_id IS NOT NULL").select("pack", "version", "knowledge_id").distinct()
    lost = cites.join(knowledge.select("pack", "version", "knowledge_id").distinct(), ["pack", "version", "knowledge_id"], "left_anti")
    odd = packs.where(~F.col("version").rlike(r"^\d+\.\d+\.\d+")).select("pack", "version", F.col("version").alias("subject"), F.lit("bad-version").alias("fault"))
    return twice.unionByName(lost.select("pack", "version", F.col("knowledge_id").alias("subject"), F.lit("missing-knowledge").alias("fault"))).unionByName(odd)
