"""URL judgement: fixed host and path rules, and behind them a ratio of two character models.

The urls that a rule accepts train one Markov model, those that a rule rejects another. Each
predicts a character from the two before it; a context seen seldom leans on the shorter one, down
to single characters (interpolation by context count). A url no rule decides is judged by the
difference of its log-likelihoods per character against a threshold calibrated on the urls the
rules decide. Only DataFrame functions run.

Characters are mapped to a fixed alphabet, so a model has exactly ``SYMBOLS ** 3`` weights whatever
the input: that table, and nothing else, is broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from findlake.llm.scratch import ascii_lower

ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789.-_/?=&%#:"
#: 0 is any other character, the last one stands before the first character.
START = len(ALPHABET) + 1
SYMBOLS = START + 1
#: Weight of the shorter context, in observations.
LEAN = 4.0
#: Log-likelihoods are held in millionths, so that sums don't depend on their order.
UNIT = 1_000_000
#: Width of a bin of the calibration, in units, and the number of bins on either side of 0.
BIN, REACH = 10_000, 2_000

Rule = tuple[str, str, str]


def after_scheme(url: Column) -> Column:
    """What stands behind the first ``://``; empty for null and for urls without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(after_scheme(url), "^([^/?#]*)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(after_scheme(url), "^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or nulls. A rule fits its host and every
    subdomain where the path starts with the rule's."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, name, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(start)
        rule = F.when(fits, F.lit(name + start)).otherwise(rule)
        verdict = F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def _codes(url: Column) -> Column:
    """Symbols of the url behind its scheme, two starts before them."""
    rest = F.regexp_replace(ascii_lower(after_scheme(url)), "[^a-z0-9.\\-_/?=&%#:]", "~")
    found = F.transform(F.split(rest, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    return F.concat(F.array(F.lit(START), F.lit(START)), F.when(rest != "", found).otherwise(F.array().cast("array<int>")))


def _triples(rows: DataFrame) -> DataFrame:
    """One row per character: the row's other columns and ``gram``, context and character in one number."""
    codes = rows.withColumn("codes", _codes(F.col("url")))
    grams = F.transform(
        F.slice("codes", 3, F.size("codes")),
        lambda c, i: F.element_at("codes", i + 1) * (SYMBOLS * SYMBOLS) + F.element_at("codes", i + 2) * SYMBOLS + c,
    )
    return codes.withColumn("gram", F.explode(grams)).drop("codes", "url")


def _weights(labelled: DataFrame) -> DataFrame:
    """``gram, weight``: log P(accepted) - log P(rejected) of each of the ``SYMBOLS ** 3`` grams."""
    spark = labelled.sparkSession
    counts = _triples(labelled.select("url", "verdict")).groupBy("gram").agg(
        *(F.count(F.when(F.col("verdict") == kind, 1)).alias(kind) for kind in ("allow", "block"))
    )
    grid = spark.range(SYMBOLS**3).select(F.col("id").cast("int").alias("gram")).join(counts, "gram", "left").na.fill(0)
    grid = grid.withColumn("context", F.expr(f"gram div {SYMBOLS}")).withColumn("pair", F.col("gram") % (SYMBOLS**2))
    kinds = ("allow", "block")
    pairs = grid.groupBy("pair").agg(*(F.sum(k).alias(f"pair_{k}") for k in kinds))
    pairs = pairs.withColumn("before", F.expr(f"pair div {SYMBOLS}")).withColumn("symbol", F.col("pair") % SYMBOLS)
    singles = pairs.groupBy("symbol").agg(*(F.sum(f"pair_{k}").alias(f"single_{k}") for k in kinds))
    alone, before, context = Window.partitionBy(F.lit(0)), Window.partitionBy("before"), Window.partitionBy("context")
    singles = singles.select("symbol", *((F.col(f"single_{k}") + 0.5) / (F.sum(f"single_{k}").over(alone) + 0.5 * SYMBOLS) for k in kinds)).toDF("symbol", *(f"p1_{k}" for k in kinds))
    pairs = pairs.join(F.broadcast(singles), "symbol").select(
        "pair", *(((F.col(f"pair_{k}") + LEAN * F.col(f"p1_{k}")) / (F.sum(f"pair_{k}").over(before) + LEAN)).alias(f"p2_{k}") for k in kinds)
    )
    grid = grid.join(F.broadcast(pairs), "pair").select(
        "gram", *(((F.col(k) + LEAN * F.col(f"p2_{k}")) / (F.sum(k).over(context) + LEAN)).alias(f"p3_{k}") for k in kinds)
    )
    return grid.select("gram", F.round((F.log("p3_allow") - F.log("p3_block")) * UNIT).cast("long").alias("weight"))


def scores(rows: DataFrame, weights: DataFrame) -> DataFrame:
    """``url, score`` of every different url: mean weight of its characters; urls without a character have no row."""
    urls = rows.where("url is not null").groupBy("url").agg(F.col("url").alias("same"))
    return _triples(urls).join(F.broadcast(weights), "gram").groupBy(F.col("same").alias("url")).agg((F.sum("weight") / F.count("weight")).alias("score"))


def threshold(scored: DataFrame) -> float:
    """The bin edge with the best mean of the two classes' hit rates on ``verdict, score`` rows,
    the one nearest 0 among equals; 0 where a class is missing. Only that number leaves Spark."""
    bins = scored.where("verdict is not null and score is not null").withColumn("bin", F.greatest(F.lit(-REACH), F.least(F.lit(REACH), F.floor(F.col("score") / BIN))))
    bins = bins.groupBy("bin").agg(*(F.count(F.when(F.col("verdict") == k, 1)).alias(k) for k in ("allow", "block")))
    everywhere = Window.partitionBy(F.lit(0))
    below = everywhere.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    rates = bins.select(
        "bin",
        ((F.sum("allow").over(everywhere) - F.coalesce(F.sum("allow").over(below), F.lit(0))) / F.sum("allow").over(everywhere)).alias("kept"),
        (F.coalesce(F.sum("block").over(below), F.lit(0)) / F.sum("block").over(everywhere)).alias("caught"),
    )
    best = rates.where("kept is not null and caught is not null").orderBy((F.col("kept") + F.col("caught")).desc(), F.abs("bin"), "bin").first()
    return float(best["bin"]) * BIN if best else 0.0


def judge(pages: DataFrame, rules: Sequence[Rule], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per row of ``pages``: ``page_id, host, path, rule, verdict, score``.

    Null urls and urls without ``://`` have an empty host and path and no score; they are allowed.
    Where the rules decide no url, or only one way, the threshold is 0. Ids may repeat or be null.
    An empty table gives an empty result.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    rows = rows.withColumn("host", host(F.col("url"))).withColumn("path", path(F.col("url")))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("verdict", verdict)
    weights = _weights(rows.where("verdict is not null"))
    scored = rows.join(scores(rows, weights), "url", "left")
    cut = threshold(scored)
    decided = F.coalesce("verdict", F.when(F.col("score") < cut, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", "rule", decided.alias("verdict"), (F.col("score") / UNIT).alias("score"))
