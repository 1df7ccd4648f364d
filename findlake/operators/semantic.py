"""The model pass: which findings are asked about, the code shown, and what of a reply counts.

The provider is the user's; it runs inside ``mapInPandas`` on prompt rows. A reply never closes
or lowers a finding: a verdict informs, and a claim counts only where its quote is in the code.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from findlake.functions.paths import is_secret_file
from findlake.functions.severity import severity_rank
from findlake.functions.text import clip, scrub_quoted, slug, squash, verdict_word
from findlake.operators.ordered import first_per_key, numbered, top_per_key

# --- fixed values: lines shown around a finding, and verdict words ---
RADIUS = 8
REAL = ("real", "true_positive", "confirmed", "yes")
UNSURE = ("unsure", "unknown", "unclear")
FALSE = ("false_positive", "fp", "not_real", "no")
CATEGORIES = ("security", "reliability", "performance", "maintainability")
WITHHELD = "[line withheld: may hold a secret]"


def is_candidate(findings: DataFrame) -> DataFrame:
    """Findings the detectors are unsure of, not about secrets, no analyzer or model spoke to."""
    spoken = F.exists("evidence", lambda e: e["kind"].isin("external-analyzer", "semantic-review"))
    rule = F.coalesce("rule_id", F.lit(""))
    return findings.where(
        (F.col("confidence") != "high") & ~rule.rlike("secret|credential") & ~is_secret_file(F.col("file")) & ~spoken & F.col("line").isNotNull()
    )


def candidates(findings: DataFrame, n: int | None = None) -> DataFrame:
    """Candidates by severity within their repository, the first ``n`` where a caller limits a pass."""
    order = [severity_rank(F.col("severity")), F.col("ord")]
    if n is not None:
        return top_per_key(findings, ["repo"], order, n)
    return findings.withColumn("position", F.row_number().over(Window.partitionBy("repo").orderBy(*order)))


def windows(points: DataFrame, lines: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Lines around each distinct ``(repo, file, line)``: an equi join after listing the at most
    ``2 * radius + 1`` wanted lines. Returns repo, file, line, n, text."""
    wanted = points.select("repo", "file", "line").distinct()
    wanted = wanted.withColumn("n", F.explode(F.sequence(F.greatest(F.col("line") - radius, F.lit(1)), F.col("line") + radius)))
    return wanted.join(lines.select("repo", "file", F.col("line").alias("n"), "text"), ["repo", "file", "n"]).select("repo", "file", "line", "n", "text")


def render(view: DataFrame, withheld: DataFrame | None = None) -> DataFrame:
    """Windows as numbered text, the flagged line marked, secrets scrubbed or withheld. A window
    holds at most ``2 * radius + 1`` lines, so it may be collected."""
    if withheld is None:
        view = view.withColumn("hidden", F.lit(None).cast("boolean"))
    else:
        hidden = withheld.select("repo", "file", F.col("line").alias("n")).distinct().withColumn("hidden", F.lit(True))
        view = view.join(hidden, ["repo", "file", "n"], "left")
    body = F.when(F.col("hidden"), WITHHELD).otherwise(scrub_quoted(F.col("text")))
    mark = F.when(F.col("n") == F.col("line"), ">").otherwise(" ")
    shown = F.concat(mark, F.lit(" "), F.lpad(F.col("n").cast("string"), 4, " "), F.lit(" | "), body)
    collected = view.groupBy("repo", "file", "line").agg(F.sort_array(F.collect_list(F.struct("n", shown.alias("s")))).alias("v"))
    return collected.select("repo", "file", "line", F.array_join(F.transform("v", lambda x: x["s"]), "\n").alias("view"))


def ask(prompts: DataFrame, provider: Callable[[str, str], str]) -> DataFrame:
    """``prompts`` (repo, prompt_id, system, user) to replies; a provider error is a failed reply."""

    def answer(batches: Iterator) -> Iterator:
        for batch in batches:
            replies, faults = [], []
            for system, user in zip(batch["system"], batch["user"], strict=True):
                try:
                    replies.append(provider(system, user))
                    faults.append(None)
                except Exception as error:  # noqa: BLE001 - a provider may fail in any way
                    replies.append(None)
                    faults.append(str(error))
            yield batch[["repo", "prompt_id"]].assign(reply=replies, fault=faults)

    return prompts.mapInPandas(answer, "repo string, prompt_id string, reply string, fault string")


def embedded_object(reply: Column) -> Column:
    """The reply as a JSON object text: the whole, else between the first and last brace."""
    whole = F.trim(reply)
    between = F.regexp_extract(reply, r"(?s)(\{.*\})", 1)
    is_object = lambda t: F.json_object_keys(t).isNotNull()
    return F.when(is_object(whole), whole).when((between != "") & is_object(between), between)


def verdicts(replies: DataFrame, view: DataFrame) -> DataFrame:
    """Verdict per reply (repo, file, line, reply). "False positive" must quote a shown line other
    than the flagged one; a doubt that cannot be grounded is unsure; anything else is null."""
    document = embedded_object(F.col("reply"))
    field = lambda n: clip(F.coalesce(F.get_json_object(document, f"$.{n}"), F.lit("")))
    read = replies.select(
        "*", verdict_word(field("verdict")).alias("word"), field("reason").alias("reason"), squash(field("proof")).alias("proof"), document.isNotNull().alias("usable")
    )
    doubts = read.where(F.col("word").isin(*FALSE) & (F.length("proof") >= 4))
    shown = view.select("repo", "file", "line", "n", squash(F.col("text")).alias("code"))
    grounded = (
        doubts.join(shown, ["repo", "file", "line"])
        .where((F.col("n") != F.col("line")) & F.contains(F.col("code"), F.col("proof")))
        .select("repo", "file", "line", "proof", F.lit(True).alias("grounded"))
        .distinct()
    )
    joined = read.join(grounded, ["repo", "file", "line", "proof"], "left")
    word = F.col("word")
    verdict = (
        F.when(~F.col("usable"), None)
        .when(word.isin(*REAL), "confirmed")
        .when(word.isin(*UNSURE), "unsure")
        .when(word.isin(*FALSE) & F.col("grounded"), "doubtful")
        .when(word.isin(*FALSE), "unsure")
    )
    return joined.select(*replies.columns, verdict.alias("verdict"), "reason")


ISSUES = "array<struct<line:string,quote:string,title:string,why:string,category:string,severity:string>>"


def claims(replies: DataFrame, lines: DataFrame, existing: DataFrame, shown: DataFrame | None = None) -> DataFrame:
    """Claims of detection replies (repo, file, reply) with ``status`` detected, rejected, repeated
    or known. A claim needs its whole quote on the claimed line.
    ``shown`` (repo, file, line) limits the lines the model was given."""
    document = embedded_object(F.col("reply"))
    listed = F.from_json(F.get_json_object(document, "$.issues"), ISSUES)
    rows = replies.select("repo", "file", F.posexplode(listed).alias("pos", "i")).select(
        "repo",
        "file",
        "pos",
        F.col("i.line").try_cast("int").alias("line"),
        clip(F.coalesce("i.quote", F.lit(""))).alias("quote"),
        clip(F.coalesce("i.title", F.lit(""))).alias("title"),
        clip(F.coalesce("i.why", F.lit(""))).alias("why"),
        F.when(F.col("i.category").isin(*CATEGORIES), F.col("i.category")).otherwise("reliability").alias("category"),
        F.when(F.col("i.severity") == "low", "low").otherwise("medium").alias("severity"),
    )
    visible = lines if shown is None else lines.join(shown.select("repo", "file", "line").distinct(), ["repo", "file", "line"], "left_semi")
    joined = rows.join(visible.select("repo", "file", "line", "text"), ["repo", "file", "line"], "left")
    grounded = (F.length("quote") >= 4) & F.contains(squash(F.col("text")), squash(F.col("quote")))
    topic = slug(F.col("title"))
    ok = F.coalesce(grounded, F.lit(False)) & (F.col("title") != "") & (F.col("why") != "")
    judged = joined.withColumn("topic", topic).withColumn("ok", ok)
    first = first_per_key(
        judged.where("ok AND topic <> ''").select("repo", "file", "line", "topic", F.col("pos").alias("first")), ["repo", "file", "line", "topic"], [F.col("first")]
    )
    reported = existing.select("repo", "file", "line").distinct().withColumn("known", F.lit(True))
    placed = judged.join(first, ["repo", "file", "line", "topic"], "left").join(reported, ["repo", "file", "line"], "left")
    status = (
        F.when(~F.col("ok"), "rejected")
        .when((F.col("topic") == "") | (F.col("pos") != F.coalesce("first", F.lit(-1))), "repeated")
        .when(F.col("known"), "known")
        .otherwise("detected")
    )
    return placed.select("repo", "file", "line", "pos", "title", "why", "category", "severity", F.concat(F.lit("semantic:"), "topic").alias("rule_id"), status.alias("status"))


def before_failures(attempts: DataFrame, limit: int) -> DataFrame:
    """Attempts of a pass up to and including its ``limit``-th failure in a row: repo, ord, failed.

    Each failure marks its own position and the ``limit - 1`` after it; a position marked
    ``limit`` times ends the pass. No window spans a repository."""
    order = numbered(attempts, ["repo"], "ord", out="nth")
    marks = order.where("failed").select("repo", F.explode(F.sequence(F.col("nth"), F.col("nth") + limit - 1)).alias("position"))
    full = marks.groupBy("repo", "position").count().where(F.col("count") == limit)
    stop = full.groupBy("repo").agg(F.min("position").alias("stop"))
    kept = order.join(stop, "repo", "left").where(F.col("stop").isNull() | (F.col("nth") <= F.col("stop")))
    return kept.select(*attempts.columns)
