"""What a review accepts: baselines, repository memory, inline directives, analyzer merge, gate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findlake.functions.fixed import LEDGER_ACTIVE
from findlake.functions.globs import glob_regex
from findlake.functions.identity import baseline_key, identity
from findlake.functions.severity import severity_rank, threshold_rank
from findlake.operators.lookup import first_match
from findlake.operators.ordered import numbered


def with_baseline_key(findings: DataFrame) -> DataFrame:
    return findings.withColumn("key", baseline_key(F.col("file"), F.col("rule_id"), F.col("anchor")))


def create_baseline(findings: DataFrame) -> DataFrame:
    """Accept every finding: a count per key and the first title."""
    return (
        with_baseline_key(findings)
        .groupBy("repo", "key")
        .agg(
            F.min_by(F.struct("file", F.coalesce("rule_id", F.lit("")).alias("rule_id"), "title"), "ord").alias("f"),
            F.count(F.lit(1)).alias("count"),
        )
        .select("repo", "key", "f.file", "f.rule_id", "f.title", "count")
    )


def apply_baseline(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    """Multiset difference that keeps rows: the n-th identical finding is accepted if n <= count."""
    counts = baseline.select("repo", "key", F.col("count").alias("accepted"))
    nth = numbered(with_baseline_key(findings), ["repo", "key"], "ord", attach=counts)
    return nth.withColumn("baselined", F.col("nth") <= F.coalesce("accepted", F.lit(0))).drop("accepted")


_PRECEDENCE = {"suppression": 0, "accepted-deviation": 1, "exception": 2}


def apply_memory(findings: DataFrame, memory: DataFrame) -> DataFrame:
    """Findings plus ``memory_item`` and ``suppressed_by`` of the active item that covers each.

    Suppression beats accepted deviation beats exception; inside a kind, store order. A finding
    asks for at most seven exact keys, so null-means-any items stay equi joins.
    """
    any_of = F.lit("*")
    file_key = F.coalesce(F.concat(F.lit("f:"), F.col("file")), any_of)
    rule_key = F.coalesce(F.concat(F.lit("r:"), F.col("rule_id")), any_of)
    kind = F.col("kind")
    lookup = (
        F.when(kind == "suppression", F.concat_ws("|", F.lit("s"), file_key, identity(F.col("rule_id"), F.col("category"))))
        .when(kind == "accepted-deviation", F.concat_ws("|", F.lit("d"), file_key, rule_key))
        .when(kind == "exception", F.concat_ws("|", F.lit("e"), file_key, rule_key))
    )
    precedence = F.when(kind == "suppression", 0).when(kind == "accepted-deviation", 1).otherwise(2)
    rules = memory.where((F.col("status") == "active") & kind.isin(*_PRECEDENCE)).select(
        "repo", lookup.alias("lookup"), precedence.alias("precedence"), "item_ord", F.col("item_id").alias("memory_item"), kind.alias("suppressed_by")
    )
    rows = findings.withColumn("__identity", identity(F.col("rule_id"), F.col("category")))
    named = F.col("__identity").startswith("r:")
    file_part = F.concat(F.lit("f:"), F.col("file"))
    asked = F.array(
        F.concat_ws("|", F.lit("s"), file_part, "__identity"),
        F.when(named, F.concat_ws("|", F.lit("d"), file_part, "__identity")),
        F.when(named, F.concat_ws("|", F.lit("d"), any_of, "__identity")),
        F.when(named, F.concat_ws("|", F.lit("e"), file_part, "__identity")),
        F.when(named, F.concat_ws("|", F.lit("e"), any_of, "__identity")),
        F.concat_ws("|", F.lit("e"), file_part, any_of),
        F.concat_ws("|", F.lit("e"), any_of, any_of),
    )
    return first_match(
        rows,
        ["repo", "file", "__identity"],
        F.array_compact(asked),
        rules,
        ["precedence", "item_ord"],
        ["memory_item", "suppressed_by"],
    ).drop("__identity")


def apply_directives(findings: DataFrame, directives: DataFrame) -> DataFrame:
    """Findings plus the position and reason of the first directive in file order that covers them.

    ``directives``: repo, file, scope (line, next-line, file), line, rule_ids (null = all), reason.
    """
    target = F.when(F.col("scope") == "line", F.col("line")).when(F.col("scope") == "next-line", F.col("line") + 1)
    rules = directives.select(
        "repo",
        "line",
        "reason",
        F.explode(F.coalesce("rule_ids", F.array(F.lit("*")))).alias("rule"),
        "file",
        F.coalesce(target.cast("string"), F.lit("*")).alias("target"),
    ).select(
        "repo",
        F.concat_ws("|", "file", "target", "rule").alias("lookup"),
        F.col("line").alias("directive_line"),
        F.col("reason").alias("directive_reason"),
    )
    rows = findings.withColumn("__line", F.coalesce(F.col("line").cast("string"), F.lit("?"))).withColumn(
        "__rule", F.coalesce("rule_id", F.lit("?"))
    )
    asked = F.array(
        F.concat_ws("|", "file", "__line", "__rule"),
        F.concat_ws("|", "file", "__line", F.lit("*")),
        F.concat_ws("|", "file", F.lit("*"), "__rule"),
        F.concat_ws("|", "file", F.lit("*"), F.lit("*")),
    )
    return first_match(
        rows,
        ["repo", "file", "__line", "__rule"],
        asked,
        rules.withColumn("covered", F.lit(True)),
        ["directive_line"],
        ["directive_line", "directive_reason", "covered"],
    ).withColumn("covered", F.coalesce("covered", F.lit(False))).drop("__line", "__rule")


def merge_analyzer_findings(
    own: DataFrame, analyzer: DataFrame, supersedes: DataFrame, equivalents: DataFrame, runs: DataFrame | None = None
) -> DataFrame:
    """Own findings a tool answers for are dropped, then both sides are united.

    ``supersedes``: tool, rule_id (ours). ``equivalents``: tool, tool_rule, rule_id (ours).
    ``analyzer`` carries tool, tool_rule and the finding columns of ``own``. ``runs`` (repo, tool)
    lists the tools that returned a result: one that found nothing supersedes as well.
    """
    tools = (analyzer if runs is None else runs).select("repo", "tool").distinct()
    gone = tools.join(supersedes, "tool").select("repo", "rule_id").distinct()
    covered = (
        analyzer.where("line IS NOT NULL")
        .select("repo", "tool", "tool_rule", "file", "line")
        .join(equivalents, ["tool", "tool_rule"])
        .select("repo", "file", "line", "rule_id")
        .distinct()
    )
    kept = own.join(gone, ["repo", "rule_id"], "left_anti").join(covered, ["repo", "file", "line", "rule_id"], "left_anti")
    return kept.select(*own.columns).unionByName(analyzer.select(*own.columns))


def on_changed_lines(findings: DataFrame, changed: DataFrame, files: DataFrame) -> DataFrame:
    """Keep findings on an added line; a finding without a line counts when its file changed; all
    findings of an untracked file count.

    ``changed``: repo, file, line. ``files``: repo, file, untracked.
    """
    state = files.groupBy("repo", "file").agg(F.bool_or("untracked").alias("__untracked"))
    touched = changed.select("repo", "file", "line").distinct().withColumn("__touched", F.lit(True))
    joined = findings.join(state, ["repo", "file"]).join(touched, ["repo", "file", "line"], "left")
    kept = joined.where(F.col("__untracked") | F.col("line").isNull() | F.col("__touched"))
    return kept.select(*findings.columns)


def leave_out_ignored(findings: DataFrame, globs: Sequence[str], prefix: str = "") -> DataFrame:
    """Drop findings under ignored globs; a finding without a file stays."""
    if not globs:
        return findings
    path = F.col("file") if not prefix else F.concat(F.lit(prefix + "/"), F.col("file"))
    hit = F.lit(False)
    for pattern in globs:
        hit = hit | path.rlike(glob_regex(pattern))
    return findings.where((F.col("file") == "") | ~hit)


def bar_of(path: Column, default: str, overrides: Sequence[tuple[Sequence[str], str]]) -> Column:
    """The bar for a path: the first override one of whose globs matches, else the run's."""
    chain = F.lit(default)
    for globs, bar in reversed(list(overrides)):
        hit = F.lit(False)
        for pattern in globs:
            hit = hit | path.rlike(glob_regex(pattern))
        chain = F.when(hit, F.lit(bar)).otherwise(chain)
    return chain


def fail_gate(findings: DataFrame, default: str, overrides: Sequence[tuple[Sequence[str], str]] = (), repos: DataFrame | None = None) -> DataFrame:
    """Per repository: does a counted finding reach its bar? ``counted`` marks the rows that count.
    ``repos`` (repo) lists the repositories reviewed; those without a finding pass."""
    limit = threshold_rank(bar_of(F.col("file"), default, overrides))
    over = F.col("counted") & F.coalesce(severity_rank(F.col("severity")) <= limit, F.lit(False))
    gate = findings.groupBy("repo").agg(F.bool_or(over).alias("failed"), F.count_if(over).alias("over_bar"))
    if repos is None:
        return gate
    every = repos.select("repo").distinct().join(gate, "repo", "full_outer")
    return every.select("repo", F.coalesce("failed", F.lit(False)).alias("failed"), F.coalesce("over_bar", F.lit(0)).alias("over_bar"))


def accept_into_memory(requests: DataFrame, ledger: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Accept ledger entries by request (repo, entry_id, reason, requested_at): memory rows with
    their history, the entries to dismiss, and rejects (unknown entry, short reason, no rule)."""
    entry = ledger.select("repo", "entry_id", "file", "rule_id", "category", F.col("status").alias("entry_status"))
    joined = requests.join(entry, ["repo", "entry_id"], "left")
    fault = (
        F.when(F.length(F.trim("reason")) < 8, "reason too short")
        .when(F.col("file").isNull(), "not found")
        .when(F.col("rule_id").isNull(), "no rule")
    )
    marked = joined.withColumn("fault", fault)
    steps = [(None, "detected"), ("detected", "suggested"), ("suggested", "confirmed"), ("confirmed", "active")]
    history = F.array(*[F.struct(F.col("requested_at").alias("timestamp"), F.lit(a).cast("string").alias("previous_state"), F.lit(b).alias("new_state")) for a, b in steps])
    items = marked.where("fault IS NULL").select(
        "repo",
        F.substring(F.sha2(F.concat_ws("|", "repo", "entry_id", "reason"), 256), 1, 32).alias("item_id"),
        F.lit("suppression").alias("kind"),
        "file",
        "rule_id",
        "category",
        F.lit("active").alias("status"),
        F.col("reason").alias("rationale"),
        history.alias("history"),
    )
    dismissed = marked.where(F.col("fault").isNull() & F.col("entry_status").isin(*LEDGER_ACTIVE)).select("repo", "entry_id", "reason")
    return items, dismissed, marked.where("fault IS NOT NULL").select("repo", "entry_id", "reason", "fault")
