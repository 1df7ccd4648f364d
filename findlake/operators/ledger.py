"""The findings ledger: matching, sync, change references, listings.

Identity is ``(repo, file, rule)``, or category where no rule is cited; the content anchor is
not part of it. Findings of one session are folded in order: each is compared with the anchor
the previous finding of the same identity left, so ``changed`` is a lag.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from findlake.functions.fixed import LEDGER_ACTIVE
from findlake.functions.identity import entry_id, identity
from findlake.operators.ordered import first_per_key, with_previous

KEYS = ["repo", "file", "identity"]
CLOSED = ("resolved", "dismissed")
LATEST = ["rule_id", "category", "anchor", "severity", "line", "title"]


def with_identity(df: DataFrame) -> DataFrame:
    return df.withColumn("identity", identity(F.col("rule_id"), F.col("category")))


def _first_entries(ledger: DataFrame) -> DataFrame:
    """First entry per identity by ledger order, all entries considered, not only active ones."""
    first = first_per_key(with_identity(ledger).select(*KEYS, "entry_id", "status", "anchor", "entry_ord"), KEYS, [F.col("entry_ord")])
    return first.select(
        *KEYS,
        F.col("entry_id").alias("known_id"),
        F.col("status").alias("known_status"),
        F.col("anchor").alias("known_anchor"),
    )


def _differs(before: Column, after: Column) -> Column:
    """Changed only when both anchors exist and differ."""
    return F.coalesce(before != after, F.lit(False))


def match(findings: DataFrame, ledger: DataFrame) -> DataFrame:
    """Each finding with the entry it matches, or null; ``changed`` against that entry's anchor."""
    joined = with_identity(findings).join(_first_entries(ledger), KEYS, "left")
    return joined.select(
        *findings.columns, F.col("known_id").alias("entry_id"), _differs(F.col("known_anchor"), F.col("anchor")).alias("changed")
    )


@dataclass(frozen=True)
class SyncResult:
    """``outcomes``: one row per finding. ``ledger``: the next state. ``report``: long format."""

    outcomes: DataFrame
    ledger: DataFrame
    report: DataFrame


Session = str | DataFrame


def _stamped(df: DataFrame, session: Session, at: Column | str | None = None) -> DataFrame:
    """``df`` with the session and time that apply to its repository; null where none does."""
    if isinstance(session, DataFrame):
        return df.join(session.select("repo", F.col("session").alias("__session"), F.col("at").cast("timestamp").alias("__at")), "repo", "left")
    return df.withColumn("__session", F.lit(session)).withColumn("__at", (at if isinstance(at, Column) else F.lit(at)).cast("timestamp"))


def outcomes(findings: DataFrame, ledger: DataFrame, session: Session) -> DataFrame:
    """One row per finding: ``entry_id`` and ``outcome`` (new, reopened, changed, unchanged)."""
    rows = with_identity(findings)
    folded = with_previous(rows, KEYS, "ord", "anchor", out="previous", attach=_first_entries(ledger))
    first = F.col("previous").isNull()
    against = F.when(first, F.col("known_anchor")).otherwise(F.col("previous.value"))
    outcome = (
        F.when(first & F.col("known_id").isNull(), "new")
        .when(first & F.col("known_status").isin(*CLOSED), "reopened")
        .when(_differs(against, F.col("anchor")), "changed")
        .otherwise("unchanged")
    )
    ident = entry_id(F.col("repo"), F.col("file"), F.col("identity"), F.col("__session"))
    return _stamped(folded, session).select(*findings.columns, F.coalesce("known_id", ident).alias("entry_id"), outcome.alias("outcome"))


def _event(time: Column, before: Column, after: Column, origin: Column) -> Column:
    return F.struct(
        time.alias("timestamp"),
        before.cast("string").alias("previous_state"),
        after.alias("new_state"),
        origin.alias("origin"),
        F.lit(None).cast("string").alias("comment"),
    )


def not_analyzed(rule_id: Column, tool_ran: Column, known_tools: Sequence[str]) -> Column:
    """An entry of a tool that did not run (or of a model) says nothing by its absence."""
    tool = F.element_at(F.split(rule_id, ":"), 1)
    return F.coalesce((tool == "semantic") | (tool.isin(*known_tools) & ~F.coalesce(tool_ran, F.lit(False))), F.lit(False))


def sync(
    findings: DataFrame,
    ledger: DataFrame,
    session: Session,
    at: Column | str | None = None,
    scope: DataFrame | None = None,
    ran_tools: DataFrame | None = None,
    known_tools: Sequence[str] = (),
) -> SyncResult:
    """Apply one session: a name and a time, or rows (repo, session, at) with one session per
    repository; repositories without one are left as they are. ``scope`` (repo, file) limits what absence may resolve; null means the
    whole workspace. ``ran_tools`` (repo, tool) lists the analyzers that ran."""
    per_finding = outcomes(findings, ledger, session)

    latest = (
        with_identity(findings)
        .groupBy(*KEYS)
        .agg(F.max_by(F.struct(*LATEST), F.col("ord")).alias("latest"), F.min("ord").alias("first_ord"))
    )
    order = Window.partitionBy(*KEYS).orderBy("entry_ord")
    # Sync itself keeps one entry per identity; a second one (edited by hand) never matches.
    known = with_identity(ledger).withColumn("nth", F.row_number().over(order))
    known = known.withColumn("identity", F.when(F.col("nth") == 1, F.col("identity")).otherwise(F.concat_ws("#", "identity", "entry_ord")))
    if scope is None:
        known = known.withColumn("in_scope", F.lit(True))
    else:
        flag = scope.select("repo", "file").distinct().withColumn("in_scope", F.lit(True))
        known = known.join(flag, ["repo", "file"], "left").withColumn("in_scope", F.coalesce("in_scope", F.lit(False)))
    known = known.withColumn("tool", F.element_at(F.split("rule_id", ":"), 1))
    if ran_tools is None:
        known = known.withColumn("tool_ran", F.lit(False))
    else:
        known = known.join(ran_tools.select("repo", "tool").distinct().withColumn("tool_ran", F.lit(True)), ["repo", "tool"], "left")
    columns = [c for c in ledger.columns if c not in ("repo", "file")]
    known = known.select(*KEYS, F.struct(*columns).alias("e"), "in_scope", "tool_ran")

    both = _stamped(known.join(latest, KEYS, "full_outer"), session, at)
    origin = F.concat(F.lit("review:"), "__session")
    is_known, is_seen = F.col("e").isNotNull(), F.col("latest").isNotNull()
    status = F.col("e.status")
    reopen = is_known & is_seen & status.isin(*CLOSED)
    resolve = (
        is_known
        & ~is_seen
        & F.col("__session").isNotNull()
        & status.isin(*LEDGER_ACTIVE)
        & F.col("in_scope")
        & ~not_analyzed(F.col("e.rule_id"), F.col("tool_ran"), known_tools)
    )
    next_status = (
        F.when(~is_known, "open").when(reopen, "reopened").when(resolve, "resolved").otherwise(status)
    )
    moved = ~is_known | reopen | resolve
    appended = F.array(_event(F.col("__at"), status, next_status, origin))
    history = F.when(moved, F.concat(F.coalesce(F.col("e.history"), F.array().cast("array<struct<timestamp:timestamp,previous_state:string,new_state:string,origin:string,comment:string>>")), appended)).otherwise(F.col("e.history"))
    refreshed = [F.when(is_seen, F.col(f"latest.{c}")).otherwise(F.col(f"e.{c}")).alias(c) for c in LATEST]
    ident = entry_id(F.col("repo"), F.col("file"), F.col("identity"), F.col("__session"))
    after = both.select(
        "repo",
        F.coalesce("e.entry_id", ident).alias("entry_id"),
        "file",
        *refreshed,
        next_status.alias("status"),
        F.coalesce("e.entry_ord", "first_ord").alias("entry_ord"),
        F.coalesce("e.created_session", "__session").alias("created_session"),
        F.when(is_seen, F.col("__session")).otherwise(F.col("e.updated_session")).alias("updated_session"),
        history.alias("history"),
        F.coalesce(resolve, F.lit(False)).alias("auto_resolved"),
    )
    report = per_finding.select("repo", "entry_id", "outcome", "ord").unionByName(
        after.where("auto_resolved").select("repo", "entry_id", F.lit("auto_resolved").alias("outcome"), F.col("entry_ord").alias("ord"))
    )
    return SyncResult(per_finding, after.drop("auto_resolved").select(*ledger.columns), report)


def sync_scope(cited: DataFrame, deleted: DataFrame | None = None, named: DataFrame | None = None) -> DataFrame:
    """Files a diff or file review may resolve: cited, deleted and named ones."""
    files = cited.select("repo", "file")
    for extra in (deleted, named):
        if extra is not None:
            files = files.unionByName(extra.select("repo", "file"))
    return files.distinct()


def change_references(report: DataFrame, ledger: DataFrame, reported: DataFrame) -> DataFrame:
    """Introduced and reopened entries that were reported, and every fixed one, per occurrence."""
    named = report.where(F.col("outcome").isin("new", "reopened", "auto_resolved")).withColumn(
        "change",
        F.when(F.col("outcome") == "new", "introduced").when(F.col("outcome") == "reopened", "reopened").otherwise("fixed"),
    )
    shown = reported.select("repo", "entry_id").distinct().withColumn("shown", F.lit(True))
    kept = named.join(shown, ["repo", "entry_id"], "left").where("change = 'fixed' OR shown")
    entry = ledger.select("repo", "entry_id", "title", "file", "line", "rule_id", "severity")
    return kept.select("repo", "entry_id", "change", "ord").join(entry, ["repo", "entry_id"])


def listing(
    ledger: DataFrame,
    status: Sequence[str] | None = None,
    severity: Sequence[str] | None = None,
    category: Sequence[str] | None = None,
    file: str | None = None,
) -> DataFrame:
    """Ledger filter; an absent argument filters nothing. Plain predicates reach the scan."""
    for column, allowed in (("status", status), ("severity", severity), ("category", category)):
        if allowed is not None:
            ledger = ledger.where(F.col(column).isin(*allowed))
    return ledger if file is None else ledger.where(F.col("file") == file)


def history_feed(ledger: DataFrame) -> DataFrame:
    """Every state change of every entry; callers order by ``timestamp`` descending."""
    return ledger.select(
        "repo", "entry_id", "file", "rule_id", "category", F.posexplode("history").alias("step", "event")
    ).select("repo", "entry_id", "file", "rule_id", "category", "step", "event.*")


def page(ledger: DataFrame, after: int, limit: int) -> DataFrame:
    """One page per repository in ledger order: rows past the cursor, at most ``limit`` of them.

    ``entry_ord`` is the cursor, so a page is a range predicate and a per-repository top-n; totals
    come from a partial aggregate, never from numbering the whole ledger.
    """
    rest = ledger.where(F.col("entry_ord") > after)
    window = Window.partitionBy("repo").orderBy("entry_ord")
    rows = rest.withColumn("position", F.row_number().over(window)).where(F.col("position") <= limit)
    totals = ledger.groupBy("repo").agg(F.count(F.lit(1)).alias("total"))
    left = rest.groupBy("repo").agg(F.count(F.lit(1)).alias("remaining"))
    return rows.join(totals, "repo").join(left, "repo").withColumn(
        "next_cursor", F.when((F.col("remaining") > limit) & (F.col("position") == limit), F.col("entry_ord"))
    )
