"""The review as one plan: detect, merge analyzers, accept, sync, report, gate.

Every stage is lazy; running a result runs only the stages it needs. Rows move by
``(repo, file, identity)`` once, in the sync; everything before is row-local or an equi join.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from findlake.functions.directives import parse_directives
from findlake.operators import accept, ledger as L, rules
from findlake.operators.rules import LineRule
from findlake.schemas import FLAT_FINDING
from findlake.sources.analyzers import EQUIVALENTS, SUPERSEDES, to_findings


@dataclass(frozen=True)
class Review:
    """``findings``: what is reported. The rest is what was kept back and why, and what changed."""

    findings: DataFrame
    baselined: DataFrame
    suppressed: DataFrame
    inline: DataFrame
    sync: L.SyncResult
    changes: DataFrame
    gate: DataFrame


def detected(lines: DataFrame, line_rules: Sequence[LineRule], policy_rules: DataFrame | None = None) -> DataFrame:
    """Rule hits as flat findings. ``lines``: repo, file, line, text, ord (unique per repository);
    ``ord`` of a finding leaves room for a hit of every rule on its line."""
    hits = rules.with_excerpt(rules.scan_lines(lines, line_rules))
    if policy_rules is not None:
        hits = hits.join(policy_rules.select("repo", "rule_id").distinct(), ["repo", "rule_id"], "left_semi")
    place = F.array_position(F.array(*[F.lit(r.rule_id) for r in line_rules]), F.col("rule_id"))
    return hits.select(
        "repo", "file", "rule_id", "category", "severity", F.col("line").cast("int").alias("line"), "anchor",
        (F.col("ord").cast("long") * len(line_rules) + place - 1).alias("ord"), F.concat("rule_id", F.lit(" at line "), F.col("line").cast("string")).alias("title"),
    )


def merged(spark: SparkSession, own: DataFrame, analyzer: DataFrame, lines: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """Own findings and the analyzers' (``analyzer`` adds ord), duplicates resolved for the tool.
    ``runs``: repo, tool of every analyzer that returned a result, findings or none."""
    supersedes = spark.createDataFrame(list(SUPERSEDES), "tool string, rule_id string")
    equivalents = spark.createDataFrame(list(EQUIVALENTS), "tool string, tool_rule string, rule_id string")
    return accept.merge_analyzer_findings(own, to_findings(analyzer, lines), supersedes, equivalents, runs)


def review(
    found: DataFrame,
    ledger: DataFrame,
    session: L.Session,
    at: str | None = None,
    memory: DataFrame | None = None,
    baseline: DataFrame | None = None,
    comments: DataFrame | None = None,
    scope: DataFrame | None = None,
    ran_tools: DataFrame | None = None,
    known_tools: Sequence[str] = (),
    fail_on: str = "high",
    overrides: Sequence[tuple[Sequence[str], str]] = (),
    repos: DataFrame | None = None,
) -> Review:
    """Take flat findings through acceptance, the ledger and the gate.

    Inline directives hide first, then repository memory; the ledger sees all that is left, and
    the baseline only decides what is reported. ``repos`` (repo) lists the repositories reviewed, so
    that one without a finding passes the gate.
    """
    names = [f.name for f in found.sparkSession.createDataFrame([], FLAT_FINDING).schema]
    rows = found.select(*names)
    none = rows.limit(0)
    inline = none
    if comments is not None:
        marked = accept.apply_directives(rows, parse_directives(comments))
        inline = marked.where("covered")
        rows = marked.where("NOT covered").select(*names)
    suppressed = none
    if memory is not None:
        marked = accept.apply_memory(rows, memory)
        suppressed = marked.where("memory_item IS NOT NULL")
        rows = marked.where("memory_item IS NULL").select(*names)
    synced = L.sync(rows, ledger, session, at, scope, ran_tools, known_tools)
    if baseline is None:
        reported, accepted = rows, none
    else:
        split = accept.apply_baseline(rows, baseline)
        reported, accepted = split.where("NOT baselined").select(*names), split.where("baselined")
    shown = reported.select("repo", "ord").join(synced.outcomes.select("repo", "ord", "entry_id"), ["repo", "ord"])
    changes = L.change_references(synced.report, synced.ledger, shown)
    gate = accept.fail_gate(reported.withColumn("counted", F.lit(True)), fail_on, overrides, repos)
    return Review(reported, accepted, suppressed, inline, synced, changes, gate)
