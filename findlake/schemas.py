"""Row shapes. Every table starts with ``repo``; a finding keeps its nested form, and operators
work on the flat view ``flatten_findings`` gives."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findlake.functions.identity import content_anchor, first_code_excerpt, identity, rule_id_from_evidence

LINE_RANGE = "struct<start:int,end:int>"
LOCATION = f"struct<file:string,lines:{LINE_RANGE},columns:{LINE_RANGE}>"
EVIDENCE = (
    "struct<kind:string,file:string,excerpt:string,pack:string,rule_id:string,tool:string,"
    "version:string,license:string,url:string,role:string,provider:string,model:string,"
    "verdict:string,reason:string,topic:string>"
)
EXAMPLE = "struct<before:string,after:string>"
RECOMMENDATION = f"struct<summary:string,example:{EXAMPLE}>"

FINDING = (
    "repo string, id string, title string, explanation string, severity string, confidence string, "
    f"category string, locations array<{LOCATION}>, evidence array<{EVIDENCE}>, "
    f"recommendations array<{RECOMMENDATION}>, ord long"
)
FLAT_FINDING = (
    "repo string, file string, rule_id string, category string, severity string, line int, "
    "anchor string, ord long, title string"
)
HISTORY_EVENT = "struct<timestamp:timestamp,previous_state:string,new_state:string,origin:string,comment:string>"
LEDGER = (
    "repo string, entry_id string, file string, rule_id string, category string, anchor string, "
    "status string, severity string, line int, title string, entry_ord long, created_session string, "
    f"updated_session string, history array<{HISTORY_EVENT}>"
)
MEMORY = (
    "repo string, item_id string, kind string, file string, rule_id string, category string, "
    "status string, item_ord long, rationale string"
)
BASELINE = "repo string, key string, file string, rule_id string, title string, count long"
ANALYZER_FINDING = (
    "repo string, tool string, rule_id string, message string, severity string, category string, "
    "file string, line int, column int, end_line int, end_column int, url string, sensitive boolean"
)


def flatten_findings(findings: DataFrame) -> DataFrame:
    """Nested findings to the flat view: first location, cited rule, content anchor."""
    first = F.try_element_at("locations", F.lit(1))
    return findings.select(
        "repo",
        F.coalesce(first["file"], F.lit("")).alias("file"),
        rule_id_from_evidence(F.col("evidence")).alias("rule_id"),
        "category",
        "severity",
        first["lines"]["start"].alias("line"),
        content_anchor(first_code_excerpt(F.col("evidence"))).alias("anchor"),
        "ord",
        "title",
    )


def fingerprints(flat: DataFrame) -> DataFrame:
    """``(file, rule_id, category, anchor)`` plus the identity the ledger matches on."""
    return flat.select(
        "repo", "file", "rule_id", "category", "anchor", identity(F.col("rule_id"), F.col("category")).alias("identity"), "ord"
    )


def affected_files(findings: DataFrame) -> DataFrame:
    """Distinct files of each finding in first-seen order."""
    files = F.array_distinct(F.transform("locations", lambda l: l["file"]))
    return findings.select("repo", "id", "ord", files.alias("files"))


def split_well_formed(findings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A finding needs a location and a piece of evidence; the rest goes to a rejects table."""
    fault = (
        F.when(F.coalesce(F.size("locations"), F.lit(0)) < 1, "no location")
        .when(F.coalesce(F.size("evidence"), F.lit(0)) < 1, "no evidence")
    )
    marked = findings.withColumn("fault", fault)
    return marked.where("fault IS NULL").drop("fault"), marked.where("fault IS NOT NULL")
