"""Inline directives: comments that accept a finding where it is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findlake.functions.paths import extension
from findlake.functions.text import ascii_words, trim_space

MARKER = "findlake-ignore"


def parse_directives(comments: DataFrame, marker: str = MARKER) -> DataFrame:
    """``comments`` (repo, file, line, text) to directives (repo, file, line, scope, rule_ids,
    reason). No rule ids, or ``*``, covers every rule; the reason follows `` -- `` or `` — ``."""
    shape = ascii_words(rf"{marker}(-next-line|-file)?\b(.*)$")
    text = F.col("text")
    kept = comments.where(text.contains(marker)).where(text.rlike(shape))
    suffix, rest = F.regexp_extract("text", shape, 1), F.regexp_extract("text", shape, 2)
    parts = F.split(rest, r"\s--\s|\s—\s")
    reason = F.array_join(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), " -- ")
    reason = trim_space(F.regexp_replace(reason, r"\*/\s*$", ""))
    ids = F.filter(F.split(F.element_at(parts, 1), r"[\s,:]+"), lambda r: r.rlike(r"^[\w*-]+$"))
    every = (F.size(ids) == 0) | F.array_contains(ids, "*")
    return kept.select(
        "repo",
        "file",
        "line",
        F.when(suffix == "-next-line", "next-line").when(suffix == "-file", "file").otherwise("line").alias("scope"),
        F.when(~every, ids).alias("rule_ids"),
        F.when(reason != "", reason).alias("reason"),
    )


def suppression_comment(file: Column, rule: Column, reason: Column, marker: str = MARKER) -> Column:
    """The comment that accepts one rule on the next line, in the file's own syntax."""
    body = F.concat(F.lit(f"{marker}-next-line "), rule, F.lit(" -- "), reason)
    ends = extension(file)
    return (
        F.when(ends.isin("py", "rb", "sh", "yaml", "yml", "toml", "env"), F.concat(F.lit("# "), body))
        .when(ends.isin("html", "htm", "vue", "svelte", "md"), F.concat(F.lit("<!-- "), body, F.lit(" -->")))
        .otherwise(F.concat(F.lit("// "), body))
    )
