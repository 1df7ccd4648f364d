"""Globs as regular expressions, decided once per pattern, never per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from findlake.functions.text import after

_SPECIAL = set(".\\+()[]{}^$|")


def _literal(text: str) -> str:
    return "".join("\\" + c if c in _SPECIAL else c for c in text)


def glob_regex(pattern: str) -> str:
    """A config glob: ``**`` crosses directories, ``*`` and ``?`` stay inside one, a pattern with
    no slash matches at any depth, and a directory pattern covers what is inside it."""
    body = pattern.removeprefix("./")
    out, i = [], 0
    while i < len(body):
        if body.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 3
        elif body.startswith("**", i):
            out.append(".*")
            i += 2
        else:
            out.append({"*": "[^/]*", "?": "[^/]"}.get(body[i], _literal(body[i])))
            i += 1
    start = "^" if "/" in body else "(?:^|/)"
    return f"(?s){start}{''.join(out)}(?:/|\\z)"


def owner_rule_columns(pattern: Column) -> dict[str, Column]:
    """Columns for one CODEOWNERS pattern: its regex and the exact key a matching path must hold.

    The key lets rules meet files by an equi join: the literal leading directories of an anchored
    pattern, the name of a one-segment pattern, the suffix of ``*.ext``; else ``any``.
    """
    pattern = F.regexp_replace(pattern, r"^\\", "")
    dir_only = pattern.endswith("/")
    body = F.regexp_replace(pattern, r"/+$", "")
    anchored = body.contains("/")
    segments = F.filter(F.split(body, "/"), lambda s: s != "")
    last = F.try_element_at(segments, F.lit(-1))
    last_is_glob = last.rlike(r"[*?]")
    size = F.size(segments)

    def piece(segment: Column, index: Column) -> Column:
        escaped = F.regexp_replace(segment, r"([.\\+()\[\]{}^$|])", r"\\$1")
        text = F.regexp_replace(F.regexp_replace(escaped, r"\*", "[^/]*"), r"\?", "[^/]")
        is_last = index == size - 1
        return (
            F.when((segment == "**") & is_last, ".+")
            .when(segment == "**", "(?:[^/]+/)*")
            .otherwise(F.concat(text, F.when(is_last, "").otherwise("/")))
        )

    middle = F.array_join(F.transform(segments, piece), "")
    end = (
        F.when(last_is_glob & dir_only, "(?!)")
        .when(last_is_glob, r"\z")
        .when(dir_only, "/")
        .otherwise(r"(?:/|\z)")
    )
    start = F.when(anchored, "^").otherwise("(?:^|/)")
    regex = F.concat(F.lit("(?s)"), start, middle, end)

    plain = F.transform(segments, lambda s: ~s.rlike(r"[*?]"))
    wild_at = F.array_position(plain, F.lit(False))
    leading = F.when(wild_at == 0, size).otherwise(wild_at - 1).cast("int")
    key = (
        F.when(anchored & (leading > 0), F.concat(F.lit("a|"), F.array_join(F.slice(segments, F.lit(1), leading), "/")))
        .when(~anchored & ~last_is_glob, F.concat(F.lit("s|"), last))
        .when(~anchored & last.rlike(r"^\*\.[^*?]+$"), F.concat(F.lit("x|"), after(last, 1)))
        .otherwise("any")
    )
    return {"regex": regex, "lookup": key, "segments": segments}


def path_lookups(path: Column) -> Column:
    """Every key a path can be found under: its ancestors, its segments, its name's suffixes."""
    segments = F.split(path, "/")
    ancestors = F.transform(
        F.sequence(F.lit(1), F.size(segments)), lambda n: F.concat(F.lit("a|"), F.array_join(F.slice(segments, F.lit(1), n), "/"))
    )
    names = F.transform(F.array_distinct(segments), lambda s: F.concat(F.lit("s|"), s))
    dots = F.split(F.element_at(segments, -1), r"\.")
    suffixes = F.when(
        F.size(dots) > 1,
        F.transform(
            F.sequence(F.lit(2), F.greatest(F.size(dots), F.lit(2))),
            lambda n: F.concat(F.lit("x|."), F.array_join(F.slice(dots, n, F.size(dots)), ".")),
        ),
    ).otherwise(F.array().cast("array<string>"))
    return F.concat(ancestors, names, suffixes, F.array(F.lit("any")))
