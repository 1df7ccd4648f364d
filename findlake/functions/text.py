"""Text functions: whitespace, UTF-16 lengths, redaction, excerpts, generated content."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from findlake.functions import fixed

# The white space ECMAScript's trim removes.
_SPACE = r"[\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
_SPACE_CHARS = "\t\n\x0b\f\r \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


# Java's `\\b` follows Unicode letters before JDK 19; the patterns here mean ASCII words.
_BOUNDARY = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
_WORD_START = r"(?<![A-Za-z0-9_])"
_WORD_NEXT = re.compile(r"(?:\(\?:)?(?:[A-Za-z0-9_]|\\[dw]|\[(?:A-Z|a-z|0-9|_)+\])")


def ascii_words(pattern: str) -> str:
    """The pattern with every word boundary taken between ASCII word characters and anything
    else; a boundary in front of a word character only has to look back."""
    head, *rest = pattern.split(r"\b")
    return head + "".join((_WORD_START if _WORD_NEXT.match(part) else _BOUNDARY) + part for part in rest)


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def after(text: Column, n: int) -> Column:
    """What follows the first ``n`` characters."""
    return F.substring(text, F.lit(n + 1), F.length(text))


def trim_space(text: Column) -> Column:
    return F.btrim(text, F.lit(_SPACE_CHARS))


def units(text: Column) -> Column:
    """Length in UTF-16 code units; text without astral characters skips the encoding."""
    astral = F.length(F.regexp_replace(text, r"[^\x{10000}-\x{10FFFF}]", ""))
    return F.length(text) + F.when(F.octet_length(text) > F.length(text), astral).otherwise(0)


def first_units(text: Column, limit: int) -> Column:
    """The first ``limit`` UTF-16 units; a character cut in half becomes U+FFFD."""

    def take(state: Column, ch: Column) -> Column:
        size = F.when(ch.rlike(r"[\x{10000}-\x{10FFFF}]"), 2).otherwise(1)
        total = state["used"] + size
        kept = (
            F.when(total <= limit, F.concat(state["out"], ch))
            .when(state["used"] < limit, F.concat(state["out"], F.lit("\ufffd")))
            .otherwise(state["out"])
        )
        return F.struct(kept.alias("out"), F.least(total, F.lit(limit)).alias("used"))

    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("used"))

    def cut(head: Column) -> Column:
        exact = F.aggregate(F.split(head, ""), start, take, lambda s: s["out"])
        wide = (F.octet_length(head) > F.length(head)) & head.rlike(r"[\x{10000}-\x{10FFFF}]")
        return F.when(wide, exact).otherwise(head)

    return bound(F.substring(text, 1, limit), cut)


def _may_hold_token(text: Column) -> Column:
    """Plain substring tests, so the patterns run only on the few texts that need them."""
    hit = F.lit(False)
    for mark in fixed.KNOWN_TOKEN_MARKS:
        hit = hit | F.contains(text, F.lit(mark))
    return hit


def redact_known_tokens(text: Column) -> Column:
    """Every self-identifying credential replaced, one format after the other."""

    def redact(plain: Column) -> Column:
        clean = plain
        for pattern in fixed.KNOWN_TOKEN_PATTERNS:
            clean = F.regexp_replace(clean, ascii_words(pattern), fixed.REDACTED)
        return F.when(_may_hold_token(plain), clean).otherwise(plain)

    return bound(text, redact)


def holds_known_token(text: Column) -> Column:
    return _may_hold_token(text) & text.rlike("|".join(f"(?:{ascii_words(p)})" for p in fixed.KNOWN_TOKEN_PATTERNS))


def excerpt(line: Column) -> Column:
    """The line trimmed, credentials redacted, cut at 200 units: the text an anchor hashes."""
    return first_units(redact_known_tokens(trim_space(line)), fixed.EXCERPT_UNITS)


def scrub_quoted(text: Column) -> Column:
    """Quoted tokens of 24 or more token characters, hidden before text leaves for a model."""
    return F.regexp_replace(text, r"""(["'`])[A-Za-z0-9_\-/+=.]{24,}\1""", "$1[REDACTED]$1")


def squash(text: Column) -> Column:
    """All white space removed, for comparing a quote with the code it claims to quote."""
    return F.regexp_replace(text, f"{_SPACE}+", "")


def clip(text: Column, limit: int | None = None) -> Column:
    """White space collapsed; cut at ``limit`` characters where a caller shows an excerpt."""
    flat = trim_space(F.regexp_replace(text, f"{_SPACE}+", " "))
    return flat if limit is None else F.substring(flat, 1, limit)


def slug(title: Column, limit: int | None = None) -> Column:
    """Lower-case words joined by hyphens; cut only where a caller shows a short name."""
    dashed = F.regexp_replace(F.regexp_replace(F.lower(title), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")
    return dashed if limit is None else F.substring(dashed, 1, limit)


def verdict_word(text: Column) -> Column:
    """Lower case, each run of white space or hyphens as one underscore."""
    return F.regexp_replace(F.lower(text), r"[\s-]+", "_")


def first_sentence(statement: Column) -> Column:
    return trim_space(F.element_at(F.split(statement, r"[.\n]"), 1))


def line_array(content: Column) -> Column:
    return F.split(content, "\n")


def is_generated_content(content: Column) -> Column:
    """A generated-file header in the first lines, or text shaped like minified code."""

    def judge(lines: Column) -> Column:
        head = F.array_join(F.slice(lines, 1, fixed.GENERATED_HEAD_LINES), "\n")
        longest = F.array_max(F.transform(lines, units))
        return head.rlike(fixed.GENERATED_HEAD_PATTERN) | (
            (total >= fixed.MINIFIED_MIN_UNITS)
            & ((longest > fixed.MINIFIED_LONGEST_LINE) | (total / F.size(lines) > fixed.MINIFIED_AVERAGE_LINE))
        )

    total = units(content)
    return bound(line_array(content), judge)


def word_count(text: Column) -> Column:
    return bound(trim_space(text), lambda t: F.when(t == "", 0).otherwise(F.size(F.split(t, f"{_SPACE}+"))))


def markdown_title(text: Column) -> Column:
    """Text of the first level-one heading, or null."""
    found = F.regexp_extract(text, r"(?m)^#[ \t]+(.+)$", 1)
    return F.when(found != "", trim_space(found))


def shannon_entropy(text: Column) -> Column:
    """Bits per character, from character counts inside the row."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    n = F.size(chars).cast("double")

    def term(total: Column, ch: Column) -> Column:
        p = F.size(F.filter(chars, lambda c: c == ch)) / n
        return total - p * F.log2(p)

    return F.when(n > 0, F.aggregate(F.array_distinct(chars), F.lit(0.0), term)).otherwise(F.lit(0.0))
