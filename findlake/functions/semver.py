"""Semantic versions as comparable structs, and the ranges packs depend on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from findlake.functions.text import trim_space

_SHAPE = r"^(\d+)\.(\d+)\.(\d+)"


def parse(version: Column) -> Column:
    """``struct<major,minor,patch>``; null when the text does not start like a version."""
    text = trim_space(version)
    return F.when(text.rlike(_SHAPE), F.struct(*_numbers(text)))


def _numbers(text: Column) -> list[Column]:
    out = []
    for i, name in ((1, "major"), (2, "minor"), (3, "patch")):
        out.append(F.regexp_extract(text, _SHAPE, i).try_cast("double").alias(name))
    return out


def sort_key(version: Column) -> Column:
    """Orders like the versions do; an unparseable one sorts first."""
    parsed = parse(version)
    low = F.lit(-1.0)
    return F.struct(
        F.coalesce(parsed["major"], low).alias("major"),
        F.coalesce(parsed["minor"], low).alias("minor"),
        F.coalesce(parsed["patch"], low).alias("patch"),
    )


def satisfies(version: Column, wanted: Column) -> Column:
    """``*`` or empty, ``^x.y.z``, ``~x.y.z`` or an exact version."""
    text = trim_space(wanted)
    have = parse(version)
    base = parse(F.regexp_replace(text, r"^[\^~]", ""))
    at_least = sort_key(version) >= sort_key(F.regexp_replace(text, r"^[\^~]", ""))
    same_major = have["major"] == base["major"]
    verdict = (
        F.when(text.isin("*", ""), True)
        .when(text.startswith("^"), same_major & at_least)
        .when(text.startswith("~"), same_major & (have["minor"] == base["minor"]) & at_least)
        .otherwise(have == base)
    )
    return F.coalesce(verdict, F.lit(False))
