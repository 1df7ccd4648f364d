"""Ordered per-key work that survives a hot key.

A window over ``(key order by ord)`` puts every row of a key into one task. Here each key is
cut into chunks of ``width`` consecutive ``ord`` values. ``ord`` is unique within a repository,
so a chunk never holds more than ``width`` rows, whatever its key. Key columns are never null
(identities are coalesced before), which lets the carry join reuse the window's partitioning.

Work is done per chunk, the small chunk summaries are combined per key, and the carry goes back
to the chunk's rows through a join on ``(key, chunk)``, which has one summary row per chunk and
therefore no hot key. ``attach`` is a table with one row per key whose columns should reach every
row: it is joined to the summaries, not to the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK_WIDTH = 1_000_000
_CHUNK = "__chunk"


def chunk_of(ord_col: str, width: int = CHUNK_WIDTH) -> Column:
    return F.expr(f"CAST(`{ord_col}` AS BIGINT) div {width}")


def _attached(carry: DataFrame, keys: Sequence[str], attach: DataFrame | None) -> tuple[DataFrame, list[str]]:
    if attach is None:
        return carry, []
    return carry.join(attach, list(keys), "left"), [c for c in attach.columns if c not in keys]


def numbered(
    df: DataFrame,
    keys: Sequence[str],
    ord_col: str,
    out: str = "nth",
    width: int = CHUNK_WIDTH,
    attach: DataFrame | None = None,
) -> DataFrame:
    """1-based position of each row within its key, in ``ord`` order."""
    rows = df.withColumn(_CHUNK, chunk_of(ord_col, width))
    per_chunk = rows.groupBy(*keys, _CHUNK).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy(_CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    carry = per_chunk.select(*keys, _CHUNK, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    carry, extra = _attached(carry, keys, attach)
    inside = Window.partitionBy(*keys, _CHUNK).orderBy(ord_col)
    local = rows.withColumn("__local", F.row_number().over(inside))
    joined = local.join(carry, [*keys, _CHUNK], "inner")
    return joined.select(*df.columns, *extra, (F.col("__before") + F.col("__local")).alias(out))


def with_previous(
    df: DataFrame,
    keys: Sequence[str],
    ord_col: str,
    value: str,
    out: str = "previous",
    width: int = CHUNK_WIDTH,
    attach: DataFrame | None = None,
) -> DataFrame:
    """``out`` = struct of the previous row's ``value`` in the key, or null on the key's first row."""
    rows = df.withColumn(_CHUNK, chunk_of(ord_col, width))
    last = rows.groupBy(*keys, _CHUNK).agg(F.max_by(F.struct(F.col(value).alias("value")), F.col(ord_col)).alias("__last"))
    across = Window.partitionBy(*keys).orderBy(_CHUNK)
    carry = last.select(*keys, _CHUNK, F.lag("__last").over(across).alias("__carry"))
    carry, extra = _attached(carry, keys, attach)
    inside = Window.partitionBy(*keys, _CHUNK).orderBy(ord_col)
    local = rows.withColumn("__lag", F.lag(F.struct(F.col(value).alias("value"))).over(inside))
    joined = local.join(carry, [*keys, _CHUNK], "inner")
    return joined.select(*df.columns, *extra, F.coalesce("__lag", "__carry").alias(out))


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One whole row per key, the first in ``order``; combined map-side, so no hot task."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__row"))
    return picked.select(*keys, "__row.*").select(*df.columns)


def last_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__row"))
    return picked.select(*keys, "__row.*").select(*df.columns)


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, out: str = "position") -> DataFrame:
    """First ``n`` rows per key. Spark drops rows past ``n`` in each input partition before the
    shuffle (window group limit), so a task sees at most ``n`` rows per partition and key."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.row_number().over(window)).where(F.col(out) <= n)
