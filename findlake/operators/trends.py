"""How findings move over time, from the ledger's history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findlake.functions.fixed import LEDGER_ACTIVE
from findlake.operators.ordered import top_per_key

DAY_MS = 86_400_000


def parse_window_days(text: str) -> int:
    """``30d``, ``8w`` or a bare number of days; at least one day."""
    number, unit = (text[:-1], 7) if text.endswith("w") else (text.removesuffix("d"), 1)
    if not number.isascii() or not number.isdigit() or int(number) * unit < 1:
        raise ValueError('expected a window of at least a day, like "30d" or "8w"')
    return int(number) * unit


def entry_times(ledger: DataFrame) -> DataFrame:
    """When each entry was first seen, and last resolved if it is resolved now (milliseconds)."""
    resolved = F.filter("history", lambda h: h["new_state"] == "resolved")
    closed = F.when(F.col("status") == "resolved", F.try_element_at(resolved, F.lit(-1))["timestamp"])
    return ledger.select(
        "repo",
        "entry_id",
        "status",
        F.unix_millis(F.try_element_at("history", F.lit(1))["timestamp"]).alias("first_ms"),
        F.unix_millis(closed).alias("closed_ms"),
    )


def _week(ms: Column, since: int, weeks: int) -> Column:
    return F.least(F.greatest(F.floor((ms - since) / (7 * DAY_MS)), F.lit(0)), F.lit(weeks - 1)).cast("int")


def weekly(times: DataFrame, now_ms: int, days: int = 30) -> DataFrame:
    """Introduced and resolved per week; every week is present, the last one takes the remainder."""
    since = now_ms - days * DAY_MS
    weeks = max(1, -(-days // 7))
    marks = times.select(
        F.explode(
            F.array(
                F.struct(F.lit("introduced").alias("what"), F.col("first_ms").alias("ms")),
                F.struct(F.lit("resolved").alias("what"), F.col("closed_ms").alias("ms")),
            )
        ).alias("m")
    ).where(F.col("m.ms") >= since)
    counted = marks.groupBy(_week(F.col("m.ms"), since, weeks).alias("week")).agg(
        F.count_if(F.col("m.what") == "introduced").alias("introduced"), F.count_if(F.col("m.what") == "resolved").alias("resolved")
    )
    spine = times.sparkSession.range(weeks).select(F.col("id").cast("int").alias("week"))
    start = F.date_format(F.timestamp_millis(F.lit(since) + F.col("week").cast("long") * (7 * DAY_MS)), "yyyy-MM-dd")
    return spine.join(counted, "week", "left").select(
        "week", start.alias("start"), F.coalesce("introduced", F.lit(0)).alias("introduced"), F.coalesce("resolved", F.lit(0)).alias("resolved")
    )


def mean_days_to_resolve(times: DataFrame, now_ms: int, days: int = 30) -> DataFrame:
    """Mean days from first seen to resolved, over entries resolved inside the window."""
    since = now_ms - days * DAY_MS
    inside = times.where((F.col("closed_ms") >= since) & F.col("first_ms").isNotNull())
    return inside.agg(
        F.count(F.lit(1)).alias("resolved"), F.avg((F.col("closed_ms") - F.col("first_ms")) / F.lit(float(DAY_MS))).alias("mean_days")
    )


def top(ledger: DataFrame, column: Column, n: int) -> DataFrame:
    """Names with most active entries, count descending then name."""
    active = ledger.where(F.col("status").isin(*LEDGER_ACTIVE))
    return active.groupBy(column.alias("name")).agg(F.count(F.lit(1)).alias("open")).orderBy(F.desc("open"), "name").limit(n)


def top_per_repo(ledger: DataFrame, column: Column, n: int) -> DataFrame:
    active = ledger.where(F.col("status").isin(*LEDGER_ACTIVE))
    counts = active.groupBy("repo", column.alias("name")).agg(F.count(F.lit(1)).alias("open"))
    return top_per_key(counts, ["repo"], [F.desc("open"), F.col("name")], n)
