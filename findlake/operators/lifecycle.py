"""Lifecycle state machines over requested moves, with illegal moves rejected.

Whether a move is legal depends on every accepted move before it. Each request is a function on
the (few) states, functions compose, and composition is associative, so a key's requests can be
folded in blocks of bounded size and the blocks folded again: no key, however hot, is ever
collected whole.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findlake.functions import fixed
from findlake.operators.ordered import last_per_key, numbered, with_previous

BLOCK = 256

LEDGER = (fixed.LEDGER_STATES, fixed.LEDGER_MOVES)
MEMORY = (fixed.MEMORY_STATES, fixed.MEMORY_MOVES)
SESSION = (fixed.SESSION_STATES, fixed.SESSION_MOVES)


def is_legal(before: Column, after: Column, moves: Mapping[str, Sequence[str]]) -> Column:
    """The transition table as one predicate."""
    allowed = F.lit(False)
    for source, targets in moves.items():
        if targets:
            allowed = allowed | ((before == source) & after.isin(*targets))
    return allowed


def check_sequence(events: DataFrame, keys: Sequence[str], ord_col: str, state: str, moves: Mapping[str, Sequence[str]]) -> DataFrame:
    """Recorded histories: is each state a legal move from the one recorded before it?"""
    rows = with_previous(events, keys, ord_col, state, out="__previous")
    before = F.col("__previous.value")
    legal = F.when(before.isNull(), F.lit(True)).otherwise(is_legal(before, F.col(state), moves))
    return rows.select(*events.columns, before.alias("previous_state"), legal.alias("legal"))


def _request_function(target: Column, states: Sequence[str], moves: Mapping[str, Sequence[str]]) -> Column:
    """The request as an array: position = state before, value = state after."""
    chain = F.array(*[F.lit(i) for i in range(len(states))])
    for t, name in enumerate(states):
        image = [t if name in moves[s] else i for i, s in enumerate(states)]
        chain = F.when(target == name, F.array(*[F.lit(i) for i in image])).otherwise(chain)
    return chain


def _starts(rows: DataFrame, keys: Sequence[str], start: int, size: int, levels: int, current: DataFrame | None) -> DataFrame:
    """``rows``: keys, idx, fn. Adds ``begin``: the state each row's function is applied to."""
    block = F.floor(F.col("idx") / BLOCK).cast("long")
    grouped = rows.groupBy(*keys, block.alias("block")).agg(F.sort_array(F.collect_list(F.struct("idx", "fn"))).alias("items"))
    if levels <= 1 and current is None:
        begun = grouped.withColumn("begin", F.lit(start))
    elif levels <= 1:
        begun = grouped.join(current, list(keys), "left").withColumn("begin", F.coalesce("begin", F.lit(start)))
    else:
        same = F.array(*[F.lit(i) for i in range(size)])
        composed = F.aggregate(
            "items", same, lambda acc, item: F.transform(acc, lambda s: F.element_at(item["fn"], s + 1))
        )
        above = _starts(grouped.select(*keys, F.col("block").alias("idx"), composed.alias("fn")), keys, start, size, levels - 1, current)
        begun = grouped.join(above.select(*keys, F.col("idx").alias("block"), "begin"), [*keys, "block"])

    def step(acc: Column, item: Column) -> Column:
        return F.struct(
            F.concat(acc["out"], F.array(F.struct(item["idx"].alias("idx"), acc["at"].alias("begin")))).alias("out"),
            F.element_at(item["fn"], acc["at"] + 1).alias("at"),
        )

    empty = F.array().cast("array<struct<idx:bigint,begin:int>>")
    walked = F.aggregate("items", F.struct(empty.alias("out"), F.col("begin").alias("at")), step, lambda acc: acc["out"])
    return begun.select(*keys, F.explode(walked).alias("w")).select(*keys, "w.idx", "w.begin")


def fold(
    events: DataFrame,
    keys: Sequence[str],
    ord_col: str,
    target: str,
    machine: tuple[Sequence[str], Mapping[str, Sequence[str]]],
    start: str | None = None,
    current: DataFrame | None = None,
) -> DataFrame:
    """Each request with ``state_before``, ``accepted`` and ``state_after``. ``current`` (keys,
    status) holds the states keys are in already; others begin in ``start``.

    One small action finds the longest key, which fixes how many block levels the plan needs
    (one for keys of up to 256 requests, two up to 65,536, and so on).
    """
    states, moves = machine
    first = list(states).index(start or states[0])
    longest = events.groupBy(*keys).count().agg(F.max("count")).first()[0] or 1
    levels = max(1, math.ceil(math.log(max(longest, 2), BLOCK)))
    rows = numbered(events, keys, ord_col, out="__nth").withColumn("idx", F.col("__nth") - 1)
    rows = rows.withColumn("fn", _request_function(F.col(target), states, moves))
    if current is not None:
        place = F.array_position(F.array(*[F.lit(s) for s in states]), F.col("status")) - 1
        current = current.select(*keys, place.cast("int").alias("begin"))
    begins = _starts(rows.select(*keys, "idx", "fn"), keys, first, len(states), levels, current)
    joined = rows.join(begins, [*keys, "idx"])
    names = F.array(*[F.lit(s) for s in states])
    before = F.element_at(names, F.col("begin") + 1)
    after = F.element_at(names, F.element_at("fn", F.col("begin") + 1) + 1)
    accepted = is_legal(before, F.col(target), moves)
    return joined.select(*events.columns, before.alias("state_before"), accepted.alias("accepted"), after.alias("state_after"))


def current_states(folded: DataFrame, keys: Sequence[str], ord_col: str) -> DataFrame:
    """Last state per key, with how many requests were accepted and rejected."""
    last = last_per_key(folded.select(*keys, ord_col, F.col("state_after").alias("status")), keys, [F.col(ord_col)])
    counts = folded.groupBy(*keys).agg(F.count_if("accepted").alias("accepted"), F.count_if(~F.col("accepted")).alias("rejected"))
    return last.join(counts, list(keys)).drop(ord_col)


def memory_requests(actions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Memory actions (suggest, confirm, activate, reject, deprecate, reactivate, archive, remove)
    as target states; ``remove`` deletes the item, an unknown action is refused."""
    chain = F.lit(None).cast("string")
    for action, state in fixed.MEMORY_ACTIONS.items():
        chain = F.when(F.col("action") == action, state).otherwise(chain)
    mapped = actions.withColumn("target", chain)
    return mapped.where("target IS NOT NULL"), mapped.where("target IS NULL AND action = 'remove'").select("repo", "item_id").distinct()
