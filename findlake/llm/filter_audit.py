"""How filters of documents act on each other: failing-id relations joined for every order.

One pass over the texts says which rows fail which filter; the rows that fail a filter are written
as that filter's own table. What a filter removes behind a set of earlier ones is its table with the
earlier tables taken away by a left-anti join on set and row number, so only failing rows are joined. An order's step depends on the earlier filters only as a set, so n
filters need n * 2**(n - 1) such counts for all n! orders.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from findlake.llm.scratch import drop, written

Fails = Callable[[Column], Column]
SPACE = "[\\x20\\x09-\\x0D]+"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def few_words(least: int) -> Fails:
    return lambda text: F.size(words(text)) < least


def repeated_words(least_percent: int) -> Fails:
    return lambda text: 100 * F.size(F.array_distinct(words(text))) < least_percent * F.size(words(text))


def many_capitals(most_percent: int) -> Fails:
    # deleting the capitals is one pass in the JVM; lengths count code points
    return lambda text: 100 * (F.length(text) - F.length(F.translate(text, CAPITALS, ""))) > most_percent * F.length(text)


def holds(pattern: str) -> Fails:
    return lambda text: text.rlike(pattern)


def failing(docs: DataFrame, labels: DataFrame, filters: dict[str, Fails], copies: str, part_col: str, id_col: str, text_col: str):
    """(rows of each part, table of failing rows by filter). ``copies`` names the filter that a text
    fails when a row of a smaller id has the same."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    rows = written(
        docs.select(
            F.monotonically_increasing_id().alias("row"),
            docs[id_col].alias("doc_id"),
            F.coalesce(docs[part_col].cast("string"), F.lit("")).alias("part"),
            F.unhex(F.sha2(text, 256)).alias("sha"),
            *(fails(text).alias(f"fails_{name}") for name, fails in filters.items()),
        ),
        "audit-rows",
    )
    parts = rows.groupBy("part").agg(F.count(F.lit(1)).alias("total"))
    # only texts that more than one row has; both sides are freshly exchanged, so a hot text is split
    twins = written(rows.groupBy("sha").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("sha", "first"), "audit-twins")
    marks = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    judged = rows.join(twins.hint("merge"), "sha", "left").withColumn(f"fails_{copies}", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)))
    names = [*filters, copies]
    judged = judged.where(reduce(Column.__or__, (F.col(f"fails_{n}") for n in names))).join(marks.hint("merge"), "doc_id", "left")
    judged = written(
        judged.select("row", "part", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"), *(f"fails_{n}" for n in names)), "audit-judged"
    )
    tables = {n: written(judged.where(f"fails_{n}").select("row", "part", "good", "toxic"), f"audit-failing-{n}") for n in names}
    parts = written(parts, "audit-parts")
    drop(rows, twins, judged)
    return parts, tables


def removals(tables: dict[str, DataFrame]) -> DataFrame:
    """``part, letter, earlier, removed, good_lost, toxic_lost``: what each filter removes behind every
    set of earlier ones (as bits of the names in order); sets that remove nothing have no row.

    What the earlier filters have taken is one relation of (set, row) from all failing-id tables, and
    one left-anti join with it leaves what a filter still finds: a row number occurs at most once for
    each set and filter, so no key is hot."""
    bit = {name: 1 << k for k, name in enumerate(sorted(tables))}

    def sets(chosen):
        return F.explode(F.array(*(F.lit(s) for s in range(1 << len(bit)) if chosen(s)))).alias("earlier")

    taken = [rows.select("row", sets(lambda s, name=name: s & bit[name])) for name, rows in tables.items()]
    found = [rows.select("*", F.lit(name).alias("letter"), sets(lambda s, name=name: not s & bit[name])) for name, rows in tables.items()]
    # explode hides from the statistics how large the sides are, so the join is named
    left = reduce(DataFrame.unionAll, found).join(reduce(DataFrame.unionAll, taken).hint("merge"), ["earlier", "row"], "left_anti")
    counts = left.groupBy("part", "letter", "earlier").agg(F.count(F.lit(1)).alias("removed"), F.sum("good").alias("good_lost"), F.sum("toxic").alias("toxic_lost"))
    return written(counts, "audit-removals")


def audit(
    docs: DataFrame, labels: DataFrame, filters: dict[str, Fails], copies: str, part_col: str = "lang", id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per part, order of the filters and step: ``part, filter_order, step, kept, removed,
    redundant, unique_fails, good_lost, toxic_lost, shapley``.

    ``filters`` says by a one-letter name when a text fails; ``copies`` is the name of one more, which
    a row fails whose text a row with a smaller id has, wherever that is. A null text is empty, a
    null part the empty string. A row without an id is never a copy and has no label; rows that
    repeat an id are each judged, and an id with several labels has the highest. Parts where nothing
    fails have zeros; an empty table gives an empty result. Other columns are not read.
    """
    parts, tables = failing(docs, labels, filters, copies, part_col, id_col, text_col)
    cells = removals(tables)
    drop(*tables.values())
    names = sorted(tables)
    steps = [
        {"filter_order": "".join(order), "step": k + 1, "letter": order[k], "earlier": sum(1 << names.index(n) for n in order[:k])}
        for order in permutations(names)
        for k in range(len(order))
    ]
    grid = parts.select("part", "total", F.inline(F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order:string,step:int,letter:string,earlier:int>>")))
    full = grid.join(cells, ["part", "letter", "earlier"], "left").na.fill(0, ["removed", "good_lost", "toxic_lost"])
    so_far = Window.partitionBy("part", "filter_order").orderBy("step")
    same = Window.partitionBy("part", "letter")
    alone = F.max(F.when(F.col("earlier") == 0, F.col("removed"))).over(same)
    last = F.max(F.when(F.bit_count("earlier") == len(names) - 1, F.col("removed"))).over(same)
    return full.select(
        "part",
        "filter_order",
        "step",
        (F.col("total") - F.sum("removed").over(so_far)).alias("kept"),
        "removed",
        (alone - F.col("removed")).alias("redundant"),
        last.alias("unique_fails"),
        "good_lost",
        "toxic_lost",
        F.sum("removed").over(same).alias("shapley"),
    )
