"""First-match lookups: "which of these rules covers this row" as equi joins.

Rows are reduced to their distinct shapes first (map-side combine, so a hot shape is one row),
each shape asks for a fixed, small number of lookup keys, and the best hit per shape goes back
to the rows. No rule is ever compared with every row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_match(
    rows: DataFrame,
    shape: Sequence[str],
    lookups: Column,
    rules: DataFrame,
    order: Sequence[str],
    payload: Sequence[str],
) -> DataFrame:
    """``rows`` plus ``payload`` of the first rule (by ``order``) whose ``(repo, lookup)`` the row
    asks for; null where none does. ``shape`` columns are not null and hold everything
    ``lookups`` (an array of strings) depends on."""
    best_rule = rules.groupBy("repo", "lookup").agg(F.min(F.struct(*order, *[p for p in payload if p not in order])).alias("__hit"))
    asked = rows.select(*shape, F.explode(lookups).alias("lookup"), *([] if "repo" in shape else ["repo"])).distinct()
    hits = asked.join(best_rule, ["repo", "lookup"]).groupBy(*shape).agg(F.min("__hit").alias("__hit"))
    joined = rows.join(hits, list(shape), "left")
    return joined.select(*rows.columns, *[F.col(f"__hit.{p}").alias(p) for p in payload])
