"""Streaming jobs: ledger sync per session, lifecycles per entity, weekly trends."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from findlake.operators import ledger as L
from findlake.operators import lifecycle
from findlake.schemas import LEDGER
from findlake.session import materialize
from findlake.streaming.state import SNAPSHOT_EVERY, StateTable, prune

LEDGER_KEYS = ["repo", "entry_id"]


SESSIONS = "repo string, session string, at timestamp, ended boolean, batch long"
APPLIED = "repo string, session string, at timestamp, late boolean, batch long"


def ledger_batch(state: StateTable, report_path: str | None = None) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` handler over findings that carry ``session``, ``ts`` and ``session_end``.

    A session's findings may come in any number of batches. They wait, as files by batch, until a
    row with ``session_end`` closes the session (a row without a file does nothing else); absence
    can only resolve what a whole session leaves out. Closed sessions of a repository are applied in
    time order, one per round, none before an open older one; one that closes after a newer session
    was applied is recorded as late and not applied. Only the ledger of the repositories at hand is
    read, and only moved entries are written.
    """
    arrivals, sessions, applied = (f"{state.path}-{part}" for part in ("arrivals", "sessions", "applied"))

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = materialize(batch, "batch")
        rows.write.mode("overwrite").parquet(f"{arrivals}/batch={batch_id}")
        heads = rows.groupBy("repo", "session").agg(F.min("ts").alias("at"), F.bool_or(F.coalesce("session_end", F.lit(False))).alias("ended"))
        heads.write.mode("overwrite").parquet(f"{sessions}/batch={batch_id}")
        seen = spark.read.schema(SESSIONS).parquet(sessions).where(F.col("batch") <= batch_id)
        seen = seen.groupBy("repo", "session").agg(F.min("at").alias("at"), F.bool_or("ended").alias("ended"), F.min("batch").alias("since"))
        done = spark.createDataFrame([], APPLIED) if batch_id <= 0 else spark.read.schema(APPLIED).parquet(applied).where(F.col("batch") < batch_id)
        place = F.struct("at", "session")
        last = done.where("NOT late").groupBy("repo").agg(F.max(place).alias("last"))
        waiting = seen.join(done, ["repo", "session"], "left_anti").join(last, "repo", "left")
        waiting = materialize(waiting.select("repo", "session", "at", "ended", "since", F.coalesce(place < F.col("last"), F.lit(False)).alias("late")), "waiting")
        first_open = waiting.where("NOT ended AND NOT late").groupBy("repo").agg(F.min(place).alias("open"))
        ready = waiting.where("ended").join(first_open, "repo", "left").where(F.col("late") | F.col("open").isNull() | (place < F.col("open")))
        order = Window.partitionBy("repo", "late").orderBy("at", "session")
        ready = materialize(ready.select("repo", "session", "at", "late", F.row_number().over(order).alias("turn")), "sessions")
        due = ready.where("NOT late")
        since = waiting.agg(F.min("since")).first()[0]
        turns = due.agg(F.max("turn")).first()[0] or 0
        if since is not None:
            prune(spark, arrivals, since)
        if batch_id % SNAPSHOT_EVERY and not turns and ready.isEmpty():
            return
        start = current = state.before(spark, batch_id)
        if turns:
            start = current = materialize(start.join(due.select("repo").distinct(), "repo", "left_semi"), "ledger")
            held = spark.read.schema(f"{ddl(rows)}, batch long").parquet(arrivals)
            held = held.where((F.col("batch") >= since) & (F.col("batch") <= batch_id) & F.col("file").isNotNull()).drop("batch")
        for turn in range(1, turns + 1):
            now = due.where(F.col("turn") == turn)
            result = L.sync(held.join(now.select("repo", "session"), ["repo", "session"], "left_semi"), current, now)
            if report_path is not None:
                result.report.write.mode("overwrite").parquet(f"{report_path}/batch={batch_id}/turn={turn}")
            current = materialize(result.ledger, "ledger")
        moved = current.exceptAll(start) if turns else start.limit(0)
        others = state.before(spark, batch_id).join(due.select("repo").distinct(), "repo", "left_anti")
        state.write(spark, batch_id, moved, others.unionByName(current) if turns else start)
        ready.select("repo", "session", "at", "late").write.mode("overwrite").parquet(f"{applied}/batch={batch_id}")

    return handle


def ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def ledger_stream(findings: DataFrame, path: str, checkpoint: str, report_path: str | None = None) -> DataStreamWriter:
    """Keep the ledger at ``path`` in step with a stream of findings."""
    state = StateTable(path, LEDGER_KEYS, LEDGER)
    return findings.writeStream.foreachBatch(ledger_batch(state, report_path)).option("checkpointLocation", checkpoint)


def lifecycle_batch(
    state: StateTable, machine: tuple[Sequence[str], Mapping[str, Sequence[str]]], ord_col: str, target: str, rejected_path: str | None = None
) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` handler for requested moves; states continue where the last batch left them."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        keys = list(state.keys)
        rows = materialize(batch, "batch")
        if rows.isEmpty():
            state.write(spark, batch_id, state.before(spark, batch_id).limit(0), state.before(spark, batch_id))
            return
        current = state.before(spark, batch_id)
        folded = materialize(lifecycle.fold(rows, keys, ord_col, target, machine, current=current.select(*keys, "status")), "folded")
        if rejected_path is not None:
            folded.where("NOT accepted").write.mode("overwrite").parquet(f"{rejected_path}/batch={batch_id}")
        last = lifecycle.current_states(folded, keys, ord_col).withColumn("events", F.col("accepted") + F.col("rejected"))
        old = current.select(*keys, F.col("accepted").alias("old_accepted"), F.col("rejected").alias("old_rejected"))
        changed = last.join(old, keys, "left").select(
            *keys, "status", (F.col("accepted") + F.coalesce("old_accepted", F.lit(0))).alias("accepted"), (F.col("rejected") + F.coalesce("old_rejected", F.lit(0))).alias("rejected")
        )
        untouched = current.join(changed.select(*keys), keys, "left_anti")
        state.write(spark, batch_id, changed, untouched.unionByName(changed))

    return handle


def lifecycle_stream(
    requests: DataFrame,
    keys: Sequence[str],
    key_types: str,
    machine: tuple[Sequence[str], Mapping[str, Sequence[str]]],
    path: str,
    checkpoint: str,
    ord_col: str = "ord",
    target: str = "state",
    rejected_path: str | None = None,
) -> DataStreamWriter:
    """Ledger, memory and session lifecycles as a stream of requested moves."""
    state = StateTable(path, list(keys), f"{key_types}, status string, accepted long, rejected long")
    return requests.writeStream.foreachBatch(lifecycle_batch(state, machine, ord_col, target, rejected_path)).option("checkpointLocation", checkpoint)


WEEKS = "week_start timestamp, introduced long, resolved long"


def weekly_changes(changes: DataFrame, time: str = "ts", kind: Column | None = None, late: str = "1 day") -> DataFrame:
    """Introduced and resolved per week of event time. The watermark lets Spark forget a week that
    is ``late`` behind the newest row; until then every change of its counts is sent again."""
    what = F.col("change") if kind is None else kind
    return (
        changes.withWatermark(time, late)
        .groupBy(F.window(time, "7 days").alias("week"))
        .agg(F.count_if(what == "introduced").alias("introduced"), F.count_if(what == "resolved").alias("resolved"))
        .select(F.col("week.start").alias("week_start"), "introduced", "resolved")
    )


def weekly_stream(changes: DataFrame, path: str, checkpoint: str, late: str = "1 day") -> DataStreamWriter:
    """Keep the counts of every week, open ones too, at ``path``: each batch replaces the weeks it changed."""
    state = StateTable(path, ["week_start"], WEEKS)

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        moved = materialize(batch, "weeks")
        kept = state.before(spark, batch_id).join(moved.select("week_start"), "week_start", "left_anti")
        state.write(spark, batch_id, moved, kept.unionByName(moved))

    return weekly_changes(changes, late=late).writeStream.outputMode("update").foreachBatch(handle).option("checkpointLocation", checkpoint)
