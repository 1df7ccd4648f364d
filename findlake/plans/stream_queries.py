"""Streaming jobs run to completion over the shared events; each returns what it left behind."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from findlake.operators import lifecycle
from findlake.plans.ledger_queries import LEGAL_SQL, STATE_SQL
from findlake.plans.registry import query
from findlake.plans.tables import FINDINGS_SQL, SESSIONS_SQL, SPLIT, findings, table
from findlake.schemas import LEDGER
from findlake.session import checkpoint_root
from findlake.streaming.jobs import LEDGER_KEYS, WEEKS, ledger_stream, lifecycle_stream, weekly_stream
from findlake.streaming.state import StateTable


def _events_stream(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def _workspace(spark, name):
    return f"{checkpoint_root(spark)}/findlake/streams/{name}-{uuid.uuid4().hex}"


def _batches(spark, query_handle):
    return (query_handle.lastProgress or {}).get("batchId", 0) + 1


@query(
    "stream_ledger_sync",
    f"""WITH {SESSIONS_SQL},
a AS (SELECT repo, file, coalesce('r:' || rule_id, 'c:' || category) AS identity, min(ord) AS entry_ord, arg_max(anchor, ord) AS anchor FROM s1 GROUP BY 1, 2, 3),
b AS (SELECT repo, file, coalesce('r:' || rule_id, 'c:' || category) AS identity, min(ord) AS entry_ord, arg_max(anchor, ord) AS anchor FROM s2 GROUP BY 1, 2, 3)
SELECT coalesce(a.repo, b.repo) AS repo, coalesce(a.file, b.file) AS file, coalesce(a.entry_ord, b.entry_ord) AS entry_ord,
  CASE WHEN b.repo IS NULL THEN 'resolved' ELSE 'open' END AS status, coalesce(b.anchor, a.anchor) AS anchor, CASE WHEN b.repo IS NULL THEN 2 ELSE 1 END AS events
FROM a FULL OUTER JOIN b ON a.repo = b.repo AND a.file = b.file AND a.identity = b.identity""",
)
def stream_ledger_sync(spark, sf_dir):
    """Four files with parts of every session of every repository, then one that closes them."""
    place = _workspace(spark, "ledger")
    rows = findings(spark, sf_dir).withColumn("session", F.when(F.col("ts") < F.lit(SPLIT).cast("timestamp"), "s1").otherwise("s2")).withColumn("session_end", F.lit(False))
    rows.repartitionByRange(4, F.xxhash64("ord")).write.parquet(f"{place}/in")
    ends = rows.groupBy("repo", "session").agg(F.max("ts").alias("ts")).withColumn("session_end", F.lit(True))
    blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema if f.name not in ends.columns]
    ends.select("*", *blank).select(*rows.columns).coalesce(1).write.mode("append").parquet(f"{place}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(f"{place}/in")
    running = ledger_stream(stream, f"{place}/state", f"{place}/checkpoint").trigger(availableNow=True).start()
    running.awaitTermination()
    state = StateTable(f"{place}/state", LEDGER_KEYS, LEDGER).before(spark, _batches(spark, running))
    return state.select("repo", "file", "entry_ord", "status", "anchor", F.size("history").alias("events"))


@query(
    "stream_lifecycle",
    f"""WITH RECURSIVE e AS (SELECT user_id AS entry, {STATE_SQL} AS state, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
legal(a, b) AS {LEGAL_SQL},
walk AS (
  SELECT entry, CAST(0 AS BIGINT) AS n, 'open' AS status, CAST(0 AS BIGINT) AS accepted FROM (SELECT DISTINCT entry FROM e)
  UNION ALL
  SELECT e.entry, e.n, CASE WHEN l.a IS NOT NULL THEN e.state ELSE w.status END, w.accepted + CAST(l.a IS NOT NULL AS BIGINT)
  FROM walk w JOIN e ON e.entry = w.entry AND e.n = w.n + 1 LEFT JOIN legal l ON l.a = w.status AND l.b = e.state)
SELECT entry, arg_max(status, n) AS status, max(accepted) AS accepted, max(n) - max(accepted) AS rejected FROM walk GROUP BY entry""",
)
def stream_lifecycle(spark, sf_dir):
    kind = F.col("event_type")
    state = F.when(kind == "signup", "open").when(kind == "view", "acknowledged").when(kind == "purchase", "resolved").when(kind == "click", "dismissed").otherwise("reopened")
    requests = _events_stream(spark, sf_dir).select(F.col("user_id").alias("entry"), F.col("event_id").alias("ord"), state.alias("state"))
    place = _workspace(spark, "lifecycle")
    running = lifecycle_stream(requests, ["entry"], "entry long", lifecycle.LEDGER, f"{place}/state", f"{place}/checkpoint").trigger(availableNow=True).start()
    running.awaitTermination()
    left = StateTable(f"{place}/state", ["entry"], "entry long, status string, accepted long, rejected long")
    return left.before(spark, _batches(spark, running)).select("entry", "status", "accepted", "rejected")


@query(
    "stream_weekly_trends",
    f"""WITH {FINDINGS_SQL},
w AS (SELECT CAST(floor(epoch_us(ts) / 604800000000) AS BIGINT) AS week, count(*) FILTER (category IN ('signup', 'error')) AS introduced, count(*) FILTER (category = 'purchase') AS resolved FROM findings GROUP BY 1)
SELECT strftime(make_timestamp(week * 604800000000), '%Y-%m-%d') AS week_start, introduced, resolved FROM w""",
)
def stream_weekly_trends(spark, sf_dir):
    events = findings(spark, sf_dir, _events_stream(spark, sf_dir))
    change = F.when(F.col("category").isin("signup", "error"), "introduced").when(F.col("category") == "purchase", "resolved")
    place = _workspace(spark, "weekly")
    running = weekly_stream(events.withColumn("change", change), f"{place}/weeks", f"{place}/checkpoint").trigger(availableNow=True).start()
    running.awaitTermination()
    out = StateTable(f"{place}/weeks", ["week_start"], WEEKS).before(spark, _batches(spark, running))
    return out.select(F.date_format("week_start", "yyyy-MM-dd").alias("week_start"), "introduced", "resolved")
