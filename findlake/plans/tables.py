"""The shared parquet tables seen as findings, ledger entries, files, lines and edges.

Each Spark view has its SQL twin below it, so a plan and its reference query start from the
same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from findlake.functions import fixed
from findlake.functions.identity import content_anchor
from findlake.operators.ledger import sync
from findlake.schemas import LEDGER


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reviewed(spark: SparkSession, sf_dir: str, found: DataFrame) -> DataFrame:
    """Repositories of a review: those with findings, and clean ones."""
    clean = table(spark, sf_dir, "nation").select(F.concat(F.lit("clean-"), "n_nationkey").alias("repo"))
    return found.select("repo").distinct().unionByName(clean)


def texts(spark: SparkSession, sf_dir: str, name: str, *keys: str) -> DataFrame:
    """A text table; ``keys`` name its rows."""
    return table(spark, sf_dir, name)


def findings(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """Events as findings: a repository per ten users, a file per user, a rule per event type."""
    value = F.col("value")
    severity = (
        F.when(value >= 170, "critical").when(value >= 110, "high").when(value >= 70, "medium").when(value >= 35, "low").otherwise("informational")
    )
    rows = table(spark, sf_dir, "events") if events is None else events
    return rows.select(
        (F.col("user_id") % 10).cast("string").alias("repo"),
        F.concat(F.lit("u"), F.col("user_id")).alias("file"),
        F.when(F.col("event_type") != "view", F.col("event_type")).alias("rule_id"),
        F.col("event_type").alias("category"),
        severity.alias("severity"),
        (F.col("event_id") % 500 + 1).cast("int").alias("line"),
        content_anchor(F.col("props")).alias("anchor"),
        F.col("event_id").alias("ord"),
        F.concat(F.col("event_type"), F.lit(" in u"), F.col("user_id")).alias("title"),
        F.col("ts").cast("timestamp").alias("ts"),
    )


FINDINGS_SQL = """
findings AS (
  SELECT CAST(user_id % 10 AS VARCHAR) AS repo,
         'u' || user_id AS file,
         CASE WHEN event_type <> 'view' THEN event_type END AS rule_id,
         event_type AS category,
         CASE WHEN value >= 170 THEN 'critical' WHEN value >= 110 THEN 'high' WHEN value >= 70 THEN 'medium'
              WHEN value >= 35 THEN 'low' ELSE 'informational' END AS severity,
         CAST(event_id % 500 + 1 AS INTEGER) AS line,
         substr(sha256(props), 1, 16) AS anchor,
         event_id AS ord,
         event_type || ' in u' || user_id AS title,
         ts
  FROM events
)"""

SPLIT = "2024-01-16 00:00:00"


def session_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(spark, sf_dir).where(F.col("ts") < F.lit(SPLIT).cast("timestamp"))


def session_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(spark, sf_dir).where(F.col("ts") >= F.lit(SPLIT).cast("timestamp"))


SESSIONS_SQL = f"""{FINDINGS_SQL},
s1 AS (SELECT * FROM findings WHERE ts < TIMESTAMP '{SPLIT}'),
s2 AS (SELECT * FROM findings WHERE ts >= TIMESTAMP '{SPLIT}'),
s3 AS (SELECT * FROM s2 WHERE severity IN ('critical', 'high'))"""


def empty_ledger(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], LEDGER)


def _moved(entry_ord: Column) -> Column:
    return F.when(entry_ord % 7 == 0, "resolved").when(entry_ord % 11 == 0, "dismissed").when(entry_ord % 5 == 0, "acknowledged")


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session one synced into an empty ledger, then moved by hand according to ``entry_ord``."""
    first = session_one(spark, sf_dir)
    synced = sync(first, empty_ledger(spark), "s1", F.lit("2024-01-01").cast("timestamp")).ledger
    seen = first.select("repo", F.col("ord").alias("entry_ord"), F.col("ts").alias("opened"))
    moved = _moved(F.col("entry_ord"))
    opened = F.struct(
        F.col("opened").alias("timestamp"),
        F.lit(None).cast("string").alias("previous_state"),
        F.lit("open").alias("new_state"),
        F.lit("review:s1").alias("origin"),
        F.lit(None).cast("string").alias("comment"),
    )
    later = (F.col("opened") + F.make_dt_interval(days=(F.col("entry_ord") % 20 + 1).cast("int"))).cast("timestamp")
    by_hand = F.struct(
        later.alias("timestamp"),
        F.lit("open").alias("previous_state"),
        moved.alias("new_state"),
        F.lit("manual").alias("origin"),
        F.lit(None).cast("string").alias("comment"),
    )
    history = F.when(moved.isNull(), F.array(opened)).otherwise(F.array(opened, by_hand))
    joined = synced.join(seen, ["repo", "entry_ord"])
    return joined.withColumn("history", history).withColumn("status", F.coalesce(moved, F.lit("open"))).select(*synced.columns)


LEDGER_SQL = f"""{SESSIONS_SQL},
ledger AS (
  SELECT repo, file, identity, rule_id, category, entry_ord, anchor, severity, line, title, opened,
         substr(sha256(repo || '|' || file || '|' || identity || '|s1'), 1, 32) AS entry_id,
         CASE WHEN entry_ord % 7 = 0 THEN 'resolved' WHEN entry_ord % 11 = 0 THEN 'dismissed'
              WHEN entry_ord % 5 = 0 THEN 'acknowledged' ELSE 'open' END AS status,
         CASE WHEN entry_ord % 7 = 0 OR entry_ord % 11 = 0 OR entry_ord % 5 = 0
              THEN opened + to_days(CAST(entry_ord % 20 + 1 AS INTEGER)) END AS moved_at
  FROM (
    SELECT repo, file, coalesce('r:' || rule_id, 'c:' || category) AS identity,
           min(rule_id) AS rule_id, min(category) AS category, min(ord) AS entry_ord, min(ts) AS opened,
           arg_max(anchor, ord) AS anchor, arg_max(severity, ord) AS severity,
           arg_max(line, ord) AS line, arg_max(title, ord) AS title
    FROM s1 GROUP BY 1, 2, 3
  )
)"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: one repository per source."""
    return texts(spark, sf_dir, "documents", "doc_id").select(
        F.col("source").alias("repo"),
        F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"),
        "doc_id",
        "lang",
        "n_chars",
        F.col("text").alias("content"),
    )


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line, 1-based; exploded inside the row's task."""
    split = F.posexplode(F.split("content", "\n")).alias("pos", "text")
    return files(spark, sf_dir).select("repo", "path", "doc_id", "lang", split).select(
        "repo", "path", "doc_id", "lang", (F.col("pos") + 1).alias("line"), "text"
    )


LINES_SQL = """
lines AS (
  SELECT source AS repo, source || '/' || doc_id AS path, doc_id, lang,
         generate_subscripts(string_split(text, chr(10)), 1) AS line,
         unnest(string_split(text, chr(10))) AS text
  FROM documents
)"""


def trade_edges(spark: SparkSession, sf_dir: str, across: bool = False) -> DataFrame:
    """Module edges from trade: supplier nation to customer nation; trade that leaves its region
    counts as an edge of another kind unless ``across``."""
    nation = table(spark, sf_dir, "nation")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    lineitem = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    src = nation.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("src"), F.col("n_regionkey").alias("src_region"))
    dst = nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("dst"), F.col("n_regionkey").alias("dst_region"))
    trade = (
        lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy("s_nationkey", "c_nationkey")
        .agg(F.count(F.lit(1)).alias("lines"))
    )
    named = trade.join(src, "s_nationkey").join(dst, "c_nationkey").where("src <> dst")
    inside = named if across else named.where("src_region = dst_region")
    return inside.select(F.lit("trade").alias("repo"), "src", "dst", "lines")


def trade_edges_sql(across: bool = False) -> str:
    return f"""
edges AS (
  SELECT a.n_name AS src, b.n_name AS dst, count(*) AS lines
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation a ON s_nationkey = a.n_nationkey JOIN nation b ON c_nationkey = b.n_nationkey
  WHERE {'' if across else 'a.n_regionkey = b.n_regionkey AND '}a.n_name <> b.n_name
  GROUP BY 1, 2
)"""


KNOWN_TOKENS_SQL = fixed.KNOWN_TOKEN_PATTERNS


def redact_sql(column: str) -> str:
    for pattern in fixed.KNOWN_TOKEN_PATTERNS:
        column = f"regexp_replace({column}, '{pattern}', '[redacted]', 'g')"
    return column
