"""The registered queries of the training-data operators, with reference SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from findlake.llm import (
    decontaminate,
    exact_dedup,
    filter_audit,
    jaccard,
    language_id,
    language_model,
    pii,
    sentencepiece_bpe,
    sharding,
    toxicity,
    url_filter,
    web_archive,
    zone_maps,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def register(plan):
        QUERIES[name] = plan
        if sql:
            SQL[name] = sql
        return plan

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query("op1_pii")
def op1(spark, sf_dir):
    """``n_*`` count the plain spans, as ``base_sha256`` lists them; ``spans`` and ``n_disguised`` have the disguised ones too."""
    found = pii.find(_table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: ~s["disguised"])

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def counted(kind):
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *(counted(kind) for kind in pii.KINDS),
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: s["disguised"])).cast("long").alias("n_disguised"),
    )


@_query("op2_sharding")
def op2(spark, sf_dir):
    shards = sharding.stratified_shards(_table(spark, sf_dir, "documents"), shards=24)
    return shards.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "stratum", "rank", "position"
    )


@_query(
    "op4_exact_dedup",
    r"""
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = min(doc_id) OVER same AS kept, sha256(body) AS text_sha256
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents)
WINDOW same AS (PARTITION BY body)""",
)
def op4(spark, sf_dir):
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))


#: A document at or over this score is rejected.
TOXIC = 0.7


@_query("op3_toxicity")
def op3(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (~toxicity.learning_part(F.col("doc_id"))).alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"))


@_query(
    "op5_language_model",
    r"""
WITH listed AS (
  SELECT doc_id, string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') AS ws
  FROM documents
), w AS (SELECT * FROM (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM listed) WHERE word <> ''),
one AS (SELECT word, count(*) AS c FROM w GROUP BY word), tot AS (SELECT count(*) AS n FROM w),
p AS (SELECT doc_id, word, lag(word) OVER (PARTITION BY doc_id ORDER BY i) AS prev FROM w),
two AS (SELECT prev, word, count(*) AS c FROM p WHERE prev IS NOT NULL GROUP BY prev, word),
own AS (SELECT doc_id, prev, word, count(*) AS k FROM p WHERE prev IS NOT NULL GROUP BY doc_id, prev, word),
parts AS (
  SELECT doc_id, k * CASE WHEN two.c > k THEN round(ln((two.c - k) / a.c) * 1000000) ELSE round(ln(0.4 * b.c / n) * 1000000) END AS part
  FROM own JOIN two USING (prev, word) JOIN one a ON a.word = own.prev JOIN one b ON b.word = own.word, tot
  UNION ALL SELECT doc_id, round(ln(0.4 * one.c / n) * 1000000) - round(ln(0.4) * 1000000) FROM p JOIN one USING (word), tot WHERE prev IS NULL
), total AS (SELECT doc_id, sum(part) AS s FROM parts GROUP BY doc_id)
SELECT doc_id, coalesce(m, 0) AS n_words, CAST(coalesce(s, 0) AS BIGINT) AS log_score, CAST(s AS DOUBLE) / 1000000.0::DOUBLE / m AS score
FROM documents LEFT JOIN total USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS m FROM w GROUP BY doc_id) USING (doc_id)""",
)
def op5(spark, sf_dir):
    return language_model.score(_table(spark, sf_dir, "documents"))


@_query("op6_web_archive")
def op6(spark, sf_dir):
    rows = web_archive.archived(_table(spark, sf_dir, "pages"))
    return rows.select(
        F.col("page").cast("bigint").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("bigint").alias("refers_to"), "record_id"
    )


@_query("op7_jaccard")
def op7(spark, sf_dir):
    return jaccard.near_duplicates(_table(spark, sf_dir, "documents"))


URL_RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))


@_query("op8_url_filter")
def op8(spark, sf_dir):
    return url_filter.judge(_table(spark, sf_dir, "pages"), URL_RULES)


@_query("op9_decontamination")
def op9(spark, sf_dir):
    return decontaminate.matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@_query("op10_sentencepiece")
def op10(spark, sf_dir):
    coded = sentencepiece_bpe.encode_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@_query(
    "op11_filter_audit",
    r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents
), flagged AS (
  SELECT part, (len(ws) < 100)::INT AS a, (100 * len(list_distinct(ws)) < 80 * len(ws))::INT AS b,
    (100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t))::INT AS c, regexp_matches(t, '[#$%&*|]')::INT AS d,
    (doc_id > min(doc_id) OVER (PARTITION BY t))::INT AS e, coalesce(quality = 1, false)::INT AS good, coalesce(toxic = 1, false)::INT AS bad
  FROM d LEFT JOIN labels USING (doc_id)
), pattern AS (SELECT part, a + 2 * b + 4 * c + 8 * d + 16 * e AS fails, count(*) AS n, sum(good) AS good, sum(bad) AS bad FROM flagged GROUP BY ALL),
letters AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS l(letter, bit)),
orders AS (
  SELECT p.letter || q.letter || r.letter || s.letter || t.letter AS filter_order FROM letters p, letters q, letters r, letters s, letters t
  WHERE p.bit | q.bit | r.bit | s.bit | t.bit = 31
), steps AS (
  SELECT filter_order, step::INT AS step, (1 << (ascii(filter_order[step]) - 65))::INT AS bit,
    list_sum(list_transform(range(1, step), lambda k: 1 << (ascii(filter_order[k]) - 65)))::INT AS earlier
  FROM orders, range(1, 6) AS x(step)
), cells AS (
  SELECT part, filter_order, step, bit, sum(n) AS total,
    sum(n) FILTER (fails & (coalesce(earlier, 0) | bit) = 0) AS kept,
    sum(n) FILTER (fails & bit > 0 AND fails & coalesce(earlier, 0) = 0) AS removed,
    sum(n) FILTER (fails & bit > 0 AND fails & coalesce(earlier, 0) > 0) AS redundant,
    sum(n) FILTER (fails = bit) AS unique_fails,
    sum(good) FILTER (fails & bit > 0 AND fails & coalesce(earlier, 0) = 0) AS good_lost,
    sum(bad) FILTER (fails & bit > 0 AND fails & coalesce(earlier, 0) = 0) AS toxic_lost
  FROM pattern, steps GROUP BY part, filter_order, step, bit
)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
  coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
  coalesce(sum(removed) OVER (PARTITION BY part, bit), 0)::BIGINT AS shapley
FROM cells""",
)
def op11(spark, sf_dir):
    filters = {
        "A": filter_audit.few_words(100),
        "B": filter_audit.repeated_words(80),
        "C": filter_audit.many_capitals(10),
        "D": filter_audit.holds("[#$%&*|]"),
    }
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), filters, copies="E")


def _cluster_sql(k: int, rounds: int, width: int, seed: str) -> str:
    near = "list_sum(list_transform(list_zip(v, m), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    out = f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {width} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {width}
), c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) - 1 AS c, v AS m FROM kept ORDER BY sha256('{seed}:' || vec_id) LIMIT {k})"""
    for i in range(rounds + 1):
        out += f""", a{i} AS MATERIALIZED (
  SELECT row, vec_id, v, c, {near}::BIGINT AS d FROM kept, c{i} QUALIFY row_number() OVER (PARTITION BY row ORDER BY d, c) = 1
)"""
        if i < rounds:
            out += f""", s{i} AS (
  SELECT c, i, sum(x) AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, unnest(range({width})) AS i FROM a{i}) GROUP BY c, i
), c{i + 1} AS MATERIALIZED (
  SELECT c, coalesce(g.m, c{i}.m) AS m
  FROM c{i} LEFT JOIN (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS m FROM s{i} GROUP BY c) g USING (c)
)"""
    return out + f"""
SELECT vec_id, c::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(m, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} USING (c)"""


@_query("op12_zone_maps", _cluster_sql(8, 10, 64, "3"))
def op12(spark, sf_dir):
    place = F.sha2(F.concat(F.lit("3:"), F.col("vec_id").cast("string")), 256)
    return zone_maps.cluster(_table(spark, sf_dir, "embeddings"), k=8, rounds=10, width=64, scale=1024, place=place)


@_query("op13_language_id")
def op13(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    found = language_id.predict(docs, language_id.train(docs))
    return found.select("doc_id", (~toxicity.learning_part(F.col("doc_id"))).alias("held_out"), "lang_pred", "score")
