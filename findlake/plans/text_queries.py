"""Text, scan-scope and report-row queries."""

from pyspark.sql import functions as F

from findlake.functions import text as T
from findlake.operators import coverage
from findlake.plans.registry import query
from findlake.plans.tables import files, redact_sql, texts

TRIM_SQL = r"regexp_replace(text, '^\s+|\s+$', '', 'g')"


@query(
    "content_anchor",
    f"""SELECT doc_id, substr(sha256(substr({redact_sql(TRIM_SQL)}, 1, 200)), 1, 16) AS anchor FROM documents""",
)
def content_anchor(spark, sf_dir):
    from findlake.functions.identity import content_anchor as anchor

    return texts(spark, sf_dir, "documents", "doc_id").select("doc_id", anchor(T.excerpt(F.col("text"))).alias("anchor"))


def _scrub_sql(column: str) -> str:
    for quote in ('"', "''", "`"):
        column = f"regexp_replace({column}, '{quote}[A-Za-z0-9_\\-/+=.]{{24,}}{quote}', '{quote}[REDACTED]{quote}', 'g')"
    return column


@query(
    "redact_tokens",
    f"""
WITH texts AS (
  SELECT 'd' || doc_id AS id, text FROM documents
  UNION ALL SELECT 'c' || conv_id || '/' || turn, text FROM conversations
), hidden AS (SELECT id, text, {_scrub_sql(redact_sql('text'))} AS clean FROM texts)
SELECT id, substr(sha256(clean), 1, 16) AS clean_hash, clean <> text AS touched FROM hidden""",
)
def redact_tokens(spark, sf_dir):
    documents = texts(spark, sf_dir, "documents", "doc_id").select(F.concat(F.lit("d"), "doc_id").alias("id"), "text")
    turns = texts(spark, sf_dir, "conversations", "conv_id", "turn").select(F.concat(F.lit("c"), "conv_id", F.lit("/"), "turn").alias("id"), "text")
    clean = T.scrub_quoted(T.redact_known_tokens(F.col("text")))
    return documents.unionByName(turns).select(
        "id", F.substring(F.sha2(clean, 256), 1, 16).alias("clean_hash"), (clean != F.col("text")).alias("touched")
    )


@query(
    "generated_content",
    r"""
WITH texts AS (
  SELECT 'd' || doc_id AS id, text FROM documents UNION ALL SELECT 'p' || page_id, html FROM pages
), parts AS (SELECT id, text, string_split(text, chr(10)) AS ls FROM texts)
SELECT id,
       regexp_matches(array_to_string(ls[1:8], chr(10)), '(?i)@generated|DO NOT EDIT|auto-?generated|this file (?:was|is) generated')
       OR (length(text) >= 2000
           AND (list_max(list_transform(ls, lambda x: length(x))) > 1000 OR length(text) / len(ls) > 300)) AS generated
FROM parts""",
)
def generated_content(spark, sf_dir):
    documents = texts(spark, sf_dir, "documents", "doc_id").select(F.concat(F.lit("d"), "doc_id").alias("id"), "text")
    pages = texts(spark, sf_dir, "pages", "page_id").select(F.concat(F.lit("p"), "page_id").alias("id"), F.col("html").alias("text"))
    return documents.unionByName(pages).select("id", T.is_generated_content(F.col("text")).alias("generated"))


@query(
    "word_count_title",
    r"""
SELECT doc_id,
       CAST(CASE WHEN t = '' THEN 0 ELSE len(regexp_split_to_array(t, '\s+')) END AS INTEGER) AS words,
       CASE WHEN regexp_matches(text, '(?m)^#[ \t]+(.+)$') THEN trim(regexp_extract(text, '(?m)^#[ \t]+(.+)$', 1)) END AS title
FROM (SELECT doc_id, text, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM documents)""",
)
def word_count_title(spark, sf_dir):
    text = F.col("text")
    return texts(spark, sf_dir, "documents", "doc_id").select("doc_id", T.word_count(text).alias("words"), T.markdown_title(text).alias("title"))


@query(
    "skip_examples",
    """
WITH marked AS (
  SELECT source, doc_id, CASE WHEN n_chars > 4000 THEN 'too-large' WHEN n_chars < 40 THEN 'too-small' ELSE NULL END AS reason FROM documents
), ranked AS (SELECT *, row_number() OVER (PARTITION BY reason ORDER BY doc_id) AS rn, count(*) OVER (PARTITION BY reason) AS files
              FROM marked WHERE reason IS NOT NULL)
SELECT reason, any_value(files) AS files, string_agg(source || '/' || doc_id, ',' ORDER BY doc_id) AS examples
FROM ranked WHERE rn <= 5 GROUP BY reason""",
)
def skip_examples(spark, sf_dir):
    size = F.col("n_chars")
    skipped = files(spark, sf_dir).select("path", F.col("doc_id").alias("ord"), F.when(size > 4000, "too-large").when(size < 40, "too-small").alias("reason"))
    out = coverage.skips_by_reason(skipped.where("reason IS NOT NULL"), 5)
    return out.select("reason", "files", F.array_join("examples", ",").alias("examples"))
