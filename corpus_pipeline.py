"""From raw documents to token ids: reject, deduplicate, decontaminate, encode.

Every stage reads what its predecessor wrote; all but the last return the columns of ``documents``.
The stages that drop copies judge rows, not ids: a row is known by its file and its place there, so
rows that share an id, or have none, stay or go each for its own text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from findlake import configure
from findlake.llm import decontaminate, exact_dedup, jaccard, sentencepiece_bpe, toxicity
from findlake.llm.queries import TOXIC
from findlake.llm.scratch import drop, written

#: No SQL says these stages: learnt scores, alignments and token ids. Brute-force tests stand in.
ORACLE_SQL = None


def _place() -> Column:
    """A row's place in the table, the same however the files are split: docs must be read from files."""
    return F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))


def _rows(docs: DataFrame) -> DataFrame:
    """``doc_id, text``, where the id is the row's own: ordered by the document's id (null last), then by place."""
    return docs.select(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), _place().alias("place")).alias("doc_id"), "text")


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` without the rows in ``gone``, by their ids from ``_rows``; joined the same way at every size."""
    place = max(docs.columns, key=len) + "_place"  # longer than any column, so that none has the name
    gone = gone.select(F.col("doc_id.place").alias(place))
    return docs.select("*", _place().alias(place)).join(gone.hint("merge"), place, "left_anti").select(*docs.columns)


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.clean(docs, model, TOXIC)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _without(docs, exact_dedup.exact_dedup(_rows(docs)).where("not kept"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _without(docs, jaccard.near_duplicates(_rows(docs)).where("not (doc_id <=> component_id)"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    coded = sentencepiece_bpe.encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return coded.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", reject_toxic),
    ("exact_dedup", drop_copies),
    ("near_duplicates", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("sentencepiece", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; the tables between the stages are deleted once read."""
    configure(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
        if before is not None:
            drop(before)
        before = docs
    return docs
