"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; every other document of the learning part, whether
labelled clean or not labelled at all, counts as unlabelled. A linear model in numpy minimises the
class-prior-corrected risk ``pi R+(P) + max(0, R-(U) - pi R-(P))``, whose second term is kept from
going negative, so that the model doesn't learn to call every unlabelled document clean.

Features are the presence of words and word beginnings, hashed to ``BUCKETS``. Which of them carry
weight is decided by how much more often all confirmed positives have them than all other learning
documents do, gathered by distributed sums; the model is then fitted on a bounded sample of
documents (arguments of ``train``), chosen by a hash of their ids, on their
``FEATURES`` most telling features. Only that sample's
feature numbers reach the driver, and only the model goes back to the executors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findlake.llm.grams import slices, stems
from findlake.llm.scratch import prepare

BUCKETS = 1 << 18
STEMS = (4, 5, 6)
FEATURES = 1024
MOST_POSITIVE, MOST_UNLABELLED = 3_000, 6_000
#: Least standard score of a feature that the model may use.
TELLING = 3.0
STEPS, RATE, RIDGE = 300, 0.1, 1e-4


@dataclass
class Model:
    features: np.ndarray  # sorted buckets
    weights: np.ndarray
    bias: float

    def score(self, texts: list[str | None]) -> np.ndarray:
        raw = np.full(len(texts), self.bias)
        if len(self.features):
            for text, at in present(texts, self.features):
                np.add.at(raw, text, self.weights[at])
        return 1 / (1 + np.exp(-np.clip(raw, -50, 50)))


def present(texts: list[str | None], features: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, bucket) of the features each text holds, once each; with ``features`` only those, as
    positions in it."""
    for lo, hi in slices([len(t or "") for t in texts]):
        text, value = stems(texts[lo:hi], STEMS)
        value = (value % np.uint64(BUCKETS)).astype(np.int64)
        if features is not None:
            at = np.searchsorted(features, value)
            at[at == len(features)] = 0
            hit = features[at] == value
            text, value = text[hit], at[hit]
        pairs = np.unique(text * BUCKETS + value)
        yield pairs // BUCKETS + lo, pairs % BUCKETS


def fit(rows: list[np.ndarray], positive: np.ndarray, n_features: int, prior: float) -> tuple[np.ndarray, float]:
    """Weights and bias of least non-negative positive-unlabelled logistic risk, by Adam over all rows."""
    x = np.zeros((len(rows), n_features + 1), np.float32)
    x[:, n_features] = 1
    for i, at in enumerate(rows):
        x[i, at] = 1
    p, u = x[positive], x[~positive]
    w = np.zeros(n_features + 1, np.float32)
    w[-1] = np.log(prior / (1 - prior))
    first, second = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, STEPS + 1):
        sp, su = 1 / (1 + np.exp(-np.clip(p @ w, -30, 30))), 1 / (1 + np.exp(-np.clip(u @ w, -30, 30)))
        # of the logistic loss: log(1 + exp(-g)) has slope s - 1, log(1 + exp(g)) has slope s
        excess = np.logaddexp(0, u @ w).mean() - prior * np.logaddexp(0, p @ w).mean()
        toward = p.T @ (sp - 1) * (prior / len(p))
        away = u.T @ su / len(u) - p.T @ sp * (prior / len(p))
        slope = toward + away if excess >= 0 else -away
        slope[:-1] += RIDGE * w[:-1]
        first = 0.9 * first + 0.1 * slope
        second = 0.999 * second + 0.001 * slope**2
        w -= RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return w[:-1].astype(float), float(w[-1])


def learning_part(doc_id) -> F.Column:
    """Rows whose labels may be learnt from; the rest is held out."""
    return F.coalesce(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 != 1, F.lit(False))


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_positive: int = MOST_POSITIVE, most_unlabelled: int = MOST_UNLABELLED
) -> Model:
    """The model of ``docs`` (id, text) and ``labels`` (doc_id, toxic). Held-out rows take no part.
    Without a confirmed toxic or without another document the model is a constant.

    The fit is on at most ``most_positive`` and ``most_unlabelled`` documents; of rows that share an id
    one takes part. The class prior is the share of toxic ones among the labelled, applied to those
    without a label, and is kept from 0.01 to 0.5, where the risk is defined and steps stay finite.
    """
    spark = prepare(docs.sparkSession)
    marks = labels.where(learning_part(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text")).where(learning_part(F.col("doc_id")))
    ids = rows.select("doc_id").join(marks, "doc_id", "left")
    known = ids.agg(F.count(F.lit(1)), F.count("toxic"), F.sum((F.col("toxic") > 0).cast("int"))).first()
    total, labelled, toxic = known[0], known[1], known[2] or 0
    rate = toxic / labelled if labelled else 0.0
    if not toxic or toxic == total:
        return Model(np.zeros(0, np.int64), np.zeros(0), float(np.log((rate + 0.01) / (1.01 - rate))))
    # toxic documents hide among those without a label at the rate of those with one
    prior = min(max(rate * (total - labelled) / (total - toxic), 0.01), 0.5)

    def by_hash(kind, most):
        chosen = ids.where(kind).groupBy("doc_id").agg(F.xxhash64("doc_id").alias("place"))
        return chosen.orderBy("place", "doc_id").limit(most).select("doc_id")

    confirmed = F.coalesce(F.col("toxic") > 0, F.lit(False))
    sample = by_hash(confirmed, most_positive).withColumn("positive", F.lit(True))
    sample = sample.unionByName(by_hash(~confirmed, most_unlabelled).withColumn("positive", F.lit(False)))

    def counted(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, np.int64)
        for batch in source:
            for _, bucket in present(batch.column(0).to_pylist()):
                counts += np.bincount(bucket, minlength=BUCKETS)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], ["bucket", "n"])

    def summed(texts: DataFrame) -> DataFrame:
        return texts.select("text").mapInArrow(counted, "bucket bigint, n bigint")

    # every confirmed toxic document counts; the others are what is left of all
    marked = rows.join(marks.where("toxic > 0").select("doc_id").hint("merge"), "doc_id")
    stats = summed(marked).select("bucket", F.col("n").alias("p"), (-F.col("n")).alias("u"))
    stats = stats.unionByName(summed(rows).select("bucket", F.lit(0).cast("bigint").alias("p"), F.col("n").alias("u")))
    stats = stats.groupBy("bucket").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    shown, rest = toxic, total - toxic
    gap = F.col("p") / shown - F.col("u") / rest
    spread = F.sqrt((F.col("p") + 1) / shown / shown + (F.col("u") + 1) / rest / rest)
    telling = stats.select("bucket", (gap / spread).alias("z")).where(F.col("z") >= TELLING).orderBy(F.col("z").desc(), "bucket").limit(FEATURES)
    features = np.array(sorted(r["bucket"] for r in telling.collect()), np.int64)
    if not len(features):
        return Model(features, np.zeros(0), float(np.log(prior / (1 - prior))))

    def featured(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            texts = batch.column(0).to_pylist()
            held: list[list[int]] = [[] for _ in texts]
            for text, at in present(texts, features):
                for t, a in zip(text.tolist(), at.tolist(), strict=True):
                    held[t].append(a)
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.list_(pa.int32())), *batch.columns[1:]], ["held", "positive", "doc_id"])

    # at most most_positive + most_unlabelled ids are broadcast, and as many rows come back: an id may be repeated
    kind = ids.schema["doc_id"].dataType.simpleString()
    drawn = rows.join(F.broadcast(sample), "doc_id").select("text", "positive", "doc_id").mapInArrow(featured, f"held array<int>, positive boolean, doc_id {kind}")
    drawn = drawn.groupBy("doc_id", "positive").agg(F.min("held").alias("held")).orderBy("doc_id").collect()
    positive = np.array([r["positive"] for r in drawn], bool)
    if positive.all() or not positive.any():
        return Model(np.zeros(0, np.int64), np.zeros(0), float(np.log(prior / (1 - prior))))
    weights, bias = fit([np.array(r["held"], np.int64) for r in drawn], positive, len(features), prior)
    return Model(features, weights, bias)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` rows as ``doc_id, score``; the score of every whole text, null counting as empty.
    Only the text decides it. Repeated rows repeat their score; an empty table gives an empty result."""
    prepare(docs.sparkSession)
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def scored(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(batch.column(1).to_pylist()))], ["doc_id", "score"])

    return rows.mapInArrow(scored, f"doc_id {kind}, score double")


def clean(docs: DataFrame, model: Model, limit: float, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose score is below ``limit``."""
    prepare(docs.sparkSession)
    at = docs.columns.index(text_col)

    def kept(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            yield batch.filter(pa.array(model.score(batch.column(at).to_pylist()) < limit))

    return docs.mapInArrow(kept, docs.schema)
