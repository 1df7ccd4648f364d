"""Rows that share an id or have none, words at the cuts of long texts, bounded samples."""

import time
import zlib

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from findlake.llm import grams, pii, toxicity


def written_docs(spark, rows, folder):
    spark.createDataFrame(rows, "doc_id long, text string, doc_id_place string").repartition(3).write.parquet(str(folder))
    return spark.read.parquet(str(folder))


def left(docs, stage, spark):
    out = stage(spark, docs, "")
    assert out.columns == docs.columns
    return sorted(((r.doc_id, r.text) for r in out.collect()), key=repr)


def test_copies_go_by_row_and_not_by_id(spark, tmp_path):
    a, b, c = (" ".join(f"{x}{k}" for k in range(30)) for x in "abc")
    rows = [(1, a, None), (None, a, None), (None, b, None), (5, a, None), (5, c, None)]
    want = [(1, a), (5, c), (None, b)]
    docs = written_docs(spark, rows, tmp_path / "one")
    for stage in (corpus_pipeline.drop_copies, corpus_pipeline.drop_near_copies):
        assert left(docs, stage, spark) == sorted(want, key=repr)


def test_repeated_rows_leave_one(spark, tmp_path):
    a, near = " ".join(f"a{k}" for k in range(60)), " ".join([*(f"a{k}" for k in range(59)), "z"])
    rows = [(3, a, "x")] * 4 + [(3, near, "y")] + [(None, near, None)] * 2 + [(2, None, None), (2, "", None), (None, "", None)]
    docs = written_docs(spark, rows, tmp_path / "two")
    assert left(docs, corpus_pipeline.drop_copies, spark) == sorted([(3, a), (3, near), (2, left_text(docs))], key=repr)
    found = left(docs, corpus_pipeline.drop_near_copies, spark)
    # one of the linked texts, under the least id; texts without words are linked with nothing
    assert len(found) == 4 and [i for i, t in found if t] == [3]
    empty = written_docs(spark, [], tmp_path / "none")
    assert left(empty, corpus_pipeline.drop_copies, spark) == [] == left(empty, corpus_pipeline.drop_near_copies, spark)


def left_text(docs):
    """Which of the two texts of document 2 is first by place."""
    rows = docs.where("doc_id = 2").select("text", F.xxhash64("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("at")).collect()
    return min(rows, key=lambda r: (r.f, r.at)).text


def test_a_word_at_the_cut_is_seen():
    _, alone = grams.stems(["marker"], (4, 5, 6))
    for before in range(grams._BLOCK - 8, grams._BLOCK + 2):
        _, found = grams.stems(["x" * 3 + " " + "y" * (before - 5) + " marker tail"], (4, 5, 6))
        assert np.isin(alone, found).all(), before


def ids(learn):
    return (i for i in range(10**6) if (zlib.crc32(str(i).encode()) % 3 != 1) == learn)


def test_a_repeated_id_is_one_row_of_the_fit(spark, monkeypatch):
    own = list(zip(range(60), ids(True)))
    docs = [(i, f"badword filler{k}" if k < 20 else f"fine filler{k}") for k, i in own]
    docs += [docs[30]] * 500
    labels = [(i, int(k < 20)) for k, i in own if k % 2 or k < 20]
    seen = []
    fit = toxicity.fit
    monkeypatch.setattr(toxicity, "fit", lambda rows, *rest: seen.append(len(rows)) or fit(rows, *rest))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    toxicity.train(frame, marks)
    toxicity.train(frame, marks, most_positive=5, most_unlabelled=7)
    assert seen == [60, 12]


def test_many_spans_take_linear_time():
    text = "write to jane at mail dot example dot org or +49 five five 5 12345678, 1[.]2[.]3[.]4 then " * 3000
    start = time.process_time()
    spans = pii.scan(text)
    assert len(spans) >= 3 * 3000 and time.process_time() - start < 20
