"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Every benchmark item is cut into seeds of ``SEED_WORDS`` words. All of them, frequent ones too, are
looked up in every document; the hits of an item that lie near each other are gathered, and the
item's words aligned with the document's words there, unless too few of them stand there at all.
The alignment allows for changed, added and missing words; its score over that of a perfect copy is
the similarity.

Documents are never shuffled: the pass is one narrow stage, so a passage that a third of all
documents share costs each task its own share. The benchmark is the stated query set. It is taken
in blocks of at most about ``BLOCK_BYTES`` of text, each a pass of its own over all documents.
Words are runs of ASCII letters and digits and of other characters, A-Z lower-cased.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findlake.llm.grams import ngrams, slices, words
from findlake.llm.scratch import prepare

SEED_WORDS = 4
BLOCK_BYTES = 8 << 20
MATCH, MISMATCH, GAP = 2, -1, -1
#: Least similarity of a match.
SIMILAR = 0.5


class Seeds:
    """The seeds of a block of items, and where in which item they stand."""

    def __init__(self, ids: list, texts: list[str | None]):
        self.ids = ids
        self.words, counts = words(texts, plain=True)
        self.first = np.concatenate(([0], np.cumsum(counts)))
        item, place, value = ngrams(self.words, counts, SEED_WORDS)
        order = np.argsort(value, kind="stable")
        self.item, self.place, self.value = item[order], place[order], value[order]
        self.seeds = np.unique(self.value)

    def length(self, item: int) -> int:
        return int(self.first[item + 1] - self.first[item])

    def _hits(self, texts):
        body, counts = words(texts, plain=True)
        text, place, value = ngrams(body, counts, SEED_WORDS)
        at = np.searchsorted(self.seeds, value)
        at[at == len(self.seeds)] = 0
        hit = self.seeds[at] == value
        return text[hit], place[hit], at[hit], body, counts

    def matches(self, texts: list[str | None], least: float) -> list[tuple[int, int, float, int, int]]:
        """(text, item, similarity, first word, word after the last) of every alignment of at least
        ``least``; alignments of one item in one text don't share seeds."""
        out = []
        for lo, hi in slices([len(t or "") for t in texts]):
            text, place, at, body, counts = self._hits(texts[lo:hi])
            if not len(text):
                continue
            starts = np.concatenate(([0], np.cumsum(counts)))
            a, b = np.searchsorted(self.value, self.seeds[at]), np.searchsorted(self.value, self.seeds[at], side="right")
            each = np.repeat(np.arange(len(at)), b - a)
            of = np.arange(len(each)) - np.repeat(np.cumsum(b - a) - (b - a), b - a) + a[each]
            t, p, item = text[each], place[each], self.item[of]
            order = np.lexsort((p, item, t))
            t, p, item = t[order], p[order], item[order]
            sizes = np.diff(self.first)[item]
            new = np.ones(len(t), bool)
            new[1:] = (t[1:] != t[:-1]) | (item[1:] != item[:-1]) | (p[1:] - p[:-1] > 2 * sizes[1:])
            heads = np.flatnonzero(new)
            for h, e in zip(heads, np.append(heads[1:], len(t)), strict=True):
                k, i, n = int(t[h]), int(item[h]), int(sizes[h])
                low, high = max(0, int(p[h]) - 2 * n), min(int(counts[k]), int(p[e - 1]) + 2 * n + SEED_WORDS)
                window = body[starts[k] + low : starts[k] + high]
                own = self.words[self.first[i] : self.first[i + 1]]
                if np.isin(own, window).sum() < least * n:  # each word adds MATCH at most
                    continue
                score, end = align(own, window)
                if score >= least * MATCH * n:
                    back, size = align(own[::-1], window[:end][::-1])
                    out.append((lo + k, i, score / (MATCH * n), low + end - size, low + end))
        return out


def align(item: np.ndarray, body: np.ndarray) -> tuple[int, int]:
    """(score, end in ``body``) of the best local alignment. A row of the table for each word of the
    item; a run of gaps along the row is a running maximum."""
    ramp = np.arange(len(body) + 1, dtype=np.int64) * -GAP
    row = np.zeros(len(body) + 1, np.int64)
    best, end = 0, 0
    for word in item:
        step = np.maximum(row + GAP, 0)
        step[1:] = np.maximum(step[1:], row[:-1] + np.where(body == word, MATCH, MISMATCH))
        row = np.maximum.accumulate(step + ramp) - ramp
        top = int(row.argmax())
        if row[top] > best:
            best, end = int(row[top]), top
    return best, end


def blocks(docs: DataFrame, benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text") -> Iterator[Seeds]:
    """The benchmark block by block, for a search in ``docs``."""
    prepare(docs.sparkSession)
    items = benchmark.select(benchmark[item_col].alias("item_id"), benchmark[text_col].cast("string").alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    number = size // BLOCK_BYTES + 1
    for k in range(number):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(number)) == k).orderBy("item_id", "text").collect()
        seeds = Seeds([r["item_id"] for r in rows], [r["text"] for r in rows])
        if len(seeds.seeds):
            yield seeds


def matches(
    docs: DataFrame, benchmark: DataFrame, least: float = SIMILAR, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """``doc_id, item_id, similarity, first_word, end_word`` of every alignment of at least ``least``.

    Null and empty texts match nothing, nor do items of fewer than ``SEED_WORDS`` words. Repeated
    rows, of either table, repeat their matches. An empty table, either one, gives an empty result.
    """
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    item = benchmark.select(benchmark[item_col].alias("item_id"))
    kinds = rows.schema["doc_id"].dataType.simpleString(), item.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, similarity double, first_word int, end_word int"
    item_type = pa.array([], _arrow(item)).type

    def searched(seeds: Seeds):
        def search(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in source:
                found = seeds.matches(batch.column(1).to_pylist(), least)
                at = [f[0] for f in found]
                columns = [batch.column(0).take(pa.array(at, pa.int64())), pa.array([seeds.ids[f[1]] for f in found], item_type)]
                columns += [pa.array([f[2] for f in found], pa.float64()), pa.array([f[3] for f in found], pa.int32()), pa.array([f[4] for f in found], pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "similarity", "first_word", "end_word"])

        return rows.mapInArrow(search, schema)

    parts = [searched(seeds) for seeds in blocks(docs, benchmark, item_col, item_text_col)]
    return reduce(DataFrame.unionByName, parts) if parts else docs.sparkSession.createDataFrame([], schema)


def _arrow(df: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[0].dataType)


def clean(docs: DataFrame, benchmark: DataFrame, least: float = SIMILAR, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that hold no passage aligned with an item."""
    at = docs.columns.index(text_col)

    def without(docs: DataFrame, seeds: Seeds) -> DataFrame:
        def kept(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in source:
                found = {f[0] for f in seeds.matches(batch.column(at).to_pylist(), least)}
                yield batch.filter(pa.array([i not in found for i in range(batch.num_rows)], pa.bool_()))

        return docs.mapInArrow(kept, docs.schema)

    out = docs
    for seeds in list(blocks(docs, benchmark)):
        out = without(out, seeds)
    return out
