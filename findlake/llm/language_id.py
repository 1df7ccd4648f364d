"""Language of a text by prediction by partial matching over bytes.

For every language the learning documents are counted into byte context trees of orders 0 to
``ORDER``. A byte's code length in a context is ``-log2(n / (N + d))``, with ``n`` its count there, ``N``
the context's and ``d`` the number of different bytes seen in it; a byte not seen there costs the
escape ``-log2(d / (N + d))`` and is coded in the next shorter context, in the end as one of 256. The
counts are frozen: a text's code length in a language is the sum over its bytes, and the language of
the shortest code wins.

Only counts of the longest grams are gathered, by sums inside tasks and one shuffle; the shorter
contexts are their margins. A language keeps the grams that make up at least one in ``SHARE`` of its
bytes, so at most ``SHARE`` of them whatever the corpus holds; the languages themselves are taken to be few.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findlake.llm.scratch import drop, prepare, written
from findlake.llm.toxicity import learning_part

ORDER = 3
SHARE = 250_000
UNKNOWN = "und"
_PIECE = 1 << 20
#: Counts a task holds before it hands them on.
_HELD = 1 << 21
_LETTER = re.compile(r"[^\W\d_]")
# ASCII letters in lower case, other ASCII as a space, other bytes as they are
_FOLD = bytes((c | 32 if chr(c).isalpha() else 32) if c < 128 else c for c in range(256))


def grams(text: str) -> Iterator[np.ndarray]:
    """The codes of every byte with the ``ORDER`` before it (zeros before the first), piece by piece."""
    body = text.encode("utf-8", "surrogatepass").translate(_FOLD)
    for i in range(0, len(body), _PIECE):
        before = body[max(0, i - ORDER) : i].rjust(ORDER, b"\0")
        x = np.frombuffer(before + body[i : i + _PIECE], np.uint8).astype(np.uint32)
        code = x[: len(x) - ORDER].copy()
        for k in range(1, ORDER + 1):
            code = (code << np.uint32(8)) | x[k : len(x) - ORDER + k]
        yield code


def _mask(order: int) -> np.uint32:
    return np.uint32((1 << 8 * (order + 1)) - 1)


@dataclass
class Level:
    """One order: grams and contexts in order of their codes, a column for each language."""

    grams: np.ndarray
    bits: np.ndarray
    contexts: np.ndarray
    escapes: np.ndarray


@dataclass
class Model:
    languages: list[str]
    levels: list[Level]

    def bits(self, codes: np.ndarray, order: int) -> np.ndarray:
        """(code, language) lengths of bytes coded from contexts of ``order``."""
        if order < 0:
            return np.full((len(codes), len(self.languages)), 8.0, np.float32)
        level = self.levels[order]
        codes = codes & _mask(order)
        at = np.minimum(np.searchsorted(level.grams, codes), len(level.grams) - 1)
        out = level.bits[at]
        miss = np.flatnonzero(level.grams[at] != codes)
        if len(miss):
            out[miss] = self.escape(codes[miss], order) + self.bits(codes[miss], order - 1)
        return out

    def escape(self, codes: np.ndarray, order: int) -> np.ndarray:
        """What a byte unseen in its context costs before the shorter one; an unseen context costs nothing."""
        level = self.levels[order]
        context = codes >> np.uint32(8)
        at = np.minimum(np.searchsorted(level.contexts, context), len(level.contexts) - 1)
        return np.where((level.contexts[at] == context)[:, None], level.escapes[at], np.float32(0))

    def lengths(self, text: str) -> np.ndarray:
        """Bits of the whole text in each language."""
        total = np.zeros(len(self.languages))
        for codes in grams(text):
            total += self.bits(codes, ORDER).sum(0, dtype=np.float64)
        return total

    def judge(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages or not _LETTER.search(text):
            return UNKNOWN, 0.0
        total = self.lengths(text)
        best = int(total.argmin())
        return self.languages[best], float(1 / np.exp2(np.maximum(total[best] - total, -1000)).sum())


def build(languages: list[str], language: np.ndarray, codes: np.ndarray, n: np.ndarray) -> Model:
    """The model of counts ``n`` of the longest grams ``codes`` in languages by number."""
    model = Model(languages, [])
    for order in range(ORDER + 1):
        short = codes & _mask(order)
        own = np.unique(short)
        count = np.zeros((len(own), len(languages)))
        np.add.at(count, (np.searchsorted(own, short), language), n)
        contexts, first = np.unique(own >> np.uint32(8), return_index=True)
        at = np.searchsorted(contexts, own >> np.uint32(8))
        sums, kinds = np.add.reduceat(count, first), np.add.reduceat((count > 0).astype(float), first)
        escapes = np.log2(np.maximum(sums + kinds, 1)) - np.log2(np.maximum(kinds, 1))
        seen = np.log2(np.maximum(sums + kinds, 1))[at] - np.log2(np.maximum(count, 1))
        bits = np.where(count > 0, seen, escapes[at] + model.bits(own, order - 1))
        model.levels.append(Level(own, bits.astype(np.float32), contexts, escapes.astype(np.float32)))
    return model


def _counted(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list[np.ndarray]] = {}
    sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    fresh = 0

    def settle() -> None:
        nonlocal fresh
        for lang, parts in held.items():
            code, n = np.unique(np.concatenate(parts), return_counts=True)
            if lang in sums:
                both, back = np.unique(np.concatenate((sums[lang][0], code)), return_inverse=True)
                code, n = both, np.bincount(back, np.concatenate((sums[lang][1], n))).astype(np.int64)
            sums[lang] = (code, n)
        held.clear()
        fresh = 0

    def rows() -> Iterator[pa.RecordBatch]:
        for lang, (code, n) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(code), pa.string()), pa.array(code.astype(np.int64)), pa.array(n)], ["lang", "code", "n"])
        sums.clear()

    for batch in source:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for codes in grams(text):
                held.setdefault(lang, []).append(codes)
                fresh += len(codes)
                if fresh >= 4 * _PIECE:
                    settle()
                    if sum(len(code) for code, _ in sums.values()) > _HELD:
                        yield from rows()
    settle()
    yield from rows()


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """The model of the whole texts of all rows that have a language and are not held out."""
    prepare(docs.sparkSession)
    lang, text = docs[lang_col].cast("string"), docs[text_col].cast("string")
    rows = docs.where(learning_part(docs[id_col]) & lang.isNotNull() & text.isNotNull()).select(lang.alias("lang"), text.alias("text"))
    counts = written(rows.mapInArrow(_counted, "lang string, code bigint, n bigint").groupBy("lang", "code").agg(F.sum("n").alias("n")), "gram-counts")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))  # one row a language
    kept = counts.join(F.broadcast(totals), "lang").where(F.col("n") * SHARE >= F.col("total")).select("lang", "code", "n").toArrow()
    drop(counts)
    if not kept.num_rows:
        return Model([], [])
    names = kept.column("lang").combine_chunks().dictionary_encode()
    languages = names.dictionary.to_pylist()
    order = np.argsort(np.array(languages, object))  # of equally short codes the first name wins
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    language = place[np.asarray(names.indices)]
    return build([languages[i] for i in order], language, np.asarray(kept.column("code")).astype(np.uint32), np.asarray(kept.column("n")).astype(float))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score`` per row, from the whole text alone.

    ``lang_pred`` is ``und``, with score 0, where the text is null or has no letter, or no language was
    learnt. The score is the language's share of the likelihoods of all languages. Repeated rows
    repeat their result; an empty table gives an empty result; other columns are not read.
    """
    prepare(docs.sparkSession)
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def judged(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            found = [model.judge(text) for text in batch.column(1).to_pylist()]
            arrays = [batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "lang_pred", "score"])

    return rows.mapInArrow(judged, f"doc_id {kind}, lang_pred string, score double")
