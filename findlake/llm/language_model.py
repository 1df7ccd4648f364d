"""Stupid-backoff scores of documents under a word bigram model of the whole corpus.

A word is scored ``c(previous word, word) / c(previous word)`` if the bigram occurs in another
document, and ``BACKOFF * c(word) / N`` otherwise; the first word of a document ``c(word) / N``.
The bigram's count leaves out the document's own occurrences, so that a text doesn't vouch for
itself. The sum of logarithms over the number of words is the document's score.

Everything is counted over all documents, in tables partitioned by hash:

1. word counts, summed within tasks before they are dealt to blocks;
2. each document's bigrams, exploded, are dealt to the block of their first word, where they meet
   its count and each other; those that no other document supports go on
3. to the block of their second word and meet its count there;
4. the logarithms are summed by document.

Rows travel packed. Words that make up more than ``1 / FREQUENT`` of the corpus, which are fewer
than ``FREQUENT`` whatever its size, would fill one block: their counts are known to every task,
and their bigrams are dealt by both words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findlake.llm.grams import U64, mix, words
from findlake.llm.packing import LOW, Batches, block_of, groups_of, pack, slices_of, thick, thin, unpack
from findlake.llm.scratch import drop, prepare, written

BACKOFF = 0.4
FREQUENT = 50_000
#: Logarithms are kept in millionths, so that sums don't depend on their order.
UNIT = 1_000_000
SLICE = 4 << 20
#: Different words that a task sums before it sends them.
HELD = 1_000_000

_COUNTS = pa.schema([("block", pa.int32()), ("words", pa.binary()), ("counts", pa.binary()), ("total", pa.int64())])
_PARTS = pa.schema(
    [("block", pa.int32()), ("kind", pa.string()), ("base", pa.int64()), ("docs", pa.int32()), ("first", pa.binary()), ("size", pa.binary()), ("second", pa.binary()), ("owner", pa.binary())]
)
_PARTS_SQL = "block int, kind string, base bigint, docs int, first binary, size binary, second binary, owner binary"


def _units(ratio: np.ndarray) -> np.ndarray:
    return np.rint(np.log(ratio) * UNIT).astype(np.int64)


def _summed(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(values)
    values, counts = values[order], counts[order]
    heads = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1]))) if len(values) else np.zeros(0, np.int64)
    return values[heads], np.add.reduceat(counts, heads) if len(heads) else counts


def _by_block(values: np.ndarray, number: int):
    """(block, range) of sorted 48-bit values."""
    blocks = block_of(values << U64(16), number)
    bounds = np.searchsorted(blocks, np.arange(number + 1))
    for k in np.flatnonzero(np.diff(bounds)).tolist():
        yield k, slice(bounds[k], bounds[k + 1])


def _lookup(table: np.ndarray, counts: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The count of each value, 0 where the sorted table hasn't got it."""
    if not len(table):
        return np.zeros(len(values), np.int64)
    at = np.searchsorted(table, values)
    at[at == len(table)] = 0
    return np.where(table[at] == values, counts[at], 0)


def word_counts(rows: DataFrame, number: int, parts: int) -> DataFrame:
    """``block, words, counts, total``: one row for each block, its words sorted."""

    def partial(source: Batches) -> Batches:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def sent():
            value, count = _summed(np.concatenate([v for v, _ in held]), np.concatenate([c for _, c in held]))
            held[:] = [(value, count)]
            return value, count

        def out(value, count):
            held.clear()
            return pa.RecordBatch.from_pylist(
                [{"block": k, "words": pack(value[at]), "counts": count[at].astype("<i8").tobytes(), "total": 0} for k, at in _by_block(value, number)], _COUNTS
            )

        waiting = 0
        for _, texts in slices_of(source, SLICE):
            found, n = np.unique(words(texts)[0] & LOW, return_counts=True)
            held.append((found, n))
            waiting += len(found)
            if waiting > 2 * HELD:
                value, count = sent()
                waiting = len(value)
                if waiting > HELD:
                    yield out(value, count)
                    waiting = 0
        if waiting:
            yield out(*sent())

    def whole(source: Batches) -> Batches:
        for rows in groups_of(source):
            value, count = _summed(np.concatenate([unpack(r["words"]) for r in rows]), np.concatenate([np.frombuffer(r["counts"], "<i8") for r in rows]))
            yield pa.RecordBatch.from_pylist([{"block": rows[0]["block"], "words": pack(value), "counts": count.astype("<i8").tobytes(), "total": int(count.sum())}], _COUNTS)

    schema = "block int, words binary, counts binary, total bigint"
    return rows.mapInArrow(partial, schema).repartition(parts, "block").sortWithinPartitions("block").mapInArrow(whole, schema)


def _frequent(counts: DataFrame, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Words of more than ``total / FREQUENT`` occurrences, and their counts."""

    def picked(source: Batches) -> Batches:
        for batch in source:
            for data, n in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                value, n = unpack(data), np.frombuffer(n, "<i8")
                often = n * FREQUENT > total
                yield pa.RecordBatch.from_arrays([pa.array(value[often].astype(np.int64)), pa.array(n[often])], ["word", "n"])

    found = sorted((r["word"], r["n"]) for r in counts.mapInArrow(picked, "word bigint, n bigint").collect())
    return np.array([w for w, _ in found], U64), np.array([n for _, n in found], np.int64)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_words, log_score`` (sum of natural logarithms, in
    millionths) and ``score`` (their mean in nats; null without a word).

    Words are runs outside ASCII white space, A-Z lower-cased. Null and empty texts have no word and
    a sum of 0. Repeated rows are documents of their own and vouch for each other. An empty table
    gives an empty result. ``docs`` must be read from a table, whose rows keep their order when a
    task is run again.
    """
    spark = prepare(docs.sparkSession)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    number = min(2 * parts, 1 << 16)
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    id_type = rows.limit(0).toArrow().schema.field("doc_id").type
    parts_arrow = _PARTS.append(pa.field("ids", pa.list_(id_type)))
    parts_sql = f"{_PARTS_SQL}, ids array<{kind}>"
    counts = written(word_counts(rows, number, parts), "words")
    total = counts.agg(F.sum("total")).first()[0] or 1
    common, common_n = _frequent(counts, total)
    nothing = dict.fromkeys(parts_arrow.names)

    def row(**values):
        return nothing | values

    def batch(out: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist(out, parts_arrow)

    class Gathered:
        """What a task has for documents of several slices: values to add, and words to ask about."""

        def __init__(self):
            self.values: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
            self.words: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def add(self, base: int, owner: np.ndarray, value: np.ndarray) -> None:
            if len(owner):
                self.values.setdefault(base, []).append((owner, value))

        def ask(self, base: int, owner: np.ndarray, word: np.ndarray) -> None:
            """Words to be scored by their own count: at once if common, else where their count is."""
            known = _lookup(common, common_n, word)
            have = known > 0
            self.add(base, owner[have], _units(BACKOFF * known[have] / total))
            if not have.all():
                self.words.setdefault(base, []).append((owner[~have], word[~have]))

        def rows(self) -> list[dict]:
            out = []
            for base, parts in self.values.items():
                who, at = np.unique(np.concatenate([o for o, _ in parts]), return_inverse=True)
                added = np.zeros(len(who), np.int64)
                np.add.at(added, at, np.concatenate([v for _, v in parts]))
                out.append(row(block=base % number, kind="sum", base=base, first=thin(added), owner=thin(who)))
            if self.words:
                bases = np.array(list(self.words), "<i8")
                owner = np.concatenate([o for parts in self.words.values() for o, _ in parts])
                word = np.concatenate([w for parts in self.words.values() for _, w in parts])
                of = np.repeat(np.arange(len(bases)), [sum(len(o) for o, _ in parts) for parts in self.words.values()])
                block = block_of(word << U64(16), number)
                order = np.argsort(block, kind="stable")
                bounds = np.searchsorted(block[order], np.arange(number + 1))
                for k in np.flatnonzero(np.diff(bounds)).tolist():
                    part = order[bounds[k] : bounds[k + 1]]
                    size = thin(np.bincount(of[part], minlength=len(bases)))
                    out.append(row(block=k, kind="ask", first=bases.tobytes(), size=size, second=pack(word[part]), owner=thin(owner[part])))
            return out

    def bigrams(source: Batches) -> Batches:
        base = TaskContext.get().partitionId() << 33
        for ids, texts in slices_of(source, SLICE):
            hashes, sizes = words(texts)
            word, n = hashes & LOW, len(ids)
            owner = np.repeat(np.arange(n), sizes)
            out = [row(block=base % number, kind="head", base=base, docs=n, size=sizes.astype("<u4").tobytes(), ids=ids)]
            heads = np.ones(len(word), bool)
            heads[1:] = owner[1:] != owner[:-1]
            gathered = Gathered()
            gathered.add(base, owner[heads], np.full(heads.sum(), -_units(np.array([BACKOFF]))[0]))
            gathered.ask(base, owner[heads], word[heads])
            out += gathered.rows()
            at = np.flatnonzero(~heads)
            first, second, owner = word[at - 1], word[at], owner[at]
            often = _lookup(common, common_n, first) > 0
            route = np.where(often, mix(first + mix(second)) & LOW, first)
            for mask, what in ((~often, "rare"), (often, "common")):
                f, s, o, r = first[mask], second[mask], owner[mask], route[mask]
                order = np.argsort(r, kind="stable")
                f, s, o, r = f[order], s[order], o[order], r[order]
                for k, part in _by_block(r, number):
                    if what == "rare":
                        head = np.flatnonzero(np.concatenate(([True], f[part][1:] != f[part][:-1])))
                        lead, size = pack(f[part][head]), thin(np.diff(np.append(head, len(f[part]))))
                    else:
                        lead, size = np.searchsorted(common, f[part]).astype("<u2").tobytes(), None
                    out.append(row(block=k, kind=what, base=base, docs=n, first=lead, size=size, second=pack(s[part]), owner=thin(o[part])))
            yield batch(out)
            base += n

    def supported(source: Batches) -> Batches:
        for group in groups_of(source):
            out = [r for r in group if r["kind"] in ("head", "sum", "ask")]
            table = next((r for r in group if r["kind"] == "words"), None)
            own = (unpack(table["first"]), np.frombuffer(table["second"], "<i8")) if table else (np.zeros(0, U64), np.zeros(0, np.int64))
            held = [r for r in group if r["kind"] in ("rare", "common")]
            firsts, counted = [], []
            for r in held:
                if r["kind"] == "rare":
                    lead, size = unpack(r["first"]), thick(r["size"])
                    firsts.append(np.repeat(lead, size))
                    counted.append(np.repeat(_lookup(*own, lead), size))
                else:
                    at = np.frombuffer(r["first"], "<u2")
                    firsts.append(common[at])
                    counted.append(common_n[at])
            if held:
                gathered = Gathered()
                seconds = [unpack(r["second"]) for r in held]
                who = [thick(r["owner"]) for r in held]
                pair = mix(np.concatenate(firsts) * U64(0x9E3779B97F4A7C15) + mix(np.concatenate(seconds) + U64(1)))
                document = mix(np.concatenate([np.full(len(w), r["base"], np.int64) + w for w, r in zip(who, held, strict=True)]).astype(U64))
                _, which, often = np.unique(pair, return_inverse=True, return_counts=True)
                _, mine, within = np.unique(pair + document, return_inverse=True, return_counts=True)
                others = often[which] - within[mine]
                done = 0
                for r, w, second, c in zip(held, who, seconds, counted, strict=True):
                    rest = others[done : done + len(w)]
                    done += len(w)
                    found = rest > 0
                    gathered.add(r["base"], w[found], _units(rest[found] / c[found]))
                    gathered.ask(r["base"], w[~found], second[~found])
                out += gathered.rows()
            if out:
                yield batch(out)

    def backed_off(source: Batches) -> Batches:
        for group in groups_of(source):
            out = [r for r in group if r["kind"] in ("head", "sum")]
            table = next((r for r in group if r["kind"] == "words"), None)
            gathered = Gathered()
            for r in group:
                if r["kind"] == "ask":
                    n = _lookup(unpack(table["first"]), np.frombuffer(table["second"], "<i8"), unpack(r["second"]))
                    value, owner, at = _units(BACKOFF * n / total), thick(r["owner"]), 0
                    for base, size in zip(np.frombuffer(r["first"], "<i8").tolist(), thick(r["size"]).tolist(), strict=True):
                        gathered.add(base, owner[at : at + size], value[at : at + size])
                        at += size
            out += gathered.rows()
            if out:
                yield batch(out)

    result = pa.schema([("doc_id", id_type), ("n_words", pa.int64()), ("log_score", pa.int64())])

    def documents(source: Batches) -> Batches:
        for group in groups_of(source):
            head = next(r for r in group if r["kind"] == "head")
            added = np.zeros(head["docs"], np.int64)
            for r in group:
                if r["kind"] == "sum":
                    added[thick(r["owner"])] += thick(r["first"])
            yield pa.RecordBatch.from_arrays([pa.array(head["ids"], id_type), pa.array(np.frombuffer(head["size"], "<u4").astype(np.int64)), pa.array(added)], schema=result)

    none = F.lit(None)
    tables = counts.select(
        "block", F.lit("words").alias("kind"), none.cast("bigint").alias("base"), none.cast("int").alias("docs"), F.col("words").alias("first"),
        none.cast("binary").alias("size"), F.col("counts").alias("second"), none.cast("binary").alias("owner"), none.cast(f"array<{kind}>").alias("ids"),
    )

    def dealt(rows: DataFrame, key: str) -> DataFrame:
        return rows.select(key, *[c for c in rows.columns if c != key]).repartition(parts, key).sortWithinPartitions(key)

    first = dealt(rows.mapInArrow(bigrams, parts_sql).unionByName(tables), "block").mapInArrow(supported, parts_sql)
    second = dealt(first.unionByName(tables), "block").mapInArrow(backed_off, parts_sql)
    scored = written(dealt(second, "base").mapInArrow(documents, f"doc_id {kind}, n_words bigint, log_score bigint"), "scores")
    drop(counts)
    return scored.withColumn("score", F.col("log_score") / F.lit(float(UNIT)) / F.when(F.col("n_words") > 0, F.col("n_words")))
