"""Near duplicates: exact Jaccard join of documents on word shingles, and its components.

The product of the document by shingle incidence matrix with its transpose, in blocks of columns,
without the parts that can't matter:

1. Incidences go to blocks by shingle, packed as arrays. A block counts each of its columns; a
   column with one document adds to no overlap. Only the others return to their documents.
2. A document in which fewer shingles are shared than ``3/4`` of its size can't reach the overlap
   that its size asks for, whatever the partner, and leaves.
3. Of the rest, in an order by column count, the first ``size - ceil(3/4 size) + 1`` shingles must
   hold a shared one of any partner. Blocks of these columns give the candidate pairs.
4. A candidate's overlap is counted over both documents' shingles and held against both sizes.

Large groups of copies are not multiplied out. Documents with the same size and the same shared
shingles have the same links to all others, so one of them stands for the rest, which follow it:
at once if they link among themselves, else if it links with anything. Of near copies, in each column the most central document is the
hub; a document is first compared with its best hub only, and the components of the links found so
are contracted. Only pairs of a column that lie in different components are compared after that, so
no link between components is lost. A group of near copies stays linear if its documents' best hubs
are of the group; if texts of other groups are more central in all its columns, its differing texts
are still paired, each with each, where a column of their prefixes and the sizes allow it.

A document is known by the number of its row. ``docs`` must be read from a table, whose rows keep
their order when a task is run again.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findlake.llm.components import components
from findlake.llm.grams import U64, distinct, ngrams, words
from findlake.llm.packing import LOW, Batches, block_of, groups_of, owners, pack, runs, slices_of, unpack
from findlake.llm.scratch import drop, prepare, written

WORDS = 5
#: Similarity of a link: NUMERATOR / DENOMINATOR.
NUMERATOR, DENOMINATOR = 3, 4
#: Text of a packed slice, bytes, and shingles of it that a block should get at least.
SLICE, PER_BLOCK = 4 << 20, 64


def shared_shingles(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``row, doc_id, n_shingles, shared``: of documents that pass the bound of step 2, their shared
    shingles by ascending column count; null for the others."""
    spark = prepare(docs.sparkSession)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    number = min(4 * parts, 1 << 16)
    size = max(SLICE, number * PER_BLOCK * 6)
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    arrow_kind = rows.limit(0).toArrow().schema.field("doc_id").type
    packed = f"block int, base bigint, docs int, runs binary, shingles binary, counts binary, ids array<{kind}>"
    names = ["block", "base", "docs", "runs", "shingles", "counts", "ids"]
    arrow = pa.schema(zip(names, (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(arrow_kind)), strict=True))

    def incidences(source: Batches) -> Batches:
        base = TaskContext.get().partitionId() << 33
        for ids, texts in slices_of(source, size):
            hashes, counts = words(texts)
            owner, _, value = ngrams(hashes, counts, WORDS, short=True)
            owner, value = distinct(owner, value)
            n = len(ids)
            block = block_of(value, number)
            order = np.argsort(block, kind="stable")
            bounds = np.searchsorted(block[order], np.arange(number + 1))
            owner_at, value_at = owner[order], value[order] & LOW
            out = [{"block": base % number, "base": base, "docs": n, "runs": np.bincount(owner, minlength=n).astype("<u4").tobytes(), "shingles": None, "counts": None, "ids": ids}]
            for k in np.flatnonzero(np.diff(bounds)).tolist():
                lo, hi = bounds[k], bounds[k + 1]
                out.append({"block": k, "base": base, "docs": n, "runs": runs(owner_at[lo:hi], n), "shingles": pack(value_at[lo:hi]), "counts": None, "ids": None})
            yield pa.RecordBatch.from_pylist(out, arrow)
            base += n

    def columns(source: Batches) -> Batches:
        for rows in groups_of(source):
            out = [r for r in rows if r["ids"] is not None]
            rows = [r for r in rows if r["ids"] is None]
            if rows:
                values = [unpack(r["shingles"]) for r in rows]
                _, which, often = np.unique(np.concatenate(values), return_inverse=True, return_counts=True)
                often = often[which]
                at = 0
                for r, value in zip(rows, values, strict=True):
                    count = often[at : at + len(value)]
                    at += len(value)
                    keep = count > 1
                    if keep.any():
                        owner = owners(r["runs"], r["docs"])[keep]
                        out.append(r | {"runs": runs(owner, r["docs"]), "shingles": pack(value[keep]), "counts": count[keep].astype("<u4").tobytes()})
            if out:
                yield pa.RecordBatch.from_pylist(out, arrow)

    result = pa.schema([("row", pa.int64()), ("doc_id", arrow_kind), ("n_shingles", pa.int64()), ("shared", pa.list_(pa.int64()))])

    def documents(source: Batches) -> Batches:
        for rows in groups_of(source):
            head = next(r for r in rows if r["ids"] is not None)
            rows = [r for r in rows if r["ids"] is None]
            n, base = head["docs"], head["base"]
            total = np.frombuffer(head["runs"], "<u4").astype(np.int64)
            shared: list[np.ndarray | None] = [None] * n
            if rows:
                owner = np.concatenate([owners(r["runs"], n) for r in rows])
                value = np.concatenate([unpack(r["shingles"]) | (U64(r["block"]) << U64(48)) for r in rows])
                often = np.concatenate([np.frombuffer(r["counts"], "<u4") for r in rows])
                held = np.bincount(owner, minlength=n)
                passed = (held > 0) & (DENOMINATOR * held >= NUMERATOR * total)
                keep = passed[owner]
                owner, value, often = owner[keep], value[keep], often[keep]
                order = np.lexsort((value, often, owner))
                owner, value = owner[order], value[order].view(np.int64)
                bounds = np.searchsorted(owner, np.arange(n + 1))
                for k in np.flatnonzero(passed).tolist():
                    shared[k] = value[bounds[k] : bounds[k + 1]]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(base, base + n)), pa.array(head["ids"], arrow_kind), pa.array(total), pa.array(shared, pa.list_(pa.int64()))], schema=result)

    by_block = rows.mapInArrow(incidences, packed).repartition(parts, "block").sortWithinPartitions("block")
    by_base = by_block.mapInArrow(columns, packed).select("base", *[n for n in names if n != "base"]).repartition(parts, "base").sortWithinPartitions("base")
    return by_base.mapInArrow(documents, f"row bigint, doc_id {kind}, n_shingles bigint, shared array<bigint>")


# --- copies ----------------------------------------------------------------------------------


def _copies(live: DataFrame) -> DataFrame:
    """``row, rep, mutual``: of documents with equal size and shared shingles all but the first, which
    is ``rep``; ``mutual``: whether these link with each other. Arrays are held to be equal when two
    64-bit hashes, forth and back, are: a finer measure than the shingles' own."""
    key = ["n_shingles", "held", "forth", "back"]
    keyed = live.select("row", "n_shingles", F.size("shared").alias("held"), F.xxhash64("shared").alias("forth"), F.xxhash64(F.reverse("shared")).alias("back"))
    classes = written(keyed.groupBy(*key).agg(F.min("row").alias("rep"), F.count(F.lit(1)).alias("rows")).where("rows > 1").drop("rows"), "classes")
    mutual = F.col("held") * (DENOMINATOR + NUMERATOR) >= 2 * NUMERATOR * F.col("n_shingles")
    copies = written(keyed.join(classes.hint("merge"), key).where("row <> rep").select("row", "rep", mutual.alias("mutual")), "copies")
    drop(classes)
    return copies


def _with_copies(roots: DataFrame, copies: DataFrame) -> DataFrame:
    """``node, root`` with the copies of the documents that have a root or link with their copies."""
    known = roots.select(F.col("node").alias("rep"), "root")
    led = copies.select("rep", "mutual").distinct().join(known.hint("merge"), "rep", "left")
    leaders = written(led.select("rep", F.coalesce("root", F.when(F.col("mutual"), F.col("rep"))).alias("root"), F.col("root").isNull().alias("new")).where("root is not null"), "leaders")
    followers = copies.join(leaders.hint("merge"), "rep").select(F.col("row").alias("node"), "root")
    out = written(roots.unionByName(leaders.where("new").select(F.col("rep").alias("node"), "root")).unionByName(followers), "roots")
    drop(leaders)
    return out


# --- candidates ------------------------------------------------------------------------------


def _prefix(sets: DataFrame) -> DataFrame:
    """``token, row, n, left``: the shingles of step 3; ``left``: how many of the document's
    shingles, this one too, are not before it."""
    ahead = F.col("n_shingles") - F.size("shared")  # shingles of one document come before all others
    length = F.size("shared") - F.ceil(F.col("n_shingles") * NUMERATOR / DENOMINATOR) + 1
    tokens = sets.select("row", F.col("n_shingles").alias("n"), F.size("shared").alias("held"), ahead.alias("ahead"), F.posexplode(F.slice("shared", F.lit(1), length.cast("int"))).alias("at", "token"))
    return tokens.select("token", "row", "n", "ahead", (F.col("held") - F.col("at")).alias("left"))


def _fits(n: str, m: str) -> F.Column:
    """Whether two sizes allow a link at all."""
    return (F.col(n) * DENOMINATOR >= F.col(m) * NUMERATOR) & (F.col(m) * DENOMINATOR >= F.col(n) * NUMERATOR)


def _links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``u, v`` whose overlap, counted over both documents' shingles, makes a link."""
    left = sets.select(F.col("row").alias("u"), F.col("n_shingles").alias("nu"), F.col("shared").alias("su"))
    right = sets.select(F.col("row").alias("v"), F.col("n_shingles").alias("nv"), F.col("shared").alias("sv"))
    both = pairs.join(left.hint("merge"), "u").join(right.hint("merge"), "v")
    overlap = F.size(F.array_intersect("su", "sv"))
    return both.where(overlap * (DENOMINATOR + NUMERATOR) >= NUMERATOR * (F.col("nu") + F.col("nv"))).select("u", "v")


def _hubs(postings: DataFrame) -> DataFrame:
    """``token, first, second``: of each column of two or more components, its most central
    document, and the most central one outside that document's component."""
    best = postings.groupBy("token", "root").agg(F.min(F.struct(F.col("ahead") / F.col("n"), "row", "n", "root")).alias("best"))
    first = best.groupBy("token").agg(F.min("best").alias("first"), F.count(F.lit(1)).alias("roots")).where("roots > 1")
    rest = best.join(first, "token").where(F.col("root") != F.col("first.root"))
    return rest.groupBy("token").agg(F.first("first").alias("first"), F.min("best").alias("second"))


def _with_hub(postings: DataFrame) -> DataFrame:
    """``u, v``: each document with its best hub in another component."""
    hubs = written(_hubs(postings), "hubs")
    other = F.when(F.col("first.root") != F.col("root"), F.col("first")).otherwise(F.col("second"))
    met = postings.join(hubs.hint("merge"), "token").withColumn("hub", other).withColumn("m", F.col("hub.n"))
    chosen = met.where(_fits("n", "m")).groupBy("row").agg(F.min("hub").alias("hub"))
    return chosen.select(F.least("row", "hub.row").alias("u"), F.greatest("row", "hub.row").alias("v")).distinct()


def _rooted(postings: DataFrame, links: DataFrame | None) -> DataFrame:
    if links is None:
        return postings.withColumn("root", F.col("row"))
    roots = components(links)
    return postings.join(roots.withColumnRenamed("node", "row").hint("merge"), "row", "left").withColumn("root", F.coalesce("root", "row"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hub_rounds: int = 1) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_shingles, component_id``.

    A document's set is its distinct shingles of five words, its whole word sequence if it has
    fewer; without words it is empty and linked with nothing. Two documents link when the common
    shingles are at least 3/4 of all of both. ``component_id`` is the smallest id reachable by links,
    its own included. Rows that repeat id and text are documents of their own that link; null ids
    are never a component's id unless nothing else is. An empty table gives an empty result.
    """
    sets = written(shared_shingles(docs, id_col, text_col), "shingles")
    live = sets.where("shared is not null")
    copies = _copies(live)
    live = written(live.join(copies.select("row").hint("merge"), "row", "left_anti"), "live")
    postings = written(_prefix(live), "prefix")
    done, links = None, None
    for _ in range(hub_rounds):
        pairs = written(_with_hub(_rooted(postings, links)), "pairs")
        found = written(_links(pairs, live), "links")
        done = pairs if done is None else done.unionByName(pairs)
        links = found if links is None else links.unionByName(found)
    rooted = _rooted(postings, links)
    mixed = written(rooted.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("token"), "mixed")
    open_ = written(rooted.join(mixed.hint("merge"), "token", "left_semi"), "open")
    a, b = open_.alias("a"), open_.alias("b")
    near = F.least("a.left", "b.left") * (DENOMINATOR + NUMERATOR) >= NUMERATOR * (F.col("a.n") + F.col("b.n"))
    met = a.join(b, (F.col("a.token") == F.col("b.token")) & (F.col("a.row") < F.col("b.row")) & (F.col("a.root") != F.col("b.root")) & _fits("a.n", "b.n") & near)
    pairs = written(met.select(F.col("a.row").alias("u"), F.col("b.row").alias("v")).distinct().join(done, ["u", "v"], "left_anti"), "pairs")
    links = links.unionByName(written(_links(pairs, live), "links"))
    linked = written(components(links), "linked")
    drop(postings, mixed, open_, live)
    roots = _with_copies(linked, copies)
    drop(linked, copies)
    named = roots.join(sets.select(F.col("row").alias("node"), "doc_id"), "node").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    grouped = roots.join(written(named, "named").hint("merge"), "root").select(F.col("node").alias("row"), "component_id")
    return sets.select("row", "doc_id", "n_shingles").join(grouped, "row", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
