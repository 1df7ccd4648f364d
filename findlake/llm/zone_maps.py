"""Clustering about centroids over zone maps: blocks along a Hilbert curve with their boxes.

Vectors are sorted along a Hilbert curve over their components and cut into blocks; each block keeps
the least and greatest of every component and the sum of its vectors. In a round the distances from
a centroid to the nearest and farthest corner of a box bound those of all its vectors: a centroid
whose nearest corner is farther than another's farthest can win none of them. A block with one
candidate left adds its stored sum and isn't looked into; in the others all vectors are compared
with the candidates at once. All arithmetic is in integers, so the result doesn't depend on blocks.

The table is sorted and written once; a round reads it, sums by centroid inside each task, and hands
the driver one row per centroid.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findlake.llm.scratch import written

BLOCK = 256
BITS = 4
#: Integer components stay below this, so that squared distances of 64 of them fit in a long.
LIMIT = 1 << 27
#: Below this, products of 64 components are exact in doubles.
_EXACT = 1 << 22


def hilbert_keys(cells: np.ndarray, bits: int = BITS) -> list[bytes]:
    """Each row's place on the Hilbert curve through the grid of ``bits`` bits a dimension, as bytes
    in order (the transposed form of Skilling's transform, for all rows at once)."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(n):
            turned = (x[i] & q) != 0
            swap = np.where(turned, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(turned, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros(x.shape[1], np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        flip ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= flip
    planes = [(x >> b) & 1 for b in range(bits - 1, -1, -1)]
    return [row.tobytes() for row in np.packbits(np.concatenate(planes).T.astype(np.uint8), axis=1)]


def candidates(low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The centroids that may be nearest to some vector in the box."""
    nearest = np.maximum(np.maximum(low - centroids, centroids - high), 0)
    farthest = np.maximum(np.abs(centroids - low), np.abs(high - centroids))
    return np.flatnonzero((nearest**2).sum(1) <= (farthest**2).sum(1).min())


def compare(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest centroid, squared distance) of every vector; of equally near ones the first."""
    if max(np.abs(vectors).max(), np.abs(centroids).max()) < _EXACT:
        v, c = vectors.astype(np.float64), centroids.astype(np.float64)
        squares = (v * v).sum(1)[:, None] - 2 * (v @ c.T) + (c * c).sum(1)
        squares = squares.astype(np.int64)
    else:
        squares = np.stack([((vectors - c) ** 2).sum(1) for c in centroids], 1)
    at = squares.argmin(1)
    return at, squares[np.arange(len(at)), at]


def grid(vectors: DataFrame, width: int, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id, v``: whole components of the vectors that have ``width``, all of them finite."""
    v = vectors[vector_col]
    sound = (F.size(v) == width) & F.forall(v, lambda x: F.coalesce(F.abs(x.cast("double")) < LIMIT / scale, F.lit(False)))
    return vectors.where(F.coalesce(sound, F.lit(False))).select(vectors[id_col].alias("vec_id"), F.transform(v, lambda x: F.floor(x.cast("double") * scale)).alias("v"))


def blocks(rows: DataFrame, width: int) -> DataFrame:
    """Written blocks ``ids, body, low, high, total``. Equal vectors have equal keys, so ties are cut
    by place: a hot vector spreads over as many tasks as its copies need."""
    kind = rows.schema["vec_id"].dataType.simpleString()
    squared = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    known = rows.agg(F.avg(F.aggregate("v", F.lit(0.0), lambda s, x: s + x)), F.avg(squared)).first()
    middle = (known[0] or 0.0) / width
    reach = 3 * max((known[1] or 0.0) / width - middle**2, 1.0) ** 0.5
    steps = 1 << BITS

    def keyed(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            v = np.asarray(batch.column(1).flatten(), np.int64).reshape(-1, width)
            cells = np.clip((v - (middle - reach)) * (steps / (2 * reach)), 0, steps - 1).astype(np.int64)
            body = [row.tobytes() for row in v.astype("<i4")]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hilbert_keys(cells), pa.binary()), pa.array(body, pa.binary())], ["vec_id", "key", "body"])

    def cut(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            body = batch.column(1).to_pylist()
            out: dict[str, list] = {"ids": [], "body": [], "low": [], "high": [], "total": []}
            for i in range(0, len(body), BLOCK):
                v = np.frombuffer(b"".join(body[i : i + BLOCK]), "<i4").reshape(-1, width).astype(np.int64)
                out["ids"].append(batch.column(0).slice(i, BLOCK).to_pylist())
                out["body"].append(v.astype("<i4").tobytes())
                for name, value in (("low", v.min(0)), ("high", v.max(0)), ("total", v.sum(0))):
                    out[name].append(value.astype("<i8").tobytes())
            arrays = [pa.array(out["ids"], pa.list_(batch.schema.field(0).type)), *(pa.array(out[n], pa.binary()) for n in ("body", "low", "high", "total"))]
            yield pa.RecordBatch.from_arrays(arrays, list(out))

    ordered = rows.mapInArrow(keyed, f"vec_id {kind}, key binary, body binary").withColumn("place", F.monotonically_increasing_id())
    ordered = ordered.repartitionByRange("key", "place").sortWithinPartitions("key", "place").select("vec_id", "body")
    return written(ordered.mapInArrow(cut, f"ids array<{kind}>, body binary, low binary, high binary, total binary"), "zone-maps")


def _each(batch: pa.RecordBatch, centroids: np.ndarray):
    """(vectors, stored sum, candidates) of each block of a batch."""
    width = centroids.shape[1]
    for body, low, high, total in zip(*(batch.column(n).to_pylist() for n in ("body", "low", "high", "total")), strict=True):
        low, high, total = (np.frombuffer(x, "<i8") for x in (low, high, total))
        yield np.frombuffer(body, "<i4").reshape(-1, width).astype(np.int64), total, candidates(low, high, centroids)


def sums(maps: DataFrame, centroids: np.ndarray) -> list[tuple[int, int, list[int]]]:
    """(centroid, its vectors, their sum) of the centroids that have any."""
    k, width = centroids.shape

    def task(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(k, np.int64), np.zeros((k, width), np.int64)
        for batch in source:
            for v, whole, near in _each(batch, centroids):
                if len(near) == 1:
                    n[near[0]] += len(v)
                    total[near[0]] += whole
                    continue
                at = near[compare(v, centroids[near])[0]]
                for c in np.unique(at):
                    n[c] += (at == c).sum()
                    total[c] += v[at == c].sum(0)
        some = np.flatnonzero(n)
        arrays = [pa.array(some, pa.int32()), pa.array(n[some]), pa.array(total[some].tolist(), pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(arrays, ["cluster", "n", "total"])

    parts = maps.select("body", "low", "high", "total").mapInArrow(task, "cluster int, n bigint, total array<bigint>")
    whole = parts.select("cluster", "n", F.posexplode("total")).groupBy("cluster", "pos").agg(F.sum("n").alias("n"), F.sum("col").alias("total")).collect()
    found: dict[int, tuple[int, list[int]]] = {}
    for r in whole:  # one row for each centroid and component
        found.setdefault(r["cluster"], (r["n"], [0] * width))[1][r["pos"]] = r["total"]
    return [(c, n, total) for c, (n, total) in found.items()]


def assigned(maps: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``vec_id, cluster, distance`` of every vector."""
    kind = maps.schema["ids"].dataType.elementType.simpleString()

    def task(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            ids = batch.column("ids").to_pylist()
            for own, (v, _, near) in zip(ids, _each(batch, centroids), strict=True):
                at, distance = compare(v, centroids[near])
                arrays = [pa.array(own, batch.schema.field("ids").type.value_type), pa.array(near[at], pa.int32()), pa.array(distance)]
                yield pa.RecordBatch.from_arrays(arrays, ["vec_id", "cluster", "distance"])

    return maps.mapInArrow(task, f"vec_id {kind}, cluster int, distance bigint")


def cluster(
    vectors: DataFrame, k: int, rounds: int, width: int, scale: int = 1024, place: Column | None = None, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` per vector.

    A vector takes part if it has ``width`` components, none null or not finite; they become
    ``floor(scale * x)``. Vectors with one of ``LIMIT`` or more are left out like infinite ones, as
    their squared distances don't fit in a long. Centroids start as the ``k`` first vectors by
    ``place`` (by id if not given), repeated ids by their components, a null id last; with fewer vectors there are
    fewer. Rows that repeat an id are vectors of their own, equal vectors lie in one cluster, an empty
    table gives an empty result, other columns are not read.
    """
    rows = grid(vectors, width, scale, id_col, vector_col)
    place = F.col("vec_id") if place is None else place
    # the k first alone come to the driver
    start = rows.select(place.alias("place"), "v").orderBy(F.col("place").asc_nulls_last(), "v").limit(k).collect()
    kind = rows.schema["vec_id"].dataType.simpleString()
    if not start:
        return rows.selectExpr("vec_id", "0 AS cluster", "0L AS distance", "0L AS cluster_inertia", "0L AS inertia", "'' AS centroid_sha256").where("false")
    centroids = np.array([r["v"] for r in start], np.int64)
    maps = blocks(rows, width)
    for _ in range(rounds):
        moved = centroids.copy()
        for c, n, total in sums(maps, centroids):
            moved[c] = [t // n for t in total]
        if (moved == centroids).all():
            break  # every later round would do the same
        centroids = moved
    last = assigned(maps, centroids)
    costs = {r["cluster"]: r["cost"] for r in last.groupBy("cluster").agg(F.sum("distance").alias("cost")).collect()}
    shas = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]

    def finished(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cost = np.array([costs.get(c, 0) for c in range(len(shas))], np.int64)
        for batch in source:
            at = np.asarray(batch.column(1))
            arrays = [*batch.columns, pa.array(cost[at]), pa.array(np.full(len(at), cost.sum())), pa.array([shas[c] for c in at], pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    return last.mapInArrow(finished, f"vec_id {kind}, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
