"""Approximate nearest neighbours by query-centred collision counting.

Every vector is projected on some random directions; an index block holds, for each direction, its vectors'
projections as one sorted array. A query opens in each array a window around its own projection and counts in
how many of them a vector falls. Windows grow with the search radius (virtual rehashing): only what they newly
cover is counted. A vector whose count reaches the collision threshold is verified by its exact distance. The
search of a block ends once k verified vectors lie within the radius, as a nearer one has had its chance to
collide, or when the radius covers what any vector of the block could still improve.

Blocks have bounded size and every vector is in one; each reports its k nearest, and the k nearest of those are
the result. Queries are taken in sets of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import lean, stage

#: Components of the vectors of one block, and of one set of queries, about.
BLOCK, QUERIES = 1 << 19, 1 << 18
#: Random directions; a window of the radius times WIDTH to each side; share of the directions a vector must collide in.
DIRECTIONS, WIDTH, THRESHOLD = 64, 1.0, 0.6
#: Vectors, with the smallest hashes, that give each query its first bound of the k-th distance.
SAMPLE = 1024
#: The radius starts at this share of that bound and grows by this factor up to the bound.
START, GROW = 0.6, 1.25
#: Added to windows, in units of the largest projection possible: equal vectors may be projected with other roundings.
SLACK = 1e-9

_INDEX = "dim int, block long, ids binary, xs binary, orders binary, sorted binary"
_FOUND = "query_id long, vec_id long, score double"


@lru_cache(maxsize=4)
def directions(dim: int, count: int = DIRECTIONS, seed: int = 11) -> np.ndarray:
    """Gaussian directions, the same in every task."""
    return np.random.default_rng([seed, dim]).standard_normal((dim, count))


def distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - q) ** 2).sum(axis=1))


@dataclass
class Arrays:
    """A block of vectors and its sorted projections: row j of ``order`` are vectors by their projection on direction j."""

    ids: np.ndarray
    x: np.ndarray
    order: np.ndarray
    sorted: np.ndarray

    @staticmethod
    def of(ids: np.ndarray, x: np.ndarray) -> Arrays:
        projected = (x @ directions(x.shape[1])).T
        order = np.argsort(projected, axis=1, kind="stable")
        return Arrays(ids, x, order.astype(np.int32), np.take_along_axis(projected, order, axis=1))


def search(block: Arrays, query_id: int, q: np.ndarray, k: int, bound: float) -> tuple[np.ndarray, np.ndarray]:
    """(rows, distances) of the k nearest of a block that were verified; ``bound``: k other vectors lie within it."""
    n, count = len(block.ids), block.order.shape[0]
    threshold = int(np.ceil(THRESHOLD * count))
    center = q @ directions(len(q))
    collisions = np.zeros(n, dtype=np.int32)
    low = np.array([np.searchsorted(s, c) for s, c in zip(block.sorted, center)])
    high = low.copy()
    tested = block.ids == query_id
    others = n - int(tested.sum())
    rows, gaps = np.empty(0, np.int64), np.empty(0)
    # No vector of the block is farther than this from the query in any direction.
    widest = max(float(np.abs(block.sorted[:, 0] - center).max()), float(np.abs(block.sorted[:, -1] - center).max())) if n else 0.0
    slack = SLACK * float(np.linalg.norm(q) * np.linalg.norm(directions(len(q)), axis=0).max())
    radius = START * bound if np.isfinite(bound) else widest / 64
    while len(rows) < others:
        reach = radius * WIDTH + slack
        for j in range(count):
            a = int(np.searchsorted(block.sorted[j], center[j] - reach, side="left"))
            b = int(np.searchsorted(block.sorted[j], center[j] + reach, side="right"))
            a, b = min(a, low[j]), max(b, high[j])
            for new in (block.order[j, a:low[j]], block.order[j, high[j]:b]):
                collisions[new] += 1  # a row stands once in an array
            low[j], high[j] = a, b
        fresh = np.flatnonzero((collisions >= threshold) & ~tested)
        if len(fresh):
            tested[fresh] = True
            rows, gaps = np.concatenate([rows, fresh]), np.concatenate([gaps, distances(q, block.x[fresh])])
        within = rows[gaps <= radius]
        if len(within) >= k and len(np.unique(block.ids[within])) >= k or radius >= bound or reach > widest:
            break
        radius = min(radius * GROW, bound)
    best = np.lexsort((block.ids[rows], gaps))
    return rows[best], gaps[best]


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _build(key: tuple, table: pa.Table) -> pa.Table:
    dim = key[0].as_py()
    ids = table.column("vec_id").to_numpy()
    block = Arrays.of(ids, _matrix(table.column("x").combine_chunks(), dim))
    packed = [block.ids.astype("<i8"), block.x.astype("<f8"), block.order.astype("<i4"), block.sorted.astype("<f8")]
    return pa.table(
        [pa.array([dim], pa.int32()), pa.array([key[1].as_py()], pa.int64()), *[pa.array([v.tobytes()], pa.binary()) for v in packed]],
        ["dim", "block", "ids", "xs", "orders", "sorted"],
    )


def _bounds(shared, k: int):
    """Each query with the distance within which k vectors of the sample lie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x = shared.value
        for batch in batches:
            bound = []
            for query_id, q in zip(batch.column("vec_id").to_pylist(), _matrix(batch.column("x"), x.shape[1])):
                # Each id once, as its nearest row: k different ids then lie within the bound.
                gaps = distances(q, x[ids != query_id])
                own, gap = ids[ids != query_id], np.sort(gaps)
                first = np.unique(own[np.argsort(gaps, kind="stable")], return_index=True)[1]
                gap = np.sort(gap[first])
                bound.append(float(gap[k - 1]) if len(gap) >= k else float("inf"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bound, pa.float64())], [*batch.schema.names, "bound"])

    return run


def _search(shared, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, queries, bounds = shared.value
        for batch in batches:
            for i in range(batch.num_rows):
                ids, xs, orders, arrays = (batch.column(c)[i].as_buffer() for c in ("ids", "xs", "orders", "sorted"))
                own = np.frombuffer(ids, dtype="<i8")
                block = Arrays(
                    own, np.frombuffer(xs, dtype="<f8").reshape(len(own), -1), np.frombuffer(orders, dtype="<i4").reshape(-1, len(own)),
                    np.frombuffer(arrays, dtype="<f8").reshape(-1, len(own)),
                )
                out = []
                for query_id, q, bound in zip(query_ids, queries, bounds):
                    rows, gaps = search(block, int(query_id), q, k, float(bound))
                    # Of rows that repeat an id the nearest counts.
                    first = np.sort(np.unique(block.ids[rows], return_index=True)[1])[:k]
                    out.append((np.full(len(first), query_id), block.ids[rows[first]], gaps[first]))
                a, b, c = (np.concatenate(v) for v in zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(c)], ["query_id", "vec_id", "score"])

    return lean(run)


def build_index(clean: DataFrame, dim: int) -> DataFrame:
    """Blocks of the vectors (vec_id, x) of one length, with their sorted projections; every vector is in one."""
    blocks = max(1, -(-clean.count() * dim // BLOCK))
    dealt = clean.withColumn("dim", F.lit(dim)).withColumn("block", F.pmod(F.xxhash64("vec_id", "x"), F.lit(blocks)))
    return stage(dealt.groupBy("dim", "block").applyInArrow(_build, _INDEX), "projections")


def nearest(
    vectors: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every id but the query's own, for ids divisible by ``every``.

    score is the Euclidean distance of the original vectors in doubles, ties go to the smaller id. Vectors that are
    null, empty, zero, or hold a null or non-finite component take no part, nor do rows without an id. Vectors of
    different lengths are not compared. Rows that repeat an id are one id, as near as the nearest of them to any of the
    query's. With few vectors all are verified. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    fine = F.forall(vector_col, lambda v: v.isNotNull() & (F.abs(v.cast("double")) < float("inf")))
    some = F.exists(vector_col, lambda v: v != 0)
    clean = stage(
        vectors.filter(F.col(id_col).isNotNull() & (F.size(vector_col) > 0) & fine & some)
        .select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x")).distinct(),
        "vectors",
    )
    out = spark.createDataFrame([], _FOUND)
    for dim in [r[0] for r in clean.select(F.size("x").alias("d")).distinct().collect()]:  # a model or two has made them
        own = clean.filter(F.size("x") == dim)
        asked = own.filter(F.col("vec_id") % every == 0)
        sets = -(-asked.count() * dim // QUERIES)
        if not sets:
            continue
        index = build_index(own, dim)
        sample = own.orderBy(F.xxhash64("vec_id", "x"), "vec_id").limit(SAMPLE).collect()
        shared = spark.sparkContext.broadcast((np.array([r["vec_id"] for r in sample]), np.array([r["x"] for r in sample])))
        asked = stage(
            asked.mapInArrow(_bounds(shared, k), "vec_id long, x array<double>, bound double")
            .withColumn("_set", F.pmod(F.xxhash64("vec_id", "x"), F.lit(sets))), "queries",
        )
        for s in range(sets):
            rows = asked.filter(F.col("_set") == s).collect()  # about QUERIES / dim vectors
            if rows:
                queries = spark.sparkContext.broadcast((
                    np.array([r["vec_id"] for r in rows]), np.array([r["x"] for r in rows]), np.array([r["bound"] for r in rows])
                ))
                out = out.unionByName(index.mapInArrow(_search(queries, k), _FOUND))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    once = out.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    return once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
