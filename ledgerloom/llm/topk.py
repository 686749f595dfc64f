"""Exact top-k search by inner product with a dual cover tree.

Queries and data are indexed by one tree. Its first level is a bounded set of centers, picked
farthest-first from a bounded sample; every vector joins its nearest center. Large cells are dealt
into blocks, and within a block the next levels cover it by balls of half the radius, again and
again, down to small leaves. Every node has a center and a covering radius, so no inner product of
a query node and a data node exceeds <q, p> + |q| r + |p| s + r s. Node pairs are dropped where
that is below the worst k-th score of the query node: whole cells first, then leaves, while the k-th scores
rise. The first k-th scores come from the sample itself, so cells can be dropped before any is read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import stage

#: Vectors, at most, that centers and first k-th scores come from: those with the smallest hash of the id.
SAMPLE = 4096
#: Vectors a cell is meant to hold, and centers at most; larger cells are dealt into blocks.
CELL, CENTERS = 2048, 1024
BLOCK = 4096
LEAF = 64
#: Scores beyond 64 bits count as the largest number of 64 bits, of their sign.
LARGEST_SCORE = (1 << 63) - 1


def cover(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, leaf sizes): rows leaf by leaf, each led by its center, by balls of halving radius."""
    order, sizes = [], []
    todo = [np.arange(len(x))]
    while todo:
        own = todo.pop()
        gap = np.sqrt(((x[own] - x[own[0]]) ** 2).sum(axis=1))
        radius = gap.max()
        if len(own) <= LEAF or radius == 0:
            order.append(own)
            sizes.append(len(own))
            continue
        left = own
        while len(left):
            near = np.sqrt(((x[left] - x[left[0]]) ** 2).sum(axis=1)) <= radius / 2
            if near.sum() == 1 and len(left) <= LEAF:
                near[:] = True  # scattered rest: one leaf
            ball = left[near]
            if len(ball) == len(own):
                order.append(ball)
                sizes.append(len(ball))
            else:
                todo.append(ball)
            left = left[~near]
    return np.concatenate(order), np.array(sizes, dtype=np.int64)


@dataclass
class Nodes:
    """Leaves of a packed block."""

    ids: np.ndarray
    x: np.ndarray
    starts: np.ndarray
    center: np.ndarray
    radius: np.ndarray

    @staticmethod
    def of(ids: np.ndarray, x: np.ndarray, sizes: np.ndarray) -> Nodes:
        starts = np.cumsum(sizes) - sizes
        center = x[starts]
        gap = np.sqrt(((x - np.repeat(center, sizes, axis=0)) ** 2).sum(axis=1))
        return Nodes(ids, x, starts, center, np.maximum.reduceat(gap, starts))


def bounds(q: np.ndarray, q_radius: np.ndarray, p: np.ndarray, p_radius: np.ndarray) -> np.ndarray:
    """Upper bound of the inner products of each query node with each data node, with room for rounding."""
    q_norm, p_norm = np.linalg.norm(q, axis=1), np.linalg.norm(p, axis=1)
    with np.errstate(over="ignore", invalid="ignore"):
        top = q @ p.T + q_norm[:, None] * p_radius + q_radius[:, None] * (p_norm + p_radius)
        room = (q_norm + q_radius)[:, None] * (p_norm + p_radius)
        return np.nan_to_num(top + 1 + 1e-9 * room, nan=np.inf, posinf=np.inf)


def _products(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Exact integer inner products; those beyond 64 bits become the largest number."""
    most = float(np.abs(q).max(initial=0)), float(np.abs(p).max(initial=0))
    if most[0] * most[1] * q.shape[1] < 2**53:
        return np.rint(q @ p.T).astype(np.int64)
    if most[0] * most[1] * q.shape[1] < 2**62 and max(most) < 2**62:
        return q.astype(np.int64) @ p.astype(np.int64).T
    wide = np.vectorize(int, otypes=[object])
    return np.clip(wide(q) @ wide(p).T, -LARGEST_SCORE, LARGEST_SCORE).astype(np.int64)


def _merge(best: list[tuple[int, int]], more: Iterator[tuple[int, int]], k: int) -> list[tuple[int, int]]:
    """First k of two sorted lists of (minus score, id), each id once."""
    out: list[tuple[int, int]] = []
    seen: set[int] = set()
    for pair in heapq.merge(best, more):
        if pair[1] not in seen:
            seen.add(pair[1])
            out.append(pair)
            if len(out) == k:
                break
    return out


def search(q: Nodes, floors: np.ndarray, p: Nodes, k: int) -> list[tuple[int, int, int]]:
    """(query id, id, score) of each query's best k in a block, unless below its floor."""
    out = []
    top = bounds(q.center, q.radius, p.center, p.radius)
    q_ends = np.append(q.starts[1:], len(q.ids))
    sizes = np.diff(np.append(p.starts, len(p.ids)))
    for node, (a, b) in enumerate(zip(q.starts, q_ends)):
        floor = floors[a:b].copy()
        waiting = np.argsort(-top[node], kind="stable")
        best: list[list[tuple[int, int]]] = [[] for _ in range(b - a)]
        while len(waiting):
            waiting = waiting[top[node, waiting] >= floor.min()]
            turn, waiting = waiting[:8], waiting[8:]
            if not len(turn):
                break
            rows = np.concatenate([np.arange(p.starts[i], p.starts[i] + sizes[i]) for i in turn])
            ids = p.ids[rows]
            score = _products(q.x[a:b], p.x[rows])
            reach = score >= floor[:, None]
            for i in np.flatnonzero(reach.any(axis=1)):
                at = np.flatnonzero(reach[i] & (ids != q.ids[a + i]))
                at = at[np.lexsort((ids[at], -score[i, at]))]
                best[i] = _merge(best[i], ((-int(score[i, j]), int(ids[j])) for j in at), k)
                if len(best[i]) == k:
                    floor[i] = max(floor[i], -best[i][-1][0])
        for i, found in enumerate(best):
            out += [(int(q.ids[a + i]), other, -minus) for minus, other in found]
    return out


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def farthest_first(x: np.ndarray, n: int) -> np.ndarray:
    """Rows of x, each the farthest from those before it."""
    chosen = [0]
    gap = ((x - x[0]) ** 2).sum(axis=1)
    while len(chosen) < n and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
    return x[chosen]


def _assign(shared):
    """Nearest center of every vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(1).value_lengths().to_numpy()
            for dim in np.unique(dims):
                rows = pa.array(np.flatnonzero(dims == dim))
                part = batch.take(rows)
                x = _matrix(part.column(1), int(dim)).astype(np.float64)
                center, _ = shared.value[int(dim)]
                gap = (center**2).sum(axis=1) - 2 * x @ center.T
                cell = gap.argmin(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(np.full(len(x), dim), pa.int64()), pa.array(cell, pa.int64()), part.column(1)],
                    ["vec_id", "dim", "cell", "x"],
                )

    return run


def _build(shared, k: int):
    """One row for the vectors of a block: ids and components in tree order, leaf sizes, center and radius.

    With ``shared`` the rows are queries, which also get a first k-th score from the sample.
    """

    def run(key: tuple, table: pa.Table) -> pa.Table:
        dim, cell, block = (v.as_py() for v in key)
        ids = table.column("vec_id").to_numpy()
        x = _matrix(table.column("x").combine_chunks(), dim).astype(np.float64)
        by_id = np.argsort(ids, kind="stable")
        ids, x = ids[by_id], x[by_id]
        order, sizes = cover(x)
        ids, x = ids[order], x[order]
        center = np.rint(x.mean(axis=0))
        radius = float(np.sqrt(((x - center) ** 2).sum(axis=1)).max())
        floors = np.empty(0)
        if shared is not None:
            _, (sample_ids, sample) = shared.value[dim]
            score = np.where(ids[:, None] == sample_ids[None], np.iinfo(np.int64).min, _products(x, sample))
            floors = np.full(len(x), np.iinfo(np.int64).min)
            if len(sample) > k:
                floors = np.partition(score, -k, axis=1)[:, -k]
        return pa.table({
            "dim": [dim], "cell": [cell], "block": [block], "radius": [radius],
            "center": pa.array([center.tolist()], pa.list_(pa.float64())),
            "ids": pa.array([ids.astype("<i8").tobytes()], pa.binary()),
            "xs": pa.array([x.astype("<f8").tobytes()], pa.binary()),
            "leaves": pa.array([sizes.astype("<i8").tobytes()], pa.binary()),
            "floors": pa.array([floors.astype("<i8").tobytes()], pa.binary()),
        })

    return run


_BLOCK_SCHEMA = (
    "dim long, cell long, block long, radius double, center array<double>, ids binary, xs binary, leaves binary, floors binary"
)


def _reach(cells: list):
    """Of each query block the cells that its queries may need."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                dim = batch.column("dim")[i].as_py()
                own = [c for c in cells if c["dim"] == dim]
                q = np.array([batch.column("center")[i].as_py()])
                worst = np.frombuffer(batch.column("floors")[i].as_py(), dtype="<i8").min()
                top = bounds(
                    q, np.array([batch.column("radius")[i].as_py()]), np.array([c["center"] for c in own]),
                    np.array([c["radius"] for c in own]),
                )[0]
                for j in np.flatnonzero(top >= worst):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([v]) for v in (dim, batch.column("cell")[i].as_py(), batch.column("block")[i].as_py(), own[j]["cell"])],
                        ["dim", "q_cell", "q_block", "cell"],
                    )

    return run


def _nodes(table: pa.Table, prefix: str, dim: int) -> Nodes:
    ids, xs, leaves = (table.column(prefix + c)[0].as_py() for c in ("ids", "xs", "leaves"))
    x = np.frombuffer(xs, dtype="<f8").reshape(-1, dim)
    return Nodes.of(np.frombuffer(ids, dtype="<i8"), x, np.frombuffer(leaves, dtype="<i8"))


def _search(k: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        dim = key[0].as_py()
        floors = np.frombuffer(table.column("q_floors")[0].as_py(), dtype="<i8")
        found = search(_nodes(table, "q_", dim), floors, _nodes(table, "", dim), k)
        columns = list(zip(*found)) or [(), (), ()]
        return pa.table({c: pa.array(v, pa.int64()) for c, v in zip(("query_id", "vec_id", "score"), columns)})

    return run


def _blocks(assigned: DataFrame, shared, k: int) -> DataFrame:
    """Packed blocks; the number of blocks of a cell follows its size."""
    cells = assigned.groupBy("dim", "cell").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    dealt = assigned.join(F.broadcast(cells), ["dim", "cell"]).withColumn(  # CENTERS rows a dimension
        "block", F.pmod(F.xxhash64("vec_id"), F.col("blocks"))
    )
    return stage(dealt.select("dim", "cell", "block", "vec_id", "x").groupBy("dim", "cell", "block").applyInArrow(_build(shared, k), _BLOCK_SCHEMA), "blocks")


def top_k(
    vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of every row but the query's own, for each id divisible by ``every``.

    Components x count as floor(scale * x); score is their integer inner product, ties go to the smaller id.
    Vectors that are null, empty, or hold a null or non-finite component (or one that ``scale`` takes beyond a
    double) take no part, nor do rows without an id. A score beyond 64 bits counts as the largest number of 64 bits. Vectors of different lengths are not compared. Rows that
    repeat an id are one id, with the best score of any of them. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    # Doubles of 2**53 and more are whole numbers, and may be too large for a long.
    def whole(v):
        scaled = v.cast("double") * scale
        return F.when(F.abs(scaled) < 2.0**53, F.floor(scaled).cast("double")).otherwise(scaled)

    value = F.transform(F.col(vector_col), whole)
    fine = F.forall(F.col(vector_col), lambda v: v.isNotNull() & (F.abs(v.cast("double") * scale) < float("inf")))
    clean = vectors.filter(F.col(id_col).isNotNull() & (F.size(vector_col) > 0) & fine).select(
        F.col(id_col).cast("long").alias("vec_id"), value.alias("x")
    )
    sample = clean.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()
    if not sample:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    wanted = int(np.clip(clean.count() // CELL, 8, CENTERS))
    known = {}
    for dim in [r[0] for r in clean.select(F.size("x").alias("d")).distinct().collect()]:
        own = [r for r in sample if len(r["x"]) == dim]
        x = np.array([r["x"] for r in own] or [[0] * dim], dtype=np.float64)
        ids = np.array([r["vec_id"] for r in own], dtype=np.int64)
        # A repeated id would count twice among first k-th scores.
        first = np.unique(ids, return_index=True)[1]
        known[dim] = (farthest_first(x, wanted), (ids[first], x[first] if len(own) else x[:0]))
    shared = spark.sparkContext.broadcast(known)  # SAMPLE vectors at most
    assigned = stage(clean.mapInArrow(_assign(shared), "vec_id long, dim long, cell long, x array<double>"), "cells")
    data = _blocks(assigned, None, k)
    asked = _blocks(assigned.filter(F.col("vec_id") % every == 0), shared, k)
    # Cells' centers and radii: the widest block decides; CENTERS rows a dimension.
    cells = [
        {"dim": r["dim"], "cell": r["cell"], "center": known[r["dim"]][0][r["cell"]].tolist(), "radius": r["radius"]}
        for r in data.select("dim", "cell", "center", "radius").mapInArrow(
            _cell_radius(shared), "dim long, cell long, radius double"
        ).groupBy("dim", "cell").agg(F.max("radius").alias("radius")).collect()
    ]
    pairs = asked.select("dim", "cell", "block", "center", "radius", "floors").mapInArrow(
        _reach(cells), "dim long, q_cell long, q_block long, cell long"
    )
    queries = asked.select("dim", *[F.col(c).alias(f"q_{c}") for c in ("cell", "block", "ids", "xs", "leaves", "floors")])
    met = pairs.join(queries, ["dim", "q_cell", "q_block"]).join(
        data.select("dim", "cell", "block", "ids", "xs", "leaves"), ["dim", "cell"]
    )
    found = met.groupBy("dim", "q_cell", "q_block", "cell", "block").applyInArrow(
        _search(k), "query_id long, vec_id long, score long"
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )


def _cell_radius(shared):
    """Radius around the cell's own center that covers a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            radius = [
                float(np.linalg.norm(np.array(center.as_py()) - shared.value[dim.as_py()][0][cell.as_py()]) + r.as_py())
                for dim, cell, center, r in zip(*(batch.column(c) for c in ("dim", "cell", "center", "radius")))
            ]
            yield pa.RecordBatch.from_arrays([batch.column("dim"), batch.column("cell"), pa.array(radius)], ["dim", "cell", "radius"])

    return run
