"""Nearest neighbours by cosine: a block matrix join on int8 vectors, with bounds that keep it exact.

A unit vector is rounded to ``s * q`` with integers ``q`` of 8 bits; the length of what the
rounding loses is known. So the product of two int8 tiles gives every cosine up to
``e_x + |s q_x| * e_y``. Pairs that may still be among the nearest of their query by these
bounds are computed again in double precision from the original vectors and go through a
heap per query. Nothing is lost, so the recall is 1.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from featshift.llm import tiles
from featshift.llm.tiles import Block, finite, integral, sweep

#: Room for the rounding of the bounds themselves.
SLACK = 1e-6
#: Components up to which sums of int8 products are exact in single precision.
SINGLE = (1 << 24) // 127**2
#: Pairs computed in double precision at once.
EXACT_PAIRS = 1 << 15


def dots(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed from the first component to the last."""
    return np.cumsum(x * y, axis=1)[:, -1] if len(x) else np.zeros(0)


class Units:
    """Vectors of one dimension: doubles scaled by a power of two, lengths, int8 units and what these lose."""

    def __init__(self, at: np.ndarray, vectors: np.ndarray, ids: np.ndarray):
        order = np.argsort(ids[at], kind="stable")
        self.ids, vectors = ids[at][order], vectors[order]
        self.x = np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1))[1][:, None])
        self.length = np.sqrt(dots(self.x, self.x))
        unit = self.x / self.length[:, None]
        self.step = np.abs(unit).max(axis=1) / 127
        self.q = np.rint(unit / self.step[:, None]).astype(np.int8)
        rounded = self.q * self.step[:, None]
        self.lost, self.reach = np.linalg.norm(unit - rounded, axis=1), np.linalg.norm(rounded, axis=1)


def _units(block: Block) -> dict[int, Units]:
    ids = block.numbers("id")
    return {dim: Units(at, vectors, ids) for dim, (at, vectors) in block.parts.items()}


class Nearest:
    """A heap of the nearest seen so far for each query of a block."""

    def __init__(self, queries: dict[int, Units], k: int):
        self.queries, self.k = queries, k
        self.heaps: dict[int, list[tuple[float, int]]] = {int(q): [] for u in queries.values() for q in u.ids}

    def see(self, candidates: dict[int, Units]) -> None:
        for dim in self.queries.keys() & candidates.keys():
            x, y = self.queries[dim], candidates[dim]
            step = max(1, tiles.PAIRS // len(y.ids))
            for a in range(0, len(x.ids), step):
                self._tile(x, y, slice(a, a + step))

    def _tile(self, x: Units, y: Units, part: slice) -> None:
        kind = np.float32 if x.q.shape[1] <= SINGLE else np.float64
        near = (x.q[part].astype(kind) @ y.q.astype(kind).T) * x.step[part, None].astype(kind) * y.step.astype(kind)
        error = (x.lost[part, None] + x.reach[part, None] * y.lost + SLACK).astype(kind)
        own = x.ids[part, None] == y.ids
        low = np.where(own, -np.inf, near - error)
        least = np.array([h[0][0] if len(h) == self.k else -np.inf for h in (self.heaps[int(q)] for q in x.ids[part])])
        if len(y.ids) > self.k:
            least = np.maximum(least, np.partition(low, -self.k, axis=1)[:, -self.k])
        row, col = np.nonzero((near + error >= least[:, None] - SLACK) & ~own)
        score = np.empty(len(row))
        for a in range(0, len(row), EXACT_PAIRS):
            i, j = row[a : a + EXACT_PAIRS] + part.start, col[a : a + EXACT_PAIRS]
            score[a : a + EXACT_PAIRS] = dots(x.x[i], y.x[j]) / (x.length[i] * y.length[j])
        order = np.lexsort((y.ids[col], -score, row))
        row, col, score = row[order], col[order], score[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        for i, j, s in zip(row[place < self.k].tolist(), y.ids[col[place < self.k]].tolist(), score[place < self.k].tolist(), strict=True):
            heap = self.heaps[int(x.ids[part.start + i])]
            if len(heap) < self.k:
                heapq.heappush(heap, (s, -j))
            else:
                heapq.heappushpop(heap, (s, -j))

    def rows(self) -> pa.RecordBatch:
        found = [(q, -j, s) for q, heap in self.heaps.items() for s, j in heap]
        return pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.float64())], names=["query_id", "vec_id", "score"])


def nearest(rows: DataFrame, queries: Column, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` rows with the largest cosine for each query.

    ``queries`` is a condition on the column ``vec_id``, which holds whole numbers. Every
    other row of the same dimension is a candidate; ties go to the smaller id, and a query
    with fewer candidates gets all of them. Rows whose id or vector is null, or whose vector
    is empty, zero or holds a null or non-finite component, take no part. Rows that repeat an
    id are one vector; if they differ, the smallest vector stands for it.
    """
    able = rows.select(integral(rows, vec_id).alias("id"), F.col(vector).cast("array<double>").alias("vec"))
    able = able.filter("id is not null").filter(finite(F.col("vec")) & F.exists("vec", lambda x: x != 0))
    one = able.groupBy("id").agg(F.min("vec").alias("vec"))
    found = sweep(one.withColumnRenamed("id", vec_id).filter(queries).withColumnRenamed(vec_id, "id"), one, _units, lambda block: Nearest(block, k), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
