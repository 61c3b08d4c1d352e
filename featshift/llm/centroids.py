"""Centroid clustering on a vector approximation file.

Vectors are whole numbers per component. Every component is replaced by the number of a cell
of a few bits; the cells of a vector are kept apart from the vector itself. In each round a
table says, per component, cell and centroid, between which values the squared distance can
lie, up to a term that all centroids share. The sums of these give an interval per centroid;
where that of one centroid lies below all others it is the nearest. Whole vectors are fetched
only where intervals overlap or a vector changes its cluster, as sums are carried on by what
moved; the first sums and the final distances need each vector once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featshift.llm.shelves import bucket_count, shelve
from featshift.llm.tiles import finite, integral
from featshift.storage import materialize

#: Largest component, so that a squared distance fits a long.
LARGEST = 1 << 26
#: Vectors that cell bounds are taken from, those with the smallest hashes.
SAMPLE_ROWS = 4096
_OUT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


class Cells:
    """Cells of ``bits`` bits per component: half of the bounds from quantiles of a sample, half evenly spaced."""

    def __init__(self, sample: np.ndarray, low: np.ndarray, high: np.ndarray, bits: int):
        n = 1 << bits
        self.bits, self.low, self.high = bits, low, high
        # ``bounds[d, j]`` is the first value of cell j + 1; cells that are not used begin beyond all values.
        self.bounds = np.full((sample.shape[1], n - 1), 4 * LARGEST, dtype=np.int64)
        for d in range(sample.shape[1]):
            even = np.linspace(low[d], high[d] + 1, n // 2 + 1)[1:-1]
            found = np.unique(np.ceil(np.concatenate((np.quantile(sample[:, d], np.arange(1, n // 2 + 1) / (n // 2 + 1)), even))).astype(np.int64))
            self.bounds[d, : len(found)] = found

    def encode(self, x: np.ndarray) -> np.ndarray:
        """Packed cells of each row."""
        cells = np.stack([np.searchsorted(self.bounds[d], x[:, d], side="right") for d in range(x.shape[1])], axis=1)
        bits = (cells[:, :, None] >> np.arange(self.bits)) & 1
        return np.packbits(bits.reshape(len(x), -1).astype(np.uint8), axis=1)

    def decode(self, packed: np.ndarray) -> np.ndarray:
        dims = len(self.bounds)
        bits = np.unpackbits(packed, axis=1, count=dims * self.bits).reshape(len(packed), dims, self.bits)
        return (bits.astype(np.int16) << np.arange(self.bits, dtype=np.int16)).sum(axis=2)

    def tables(self, centers: np.ndarray) -> np.ndarray:
        """Least and most of (x - c)^2 - (x - m)^2 by component, cell and centroid, for the middle m of all centroids."""
        middle = centers.sum(axis=0) // len(centers)
        off = (centers - middle).T[:, None, :]
        first = np.concatenate((self.low[:, None], self.bounds), axis=1)
        last = np.concatenate((self.bounds - 1, self.high[:, None]), axis=1)
        first, last = np.maximum(first, self.low[:, None]), np.minimum(last, self.high[:, None])
        ends = [off * off - 2 * (v - middle[:, None])[:, :, None] * off for v in (first, last)]
        return np.stack((np.minimum(*ends), np.maximum(*ends)))


def possible(tables: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """Which centroids may be the nearest one of each row."""
    low = np.zeros((len(cells), tables.shape[3]), dtype=np.int64)
    high = low.copy()
    for d in range(cells.shape[1]):
        low += tables[0, d, cells[:, d]]
        high += tables[1, d, cells[:, d]]
    return low <= high.min(axis=1, keepdims=True)


def _matrix(column: pa.Array, kind: type) -> np.ndarray:
    """The rows of a binary column, all of one length."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(len(column), -1)


def _vectors(rows: DataFrame) -> DataFrame:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column("vec").flatten().to_numpy().astype(np.int32).reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([x.tobytes() for x in flat], pa.binary())], names=["id", "vec"])

    return rows.mapInArrow(task, "id long, vec binary")


def _ranges(vectors: DataFrame, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest value of each component."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("vec"), np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims)), pa.array(x.min(axis=0).astype(np.int64)), pa.array(x.max(axis=0).astype(np.int64))], names=["d", "low", "high"])

    rows = vectors.select("vec").mapInArrow(task, "d long, low long, high long").groupBy("d").agg(F.min("low").alias("low"), F.max("high").alias("high")).orderBy("d").collect()
    return np.array([r["low"] for r in rows]), np.array([r["high"] for r in rows])


def _encoded(vectors: DataFrame, cells: Cells) -> DataFrame:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                packed = cells.encode(_matrix(batch.column("vec"), np.int32))
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([c.tobytes() for c in packed], pa.binary()), pa.array(np.full(len(packed), -1, dtype=np.int32))], names=["id", "cells", "cluster"])

    return vectors.mapInArrow(task, "id long, cells binary, cluster int")


def _marked(state: DataFrame, cells: Cells, centers: np.ndarray, all_rows: bool) -> DataFrame:
    """Add the centroids that may be nearest, and whether the vector itself is needed."""
    tables = cells.tables(centers)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(a, 4096) for a in range(0, whole.num_rows, 4096)):
                able = possible(tables, cells.decode(_matrix(batch.column("cells"), np.uint8)))
                counts = able.sum(axis=1)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), pa.array(np.nonzero(able)[1].astype(np.int32)))
                need = all_rows | (counts > 1) | (able.argmax(axis=1) != batch.column("cluster").to_numpy())
                yield pa.RecordBatch.from_arrays([*batch.columns, lists, pa.array(need)], names=[*batch.schema.names, "possible", "need"])

    return state.mapInArrow(task, "id long, cells binary, cluster int, possible array<int>, need boolean")


def _decided(marked: DataFrame, vectors: DataFrame, centers: np.ndarray) -> DataFrame:
    """The nearest centroid and squared distance of rows that need their vector, and what they change in the sums.

    Rows without an id are sums: of a cluster over the vectors that came less those that left.
    """
    k, dims = centers.shape

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, members = np.zeros((k, dims), dtype=np.int64), np.zeros(k, dtype=np.int64)
        for whole in batches:
            for batch in (whole.slice(a, 4096) for a in range(0, whole.num_rows, 4096)):
                x = _matrix(batch.column("vec"), np.int32).astype(np.int64)
                lists = batch.column("possible")
                row = np.repeat(np.arange(len(x)), np.diff(lists.offsets.to_numpy()))
                among = lists.flatten().to_numpy()
                distance = ((x[row] - centers[among]) ** 2).sum(axis=1)
                order = np.lexsort((among, distance, row))
                first = order[np.concatenate(([True], row[order][1:] != row[order][:-1]))]
                new, old = among[first], batch.column("cluster").to_numpy()
                moved = np.flatnonzero(new != old)
                left = moved[old[moved] >= 0]
                np.add.at(sums, new[moved], x[moved])
                np.subtract.at(sums, old[left], x[left])
                members += np.bincount(new[moved], minlength=k) - np.bincount(old[left], minlength=k)
                none = pa.nulls(len(x), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("cells"), pa.array(new.astype(np.int32)), pa.array(distance[first]), none], names=["id", "cells", "cluster", "distance", "sums"])
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()), pa.array(np.arange(k, dtype=np.int32)), pa.array(members), pa.array(list(sums), pa.list_(pa.int64()))], names=["id", "cells", "cluster", "distance", "sums"]
        )

    wanted = marked.filter("need").select("id", "cells", "cluster", "possible")
    return wanted.hint("shuffle_hash").join(vectors, "id").mapInArrow(task, "id long, cells binary, cluster int, distance long, sums array<long>")


def cluster(
    rows: DataFrame, k: int = 16, rounds: int = 3, scale: int = 64, dims: int = 64, bits: int = 6, seed: str = "1", vec_id: str = "vec_id", vector: str = "embedding",
) -> DataFrame:
    """``(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256)`` for every vector that takes part.

    A component x counts as floor(scale * x). Centroids start as the ``k`` vectors with the
    smallest sha256 of ``seed:id``, in that order (all, if there are fewer). Each round assigns every vector to
    the nearest centroid, ties to the smaller number, and replaces each centroid that has any
    by the floor of their mean; then vectors are assigned once more. The digest is that of
    the final centroid's components joined by commas.

    Ids are whole numbers. Rows whose id or vector is null, whose vector has not exactly ``dims`` components, or holds a
    null or non-finite one, or one beyond 2^26 after scaling, take no part. Rows that repeat an
    id are one vector; if they differ, the smallest stands for it. An inertia beyond a long is null.
    """
    spark = rows.sparkSession
    able = rows.select(integral(rows, vec_id).alias("id"), F.col(vector).cast("array<double>").alias("vec"))
    able = able.filter("id is not null").filter(finite(F.col("vec")) & (F.size("vec") == dims)).withColumn("vec", F.transform("vec", lambda x: F.floor(x * scale).cast("double")))
    able = able.filter(F.forall("vec", lambda x: F.abs(x) <= LARGEST))
    one = _vectors(able.groupBy("id").agg(F.min("vec").alias("vec")))
    buckets = bucket_count(spark, 4.0 * dims * rows.count())
    vectors = shelve(one.repartition(buckets, "id"), "id", buckets)

    smallest = vectors.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"), 256), "id").limit(max(k, SAMPLE_ROWS)).collect()
    if not smallest:
        return spark.createDataFrame([], _OUT)
    sample = np.stack([np.frombuffer(r["vec"], dtype=np.int32) for r in smallest]).astype(np.int64)
    centers = sample[:k].copy()
    k = len(centers)
    sums, members = [[0] * dims for _ in range(k)], [0] * k
    cells = Cells(sample, *_ranges(vectors, dims), bits)
    state = materialize(_encoded(vectors, cells), "cells")
    for turn in range(rounds + 1):
        marked = materialize(_marked(state, cells, centers, turn in (0, rounds)), "cells")
        found = materialize(_decided(marked, vectors, centers), "assigned")
        if turn == rounds:
            break
        state = marked.filter("not need").select("id", "cells", "cluster").unionByName(found.filter("id is not null").select("id", "cells", "cluster"))
        change = found.filter("id is null").groupBy("cluster")
        parts = [F.sum(F.col("sums")[d].cast("decimal(38,0)")).alias(f"x{d}") for d in range(dims)]
        for r in change.agg(F.sum("distance").alias("n"), *parts).collect():  # k rows
            members[r["cluster"]] += r["n"]
            sums[r["cluster"]] = [x + int(r[f"x{d}"]) for d, x in enumerate(sums[r["cluster"]])]
        centers = np.array([[x // members[c] for x in sums[c]] if members[c] else centers[c].tolist() for c in range(k)], dtype=np.int64)

    placed = found.filter("id is not null").select(F.col("id").alias("vec_id"), "cluster", "distance")
    spread = {r["cluster"]: int(r["x"]) for r in placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("x")).collect()}  # k numbers
    as_long = lambda x: x if x < 1 << 63 else None
    total = as_long(sum(spread.values()))
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers.tolist()]
    facts = spark.createDataFrame([(c, as_long(spread.get(c, 0)), total, digests[c]) for c in range(k)], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return placed.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows
