"""Queries against all rows in blocks: packed vectors, tiles of a query block and candidate blocks, best rows of each.

Vectors are packed into blocks of bounded size. The grid of query blocks (rows) and candidate
blocks is cut into columns of a bounded number of candidate blocks; each cell of the grid is
worked through by one task, one candidate block at a time, with a state of a few results per
query. So a task holds one query block, one candidate block and the state, whatever the input.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import count
from typing import Any, Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featshift.storage import materialize

#: Bytes of vectors in a query block and in a candidate block.
QUERY_BYTES, CANDIDATE_BYTES = 4 << 20, 1 << 20
#: Most candidate blocks in a column of the grid, grid cells wanted per shuffle partition, and most cells of a task.
COLUMN_BLOCKS, CELLS, TASK_CELLS = 256, 4, 64
#: Scores are held for so many pairs at once.
PAIRS = 1 << 21


def integral(rows: DataFrame, column: str) -> Column:
    """The column as a long; anything but a whole-number type is refused."""
    if not isinstance(rows.schema[column].dataType, T.IntegralType):
        raise ValueError(f"{column} must hold whole numbers")
    return F.col(column).cast("long")


def finite(vector: Column) -> Column:
    """Whether an array of doubles is there, has components, and all of them are finite numbers."""
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def pack(rows: DataFrame, block_bytes: int) -> DataFrame:
    """Rows ``(id, vec, ...)`` as blocks ``(part, block, vec, size, id, ...)``: partition, number, and an array for every column.

    ``vec`` has the doubles of all vectors one after the other, ``size`` components each.
    """
    others = [f for f in rows.schema.fields if f.name != "vec"]
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("block", T.LongType()), T.StructField("vec", T.BinaryType()), T.StructField("size", T.ArrayType(T.LongType()))])
    schema = T.StructType([*schema.fields, *(T.StructField(f.name, T.ArrayType(f.dataType)) for f in others)])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        made = count(part << 32)
        held: list[pa.RecordBatch] = []
        weight = 0

        def packed() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            vec = table.column("vec").combine_chunks()
            arrays = [pa.array([part], pa.int32()), pa.array([next(made)]), pa.array([vec.flatten().to_numpy().astype(np.float64).tobytes()], pa.binary()), pa.array([np.diff(vec.offsets.to_numpy()).astype(np.int64)])]
            arrays += [pa.ListArray.from_arrays(pa.array([0, table.num_rows], pa.int32()), table.column(f.name).combine_chunks()) for f in others]
            return pa.RecordBatch.from_arrays(arrays, names=schema.names)

        for batch in batches:
            ends = np.cumsum(8 * np.diff(batch.column("vec").offsets.to_numpy()))
            at = done = 0
            while at < batch.num_rows:
                end = max(at + (not held), int(np.searchsorted(ends, done + block_bytes - weight, side="right")))
                if end > at:
                    held.append(batch.slice(at, end - at))
                    weight += int(ends[end - 1]) - done
                    at, done = end, int(ends[end - 1])
                if at < batch.num_rows:
                    yield packed()
                    held, weight = [], 0
        if held:
            yield packed()

    return rows.mapInArrow(task, schema)


class Block:
    """A packed block: one matrix per dimension, and the rows it holds."""

    def __init__(self, columns: dict[str, pa.Array]):
        self.columns = {k: v for k, v in columns.items() if k not in ("vec", "size")}
        data, sizes = np.frombuffer(columns["vec"].as_buffer(), dtype=np.float64), columns["size"].values.to_numpy()
        starts = np.cumsum(sizes) - sizes
        self.parts: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for dim in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == dim)
            self.parts[dim] = at, data[starts[at][:, None] + np.arange(dim)]

    def numbers(self, name: str) -> np.ndarray:
        return self.columns[name].values.to_numpy(zero_copy_only=False)


def best(scores: np.ndarray, able: np.ndarray, ids: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the ``most`` highest scores in each row among ``able``, best first, ties by smaller id."""
    if np.count_nonzero(able) > 8 * most * len(scores) and scores.shape[1] > most:
        low = -np.inf if scores.dtype.kind == "f" else np.iinfo(scores.dtype).min
        masked = np.where(able, scores, low)
        able = able & (scores >= np.partition(masked, -most, axis=1)[:, -most][:, None])
    row, col = np.nonzero(able)
    order = np.lexsort((ids[col], -scores[row, col], row))
    row, col = row[order], col[order]
    first = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1]))) if len(row) else np.zeros(0, dtype=int)
    place = np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row))))
    return row[place < most], col[place < most]


class State(Protocol):
    """What is known so far about the queries of a block."""

    def see(self, candidates: Any) -> None:
        """Take in a prepared candidate block."""

    def rows(self) -> pa.RecordBatch:
        """The results over all candidate blocks seen."""


def sweep(queries: DataFrame, candidates: DataFrame, prepare: Callable[[Block], Any], state: Callable[[Any], State], schema: str) -> DataFrame:
    """``state`` of each query block after the candidate blocks of a column, for every column of the grid.

    Both inputs have columns ``id`` (long) and ``vec`` (array of doubles) and may have others.
    """
    tasks = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n_lines = int((queries.agg(F.sum(F.size("vec"))).first()[0] or 0) * 8 // QUERY_BYTES) + 1
    asked = materialize(pack(queries.repartition(n_lines), QUERY_BYTES), "blocks")
    there = materialize(pack(candidates, CANDIDATE_BYTES), "blocks")
    n_blocks = max(1, there.count())
    columns = min(n_blocks, max(math.ceil(n_blocks / COLUMN_BLOCKS), math.ceil(CELLS * tasks / n_lines)))
    cells = n_lines * columns
    # A query block goes to every column, a candidate block to every line of the grid.
    left = asked.withColumn("line", F.col("part")).withColumn("column", F.explode(F.sequence(F.lit(0), F.lit(columns - 1)))).withColumn("side", F.lit(0))
    right = there.withColumn("line", F.explode(F.sequence(F.lit(0), F.lit(n_lines - 1)))).withColumn("column", F.pmod(F.xxhash64("block"), F.lit(columns)).cast("int")).withColumn("side", F.lit(1))
    both = left.unionByName(right, allowMissingColumns=True).repartition(min(cells, max(CELLS * tasks, cells // TASK_CELLS)), "line", "column")
    both = both.sortWithinPartitions("line", "column", "side").drop("part", "block")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, states = None, []
        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: batch.column(name)[k] for name in batch.schema.names}
                here = row.pop("line").as_py(), row.pop("column").as_py()
                if here != cell:
                    yield from (s.rows() for s in states)
                    cell, states = here, []
                side, block = row.pop("side").as_py(), prepare(Block(row))
                if side == 0:
                    states.append(state(block))
                for s in states if side else ():
                    s.see(block)
        yield from (s.rows() for s in states)

    return both.mapInArrow(task, schema)
