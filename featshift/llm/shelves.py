"""Documents kept in buckets on the shared folder, so that later joins on the bucket key move no text."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from contextlib import AbstractContextManager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featshift.llm.arrays import flat, slices
from featshift.storage import fresh_path, setting, shuffles_removed

#: Bytes per bucket, as long as Spark allows the number of buckets; beyond that they grow.
BUCKET_BYTES = 16 << 20


def arrow_batches(spark: SparkSession, most: int) -> AbstractContextManager[None]:
    """Jobs that run meanwhile send batches of at most ``most`` bytes to Python, or one row."""
    return setting(spark, "spark.sql.execution.arrow.maxBytesPerBatch", str(most))


def bucket_count(spark: SparkSession, total: float, bucket_bytes: int = BUCKET_BYTES) -> int:
    """Buckets for ``total`` bytes."""
    most = int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets"))
    # With fewer buckets than shuffle partitions Spark would shuffle both sides of a join after all.
    return min(most, max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(total // bucket_bytes) + 1))


def n_buckets(docs: DataFrame, text: str, bucket_bytes: int = BUCKET_BYTES) -> int:
    """Buckets for the whole text of ``docs``, by one counting pass."""
    total = docs.agg(F.sum(F.octet_length(F.col(text)).cast("double"))).first()[0] or 0.0
    return bucket_count(docs.sparkSession, total, bucket_bytes)


def shelve(docs: DataFrame | Sequence[DataFrame], key: str, buckets: int) -> DataFrame:
    """Write ``docs``, or several tables of the same columns one after the other, in buckets by the hash of ``key`` and read them back.

    Rows and columns stay. The rows are written where they are, without a shuffle: a task writes one file for each
    bucket that it has rows of. The catalog entry is only needed to read the buckets back.
    """
    tables = [docs] if isinstance(docs, DataFrame) else docs
    spark, name = tables[0].sparkSession, f"shelf_{uuid.uuid4().hex}"
    path = fresh_path(spark, "shelf")
    for rows in tables:
        rows.write.format("parquet").mode("append").option("compression", "zstd").bucketBy(buckets, key).option("path", path).saveAsTable(name)
    stored = spark.table(name)
    stored._stored_path, stored._buckets = path, buckets
    spark.sql(f"DROP TABLE {name}")
    return stored


def packed(docs: DataFrame, text: str = "text", shard_bytes: int = 4 << 20) -> DataFrame:
    """Rows packed into shards of about ``shard_bytes`` of text, one shard per row, kept in buckets by ``shard``.

    A shard has the bytes of its texts one after the other (``data``), where each begins and
    the end (``bounds``), and an array for every other column of ``docs``.
    """
    others = [f for f in docs.schema.fields if f.name != text]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 32
        for k, batch in enumerate(slices(batches, text, shard_bytes)):
            data, bounds = flat(batch.column(text))
            made = [pa.array([first + k]), pa.array([bounds], pa.list_(pa.int64())), pa.array([data.tobytes()], pa.binary())]
            made += [pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column(f.name)) for f in others]
            yield pa.RecordBatch.from_arrays(made, names=["shard", "bounds", "data", *(f.name for f in others)])

    schema = T.StructType([T.StructField("shard", T.LongType()), T.StructField("bounds", T.ArrayType(T.LongType())), T.StructField("data", T.BinaryType())])
    schema = T.StructType([*schema.fields, *(T.StructField(f.name, T.ArrayType(f.dataType)) for f in others)])
    return shelve(docs.mapInArrow(task, schema), "shard", n_buckets(docs, text))


def unpack(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, dict[str, pa.Array]]]:
    """Shard, bytes, bounds and the other columns of each packed row."""
    for k in range(batch.num_rows):
        data = np.frombuffer(batch.column("data")[k].as_buffer(), dtype=np.uint8)
        bounds = batch.column("bounds")[k].values.to_numpy()
        yield batch.column("shard")[k].as_py(), data, bounds, {n: batch.column(n)[k] for n in batch.schema.names if n not in ("shard", "data", "bounds")}
