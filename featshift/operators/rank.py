"""Exact global ranks and running totals without a one-task window.

Rows are put into many order-preserving buckets. Totals per bucket are small,
so their running sum is cheap. Running totals and seeded ranks finish with an ordinary
window inside a bucket.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featshift.functions.hashing import seeded_hash
from featshift.storage import materialize

# Several buckets for each shuffle partition, so that hashing buckets to partitions evens out.
BUCKETS_PER_PARTITION = 16
ROWS_PER_BUCKET = 100_000


def running_totals(
    df: DataFrame,
    measures: Mapping[str, Column],
    bucket: Column,
    order: Sequence[str | Column],
    by: Sequence[str] = (),
) -> DataFrame:
    """Add inclusive running sums of ``measures`` in (bucket, order) order within ``by``.

    ``bucket`` must never decrease along ``order``; its distinct values per ``by``
    group bound the size of the offsets table.
    """
    by = list(by)
    tagged = df.withColumn("_bucket", bucket)
    offsets = tagged.groupBy(*by, "_bucket").agg(
        *[F.sum(e).alias(f"_total_{n}") for n, e in measures.items()]
    )
    before = W.partitionBy(*by).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = offsets.select(
        *by,
        "_bucket",
        *[
            F.coalesce(F.sum(f"_total_{n}").over(before), F.lit(0)).alias(f"_before_{n}")
            for n in measures
        ],
    )
    inside = (
        W.partitionBy(*by, "_bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    )
    joined = tagged.join(offsets, [*by, "_bucket"])
    for name, measure in measures.items():
        joined = joined.withColumn(name, F.sum(measure).over(inside) + F.col(f"_before_{name}"))
    return joined.drop("_bucket", *[f"_before_{n}" for n in measures])


def in_order(df: DataFrame, order: Sequence[str | Column], rows: int, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """``df`` stored in ranges of ``order``, numbered along it in ``_bucket``.

    A sample sort: Spark samples the rows for splits, whose number follows ``rows``, the size of ``df``.
    Fold equal rows first, or a frequent value fills its range; ``df`` should be stored, as sampling reads it too.
    """
    wanted = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / rows_per_bucket))
    ranges = df.repartitionByRange(wanted, *order).withColumn("_bucket", F.spark_partition_id())
    return materialize(ranges, "ranges")


def seeded_rank(
    df: DataFrame,
    key: Sequence[str | Column],
    seed: int | str,
    by: Sequence[str] = (),
    out: str = "rank",
    buckets: int | None = None,
) -> DataFrame:
    """1-based rank of every row in the seeded order of its key, within ``by``.

    The seeded hash is uniform, so cutting its range evenly gives balanced buckets in order
    without a look at the rows. The rows of every bucket (and ``by`` group) are counted from
    the keys alone, then the rows travel once, without their hash, and are numbered inside
    their bucket. Rows of one key follow their other columns, so that the rank of a row does not
    depend on when it is computed. ``df`` is read twice: store what is dear to make, and the
    result if it is used several times. ``buckets`` is ``BUCKETS_PER_PARTITION`` for every
    shuffle partition unless given.
    """
    by = list(by)
    n = buckets or BUCKETS_PER_PARTITION * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hashed = seeded_hash(seed, *key)
    bucket = F.shiftright(F.conv(F.substring(hashed, 1, 8), 16, 10).cast("bigint") * n, 32).cast("int")
    groups = df.groupBy(*by, bucket.alias("_bucket")).agg(F.count("*").alias("_rows"))
    earlier = W.partitionBy(*by).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = groups.select(*by, "_bucket", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    placed = df.repartition(bucket).select("*", hashed.alias("_h"), bucket.alias("_bucket"))
    known = {*by, *(k for k in key if isinstance(k, str))}
    rest = [f.name for f in df.schema.fields if f.name not in known and _sortable(f.dataType)]
    inside = W.partitionBy(*by, "_bucket").orderBy("_h", *key, *rest)
    numbered = placed.withColumn("_at", F.row_number().over(inside)).drop("_h")
    # One row per bucket and group.
    return numbered.join(F.broadcast(offsets), [*by, "_bucket"]).select(*df.columns, (F.col("_at") + F.col("_before")).alias(out))


def _sortable(kind: T.DataType) -> bool:
    return isinstance(kind, T.AtomicType) or (isinstance(kind, T.ArrayType) and _sortable(kind.elementType))
