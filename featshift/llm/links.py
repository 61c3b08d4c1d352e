"""Connected components of links between rows, in distributed rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featshift.storage import forget, materialize


def _smaller_end(edges: DataFrame) -> DataFrame:
    """For every node the smallest of itself and its neighbours, as ``(u, low)``."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("low"))


def components(links: DataFrame) -> DataFrame:
    """``(node, component)``: the smallest node that each linked node reaches.

    ``links`` has columns ``u`` and ``v``; direction, repeats and loops do not matter, and
    nodes without a link to another are not listed. Each round hangs the neighbours of a
    node on its smallest one (first the larger neighbours, then the smaller), which turns
    every component into a star after a number of rounds that grows with the logarithm of
    its size. No group is collected: minima are folded before the shuffle, and a node with
    many links is a skewed join key that Spark splits. Every round is a written table.
    """
    edges = materialize(
        links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links"
    )
    last = None
    while True:
        # Larger neighbours of a node hang on the smallest end.
        low = _smaller_end(edges).withColumnRenamed("u", "v")
        large = edges.join(low.hint("merge"), "v").select("u", F.col("low").alias("v")).distinct()
        # Each node and its smaller neighbours hang on the smallest of these.
        lowest = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(lowest.hint("merge"), "u").select(F.col("v").alias("u"), F.col("low").alias("v"))
        small = small.unionByName(lowest.select("u", F.col("low").alias("v"))).filter("u <> v").distinct()
        edges, old = materialize(small, "links"), edges
        forget(old)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == last:
            roots = edges.select(F.col("v").alias("node")).distinct()
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.withColumn("component", F.col("node")))
        last = state
