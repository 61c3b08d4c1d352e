"""Euclidean minimum spanning tree in rounds (Boruvka) and the divergence it gives.

Every round joins each component to its nearest other component. Edges come from a
nearest-neighbour graph; a point whose known neighbours all lie in its own component
is searched again, only if something nearer than the component's best edge may exist.
Edges are ordered by (weight, smaller id, larger id), so the tree is unique. Tables
are stored in the shared folder after every round.
"""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featshift.operators.blocks import (
    BlockIndex, BlockMap, Bounds, build_index, exact_distances, knn_join, matrix, rounding_slack, row_slices,
    squared_distances, visit_blocks,
)
from featshift.operators.divergence import labelled_points
from featshift.storage import materialize


def _edge(a: str, b: str, w: str, other: str) -> list:
    return [F.col(w).alias("w"), F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"), F.col(other).alias("other")]


def _with_component(rows: DataFrame, labels: DataFrame, id_column: str, out: str) -> DataFrame:
    return rows.join(labels.select(F.col("id").alias(id_column), F.col("comp").alias(out)), id_column)


def _best_edges(edges: DataFrame) -> DataFrame:
    """Smallest edge per component: ``(comp, w, lo, hi, other)``."""
    return edges.groupBy("comp").agg(F.min(F.struct("w", "lo", "hi", "other")).alias("e")).select("comp", "e.*")


def _search(index: BlockIndex, open_points: DataFrame, labels: DataFrame) -> DataFrame:
    """Nearest point of another component for the open points: ``(comp, w, lo, hi, other)``."""
    placed = _with_component(index.points, labels, "id", "comp")
    spans = placed.groupBy("block").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).collect()
    single = {s["block"]: s["lo"] for s in spans if s["lo"] == s["hi"]}
    codes = {comp: i for i, comp in enumerate(set(single.values()))}
    only = np.array([codes[single[b]] if b in single else -1 for b in range(len(index.map.pivot_of))])

    def rule(_: BlockMap, at: Bounds, batch: pd.DataFrame) -> np.ndarray:
        own = batch["comp"].map(codes).fillna(-2).to_numpy(dtype=np.int64)
        foreign = only[None, :] != own[:, None]
        reach = np.where(foreign, at.high, np.inf).min(axis=1)
        reach = np.minimum(reach, batch["cap"].to_numpy(dtype=float))
        return foreign & (at.low <= (reach * (1 + 1e-9) + 2 * at.slack)[:, None])

    id_type, comp_type = index.points.schema["id"].dataType, labels.schema["comp"].dataType
    schema = T.StructType([
        T.StructField("id", id_type), T.StructField("comp", comp_type), T.StructField("near", id_type),
        T.StructField("other", comp_type), T.StructField("w", T.DoubleType()),
    ])

    def nearest(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty:
            return pd.DataFrame(columns=schema.names)
        right = right.sort_values("id", ignore_index=True)
        a, b = matrix(left["vec"]), matrix(right["vec"])
        centre = b.mean(axis=0)
        slack = rounding_slack(a - centre, b - centre)
        mine, theirs = left["comp"].to_numpy(), right["comp"].to_numpy()
        pieces = []
        for rows in row_slices(len(a), len(b)):
            d2 = squared_distances(a[rows] - centre, b - centre)
            d2[mine[rows][:, None] == theirs[None, :]] = np.inf
            r, s = np.nonzero((d2 <= d2.min(axis=1)[:, None] + 2 * slack) & np.isfinite(d2))
            d = exact_distances(a[rows][r], b[s])
            order = np.lexsort((s, d, r))
            r, s, d = r[order], s[order], d[order]
            keep = np.searchsorted(r, r, side="left") == np.arange(len(r))
            pieces.append((r[keep] + rows.start, s[keep], d[keep]))
        r, s, d = (np.concatenate(p) for p in zip(*pieces))
        return pd.DataFrame({
            "id": left["id"].to_numpy()[r], "comp": mine[r], "near": right["id"].to_numpy()[s], "other": theirs[s], "w": d,
        })

    found = visit_blocks(replace(index, points=placed), open_points, rule, nearest, schema)
    return found.select("comp", *_edge("id", "near", "w", "other"))


def _merge(best: DataFrame) -> DataFrame:
    """``(comp, root)``: components chained by their best edges get the same root."""
    mutual = best.select(F.col("comp").alias("other"), F.col("other").alias("_back"))
    hooked = best.join(mutual, "other").select(
        "comp",
        F.when((F.col("_back") == F.col("comp")) & (F.col("comp") < F.col("other")), F.col("comp")).otherwise(F.col("other")).alias("root"),
    )
    parents = materialize(hooked, "parents")
    if parents.count() != best.count():
        raise RuntimeError("a component has no edge to another one")
    while True:
        above = parents.select(F.col("comp").alias("root"), F.col("root").alias("_up"))
        jumped = materialize(
            parents.join(above, "root").select("comp", F.col("_up").alias("root"), (F.col("_up") != F.col("root")).alias("moved")),
            "parents",
        )
        parents = jumped.select("comp", "root")
        if jumped.filter("moved").isEmpty():
            return parents


def minimum_spanning_tree(points: DataFrame, k: int = 8) -> DataFrame:
    """``(src, dst, weight)`` over rows ``(id, vec)``; copies hang on their smallest id at weight 0."""
    points = points.select("id", "vec")
    heads = points.groupBy("vec").agg(F.min("id").alias("head"))
    copies = points.join(heads, "vec").filter(F.col("id") != F.col("head")).select(
        F.col("head").alias("src"), F.col("id").alias("dst"), F.lit(0.0).alias("weight")
    )
    nodes = materialize(heads.select(F.col("head").alias("id"), "vec"), "nodes")
    n = nodes.count()
    if n < 2:
        return copies
    graph = materialize(
        knn_join(nodes, nodes, min(k, n - 1), exclude_self=True).select("id", "neighbour", F.col("distance").alias("w")),
        "neighbours",
    )
    # With all other points known there is nothing left to search for.
    known = F.max("w") if n - 1 > k else F.lit(float("inf"))
    horizon = graph.groupBy("id").agg(known.alias("seen"))
    index = None
    labels = nodes.select("id", F.col("id").alias("comp"))
    tree = copies
    while True:
        joined = _with_component(_with_component(graph, labels, "id", "comp"), labels, "neighbour", "other")
        alive = materialize(joined.filter(F.col("comp") != F.col("other")), "alive")
        graph = alive.select("id", "neighbour", "w")
        best = _best_edges(alive.select("comp", *_edge("id", "neighbour", "w", "other")))
        done = labels.join(graph.select("id").distinct(), "id", "left_anti").join(horizon, "id")
        caps = best.select("comp", F.col("w").alias("cap"))
        open_points = done.join(caps, "comp", "left").filter(
            (F.col("seen") < float("inf")) & (F.col("cap").isNull() | (F.col("seen") <= F.col("cap")))
        )
        open_points = materialize(
            open_points.join(nodes, "id").select("id", "vec", "comp", F.coalesce("cap", F.lit(float("inf"))).alias("cap")),
            "open",
        )
        if not open_points.isEmpty():
            index = index or build_index(nodes)
            found = _search(index, open_points, labels)
            best = _best_edges(best.select("comp", "w", "lo", "hi", "other").unionByName(found))
        best = materialize(best, "best")
        tree = tree.unionByName(
            best.select(F.col("lo").alias("src"), F.col("hi").alias("dst"), F.col("w").alias("weight")).distinct()
        )
        roots = _merge(best)
        labels = materialize(
            labels.join(roots, "comp").select("id", F.col("root").alias("comp")), "labels"
        )
        if roots.filter("comp = root").count() <= 1:
            return tree


def spanning_divergence(reference: DataFrame, query: DataFrame, k: int = 8) -> DataFrame:
    """One row: sample sizes, tree weight, edges across the samples and the divergence in [0, 1]."""
    points = labelled_points(reference, query)
    tree = minimum_spanning_tree(points, k)
    tags = points.select("id", "tag")
    ends = tree.join(tags.select(F.col("id").alias("src"), F.col("tag").alias("_a")), "src").join(
        tags.select(F.col("id").alias("dst"), F.col("tag").alias("_b")), "dst"
    )
    n = reference.count() + query.count()
    cross = F.count_if(F.col("_a") != F.col("_b"))
    value = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1.0 - 2.0 * (cross - 1) / n))
    return ends.agg(
        F.lit(n).cast("bigint").alias("n"), F.count("*").alias("edges"), F.sum("weight").alias("total_weight"),
        cross.alias("cross_edges"), value.alias("divergence"),
    )


def spanning_bayes_bounds(divergence: DataFrame) -> DataFrame:
    """Bounds on the Bayes error from the divergence u: 1/2 - sqrt(u)/2 <= error <= 1/2 - u/2."""
    u = F.col("divergence")
    return divergence.select((0.5 - F.sqrt(u) / 2).alias("lower"), (0.5 - u / 2).alias("upper"))
