"""Random forests grown on cells: distinct rows of ranges with their numbers.

A bag of a tree holds every row a Poisson(1) number of times, so a cell of n rows is in it
Poisson(n) times, each tree with draws of its own. Trees are dealt to tasks; what a task needs
of the table are its cells, at most ``MOST_CELLS`` whatever the number of rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from featshift.storage import drop_path, forget, fresh_path

MOST_CELLS = 1 << 20
_NODES = "tree int, id int, prediction double, impurity double, n0 double, n1 double, gain double, `left` int, `right` int, feature int, bin int"
_LEAF = "named_struct('featureIndex', -1, 'leftCategoriesOrThreshold', cast(array() as array<double>), 'numCategories', -1)"


def bags_rows(estimator: Estimator) -> bool:
    """Whether the forest draws whole bags of plainly counted rows, and tries all or about the root of the features at a node."""
    if not isinstance(estimator, RandomForestClassifier):
        return False
    plain = {"bootstrap": True, "subsamplingRate": 1.0, "minInstancesPerNode": 1, "minWeightFractionPerNode": 0.0, "impurity": "gini"}
    counted = not (estimator.isDefined("weightCol") and estimator.getOrDefault("weightCol"))
    tried = estimator.getOrDefault("featureSubsetStrategy") in ("auto", "sqrt", "all") and estimator.getOrDefault("numTrees") > 1
    return counted and tried and all(estimator.getOrDefault(k) == v for k, v in plain.items())


def _gini(n: np.ndarray, n1: np.ndarray) -> np.ndarray:
    p = np.divide(n1, n, out=np.zeros_like(n), where=n > 0)
    return 2.0 * p * (1.0 - p)


def grow(bins: np.ndarray, label: np.ndarray, rows: np.ndarray, depth: int, tried: int, least_gain: float, rng: np.random.Generator) -> pd.DataFrame:
    """The nodes of one tree, parents first, from cells that its bag holds ``rows`` times each."""
    bins, label, rows = bins[rows > 0], label[rows > 0], rows[rows > 0].astype(float)
    d, width = bins.shape[1], int(bins.max(initial=0)) + 1
    n, n1 = [rows.sum()], [rows[label].sum()]
    gain, left, right, feature, cut = [-1.0], [-1], [-1], [-1], [-1]
    # Nodes of this level that may be split, and the place of every cell's node among them.
    level, at = [0], np.zeros(len(rows), dtype=np.int64)
    for _ in range(depth):
        if not level or width < 2:
            break
        k = len(level)
        total, ones = np.array(n)[level], np.array(n1)[level]
        gains = np.full((k, d, width - 1), -np.inf)
        below, below1 = np.empty((k, d, width - 1)), np.empty((k, d, width - 1))
        for f in range(d):
            place = at * width + bins[:, f]
            lower = np.bincount(place, rows, k * width).reshape(k, width).cumsum(axis=1)[:, :-1]
            lower1 = np.bincount(place[label], rows[label], k * width).reshape(k, width).cumsum(axis=1)[:, :-1]
            upper, upper1 = total[:, None] - lower, ones[:, None] - lower1
            found = _gini(total, ones)[:, None] - (lower * _gini(lower, lower1) + upper * _gini(upper, upper1)) / np.maximum(total, 1.0)[:, None]
            gains[:, f] = np.where((lower > 0) & (upper > 0), found, -np.inf)
            below[:, f], below1[:, f] = lower, lower1
        gains[rng.random((k, d)).argsort(axis=1).argsort(axis=1) >= tried] = -np.inf
        best = gains.reshape(k, -1).argmax(axis=1)
        of, where = best // (width - 1), best % (width - 1)
        gained = gains[np.arange(k), of, where]
        split = (gained > 0) & (gained >= least_gain)
        kept, place = [], np.full((k, 2), -1)
        for i in np.flatnonzero(split):
            node, m, m1 = level[i], below[i, of[i], where[i]], below1[i, of[i], where[i]]
            gain[node], feature[node], cut[node], left[node], right[node] = gained[i], of[i], where[i], len(n), len(n) + 1
            for side, (c, c1) in enumerate(((m, m1), (n[node] - m, n1[node] - m1))):
                if 0 < c1 < c:
                    place[i, side] = len(kept)
                    kept.append(len(n))
                n.append(c)
                n1.append(c1)
            for column in (gain, left, right, feature, cut):
                column += [-1, -1]
        at = place[at, (bins[np.arange(len(at)), of[at]] > where[at]).astype(int)]
        bins, label, rows, at, level = bins[at >= 0], label[at >= 0], rows[at >= 0], at[at >= 0], kept
    n, n1 = np.array(n), np.array(n1)
    said = (2 * n1 > n).astype(float)
    # Two leaves that say the same are one, as Spark prunes its trees; children come after their parents.
    for i in range(len(n) - 1, -1, -1):
        if left[i] >= 0 and left[left[i]] < 0 and left[right[i]] < 0 and said[left[i]] == said[right[i]]:
            gain[i], left[i], right[i], feature[i], cut[i] = -1.0, -1, -1, -1, -1
    reached, order = [0], {}
    for node in reached:
        order[node] = len(order)
        reached += [left[node], right[node]] if left[node] >= 0 else []
    return pd.DataFrame(
        [(order[i], said[i], n[i] - n1[i], n1[i], gain[i], order.get(left[i], -1), order.get(right[i], -1), feature[i], cut[i]) for i in reached],
        columns=["id", "prediction", "n0", "n1", "gain", "left", "right", "feature", "bin"],
    ).assign(impurity=_gini(n[reached], n1[reached]))


def fit_forest(estimator: Estimator, cells) -> Model:
    """The forest of ``estimator`` on the rows behind ``cells`` of two labels, which are removed."""
    spark, d = cells.stored.sparkSession, len(cells.edges)
    bins = [f"_b{i}" for i in range(d)]
    vector, label = estimator.getOrDefault("featuresCol"), estimator.getOrDefault("labelCol")
    few = cells.stored.groupBy("_label").agg(F.min(F.struct(*bins)).alias("b")).select(F.col("_label").alias(label), "b.*")
    # One row for a label; the forest of as many trees that Spark fits on copies of them lends its form.
    copies = VectorAssembler(inputCols=bins, outputCol=vector).transform(few.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.lit(100)))))
    form = estimator.fit(copies.select(vector, label))
    # At most MOST_CELLS rows of small numbers; in a fixed order, so that bags do not depend on partitions.
    held = cells.stored.select("_label", "_weight", *[F.col(b).cast("tinyint") for b in bins]).orderBy("_label", *bins).toPandas()
    shared = spark.sparkContext.broadcast((held[bins].to_numpy().astype(np.int8), held["_label"].to_numpy() == 1.0, held["_weight"].to_numpy()))
    depth, least, seed, trees = (estimator.getOrDefault(p) for p in ("maxDepth", "minInfoGain", "seed", "numTrees"))
    tried = d if estimator.getOrDefault("featureSubsetStrategy") == "all" else math.ceil(math.sqrt(d))

    def grown(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        x, y, weight = shared.value
        for batch in batches:
            for tree in batch["id"]:
                rng = np.random.default_rng([abs(seed), int(tree)])
                yield grow(x, y, rng.poisson(weight), depth, tried, least, rng).assign(tree=int(tree))[[c.split()[0].strip("`") for c in _NODES.split(", ")]]

    tasks = min(trees, 4 * spark.sparkContext.defaultParallelism)
    nodes = spark.range(0, trees, 1, tasks).mapInPandas(grown, _NODES)
    ends = F.array(*[F.array(*[F.lit(e) for e in own]).cast("array<double>") for own in cells.edges])
    threshold = F.get(F.get(ends, F.col("feature")), F.col("bin"))
    split = F.struct(F.col("feature").alias("featureIndex"), F.array(threshold).alias("leftCategoriesOrThreshold"), F.lit(-1).alias("numCategories"))
    data = nodes.select(F.col("tree").alias("treeID"), F.struct(
        "id", "prediction", "impurity", F.array("n0", "n1").alias("impurityStats"), (F.col("n0") + F.col("n1")).cast("long").alias("rawCount"),
        "gain", F.col("left").alias("leftChild"), F.col("right").alias("rightChild"), F.when(F.col("left") >= 0, split).otherwise(F.expr(_LEAF)).alias("split"),
    ).alias("nodeData"))
    kept, made = fresh_path(spark, "model"), fresh_path(spark, "model")
    form.write().save(kept)
    data.write.parquet(f"{made}/data")
    spark.read.text(f"{kept}/metadata").coalesce(1).write.text(f"{made}/metadata")
    spark.read.parquet(f"{kept}/treesMetadata").write.parquet(f"{made}/treesMetadata")
    model = type(form).load(made)
    for path in (kept, made):
        drop_path(spark, path)
    forget(cells.stored)
    shared.unpersist()
    return model
