"""Trees, boosted ones and forests fitted on distinct rows with their numbers.

A tree only sees which of at most ``maxBins`` ranges a feature value falls in. Rows that
agree in all ranges and in the label are the same to it, so one of them with their number as
its weight stands for all: the fit finds the same sums, whatever the number of rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featshift.operators.forest import MOST_CELLS, bags_rows, fit_forest
from featshift.storage import drop_path, forget, fresh_path, materialize

#: Spark's trees find their ranges on this many rows at least; every row is counted in the cells.
DRAWN_ROWS = 10_000
#: Fits on fewer rows go without cells.
LEAST_ROWS = 100_000
#: With more features few rows agree in all ranges.
MOST_FEATURES = 8
ROWS_PER_TASK = 20_000
_WEIGHT = "_weight"


@dataclass(frozen=True)
class Cells:
    """``stored`` has a row for each cell: its label, the numbers of its ranges and how many rows it has; range k of feature i ends with ``edges[i][k]``."""

    stored: DataFrame
    edges: list[list[float]]
    n: int


def counts_rows(estimator: Estimator) -> bool:
    """Whether the fit only depends on how often a row occurs: it draws no rows or whole bags, and has no weights or least numbers of its own."""
    if bags_rows(estimator):
        return True
    if not isinstance(estimator, (GBTClassifier, DecisionTreeClassifier)):
        return False
    drawn = estimator.hasParam("subsamplingRate") and estimator.getOrDefault("subsamplingRate") < 1
    other = any(estimator.hasParam(p) and estimator.isDefined(p) and estimator.getOrDefault(p) for p in ("weightCol", "validationIndicatorCol"))
    return not drawn and not other and estimator.getOrDefault("minInstancesPerNode") == 1


def range_ends(values: np.ndarray, max_bins: int) -> list[float]:
    """Where the ranges of a feature end, the last one without, by the rule of Spark's trees.

    Between all values where they are few; else a stride is laid along the sorted values and ends
    are set between neighbours, next to each other around a value of many rows.
    """
    found, counts = np.unique(values, return_counts=True)
    between = (found[:-1] + found[1:]) / 2
    if len(between) < max_bins:
        return between.tolist()
    stride = len(values) / max_bins
    ends, target, before = [], stride, int(counts[0])
    for middle, count in zip(between.tolist(), counts[1:].tolist()):
        if abs(before - target) < abs(before + count - target):
            ends.append(middle)
            target += stride
        before += count
    return sorted(set(ends))


def value_edges(values: DataFrame, columns: Sequence[str], max_bins: int, seed: int) -> list[list[float]]:
    """The ends of the ranges of every column, from as many rows as Spark's trees draw for them."""
    drawn = max(max_bins**2, DRAWN_ROWS) / max(1, values.count())
    if drawn < 1:
        values = values.sample(drawn, seed)
    long = values.select(F.inline(F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).alias("v")) for i, c in enumerate(columns)])))

    def ends(column: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": column["i"].iloc[:1], "ends": [range_ends(column["v"].to_numpy(), max_bins)]})

    edges: list[list[float]] = [[] for _ in columns]
    for row in long.groupBy("i").applyInPandas(ends, "i int, ends array<double>").collect():
        edges[row["i"]] = row["ends"]
    return edges


def in_cells(rows: DataFrame, estimator: Estimator, n_features: int) -> Cells | None:
    """The cells of assembled ``rows``, stored, or None where they spare less than half of the rows."""
    vector, label = estimator.getOrDefault("featuresCol"), estimator.getOrDefault("labelCol")
    columns, bins = [f"_x{i}" for i in range(n_features)], [f"_b{i}" for i in range(n_features)]
    values = rows.select(F.col(label).alias("_label"), vector_to_array(vector).alias("_x"))
    values = values.select("_label", *[F.col("_x")[i].alias(c) for i, c in enumerate(columns)])
    edges = value_edges(values, columns, estimator.getOrDefault("maxBins"), estimator.getOrDefault("seed"))
    cut = [i for i, e in enumerate(edges) if e]
    if cut:
        # A value that equals an edge belongs to the range that ends there.
        splits = [[-math.inf, *(math.nextafter(e, math.inf) for e in edges[i]), math.inf] for i in cut]
        values = Bucketizer(splitsArray=splits, inputCols=[columns[i] for i in cut], outputCols=[bins[i] for i in cut]).transform(values)
    # Plain numbers: the bucketizer's own columns pass for categories.
    values = values.withColumns({b: F.col(b).cast("int") if i in cut else F.lit(0) for i, b in enumerate(bins)})
    counted = values.groupBy("_label", *bins).agg(F.count("*").cast("double").alias(_WEIGHT))
    cells = materialize(counted, "cells")
    size = cells.agg(F.count("*"), F.sum(_WEIGHT)).first()
    labels = {row[0] for row in cells.select("_label").distinct().collect()}  # two
    if 2 * size[0] > size[1] or bags_rows(estimator) and (size[0] > MOST_CELLS or labels != {0.0, 1.0}):
        forget(cells)
        return None
    return Cells(cells, edges, size[0])


def fit_cells(estimator: Estimator, cells: Cells) -> Model:
    """The model that ``estimator`` fits on the rows behind ``cells``, which are removed."""
    if bags_rows(estimator):
        return fit_forest(estimator, cells)
    vector, label = estimator.getOrDefault("featuresCol"), estimator.getOrDefault("labelCol")
    bins = [f"_b{i}" for i in range(len(cells.edges))]
    tasks = max(1, min(cells.stored.sparkSession.sparkContext.defaultParallelism, cells.n // ROWS_PER_TASK))
    rows = cells.stored.repartition(tasks, "_label", *bins).sortWithinPartitions("_label", *bins)
    rows = VectorAssembler(inputCols=bins, outputCol=vector).transform(rows).select(vector, F.col("_label").alias(label), _WEIGHT)
    model = estimator.copy({estimator.getParam("weightCol"): _WEIGHT}).fit(rows)
    forget(cells.stored)
    return _on_values(cells.stored.sparkSession, model, cells.edges)


def _on_values(spark: SparkSession, model: Model, edges: list[list[float]]) -> Model:
    """The model with every threshold on a range's number replaced by the end of that range, by way of its stored nodes."""
    kept, made = fresh_path(spark, "model"), fresh_path(spark, "model")
    model.write().save(kept)
    nodes = spark.read.parquet(f"{kept}/data")
    of_node = "nodeData" in nodes.columns
    split = F.col("nodeData.split" if of_node else "split")
    ends = F.array(*[F.array(*[F.lit(e) for e in own]).cast("array<double>") for own in edges])
    old = split["leftCategoriesOrThreshold"]
    new = F.transform(old, lambda t: F.get(F.get(ends, split["featureIndex"]), F.floor(t).cast("int")))
    split = split.withField("leftCategoriesOrThreshold", new)
    nodes = nodes.withColumn("nodeData", F.col("nodeData").withField("split", split)) if of_node else nodes.withColumn("split", split)
    nodes.write.parquet(f"{made}/data")
    spark.read.text(f"{kept}/metadata").coalesce(1).write.text(f"{made}/metadata")
    if of_node:
        spark.read.parquet(f"{kept}/treesMetadata").write.parquet(f"{made}/treesMetadata")
    changed = type(model).load(made)
    drop_path(spark, kept)
    drop_path(spark, made)
    return changed
