"""Discriminators: Spark ML classifiers that tell the query from the reference.

Any classifier estimator works whose model has ``featureImportances`` or
``coefficients``. Folds are fitted as concurrent Spark jobs over one stored table, as many at a time as memory holds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce

from pyspark import StorageLevel
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featshift.functions.scores import CORRECT_CLIP, Scored
from featshift.operators import cells as C
from featshift.operators.concurrent import run_together
from featshift.operators.evaluate import evaluate
from featshift.operators.prepare import stratified_folds
from featshift.sources.pair import ShiftPair
from featshift.storage import forget, materialize

VECTOR = "features"
CACHED_ROWS = 100_000
FIT_BYTES_PER_CORE = 512 << 20
_SLICE = "_remaining"


def random_forest(trees: int = 100, depth: int = 10, seed: int = 0) -> Estimator:
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed)


def boosted_trees(rounds: int = 20, depth: int = 5, seed: int = 0) -> Estimator:
    return GBTClassifier(maxIter=rounds, maxDepth=depth, seed=seed)


def logistic() -> Estimator:
    return LogisticRegression()


def assemble(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Feature columns in one vector; everything else (key, label, fold, role) is kept."""
    assembler = VectorAssembler(inputCols=list(features), outputCol=VECTOR, handleInvalid="error")
    return assembler.transform(df).drop(*features).withColumn("label", F.col("label").cast("double"))


@contextmanager
def cached(df: DataFrame, ready: Callable[[DataFrame], DataFrame] | None = None) -> Iterator[DataFrame]:
    """Store ``df`` and keep it on the executors' disks while it is used several times.

    What ``ready`` makes of the stored rows, such as vectors, is kept there only: plain columns
    take less room in files. Files hold at most ``CACHED_ROWS``, so that no task reads a
    part that grows with the table, however well its rows compress. Memory is left to the fits:
    an estimator reads its rows a few times and then works on a form of its own.
    With the stored table behind it, a cached part lost with its executor is read again
    in the same row order, which tree bagging depends on. Both are gone afterwards, so what
    is computed from it lazily has to be stored before.
    """
    stored = materialize(df, "cached", CACHED_ROWS)
    kept = (ready(stored) if ready else stored).persist(StorageLevel.DISK_ONLY)
    try:
        yield kept
    finally:
        kept.unpersist()
        forget(stored)


def kept_bytes(estimator: Estimator, n_features: int) -> int:
    """About how many bytes of a training row a fit keeps in memory."""
    if estimator.hasParam("numTrees"):  # binned features, and for every tree how often it draws the row
        return 128 + 4 * (n_features + estimator.getOrDefault("numTrees"))
    if estimator.hasParam("maxDepth"):  # binned features; boosted, three rounds of predictions and errors
        return 248 + 4 * n_features
    return 8 * (n_features + 2)


def fits_at_once(spark: SparkSession, estimator: Estimator, rows: int, n_features: int, wanted: int) -> int:
    """How many fits on ``rows`` rows run together, at most ``wanted``: those whose rows have room in memory.

    A fit that is large for the cluster has tasks for all cores, so others beside it gain nothing.
    """
    room = FIT_BYTES_PER_CORE * spark.sparkContext.defaultParallelism
    return max(1, min(wanted, room // (max(rows, 1) * kept_bytes(estimator, n_features))))


def _width(data: DataFrame) -> int:
    first = data.select(vector_to_array(VECTOR).alias("v")).first()
    return len(first["v"]) if first else 0


def train_rows(data: DataFrame, fold: int) -> DataFrame:
    if "role" in data.columns:
        return data.filter((F.col("fold") == fold) & (F.col("role") == "train"))
    return data.filter(F.col("fold") != fold)


def test_rows(data: DataFrame, fold: int) -> DataFrame:
    tested = data.filter(F.col("fold") == fold)
    return tested.filter(F.col("role") == "test") if "role" in data.columns else tested


test_rows.__test__ = False


def fold_numbers(data: DataFrame) -> list[int]:
    """Folds that hold test rows; a handful of integers."""
    tested = data.filter(F.col("role") == "test") if "role" in data.columns else data
    rows = tested.filter(F.col("fold") >= 0).select("fold").distinct().collect()
    return sorted(int(row["fold"]) for row in rows)


def with_columns_set(estimator: Estimator, features_col: str) -> Estimator:
    return estimator.copy(
        {estimator.getParam("featuresCol"): features_col, estimator.getParam("labelCol"): "label"}
    )


def score_rows(model: Model, rows: DataFrame) -> DataFrame:
    """Add ``prediction`` and ``p1`` (NULL for a model without probabilities)."""
    out = model.transform(rows)
    p1 = vector_to_array("probability")[1] if "probability" in out.columns else F.lit(None).cast("double")
    kept = [c for c in rows.columns if c not in (VECTOR, _SLICE)]
    return out.select(*kept, F.col("prediction").cast("int").alias("prediction"), p1.alias("p1"))


def importances_of(model: Model) -> list[float]:
    """Signed coefficients or importances, one per feature of the model's input."""
    if hasattr(model, "coefficients"):
        return [float(v) for v in model.coefficients.toArray()]
    if hasattr(model, "featureImportances"):
        return [float(v) for v in model.featureImportances.toArray()]
    raise ValueError(f"{type(model).__name__} has neither coefficients nor featureImportances")


def score_model(model: Model, rows: DataFrame, metrics: Sequence[str] = ("JD", "TV"), columns: Scored = Scored(clip=CORRECT_CLIP)) -> DataFrame:
    """``(metric, value)`` of an already fitted model on assembled, labelled rows."""
    return evaluate(score_rows(model, rows), metrics, columns=columns)


def fit_tables(tables: Sequence[DataFrame], estimator: Estimator, rows: int, n_features: int, parallelism: int) -> list[Model]:
    """A model of each table of at most ``rows`` assembled rows; trees that only count rows are fitted on cells where these are few."""
    if not tables:
        return []
    spark = tables[0].sparkSession
    cells: list[C.Cells | None] = [None] * len(tables)
    if rows >= C.LEAST_ROWS and n_features <= C.MOST_FEATURES and C.counts_rows(estimator):
        cells = run_together(spark, lambda table: C.in_cells(table, estimator, n_features), tables, parallelism)

    def fit(k: int) -> Model:
        return C.fit_cells(estimator, cells[k]) if cells[k] else estimator.fit(tables[k])

    most = max(c.n if c else rows for c in cells)
    return run_together(spark, fit, range(len(tables)), fits_at_once(spark, estimator, most, n_features, parallelism))


@dataclass(frozen=True)
class FoldFits:
    """Fitted models by fold and the scored test rows of all folds."""

    models: dict[int, Model]
    scored: DataFrame


def fit_folds(
    data: DataFrame,
    estimator: Estimator,
    folds: Sequence[int],
    positions: Sequence[int] | None = None,
    parallelism: int = 4,
) -> FoldFits:
    """Fit one model per fold on the other rows and score the fold's own rows.

    ``positions`` restricts the features to some entries of the vector. At most ``parallelism`` fits run at a time.
    """
    column = VECTOR
    n_features = len(positions) if positions is not None else _width(data)
    if positions is not None:
        column = _SLICE
        slicer = VectorSlicer(inputCol=VECTOR, outputCol=column, indices=list(positions))
        data = slicer.transform(data).drop(VECTOR)
    ready = with_columns_set(estimator, column)
    models = dict(zip(folds, fit_tables([train_rows(data, f) for f in folds], ready, data.count(), n_features, parallelism)))
    scored = reduce(DataFrame.unionByName, [score_rows(models[f], test_rows(data, f)) for f in folds])
    return FoldFits(models, scored)


def out_of_fold(pair: ShiftPair, estimator: Estimator, k: int = 5, seed: int | str = 0, parallelism: int = 4) -> DataFrame:
    """``(key, label, fold, prediction, p1)``: every row scored once, by a model that never saw it."""
    folded = stratified_folds(pair.labelled(), pair.key, k, seed)
    with cached(folded, lambda rows: assemble(rows, pair.features)) as data:
        fits = fit_folds(data, estimator, range(k), parallelism=parallelism)
        return materialize(fits.scored, "out-of-fold")
