"""Detect a shift and locate the features behind it."""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Model
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featshift.config import LocateConfig
from featshift.functions.scores import tvd_from_accuracy
from featshift.operators import knee as K
from featshift.operators.discriminate import assemble, cached, fit_folds, fold_numbers, importances_of
from featshift.operators.evaluate import evaluate, fold_mean_std
from featshift.operators.locating import (
    cut_limits, feature_cut, feature_report, normalised_importance, patience_stop, stop_reason,
)
from featshift.operators.prepare import custom_folds, stratified_folds, stratified_holdout
from featshift.sources.pair import ShiftPair

SCORES = "iteration int, fold int, metric string, value double"
CURVE = "run_id int, iteration int, x int, y double"
CUTS = "feature string, position int, importance double, iteration int"
LOG = "iteration int, n_features int, removed int, score double, detected int, stop string, seconds double"
FEATURES = "feature string, position int"


@dataclass(frozen=True)
class DetectionResult:
    """``scores`` per fold and metric, ``summary`` with mean, std and implied TVD, and the models."""

    scores: DataFrame
    summary: DataFrame
    seconds: float
    models: dict[tuple[int, int], Model]


@dataclass(frozen=True)
class LocationResult:
    """``report`` holds mask, ranking and importance per feature, already trimmed to the knee.

    ``scores``, ``cuts`` and ``log`` are trimmed too; ``curve`` covers all iterations.
    ``pending`` is the cut found when the loop ended, which is not applied.
    """

    report: DataFrame
    scores: DataFrame
    summary: DataFrame
    cuts: DataFrame
    pending: DataFrame
    curve: DataFrame
    log: DataFrame
    n_iterations: int
    n_corrupted: int
    models: dict[tuple[int, int], Model]


def prepare_folds(pair: ShiftPair, config: LocateConfig, folds: DataFrame | None) -> DataFrame:
    """Labelled rows with missing values filled and a fold column."""
    rows = pair.with_missing_filled().labelled()
    if folds is not None:
        return custom_folds(rows, folds, pair.key)
    if isinstance(config.cv, str):
        raise ValueError("pass the table with the fold column as `folds`")
    if config.cv is None:
        return stratified_holdout(rows, pair.key, config.test_size, config.random_state)
    return stratified_folds(rows, pair.key, config.cv, config.random_state)


def _fold_table(folds: DataFrame | None, config: LocateConfig, pair: ShiftPair) -> DataFrame | None:
    if folds is None or not isinstance(config.cv, str):
        return folds
    return folds.withColumn("fold", F.col(config.cv).cast("int"))


def _summary(scores: DataFrame) -> DataFrame:
    per_metric = fold_mean_std(scores, ["iteration"])
    tvd = F.when(F.col("metric") == "balanced_accuracy", tvd_from_accuracy(F.col("mean")))
    return per_metric.withColumn("tvd", tvd)


class _Rounds:
    """Runs one iteration after another over the same cached, folded table."""

    def __init__(self, data: DataFrame, pair: ShiftPair, config: LocateConfig) -> None:
        self.spark: SparkSession = data.sparkSession
        self.data, self.pair, self.config = data, pair, config
        self.folds = fold_numbers(data)
        self.scores: list[tuple] = []
        self.models: dict[tuple[int, int], Model] = {}

    def run(self, iteration: int, positions: Sequence[int]) -> tuple[float, list[tuple]]:
        """Mean balanced accuracy and the importance rows of this iteration."""
        everything = len(positions) == len(self.pair.features)
        fits = fit_folds(
            self.data, self.config.estimator, self.folds, None if everything else positions, self.config.parallelism
        )
        rows = evaluate(fits.scored, self.config.scoring, ["fold"]).collect()
        self.scores += [(iteration, int(r["fold"]), r["metric"], r["value"]) for r in rows]
        if self.config.return_estimator:
            self.models.update({(iteration, f): m for f, m in fits.models.items()})
        accuracy = [r["value"] for r in rows if r["metric"] == "balanced_accuracy"]
        importances = [
            (0, fold, self.pair.features[p], p, value)
            for fold, model in fits.models.items()
            for p, value in zip(positions, importances_of(model))
        ]
        return sum(accuracy) / len(accuracy), importances


def detect_shift(pair: ShiftPair, config: LocateConfig | None = None, folds: DataFrame | None = None) -> DetectionResult:
    """Cross-validated two-sample test: can a discriminator tell query from reference?"""
    config = config or LocateConfig()
    start = time.time()
    folded = prepare_folds(pair, config, _fold_table(folds, config, pair))
    with cached(folded, lambda rows: assemble(rows, pair.features)) as data:
        rounds = _Rounds(data, pair, config)
        rounds.run(1, range(len(pair.features)))
    scores = rounds.spark.createDataFrame(rounds.scores, SCORES)
    return DetectionResult(scores, _summary(scores), time.time() - start, rounds.models)


def locate_shift(pair: ShiftPair, config: LocateConfig | None = None, folds: DataFrame | None = None) -> LocationResult:
    """Remove the features that drive the shift, round by round, and stop at the knee.

    The folded table is assembled and cached once; later rounds slice its vector.
    Only importances and scores (a few numbers per feature and fold) reach the driver.
    """
    config = config or LocateConfig()
    spark = pair.reference.sparkSession
    remaining = list(range(len(pair.features)))
    removed: list[tuple] = []
    pending: list[tuple] = []
    curve: list[tuple] = []
    log: list[tuple] = []
    folded = prepare_folds(pair, config, _fold_table(folds, config, pair))
    with cached(folded, lambda rows: assemble(rows, pair.features)) as data:
        rounds = _Rounds(data, pair, config)
        while True:
            start = time.time()
            if pending:
                removed += [(*cut, len(curve)) for cut in pending]
                gone = {cut[1] for cut in pending}
                remaining = [p for p in remaining if p not in gone]
            iteration = len(curve) + 1
            score, importances = rounds.run(iteration, remaining)
            curve.append((0, iteration, len(removed), score))
            pending, stop = _next_cut(spark, config, pair, remaining, removed, curve, importances)
            if stop is None and len(pending) == len(remaining):
                stop = "no feature left"
            log.append((iteration, len(remaining), len(removed), score, len(pending), stop, time.time() - start))
            if stop is not None:
                break
    return _result(spark, pair, config, rounds, removed, pending, curve, log)


def _next_cut(spark, config, pair, remaining, removed, curve, importances) -> tuple[list[tuple], str | None]:
    """The next cut as (feature, position, importance) and the stop reason, if any."""
    iteration, score = len(curve), curve[-1][3]
    state = spark.createDataFrame(
        [(0, len(remaining), len(pair.features), len(removed), score, iteration)],
        "run_id int, n_features int, n_input int, removed int, score double, iteration int",
    )
    limits = cut_limits(
        state, config.step, config.percentage, config.alpha, config.threshold, config.max_features_to_filter
    )
    table = spark.createDataFrame(
        importances, "run_id int, fold int, feature string, position int, importance double"
    )
    cut = feature_cut(normalised_importance(table), limits).orderBy("cut_rank").collect()
    out_of_patience = False
    if config.patience is not None:
        points = spark.createDataFrame(curve, CURVE).withColumn("score", F.col("y"))
        out_of_patience = patience_stop(points, config.patience).first()["stop_iteration"] is not None
    decided = limits.withColumn("detected", F.lit(len(cut))).withColumn("out_of_patience", F.lit(out_of_patience))
    reason = decided.select(stop_reason(config.margin, config.max_it).alias("stop")).first()["stop"]
    return [(c["feature"], c["position"], c["importance"]) for c in cut], reason


def _result(spark, pair, config, rounds, removed, pending, curve, log) -> LocationResult:
    run = F.lit(0).alias("run_id")
    features = spark.createDataFrame(list(zip(pair.features, range(len(pair.features)))), FEATURES)
    cuts = spark.createDataFrame(removed, CUTS)
    scores = spark.createDataFrame(rounds.scores, SCORES)
    run_log = spark.createDataFrame(log, LOG)
    points = spark.createDataFrame(curve, CURVE)
    report = feature_report(features, cuts).select(run, "*")
    models = rounds.models
    if config.find_best == "knee-balanced" and len(curve) > 1:
        walked = K.walk_curves(points, config.window_length, config.polyorder, config.sensitivity, config.no_knee)
        found = walked.filter("position = 1").first()
        last, x = (found["iteration_online"], found["online_x"]) if config.online else (found["iteration_knee"], found["knee_x"])
    else:
        walked = points.select("run_id", F.col("iteration").alias("position"), "x", F.col("y").alias("y_raw"), "y")
        last, x = curve[-1][1], curve[-1][2]
    knees = spark.createDataFrame([(0, x, last)], "run_id int, knee_x int, iteration_knee int")
    # The cut of iteration i is applied in round i + 1, so rankings run below the last round.
    report = K.trim_report(report, knees).drop("run_id")
    scores = scores.filter(F.col("iteration") <= last)
    return LocationResult(
        report=report,
        scores=scores,
        summary=_summary(scores),
        cuts=cuts.filter(F.col("iteration") < last),
        pending=spark.createDataFrame(pending, "feature string, position int, importance double"),
        curve=K.curve_table(walked.withColumn("knee_x", F.lit(x)), len(pair.features)).drop("run_id"),
        log=run_log.filter(F.col("iteration") <= last),
        n_iterations=last,
        n_corrupted=x,
        models={(i, f): m for (i, f), m in models.items() if i <= last},
    )
