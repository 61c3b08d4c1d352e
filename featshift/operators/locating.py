"""The set-based steps of localisation: importances, the cut, limits and stop rules.

Every function works on many runs at once, one group of rows per run; a run has
at most one row per feature or per iteration.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PATIENCE_RESET = 0.8


def normalised_importance(importances: DataFrame, by: Sequence[str] = ("run_id",)) -> DataFrame:
    """Mean over folds of the signed importances, then its size as a share of the run's total.

    A feature without a row in some fold counts as 0 there.
    """
    by = list(by)
    folds = importances.groupBy(*by).agg(F.count_distinct("fold").alias("_folds"))
    sums = importances.groupBy(*by, "feature", "position").agg(F.sum("importance").alias("_sum"))
    joined = sums.join(folds, by)
    size = F.abs(F.col("_sum") / F.col("_folds"))
    total = F.sum(size).over(W.partitionBy(*by))
    return joined.select(
        *by, "feature", "position", F.when(total > 0, size / total).otherwise(0.0).alias("importance")
    )


def cut_limits(
    state: DataFrame,
    step: float | None = None,
    percentage: float | None = None,
    alpha: float | None = None,
    threshold: float | None = None,
    max_features: float | None = None,
) -> DataFrame:
    """Add the limits of the next cut to rows with ``n_features``, ``n_input``, ``removed`` and ``score``.

    ``step`` and ``cap`` may be given as fractions (of the remaining and of the
    input features); the percentage shrinks with the balanced accuracy ``score``.
    """
    def whole(value: float | None, of: str) -> Column:
        if value is None:
            return F.lit(None).cast("int")
        if value < 1:
            return F.floor(F.lit(value) * F.col(of)).cast("int")
        return F.lit(int(value))

    share = F.lit(None).cast("double") if percentage is None else F.lit(percentage) * 2 * (F.col("score") - 0.5)
    if alpha is not None:
        least = F.lit(float(alpha)) / F.col("n_features")
    else:
        least = F.lit(float(threshold or 0.0))
    return (
        state.withColumn("step", whole(step, "n_features"))
        .withColumn("total_cap", whole(max_features, "n_input"))
        .withColumn("cap", F.col("total_cap") - F.col("removed"))
        .withColumn("percentage", share)
        .withColumn("threshold", least)
    )


def feature_cut(importance: DataFrame, limits: DataFrame, by: Sequence[str] = ("run_id",)) -> DataFrame:
    """Features to remove next: ``(by..., feature, position, importance, cut_rank)``.

    From the largest importance down while it exceeds the threshold, within step and
    cap; the feature that carries the running total over the percentage is still
    taken, and the first feature never fails that test. Ties go to the lower position.
    """
    by = list(by)
    order = W.partitionBy(*by).orderBy(F.desc("importance"), "position")
    before = F.sum("importance").over(order.rowsBetween(W.unboundedPreceding, -1))
    ranked = importance.withColumn("cut_rank", F.row_number().over(order)).withColumn("_before", before)
    limited = ranked.join(limits.select(*by, "step", "cap", "percentage", "threshold"), by)
    within = (
        (F.col("importance") > F.col("threshold"))
        & (F.col("step").isNull() | (F.col("cut_rank") <= F.col("step")))
        & (F.col("cap").isNull() | (F.col("cut_rank") <= F.col("cap")))
        & (F.col("percentage").isNull() | (F.col("cut_rank") == 1) | (F.col("_before") <= F.col("percentage")))
    )
    return limited.filter(within).select(*by, "feature", "position", "importance", "cut_rank")


def patience_column(iterations: Column, patience: int) -> Column:
    """First iteration at which patience runs out, from an array of ``(iteration, score)``; else NULL.

    A lower score, or one of at least 0.8, resets both the counter and the best score.
    """
    if patience < 1:
        raise ValueError("patience must be at least 1")
    start = F.struct(
        F.lit(None).cast("double").alias("best"), F.lit(0).alias("waited"), F.lit(None).cast("int").alias("stop")
    )

    def advance(state: Column, point: Column) -> Column:
        score = point["score"]
        first = state["best"].isNull()
        better = (score < state["best"]) | (score >= PATIENCE_RESET)
        waited = F.when(first | better, 0).otherwise(state["waited"] + 1)
        return F.struct(
            F.when(first | better, score).otherwise(state["best"]).alias("best"),
            waited.alias("waited"),
            F.coalesce(state["stop"], F.when(waited >= patience, point["iteration"])).alias("stop"),
        )

    return F.aggregate(F.array_sort(iterations), start, advance, lambda s: s["stop"])


def patience_stop(curve: DataFrame, patience: int, by: Sequence[str] = ("run_id",)) -> DataFrame:
    """``(by..., stop_iteration)`` from rows ``(by..., iteration, score)``."""
    points = F.collect_list(
        F.struct(F.col("iteration").cast("int").alias("iteration"), F.col("score").cast("double").alias("score"))
    )
    grouped = curve.groupBy(*by).agg(points.alias("_points"))
    return grouped.select(*by, patience_column(F.col("_points"), patience).alias("stop_iteration"))


def stop_reason(margin: float | None = 0.01, max_it: int | None = None) -> Column:
    """Why a run ends at this iteration (NULL: it goes on), tested in a fixed order.

    Reads ``detected``, ``n_features``, ``score``, ``removed``, ``total_cap``,
    ``iteration`` and ``out_of_patience``.
    """
    reason = F.when(F.col("detected") == 0, "nothing detected").when(F.col("n_features") == 0, "no feature left")
    if margin is not None:
        reason = reason.when(F.col("score") < 0.5 + margin, "score within margin")
    reason = reason.when(F.col("removed") >= F.col("total_cap"), "feature limit")
    if max_it is not None:
        reason = reason.when(F.col("iteration") == max_it, "iteration limit")
    return reason.when(F.col("out_of_patience"), "patience")


def feature_report(features: DataFrame, cuts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(by..., feature, position, mask, ranking, importance)``.

    ``cuts`` has one row per removed feature with the ``iteration`` that removed it.
    """
    keys = [*by, "feature"]
    found = cuts.select(*keys, F.col("iteration").alias("ranking"), F.col("importance"))
    return features.select(*keys, "position").join(found, keys, "left").select(
        *keys,
        "position",
        F.when(F.col("ranking").isNotNull(), 1).otherwise(0).alias("mask"),
        F.coalesce("ranking", F.lit(0)).alias("ranking"),
        F.coalesce("importance", F.lit(0.0)).alias("importance"),
    )
