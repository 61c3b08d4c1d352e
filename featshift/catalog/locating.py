"""Registered queries: discriminators, detection, localisation and its set-based rules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Estimator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featshift.catalog.base import (
    LI_KEY, SQL_CV, SQL_IM, Query, customer_curves, embeddings, events_pair, lineitem_pair, long,
    part_importances, r,
)
from featshift.config import LocateConfig
from featshift.operators.corrupt import corrupt_features
from featshift.operators.discriminate import boosted_trees, logistic, out_of_fold, random_forest
from featshift.operators.evaluate import evaluate
from featshift.operators.locating import (
    cut_limits, feature_cut, feature_report, normalised_importance, patience_stop, stop_reason,
)
from featshift.plans.locate import detect_shift, locate_shift
from featshift.sources.pair import ShiftPair

DIM = 64


def embedding_pair(spark: SparkSession, d: str) -> ShiftPair:
    """All 64 dimensions as scalar features; labels 0-4 are the reference."""
    names = [f"e{i}" for i in range(DIM)]
    wide = embeddings(spark, d).select("vec_id", "label", *[F.col("vec")[i].alias(n) for i, n in enumerate(names)])
    return ShiftPair.from_predicate(wide, F.col("label") < 5, ("vec_id",), names)


def shifted_lineitem(spark: SparkSession, d: str) -> ShiftPair:
    """Line item halves whose query has two corrupted features."""
    pair = lineitem_pair(spark, d, stored=True)
    query = corrupt_features(pair.query, LI_KEY, ("l_quantity",), 5, 1)
    query = corrupt_features(query, LI_KEY, ("l_discount",), 1, 1)
    return ShiftPair(pair.reference, query, pair.features, pair.key)


def _discriminate(estimator: Callable[[], Estimator], source: Callable[[SparkSession, str], ShiftPair]):
    def build(spark: SparkSession, d: str) -> DataFrame:
        scored = out_of_fold(source(spark, d), estimator(), 5, 0)
        return evaluate(scored, ["balanced_accuracy", "roc_auc", "TV", "JD"], ["fold"]).select(
            long("fold").alias("fold"), "metric", r("value").alias("value")
        )

    return build


def oof(spark: SparkSession, d: str) -> DataFrame:
    scored = out_of_fold(embedding_pair(spark, d), logistic(), 5, 0)
    return scored.select("vec_id", long("label").alias("label"), long("fold").alias("fold"), r("p1").alias("p1"))


def detection(spark: SparkSession, d: str) -> DataFrame:
    config = LocateConfig(estimator=logistic(), scoring=("balanced_accuracy", "TV", "JD"))
    return detect_shift(events_pair(spark, d), config).summary.select(
        long("iteration").alias("iteration"), "metric", r("mean").alias("mean"), r("std").alias("std"), r("tvd").alias("tvd")
    )


def _located(spark: SparkSession, d: str):
    return locate_shift(shifted_lineitem(spark, d), LocateConfig())


def location(spark: SparkSession, d: str) -> DataFrame:
    return _located(spark, d).curve.select(
        long("x").alias("x"), r("tvd").alias("tvd"), r("tvd_smooth").alias("tvd_smooth"),
        r("percent_removed").alias("percent_removed"), long("is_knee").alias("is_knee"),
    )


def report(spark: SparkSession, d: str) -> DataFrame:
    return _located(spark, d).report.select(
        "feature", long("position").alias("position"), long("mask").alias("mask"), long("ranking").alias("ranking"),
        r("importance").alias("importance"),
    )


# --- set-based rules on recorded importances and curves ------------------------------


def mean_importance(spark: SparkSession, d: str) -> DataFrame:
    return normalised_importance(part_importances(spark, d)).select(
        "run_id", "feature", long("position").alias("position"), r("importance", 6).alias("importance")
    )


def _state(importance: DataFrame) -> DataFrame:
    """One state row per run; the score depends on the run's largest importance."""
    return importance.groupBy("run_id").agg(
        F.count("*").alias("n_features"), F.lit(10).alias("n_input"), F.lit(1).alias("removed"),
        (0.45 + F.max("importance")).alias("score"),
    )


_SETTINGS = {
    "percentage": dict(percentage=0.6, alpha=0.5),
    "step": dict(step=0.4, alpha=0.2),
    "cap": dict(threshold=0.05, max_features=0.4),
}


def cut(spark: SparkSession, d: str) -> DataFrame:
    importance = normalised_importance(part_importances(spark, d))
    state = _state(importance)
    parts = [
        feature_cut(importance, cut_limits(state, **kwargs)).select(
            F.lit(name).alias("setting"), "run_id", "feature", long("cut_rank").alias("cut_rank"),
            r("importance", 6).alias("importance"),
        )
        for name, kwargs in _SETTINGS.items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def recorded_report(spark: SparkSession, d: str) -> DataFrame:
    importance = normalised_importance(part_importances(spark, d))
    taken = feature_cut(importance, cut_limits(_state(importance), **_SETTINGS["percentage"]))
    cuts = taken.withColumn("iteration", F.ceil(F.col("cut_rank") / 2).cast("int"))
    return feature_report(importance, cuts, ["run_id"]).select(
        "run_id", "feature", long("position").alias("position"), long("mask").alias("mask"),
        long("ranking").alias("ranking"), r("importance", 6).alias("importance"),
    )


def _scored_curve(spark: SparkSession, d: str) -> DataFrame:
    return customer_curves(spark, d).withColumn("score", F.col("y"))


def patience(spark: SparkSession, d: str) -> DataFrame:
    return patience_stop(_scored_curve(spark, d), 2).select(
        "run_id", long(F.coalesce("stop_iteration", F.lit(0))).alias("stop_iteration")
    )


def stops(spark: SparkSession, d: str) -> DataFrame:
    curve = _scored_curve(spark, d)
    state = curve.join(patience_stop(curve, 2), "run_id").select(
        "run_id", "iteration", "score", F.col("x").alias("removed"), (90 - F.col("x")).alias("n_features"),
        F.lit(60).alias("total_cap"),
        F.when((F.col("run_id") + F.col("iteration")) % 11 == 0, 0).otherwise(3).alias("detected"),
        F.coalesce(F.col("iteration") >= F.col("stop_iteration"), F.lit(False)).alias("out_of_patience"),
    )
    return state.select(
        "run_id", long("iteration").alias("iteration"),
        F.coalesce(stop_reason(0.03, 9), F.lit("go on")).alias("reason"),
    )


_NORM = SQL_IM + """,
folds AS (SELECT run_id, count(DISTINCT fold) AS nf FROM im GROUP BY run_id),
means AS (SELECT run_id, feature, position, abs(sum(importance) / any_value(nf)) AS m FROM im JOIN folds USING (run_id) GROUP BY run_id, feature, position),
norm AS (SELECT run_id, feature, position, m / sum(m) OVER (PARTITION BY run_id) AS importance FROM means)"""
_CUT = _NORM + """,
st AS (SELECT run_id, count(*) AS nfeat, 0.45 + max(importance) AS score FROM norm GROUP BY run_id),
lim AS (
  SELECT 'percentage' AS setting, run_id, NULL AS step, NULL AS cap, 0.6 * 2 * (score - 0.5) AS pct, 0.5 / nfeat AS thr FROM st
  UNION ALL SELECT 'step', run_id, CAST(floor(0.4 * nfeat) AS BIGINT), NULL, NULL, 0.2 / nfeat FROM st
  UNION ALL SELECT 'cap', run_id, NULL, 4 - 1, NULL, 0.05 FROM st),
rk AS (SELECT *, row_number() OVER w AS rn, sum(importance) OVER (PARTITION BY run_id ORDER BY importance DESC, position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev
       FROM norm WINDOW w AS (PARTITION BY run_id ORDER BY importance DESC, position)),
cut AS (SELECT * FROM rk JOIN lim USING (run_id) WHERE importance > thr AND (step IS NULL OR rn <= step) AND (cap IS NULL OR rn <= cap)
        AND (pct IS NULL OR rn = 1 OR prev <= pct))"""
_PATIENCE = SQL_CV + """,
pts AS (SELECT run_id, iteration, y, row_number() OVER (PARTITION BY run_id ORDER BY iteration) AS i FROM cv)"""
_WALK = """,
walk AS (
  SELECT run_id, i, iteration, y AS best, 0 AS waited FROM pts WHERE i = 1
  UNION ALL
  SELECT p.run_id, p.i, p.iteration, CASE WHEN p.y < w.best OR p.y >= 0.8 THEN p.y ELSE w.best END,
         CASE WHEN p.y < w.best OR p.y >= 0.8 THEN 0 ELSE w.waited + 1 END
  FROM walk w JOIN pts p ON p.run_id = w.run_id AND p.i = w.i + 1),
stops AS (SELECT run_id, min(CASE WHEN waited >= 2 THEN iteration END) AS stop_iteration FROM walk GROUP BY run_id)"""

QUERIES = [
    Query("discriminate_forest", _discriminate(random_forest, embedding_pair)),
    Query("discriminate_boosted", _discriminate(boosted_trees, shifted_lineitem)),
    Query("discriminate_logistic", _discriminate(logistic, embedding_pair)),
    Query("oof_probabilities", oof),
    Query("shift_detection", detection),
    Query("shift_location", location),
    Query("feature_report", report),
    Query("mean_importance", mean_importance, f"""WITH {_NORM}
SELECT run_id, feature, CAST(position AS BIGINT) AS position, round(importance, 6) + 0.0 AS importance FROM norm"""),
    Query("feature_cut", cut, f"""WITH {_CUT}
SELECT setting, run_id, feature, rn AS cut_rank, round(importance, 6) + 0.0 AS importance FROM cut"""),
    Query("recorded_report", recorded_report, f"""WITH {_CUT}, mine AS (SELECT run_id, feature, (rn + 1) // 2 AS it, importance FROM cut WHERE setting = 'percentage')
SELECT n.run_id, n.feature, CAST(n.position AS BIGINT) AS position, CAST(mine.it IS NOT NULL AS BIGINT) AS mask, CAST(coalesce(mine.it, 0) AS BIGINT) AS ranking,
       round(coalesce(mine.importance, 0.0), 6) + 0.0 AS importance FROM norm n LEFT JOIN mine ON mine.run_id = n.run_id AND mine.feature = n.feature"""),
    Query("patience_rule", patience, f"WITH RECURSIVE {_PATIENCE}{_WALK} SELECT run_id, CAST(coalesce(stop_iteration, 0) AS BIGINT) AS stop_iteration FROM stops"),
    Query("stop_rule", stops, f"""WITH RECURSIVE {_PATIENCE}{_WALK}
SELECT run_id, CAST(iteration AS BIGINT) AS iteration, CASE WHEN (run_id + iteration) % 11 = 0 THEN 'nothing detected' WHEN 90 - x = 0 THEN 'no feature left'
  WHEN y < 0.53 THEN 'score within margin' WHEN x >= 60 THEN 'feature limit' WHEN iteration = 9 THEN 'iteration limit'
  WHEN iteration >= stop_iteration THEN 'patience' ELSE 'go on' END AS reason FROM cv JOIN stops USING (run_id)"""),
]
