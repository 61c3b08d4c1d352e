"""Registered queries: score aggregations on closed-form scored tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from featshift.catalog.base import SQL_IM, Query, long, part_importances, r, scored_events, sql_scored
from featshift.functions.scores import CORRECT_CLIP, Scored, tvd_from_accuracy
from featshift.operators.evaluate import evaluate, fold_mean_std, localization_f1
from featshift.operators.locating import normalised_importance


def _scores(metrics: Sequence[str], clip: float = 1e-4, wide: bool = False) -> Callable[[SparkSession, str], DataFrame]:
    def build(spark: SparkSession, d: str) -> DataFrame:
        out = evaluate(scored_events(spark, d, wide), metrics, ["fold"], Scored(clip=clip))
        return out.select(long("fold").alias("fold"), "metric", r("value").alias("value"))

    return build


def _sql(entries: dict[str, str], wide: bool = False, extra: str = "") -> str:
    picked = ", ".join(f"{e} AS {n}" for n, e in entries.items())
    union = " UNION ALL ".join(
        f"SELECT CAST(fold AS BIGINT) AS fold, '{n}' AS metric, round({n}, 4) + 0.0 AS value FROM agg" for n in entries
    )
    return f"WITH {sql_scored(wide)}{extra}, agg AS (SELECT fold, {picked} FROM sc GROUP BY fold) {union}"


def _clipped(p: str, clip: float) -> str:
    return f"least({1.0 - clip!r}, greatest({clip!r}, {p}))"


def _jd(p: str) -> str:
    return (f"greatest(0.0, 0.5 * (avg(ln({p})) FILTER (label = 1) + avg(ln(1.0 - {p})) FILTER (label = 0) + ln(4.0)))")


def _kl(p: str, minus_one: str, first: int) -> str:
    ratio = f"({p} / (1.0 - {p}))"
    return (f"greatest(0.0, avg(ln({ratio})) FILTER (label = {first}) - avg({ratio}{minus_one}) FILTER (label = {1 - first}))")


_LOCATE_P, _CORRECT_P = _clipped("p1", 1e-4), _clipped("p1", 1e-3)
_TP, _FP, _FN, _TN = (
    f"CAST(count(*) FILTER (label = {a} AND prediction = {b}) AS DOUBLE)" for a, b in ((1, 1), (0, 1), (1, 0), (0, 0))
)
_BA = "(avg(prediction) FILTER (label = 1) + avg(1 - prediction) FILTER (label = 0)) / 2"
_CONFUSION = {
    "accuracy": "avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END)",
    "precision": f"{_TP} / ({_TP} + {_FP})",
    "recall": f"{_TP} / ({_TP} + {_FN})",
    "f1": f"2 * {_TP} / (2 * {_TP} + {_FP} + {_FN})",
    "jaccard": f"{_TP} / ({_TP} + {_FP} + {_FN})",
    "matthews_corrcoef": "corr(label, prediction)",
    "cohen_kappa": f"""({_TP} + {_TN} - (({_TP} + {_FP}) * ({_TP} + {_FN}) + ({_TN} + {_FN}) * ({_TN} + {_FP})) / count(*))
      / (count(*) - (({_TP} + {_FP}) * ({_TP} + {_FN}) + ({_TN} + {_FN}) * ({_TN} + {_FP})) / count(*))""",
    "zero_one_loss": "avg(CASE WHEN label <> prediction THEN 1.0 ELSE 0.0 END)",
    "log_loss": "-avg(CASE WHEN label = 1 THEN ln(greatest(p1, 1e-15)) ELSE ln(greatest(1.0 - p1, 1e-15)) END)",
    "brier": "avg((p1 - label) * (p1 - label))",
}

_RANKING_SQL = f"""WITH {sql_scored()},
per_p AS (SELECT fold, p1, sum(label) AS pos, sum(1 - label) AS neg FROM sc GROUP BY fold, p1),
cum AS (SELECT *, sum(pos) OVER w AS cpos, sum(neg) OVER w AS cneg FROM per_p WINDOW w AS (PARTITION BY fold ORDER BY p1 DESC)),
agg AS (SELECT fold, sum(neg * (cpos - pos / 2.0)) / (CAST(sum(pos) AS DOUBLE) * sum(neg)) AS auc,
               sum(pos * cpos / CAST(cpos + cneg AS DOUBLE)) / sum(pos) AS ap FROM cum GROUP BY fold)
SELECT CAST(fold AS BIGINT) AS fold, 'roc_auc' AS metric, round(auc, 4) + 0.0 AS value FROM agg
UNION ALL SELECT CAST(fold AS BIGINT), 'average_precision', round(ap, 4) + 0.0 FROM agg"""


def tvd_query(spark: SparkSession, d: str) -> DataFrame:
    scores = evaluate(scored_events(spark, d), ["balanced_accuracy"], ["fold"])
    return scores.select(
        long("fold").alias("fold"), r("value").alias("balanced_accuracy"), r(tvd_from_accuracy(F.col("value"))).alias("tvd")
    )


def fold_summary(spark: SparkSession, d: str) -> DataFrame:
    scores = evaluate(scored_events(spark, d), ["balanced_accuracy", "JD", "TV"], ["fold"])
    return fold_mean_std(scores.withColumn("iteration", F.lit(1)), ["iteration"]).select(
        long("iteration").alias("iteration"), "metric", r("mean").alias("mean"), r("std").alias("std"), "folds"
    )


def localization(spark: SparkSession, d: str) -> DataFrame:
    """Features ranked two per iteration by importance, against a fixed set of corrupted positions."""
    importance = normalised_importance(part_importances(spark, d), ["run_id"])
    order = W.partitionBy("run_id").orderBy(F.desc("importance"), "position")
    place = F.row_number().over(order)
    report = importance.withColumn("ranking", F.when(place <= 6, F.ceil(place / 2)).otherwise(0).cast("int"))
    truth = importance.select("run_id", "feature", (F.col("position") < 4).cast("int").alias("is_corrupted"))
    return localization_f1(report, truth).select(
        "run_id", long("iteration").alias("iteration"), long("tp").alias("tp"), long("fp").alias("fp"), r("f1").alias("f1")
    )


_LOCALIZATION_SQL = f"""WITH {SQL_IM},
means AS (SELECT run_id, feature, position, abs(sum(importance) / (SELECT count(DISTINCT fold) FROM im i2 WHERE i2.run_id = im.run_id)) AS m
          FROM im GROUP BY run_id, feature, position),
norm AS (SELECT *, m / sum(m) OVER (PARTITION BY run_id) AS importance FROM means),
placed AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY importance DESC, position) AS place FROM norm),
rep AS (SELECT run_id, feature, CASE WHEN place <= 6 THEN (place + 1) // 2 ELSE 0 END AS ranking,
               CASE WHEN position < 4 THEN 1 ELSE 0 END AS truth FROM placed),
steps AS (SELECT run_id, unnest(range(1, max(ranking) + 2)) AS iteration FROM rep GROUP BY run_id),
counts AS (SELECT s.run_id, s.iteration,
                  count(*) FILTER (ranking > 0 AND ranking < iteration AND truth = 1) AS tp,
                  count(*) FILTER (ranking > 0 AND ranking < iteration AND truth = 0) AS fp, sum(truth) AS total
           FROM steps s JOIN rep USING (run_id) GROUP BY s.run_id, s.iteration)
SELECT run_id, CAST(iteration AS BIGINT) AS iteration, tp, fp, round(CASE WHEN tp + fp + total = 0 THEN 1.0
       ELSE 2.0 * tp / (2 * tp + fp + (total - tp)) END, 4) + 0.0 AS f1 FROM counts"""

QUERIES = [
    Query("score_balanced_accuracy", _scores(["balanced_accuracy"]), _sql({"balanced_accuracy": _BA})),
    Query("score_confusion_metrics", _scores(list(_CONFUSION)), _sql(_CONFUSION)),
    Query("score_ranking_metrics", _scores(["roc_auc", "average_precision"]), _RANKING_SQL),
    Query("score_d1_d2_d3", _scores(["D1", "D2", "D3"]), _sql({
        "D1": "2 * ln(avg(p1))", "D2": "ln(avg(p1) / avg(1.0 - p1))", "D3": "ln(avg(1.0 - p1) / avg(p1))"})),
    Query("score_jd", _scores(["JD"]), _sql({"JD": _jd(_LOCATE_P)})),
    Query("score_kl", _scores(["KL"]), _sql({"KL": _kl(_LOCATE_P, " - 1", 1)})),
    Query("score_kl_raw", _scores(["KL_raw"], CORRECT_CLIP, True), _sql({"KL_raw": _kl(_CORRECT_P, "", 1)}, True)),
    Query("score_tv", _scores(["TV"]), _sql({
        "TV": "greatest(0.0, avg(sign(p1 - 0.5) / 2) FILTER (label = 1) - avg(sign(p1 - 0.5) / 2) FILTER (label = 0))"})),
    Query("score_skl", _scores(["SKL"], CORRECT_CLIP, True), _sql({
        "SKL": _kl(_CORRECT_P, "", 1) + " + " + _kl(_clipped("1.0 - p1", 1e-3), "", 0)}, True)),
    Query("score_jsd_inverse", _scores(["JD_inverse"], CORRECT_CLIP), _sql({"JD_inverse": _jd(_clipped("1.0 - p1", 1e-3))})),
    Query("tvd_from_accuracy", tvd_query, f"""WITH {sql_scored()}, agg AS (SELECT fold, {_BA} AS ba FROM sc GROUP BY fold)
SELECT CAST(fold AS BIGINT) AS fold, round(ba, 4) + 0.0 AS balanced_accuracy, round(greatest(0.0, 2 * ba - 1), 4) + 0.0 AS tvd FROM agg"""),
    Query("fold_mean_std", fold_summary, f"""WITH {sql_scored()},
agg AS (SELECT fold, {_BA} AS balanced_accuracy, {_jd(_LOCATE_P)} AS JD,
   greatest(0.0, avg(sign(p1 - 0.5) / 2) FILTER (label = 1) - avg(sign(p1 - 0.5) / 2) FILTER (label = 0)) AS TV FROM sc GROUP BY fold),
flat AS (SELECT 'balanced_accuracy' AS metric, balanced_accuracy AS v FROM agg UNION ALL SELECT 'JD', JD FROM agg UNION ALL SELECT 'TV', TV FROM agg)
SELECT CAST(1 AS BIGINT) AS iteration, metric, round(avg(v), 4) + 0.0 AS mean, round(stddev_pop(v), 4) + 0.0 AS std, count(*) AS folds
FROM flat GROUP BY metric"""),
    Query("localization_f1", localization, _LOCALIZATION_SQL),
]
