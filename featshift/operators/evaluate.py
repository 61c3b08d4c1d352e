"""Score tables: any set of metrics over a scored table, per group."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from featshift.functions.scores import RANKING, Scored, metric_column
from featshift.operators.rank import in_order, running_totals
from featshift.storage import materialize


def evaluate(scored: DataFrame, metrics: Sequence[str], by: Sequence[str] = (), columns: Scored = Scored()) -> DataFrame:
    """Long score table ``(by..., metric, value)``."""
    by = list(by)
    plain = [m for m in metrics if m not in RANKING]
    parts = []
    if plain:
        row = scored.groupBy(*by).agg(*[metric_column(m, columns).alias(f"m{i}") for i, m in enumerate(plain)])
        entries = [
            F.struct(F.lit(m).alias("metric"), F.col(f"m{i}").cast("double").alias("value"))
            for i, m in enumerate(plain)
        ]
        parts.append(row.select(*by, F.inline(F.array(*entries))))
    ranking = [m for m in metrics if m in RANKING]
    if ranking:
        parts.append(ranking_scores(scored, by, columns).filter(F.col("metric").isin(ranking)))
    return reduce(DataFrame.unionByName, parts)


def ranking_scores(scored: DataFrame, by: Sequence[str] = (), columns: Scored = Scored()) -> DataFrame:
    """``roc_auc`` and ``average_precision`` per group, from counts per distinct probability.

    Equal probabilities are folded together before any shuffle of rows, and the
    running counts go through ranges of them, so neither a frequent
    probability nor one large group ends up in a single task.
    """
    by = list(by)
    is_query = F.col(columns.label) == 1
    counts = scored.groupBy(*by, F.col(columns.p1).alias("_p")).agg(
        F.count_if(is_query).alias("_pos"), F.count_if(~is_query).alias("_neg")
    )
    # Counted, sampled and shuffled below; the scored rows are made once.
    counts = materialize(counts, "score-counts")
    ranges = in_order(counts, [*by, F.desc("_p")], counts.count())
    running = running_totals(
        ranges, {"_cpos": F.col("_pos"), "_cneg": F.col("_neg")}, F.col("_bucket"), [F.desc("_p")], by
    )
    # Going down in p: each negative outranked by _cpos - _pos positives, half for its ties.
    wins = F.col("_neg") * (F.col("_cpos") - F.col("_pos") + F.col("_pos") / 2)
    precision = F.col("_pos") * F.col("_cpos") / (F.col("_cpos") + F.col("_cneg"))
    row = running.groupBy(*by).agg(
        F.sum(wins).alias("_wins"),
        F.sum(precision).alias("_precision"),
        F.sum("_pos").alias("_all_pos"),
        F.sum("_neg").alias("_all_neg"),
    )
    pairs = F.col("_all_pos").cast("double") * F.col("_all_neg")
    auc = F.when(pairs > 0, F.col("_wins") / pairs)
    ap = F.when(F.col("_all_pos") > 0, F.col("_precision") / F.col("_all_pos"))
    entries = [
        F.struct(F.lit(n).alias("metric"), v.cast("double").alias("value"))
        for n, v in (("roc_auc", auc), ("average_precision", ap))
    ]
    return row.select(*by, F.inline(F.array(*entries)))


def fold_mean_std(scores: DataFrame, by: Sequence[str] = ("iteration",)) -> DataFrame:
    """Mean and population deviation over folds, per group and metric."""
    return scores.groupBy(*by, "metric").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.count("*").alias("folds")
    )


def localization_f1(report: DataFrame, truth: DataFrame, run: str = "run_id") -> DataFrame:
    """F1 of the located features against the truth after 0, 1, 2, ... iterations.

    ``report`` has (run, feature, ranking), ``truth`` has (run, feature, is_corrupted).
    Iteration i counts the features found in the iterations before i; nothing found
    and nothing corrupted scores 1.
    """
    joined = report.select(run, "feature", "ranking").join(truth.select(run, "feature", "is_corrupted"), [run, "feature"])
    found_at = F.when(F.col("ranking") > 0, F.col("ranking"))
    per_step = joined.groupBy(run, found_at.alias("_found_at")).agg(
        F.count_if(F.col("is_corrupted") == 1).alias("_tp"), F.count_if(F.col("is_corrupted") == 0).alias("_fp")
    )
    totals = per_step.groupBy(run).agg(
        F.sum("_tp").alias("_true"), F.coalesce(F.max("_found_at"), F.lit(0)).alias("_last")
    )
    steps = totals.select(run, "_true", F.explode(F.sequence(F.lit(1), F.col("_last") + 1)).alias("iteration"))
    earlier = per_step.filter(F.col("_found_at").isNotNull()).select(
        run, (F.col("_found_at") + 1).alias("iteration"), "_tp", "_fp"
    )
    so_far = W.partitionBy(run).orderBy("iteration").rowsBetween(W.unboundedPreceding, 0)
    counted = steps.join(earlier, [run, "iteration"], "left").select(
        run,
        "iteration",
        "_true",
        F.sum(F.coalesce("_tp", F.lit(0))).over(so_far).alias("tp"),
        F.sum(F.coalesce("_fp", F.lit(0))).over(so_far).alias("fp"),
    )
    bottom = 2 * F.col("tp") + F.col("fp") + (F.col("_true") - F.col("tp"))
    return counted.select(
        run, "iteration", "tp", "fp", F.when(bottom > 0, 2.0 * F.col("tp") / bottom).otherwise(1.0).alias("f1")
    )
