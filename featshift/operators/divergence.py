"""Two-sample divergences and Bayes-error estimates built on the block joins.

Point tables have ``id`` and ``vec``; labelled ones also ``tag`` (0, 1, 2, ...).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.ml import Estimator
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from featshift.functions.scores import CORRECT_CLIP, Scored
from featshift.functions.weights import ensemble_weights
from featshift.operators.blocks import (
    check_dimension, fold_copies, kernel_sums, knn_join, neighbour_counts,
)
from featshift.operators.discriminate import logistic, out_of_fold
from featshift.operators.evaluate import evaluate
from featshift.operators.prepare import stratified_folds
from featshift.operators.rank import seeded_rank
from featshift.sources.pair import ShiftPair
from featshift.storage import materialize


def as_points(pair: ShiftPair) -> tuple[DataFrame, DataFrame]:
    """Reference and query with their features, missing values filled, in one vector and a single ``id`` column."""
    pair = pair.with_missing_filled()
    key = F.col(pair.key[0]) if len(pair.key) == 1 else F.concat_ws(":", *pair.key)
    vec = F.array(*[F.col(c).cast("double") for c in pair.features])
    return tuple(df.select(key.alias("id"), vec.alias("vec")) for df in (pair.reference, pair.query))


def labelled_points(reference: DataFrame, query: DataFrame) -> DataFrame:
    """Both samples with ``tag`` 0 / 1; text ids keep the two sides apart."""
    def side(df: DataFrame, tag: int) -> DataFrame:
        return df.select(F.concat_ws(":", F.lit(tag), "id").alias("id"), "vec", F.lit(tag).alias("tag"))

    return side(reference, 0).unionByName(side(query, 1))


# --- nearest-neighbour divergences ------------------------------------------------


def knn_kl(p: DataFrame, q: DataFrame, k: int = 1) -> DataFrame:
    """Nearest-neighbour estimate of KL(P || Q), one row.

    ``zero_own`` and ``zero_other`` count the rows whose k-th neighbour is at distance 0;
    their logarithm is infinite and left out of ``kl``.
    """
    dim = check_dimension(p, q)
    n, m = p.count(), q.count()
    other = knn_join(p, q, k).filter(F.col("rank") == k).select("id", F.col("distance").alias("nu"))
    own = knn_join(p, p, k, exclude_self=True).filter(F.col("rank") == k).select("id", F.col("distance").alias("rho"))
    usable = (F.col("nu") > 0) & (F.col("rho") > 0)
    total = F.coalesce(F.sum(F.when(usable, F.log(F.col("nu") / F.col("rho")))), F.lit(0.0))
    return other.join(own, "id").agg(
        F.lit(n).cast("bigint").alias("n"),
        F.lit(m).cast("bigint").alias("m"),
        F.count_if(F.col("rho") == 0).alias("zero_own"),
        F.count_if(F.col("nu") == 0).alias("zero_other"),
        (F.lit(math.log(m / (n - 1))) + F.lit(dim / n) * total).alias("kl"),
    )


def knn_kl_symmetric(p: DataFrame, q: DataFrame, k: int = 1) -> DataFrame:
    """KL(P || Q) + KL(Q || P), with both directions."""
    there = knn_kl(p, q, k).select(F.lit("p_q").alias("direction"), "kl")
    back = knn_kl(q, p, k).select(F.lit("q_p").alias("direction"), "kl")
    both = there.unionByName(back)
    return both.agg(
        F.max(F.when(F.col("direction") == "p_q", F.col("kl"))).alias("kl_p_q"),
        F.max(F.when(F.col("direction") == "q_p", F.col("kl"))).alias("kl_q_p"),
        F.sum("kl").alias("divergence"),
    )


CostFunction = Callable[[ShiftPair], DataFrame]


def divergence_cost(pair: ShiftPair, cost: CostFunction | None = None) -> DataFrame:
    """``(metric, value)`` from a caller's cost function; the symmetric kNN divergence by default."""
    if cost is not None:
        return cost(pair)
    reference, query = as_points(pair)
    return knn_kl_symmetric(reference, query, 3).select(
        F.lit("knn_kl_symmetric").alias("metric"), F.col("divergence").alias("value")
    )


# --- bandwidths ---------------------------------------------------------------------


def feature_deviations(points: DataFrame) -> Column:
    """Norm of the per-dimension population deviations, as one aggregate expression."""
    dim = check_dimension(points)
    return F.sqrt(sum((F.pow(F.stddev_pop(F.col("vec")[i]), F.lit(2)) for i in range(dim)), F.lit(0.0)))


def bandwidth_manual(points: DataFrame) -> float:
    return points.agg(feature_deviations(points).alias("h")).first()["h"]


def bandwidth_nn(points: DataFrame, k0: int = 10, sample_rows: int | None = None, seed: int | str = 0) -> float:
    """Mean distance to the k0-th neighbour, the point itself being the first.

    Averaged over all points, or a seeded sample of ``sample_rows``; the
    neighbours always come from the whole table.
    """
    probes = points.select("id", "vec")
    if sample_rows is not None:
        probes = seeded_rank(probes, ["id"], seed, out="_rank").filter(F.col("_rank") <= sample_rows).drop("_rank")
    return knn_join(probes, points, k0).filter(F.col("rank") == k0).agg(F.avg("distance")).first()[0]


def density_scores(points: DataFrame, folds: int = 20, grid: Sequence[float] | None = None, seed: int | str = 0) -> DataFrame:
    """Held-out log-likelihood of a top-hat density for every bandwidth of the grid.

    ``(step, bandwidth, empty_rows, log_likelihood)``; a held-out row without a neighbour
    in the other folds is counted in ``empty_rows`` and makes the bandwidth unusable.
    """
    dim = check_dimension(points)
    if grid is None:
        spread = bandwidth_manual(points)
        grid = list(np.linspace(0.2 * spread, 1.5 * spread, 15))
    plain = points.select("id", "vec").withColumn("label", F.lit(0))
    folded = materialize(stratified_folds(plain, ["id"], folds, seed).select("id", "vec", F.col("fold").alias("tag")), "folded")
    counts = neighbour_counts(folded, fold_copies(folded, "tag"), grid, other_tags_only=True)
    sizes = folded.groupBy(F.col("tag").alias("own")).agg(F.count("*").alias("_held_out"))
    trained = counts.join(F.broadcast(sizes), "own").withColumn("_train", F.lit(points.count()) - F.col("_held_out"))
    ball = dim / 2 * math.log(math.pi) - math.lgamma(dim / 2 + 1)
    sums = trained.agg(
        *[
            e
            for i, h in enumerate(grid)
            for e in (
                F.count_if(F.col(f"c{i}") == 0).alias(f"empty{i}"),
                F.sum(
                    F.when(
                        F.col(f"c{i}") > 0,
                        F.log(F.col(f"c{i}") / F.col("_train")) - F.lit(ball + dim * math.log(h)),
                    )
                ).alias(f"ll{i}"),
            )
        ]
    )
    entries = [
        F.struct(
            F.lit(i).alias("step"), F.lit(float(h)).alias("bandwidth"), F.col(f"empty{i}").alias("empty_rows"),
            F.coalesce(F.col(f"ll{i}"), F.lit(0.0)).alias("log_likelihood"),
        )
        for i, h in enumerate(grid)
    ]
    return sums.select(F.inline(F.array(*entries)))


def mark_best(scores: DataFrame) -> DataFrame:
    """Add ``is_best``: usable bandwidths first, then likelihood, then the smaller bandwidth."""
    order = W.partitionBy().orderBy(F.col("empty_rows") > 0, F.when(F.col("empty_rows") > 0, 0.0).otherwise(-F.col("log_likelihood")), "step")
    return scores.withColumn("is_best", (F.row_number().over(order) == 1).cast("int"))


def bandwidth_cv(points: DataFrame, folds: int = 20, seed: int | str = 0) -> float:
    return mark_best(density_scores(points, folds, seed=seed)).filter("is_best = 1").first()["bandwidth"]


def bandwidth(points: DataFrame, rule: str = "nn", k0: int = 10) -> float:
    """By name: ``nn`` (neighbour distance), ``cv`` (cross-validation) or ``manual``, whatever the size of the table."""
    if rule == "nn":
        return bandwidth_nn(points, k0)
    if rule == "cv":
        return bandwidth_cv(points)
    if rule == "manual":
        return bandwidth_manual(points)
    raise ValueError(f"unknown bandwidth rule {rule!r}")


# --- Bayes error ------------------------------------------------------------------------


def ball_bayes_error(points: DataFrame, radii: Sequence[float], seed: int | str = 0) -> DataFrame:
    """Bayes error from neighbour counts within each radius: ``(step, radius, ber)``.

    Copies of a point are counted once with their number. Classes are compared with
    those of a smaller tag.
    """
    folded = fold_copies(points, "tag")
    counts = neighbour_counts(folded, folded, radii, seed=seed)
    classes = points.groupBy("tag").agg(F.count("*").alias("_n"))
    total = points.agg(F.count("*")).scalar()
    # One row per class.
    priors = F.broadcast(classes.withColumn("prior", F.col("_n") / total).select("tag", "prior"))
    weighted = counts.join(priors, "tag")
    steps = range(len(radii))
    lower, own = F.col("tag") < F.col("own"), F.col("tag") == F.col("own")
    per_point = weighted.groupBy("id", "own", "weight").agg(
        F.max(F.when(own, F.col("prior"))).alias("prior"),
        *[F.max(F.when(lower, F.col("prior") * F.col(f"c{i}"))).alias(f"low{i}") for i in steps],
        *[F.max(F.when(own, F.col("prior") * F.col(f"c{i}"))).alias(f"own{i}") for i in steps],
    )
    first = F.col("own") == F.lit(points.agg(F.min("tag")).first()[0])

    def gain(i: int) -> Column:
        rest = F.greatest(F.lit(0.0), 1.0 - F.coalesce(F.col(f"low{i}"), F.lit(0.0)) / F.col(f"own{i}"))
        return F.when(first, F.lit(1.0)).otherwise(rest)

    row = per_point.agg(
        *[(1.0 - F.sum(F.col("weight") * gain(i)) / F.sum("weight")).alias(f"b{i}") for i in steps]
    )
    entries = [
        F.struct(F.lit(i).alias("step"), F.lit(float(h)).alias("radius"), F.col(f"b{i}").alias("ber"))
        for i, h in enumerate(radii)
    ]
    return row.select(F.inline(F.array(*entries)))


def ensemble_bayes_error(
    points: DataFrame,
    n: int = 3,
    h_range: tuple[float, float] = (1.0, 1.5),
    rule: str = "nn",
    weights: str = "chebyshev",
    k0: int = 10,
    base: float | None = None,
) -> DataFrame:
    """Weighted sum of ball estimates at ``n`` radii around the base bandwidth, one row."""
    pairs = ensemble_weights(n, weights)
    base = bandwidth(points, rule, k0) if base is None else base
    radii = [(node * (h_range[1] - h_range[0]) + h_range[0]) * base for node, _ in pairs]
    estimates = ball_bayes_error(points, radii)
    # Weights of the same few steps, applied as literals.
    weight = sum((F.when(F.col("step") == i, F.lit(w)).otherwise(0.0) for i, (_, w) in enumerate(pairs)), F.lit(0.0))
    return estimates.agg(F.sum(weight * F.col("ber")).alias("ber"), F.lit(float(base)).alias("bandwidth"))


def knn_bayes_bounds(points: DataFrame, ks: Sequence[int] = (1, 3, 5), seed: int | str = 0) -> DataFrame:
    """Cover-Hart bounds from majority votes between two seeded halves: ``(lower, upper)``.

    Each half votes on the other; errors are averaged over the halves and the k values.
    Needs two classes, 0 and 1.
    """
    halves = seeded_rank(points, ["id"], seed, out="_rank").withColumn("_half", F.col("_rank") % 2).drop("_rank")
    halves = materialize(halves, "halves")
    votes = None
    for half in (0, 1):
        test, train = halves.filter(F.col("_half") == half), halves.filter(F.col("_half") != half)
        found = knn_join(test, train.withColumnRenamed("tag", "vote"), max(ks), carry=["vote"])
        part = found.join(test.select("id", "tag"), "id").select(F.lit(half).alias("half"), "id", "tag", "vote", "rank")
        votes = part if votes is None else votes.unionByName(part)
    per_point = votes.groupBy("half", "id", "tag").agg(
        *[F.avg(F.when(F.col("rank") <= k, F.col("vote"))).alias(f"v{k}") for k in ks]
    )
    wrong = per_point.groupBy("half").agg(
        *[F.avg(((F.col(f"v{k}") > 0.5).cast("int") != F.col("tag")).cast("int")).alias(f"e{k}") for k in ks]
    )

    def lower(e: Column) -> Column:
        return (1.0 - F.sqrt(F.greatest(F.lit(0.0), 1.0 - 2.0 * e))) / 2

    return wrong.agg(
        F.avg(sum((lower(F.col(f"e{k}")) for k in ks), F.lit(0.0)) / len(ks)).alias("lower"),
        F.avg(sum((F.col(f"e{k}") for k in ks), F.lit(0.0)) / len(ks)).alias("upper"),
    )


def kde_bayes_error(points: DataFrame, bandwidth: float, seed: int | str = 0) -> DataFrame:
    """Share of points a leave-one-out Gaussian kernel classifier gets wrong, one row.

    Equal scores go to the smaller tag; a point out of reach of every kernel counts as
    the smallest tag.
    """
    folded = fold_copies(points, "tag")
    sums = kernel_sums(folded, folded, bandwidth, seed=seed)
    # One row per class.
    sizes = F.broadcast(points.groupBy("tag").agg(F.count("*").alias("_n")))
    total = points.agg(F.count("*")).scalar()
    smallest = points.agg(F.min("tag")).scalar()
    left = F.col("_n") - F.when(F.col("tag") == F.col("own"), 1).otherwise(0)
    score = F.when(left > 0, F.col("kernel") / left * F.col("_n") / total).otherwise(0.0)
    best = F.max_by("tag", F.struct(score.alias("s"), (-F.col("tag")).alias("t")))
    winners = sums.join(sizes, "tag").groupBy("id").agg(best.alias("said"))
    judged = folded.join(winners, "id", "left")
    return judged.agg(
        (
            F.sum(F.when(F.coalesce("said", smallest) != F.col("tag"), F.col("weight")).otherwise(0)) / F.sum("weight")
        ).alias("ber")
    )


# --- discriminator divergences -------------------------------------------------------------


def discriminator_divergence(pair: ShiftPair, estimator: Estimator | None = None, k: int = 5, seed: int | str = 0) -> tuple[DataFrame, DataFrame]:
    """Total variation seen by a cross-validated discriminator, and the scored rows."""
    scored = out_of_fold(pair.with_missing_filled(), estimator or logistic(), k, seed)
    return evaluate(scored, ["TV"], columns=Scored(clip=CORRECT_CLIP)), scored


def discriminator_panel(pair: ShiftPair, estimator: Estimator | None = None, k: int = 5, seed: int | str = 0) -> tuple[DataFrame, DataFrame]:
    """TV, JSD, JSD of the other class and SKL from one set of out-of-fold probabilities."""
    scored = out_of_fold(pair.with_missing_filled(), estimator or logistic(), k, seed)
    return panel(scored), scored


def panel(scored: DataFrame) -> DataFrame:
    return evaluate(scored, ["TV", "JD", "JD_inverse", "SKL"], columns=Scored(clip=CORRECT_CLIP))
