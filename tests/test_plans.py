"""Detection, localisation and correction on pairs with a known shift."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pytest
from pyspark.ml.classification import LinearSVC
from pyspark.sql import functions as F

from featshift import CorrectConfig, LocateConfig, ShiftPair, correct_features, detect_shift, locate_shift
from featshift.operators.candidates import best_candidates, correction_blocks, split_model, worst_rows
from featshift.operators.discriminate import (
    assemble, boosted_trees, logistic, out_of_fold, random_forest, score_model, score_rows, with_columns_set,
)
from featshift.operators.divergence import discriminator_divergence, divergence_cost
from featshift.operators.evaluate import localization_f1
from featshift.operators.proposals import best_proposal
from featshift.sources.gaussian import gaussian_pair
from featshift.storage import materialize


@pytest.fixture(scope="module")
def shifted(spark):
    """20 features, the first 8 with a mean shift of 0.5."""
    pair = gaussian_pair(spark.range(1000), ["id"], 20, 8, mean_shift=0.5, seed=1)
    return replace(pair, reference=materialize(pair.reference, "t"), query=materialize(pair.query, "t"))


@pytest.fixture(scope="module")
def unshifted(spark):
    pair = gaussian_pair(spark.range(600), ["id"], 5, 0, seed=2)
    return replace(pair, reference=materialize(pair.reference, "t"), query=materialize(pair.query, "t"))


def summary_of(result) -> dict:
    return {r["metric"]: r for r in result.summary.collect()}


def test_detection_sees_the_shift_and_only_the_shift(shifted, unshifted):
    config = LocateConfig(estimator=logistic(), scoring=("balanced_accuracy", "TV", "roc_auc"))
    seen, none = summary_of(detect_shift(shifted, config)), summary_of(detect_shift(unshifted, config))
    assert seen["balanced_accuracy"]["mean"] > 0.7 and seen["balanced_accuracy"]["folds"] == 5
    assert seen["balanced_accuracy"]["tvd"] == pytest.approx(2 * seen["balanced_accuracy"]["mean"] - 1)
    assert none["balanced_accuracy"]["mean"] < 0.55


def test_detection_with_holdout_and_own_folds(spark, shifted):
    held = detect_shift(shifted, LocateConfig(estimator=logistic(), cv=None, test_size=0.3, return_estimator=True))
    assert held.scores.count() == 1 and list(held.models) == [(1, 0)]
    folds = spark.range(1000).select("id", (F.col("id") % 3).cast("int").alias("fold"))
    own = detect_shift(shifted, LocateConfig(estimator=logistic()), folds)
    assert own.scores.count() == 3


def test_location_finds_the_corrupted_features(spark, shifted):
    result = locate_shift(shifted, LocateConfig(estimator=logistic(), max_features_to_filter=0.6))
    truth = spark.createDataFrame([(0, f, int(i < 8)) for i, f in enumerate(shifted.features)], "run_id int, feature string, is_corrupted int")
    scores = localization_f1(result.report.withColumn("run_id", F.lit(0)), truth).orderBy("iteration").collect()
    assert scores[-1]["f1"] >= 0.9
    report = result.report.toPandas()
    assert report["mask"].sum() == result.n_corrupted and (report["ranking"] < result.n_iterations).all()
    assert ((report["mask"] == 1) == (report["ranking"] > 0)).all() and (report.loc[report["mask"] == 0, "importance"] == 0).all()
    assert result.curve.filter("is_knee = 1").count() == 1
    assert result.log.count() == result.n_iterations


def test_location_with_a_forest_and_without_a_knee(shifted):
    pair = shifted.select_features(shifted.features[5:12])
    config = LocateConfig(estimator=random_forest(10, 4), find_best=None, percentage=None, step=2, max_it=2)
    result = locate_shift(pair, config)
    assert result.n_iterations == 2 and result.log.orderBy("iteration").collect()[-1]["stop"] is not None
    assert set(r["feature"] for r in result.cuts.collect()) <= {"f5", "f6", "f7"}


def test_location_ends_before_the_last_feature(shifted):
    pair = shifted.select_features(["f0", "f1"])
    config = LocateConfig(estimator=logistic(), percentage=None, alpha=None, margin=None, find_best=None)
    result = locate_shift(pair, config)
    assert result.log.collect()[-1]["stop"] == "no feature left" and result.pending.count() == 2


@pytest.mark.parametrize("bad", [
    dict(scoring=("accuracy",)), dict(scoring=("balanced_accuracy", "balanced_accuracy")), dict(step=2, percentage=0.1),
    dict(alpha=1, threshold=0.1), dict(cv=5, test_size=0.2), dict(percentage=1.5), dict(return_estimator=1), dict(patience=0),
    dict(scoring=("balanced_accuracy", "nope")), dict(find_best="other"), dict(cv=None),
])
def test_argument_rules(spark, bad):
    with pytest.raises(ValueError):
        LocateConfig(**bad)


def test_config_copies_are_independent(spark):
    base = LocateConfig(estimator=logistic())
    assert replace(base, cv=3).cv == 3 and base.cv == 5


def test_out_of_fold_scores_every_row_once(unshifted):
    scored = out_of_fold(unshifted, logistic(), 4)
    assert scored.count() == 1200 and scored.groupBy("id", "label").count().filter("count <> 1").isEmpty()


def test_a_model_without_probabilities_still_gets_hard_scores(unshifted):
    row = detect_shift(unshifted, LocateConfig(estimator=LinearSVC(maxIter=5))).summary.first()
    assert 0 < row["mean"] < 1


@pytest.mark.parametrize("make", [lambda: boosted_trees(4, 3), lambda: random_forest(5, 4), logistic])
def test_models_as_sums_of_products(spark, unshifted, make):
    data = assemble(unshifted.labelled(), unshifted.features)
    model = with_columns_set(make(), "features").fit(data)
    clean, bad = ["f1", "f3", "f4"], ["f0", "f2"]
    scorer = split_model(model, unshifted.features, clean, bad, spark)
    rows = unshifted.query.toPandas().sort_values("id").head(30)
    x, c = rows[clean].to_numpy(), rows[bad].to_numpy()
    scores = scorer.scores(x, c)
    crossed = [(i * 30 + j, 1, *c[j][:1], *x[i][:1], *c[j][1:], *x[i][1:]) for i in range(30) for j in range(30)]
    table = spark.createDataFrame([(k, y, *(float(v) for v in vs)) for k, y, *vs in crossed], "id bigint, label int, f0 double, f1 double, f2 double, f3 double, f4 double")
    p1 = score_rows(model, assemble(table, unshifted.features)).orderBy("id").toPandas()["p1"].to_numpy().reshape(30, 30)
    chosen = best_candidates(scorer, x, c)
    assert np.allclose(p1[np.arange(30), chosen], p1.min(axis=1), atol=1e-12)
    for i in range(30):
        order = np.argsort(scores[i], kind="stable")
        assert (np.diff(p1[i][order]) >= -1e-9).all()


def test_score_model(unshifted):
    data = assemble(unshifted.labelled(), unshifted.features)
    model = with_columns_set(logistic(), "features").fit(data)
    got = {r["metric"]: r["value"] for r in score_model(model, data).collect()}
    assert set(got) == {"JD", "TV"} and all(v >= 0 for v in got.values())


def test_worst_rows_among_equal_probabilities(spark):
    rows = spark.range(300).withColumn("p1", F.when(F.col("id") < 100, 0.9).when(F.col("id") < 110, 0.95).otherwise(0.2))
    got = worst_rows(rows, ["id"], 40)
    assert got.count() == 40 and got.filter("p1 = 0.95").count() == 10 and got.filter("p1 < 0.5").isEmpty()
    assert worst_rows(rows, ["id"], 500).count() == 110


def test_blocks_stay_bounded_when_the_query_is_longer(spark):
    reference = spark.range(250).select("id", F.lit(0.0).alias("a"))
    query = spark.range(1000).select("id", F.lit(0.0).alias("a"))
    ref, que = correction_blocks(ShiftPair.from_tables(reference, query, ["id"]), 100)
    assert {r["block"]: r["count"] for r in ref.groupBy("block").count().collect()} == {0: 100, 1: 150}
    assert que.groupBy("block", "lap").count().agg(F.max("count")).first()[0] == 150
    assert que.count() == 1000


def test_proposal_choice(spark):
    rows = [("a", 0, "x", 0.4), ("a", 1, "y", 0.05), ("a", 2, "z", 0.01), ("b", 0, "x", 1.0), ("c", 0, "x", 0.3), ("c", 1, "y", 0.3)]
    got = {r["run"]: r["chosen"] for r in best_proposal(spark.createDataFrame(rows, "run string, step int, proposal string, tv double")).collect()}
    assert got == {"a": "y", "b": "query", "c": "x"}


@pytest.fixture(scope="module")
def correlated(spark):
    """f0 and f1 depend on f2 and f3; in the query f0 and f1 are far off."""
    covariance = np.array([[1.0, 0.2, 0.8, 0.0], [0.2, 1.0, 0.0, 0.8], [0.8, 0.0, 1.0, 0.0], [0.0, 0.8, 0.0, 1.0]])
    pair = gaussian_pair(spark.range(500), ["id"], 4, 2, mean_shift=4.0, covariance=covariance, seed=4)
    return replace(pair, reference=materialize(pair.reference, "t"), query=materialize(pair.query, "t"))


def tv(pair) -> float:
    return discriminator_divergence(pair, boosted_trees(5, 3))[0].first()["value"]


def test_correction_lowers_the_divergence_and_spares_clean_columns(correlated):
    config = CorrectConfig(base_classifier=boosted_trees(5, 3), num_epochs=2)
    result = correct_features(correlated, ["f0", "f1"], config)
    before, after = correlated.query.toPandas().set_index("id").sort_index(), result.query.toPandas().set_index("id").sort_index()
    assert list(after.columns) == ["f0", "f1", "f2", "f3"] and len(after) == 500
    assert (after[["f2", "f3"]] == before[["f2", "f3"]]).all().all()
    assert tv(replace(correlated, query=result.query)) < 0.5 < tv(correlated)
    assert result.chosen in ("aligned", "linear", "knn")


@pytest.mark.parametrize("make", [lambda: boosted_trees(3, 3), logistic])
def test_epochs_run_through_blocks_and_laps(spark, correlated, make):
    """Blocks of 100 rows and a query twice as long as the reference."""
    longer = correlated.query.unionByName(correlated.query.withColumn("id", F.col("id") + 10000))
    pair = replace(correlated, query=longer)
    config = CorrectConfig(base_classifier=make(), batch_size=100, bad_share=0.0, num_epochs=2, max_dims=1)
    result = correct_features(pair, ["f0", "f1"], config)
    steps = [r["step"] for r in result.log.collect()]
    assert steps.count("epoch") == 2 and result.query.count() == 1000
    assert result.query.filter("f0 is null or f1 is null").isEmpty()


def test_correction_with_a_report_or_nothing_to_do(spark, correlated):
    report = spark.createDataFrame([("f0", 0, 0), ("f1", 1, 0)], "feature string, position int, mask int")
    assert correct_features(correlated, report).query is correlated.query
    with pytest.raises(ValueError):
        correct_features(correlated, ["unknown"])


def test_every_feature_corrupted(correlated):
    pair = correlated.select_features(["f0", "f1"])
    result = correct_features(pair, ["f0", "f1"], CorrectConfig(base_classifier=logistic(), bad_share=0.0))
    assert result.query.count() == 500 and result.chosen == "aligned"


def test_missing_values_survive_outside_the_corrupted_columns(correlated):
    holes = correlated.query.withColumn("f2", F.when(F.col("id") % 10 == 0, F.lit(None)).otherwise(F.col("f2")))
    pair = replace(correlated, query=holes)
    result = correct_features(pair, ["f0"], CorrectConfig(base_classifier=logistic(), bad_share=0.0))
    assert result.query.filter("f2 is null").count() == holes.filter("f2 is null").count() > 0


def test_divergence_cost_takes_a_function(correlated):
    assert divergence_cost(correlated).first()["value"] > 1
    own = divergence_cost(correlated, lambda p: p.query.agg(F.lit("rows").alias("metric"), F.count("*").cast("double").alias("value")))
    assert own.first()["value"] == 500
