"""Scores, importances, cuts and the knee on hand-made tables."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from featshift.functions.scores import Scored, is_metric, register_metric
from featshift.functions.weights import ensemble_weights
from featshift.operators import knee as K
from featshift.operators.evaluate import evaluate, localization_f1
from featshift.operators.locating import cut_limits, feature_cut, normalised_importance, patience_stop, stop_reason


def values(df) -> dict[str, float]:
    return {r["metric"]: r["value"] for r in df.collect()}


def scored(spark, rows):
    return spark.createDataFrame(rows, "label int, prediction int, p1 double")


def test_uninformative_probabilities_have_no_divergence(spark):
    got = values(evaluate(scored(spark, [(i % 2, 1, 0.5) for i in range(20)]), ["JD", "KL", "TV", "roc_auc", "balanced_accuracy"]))
    assert got == pytest.approx({"JD": 0, "KL": 0, "TV": 0, "roc_auc": 0.5, "balanced_accuracy": 0.5})


def test_perfect_separation(spark):
    got = values(evaluate(scored(spark, [(i % 2, i % 2, float(i % 2)) for i in range(20)]), ["JD", "TV", "roc_auc", "average_precision", "f1"]))
    assert got["TV"] == got["roc_auc"] == got["average_precision"] == got["f1"] == 1
    assert got["JD"] == pytest.approx(math.log(2), abs=1e-3)


def test_one_class_does_not_fail(spark):
    got = values(evaluate(scored(spark, [(1, 1, 0.7), (1, 0, 0.2)]), ["balanced_accuracy", "precision", "matthews_corrcoef", "roc_auc"]))
    assert got["balanced_accuracy"] == 0.5 and got["precision"] == 1 and got["roc_auc"] is None


def test_auc_against_pair_counting(spark):
    rng = np.random.default_rng(0)
    label, p = rng.integers(0, 2, 300), np.round(rng.random(300), 2)
    rows = [(int(a), int(b > 0.5), float(b)) for a, b in zip(label, p)]
    pos, neg = p[label == 1], p[label == 0]
    wins = (pos[:, None] > neg[None, :]).mean() + 0.5 * (pos[:, None] == neg[None, :]).mean()
    assert values(evaluate(scored(spark, rows), ["roc_auc"]))["roc_auc"] == pytest.approx(wins)


def test_own_metric_and_unknown_metric(spark):
    register_metric("mean_p1", lambda s: F.avg(s.p1))
    assert is_metric("mean_p1")
    assert values(evaluate(scored(spark, [(0, 0, 0.2), (1, 1, 0.6)]), ["mean_p1"]))["mean_p1"] == pytest.approx(0.4)
    with pytest.raises(ValueError, match="unknown metric"):
        evaluate(scored(spark, [(0, 0, 0.2)]), ["nope"])


def test_clip_is_a_parameter(spark):
    rows = scored(spark, [(1, 1, 1.0), (0, 0, 0.0)])
    loose, tight = (values(evaluate(rows, ["KL"], columns=Scored(clip=c)))["KL"] for c in (1e-2, 1e-4))
    assert tight > loose


def test_signed_importances_cancel_and_missing_ones_count_as_zero(spark):
    rows = [(0, 0, "a", 0, 1.0), (0, 1, "a", 0, -1.0), (0, 0, "b", 1, 1.0), (0, 0, "c", 2, 3.0), (0, 1, "c", 2, 3.0)]
    table = spark.createDataFrame(rows, "run_id int, fold int, feature string, position int, importance double")
    got = {r["feature"]: r["importance"] for r in normalised_importance(table).collect()}
    assert got == pytest.approx({"a": 0.0, "b": 0.5 / 3.5, "c": 3.0 / 3.5})


def sequential_cut(importances, step, cap, threshold, percentage):
    """The rule stated step by step."""
    taken, total = [], 0.0
    for position in sorted(range(len(importances)), key=lambda i: (-importances[i], i)):
        value = importances[position]
        total += value
        if (step is not None and len(taken) >= step) or (cap is not None and len(taken) >= cap) or value <= threshold:
            break
        taken.append(position)
        if percentage is not None and total > percentage:
            break
    return set(taken)


def test_cut_matches_the_stepwise_rule(spark):
    rng = np.random.default_rng(1)
    importances, limits, want = [], [], {}
    for run in range(120):
        raw = rng.integers(0, 6, rng.integers(1, 9)).astype(float) + 1e-9
        share = raw / raw.sum()
        step, cap = (None if rng.random() < 0.5 else int(rng.integers(0, 5)) for _ in range(2))
        threshold, percentage = float(rng.random() * 0.2), None if rng.random() < 0.3 else float(rng.random() * 1.4 - 0.3)
        importances += [(run, f"f{i}", i, float(v)) for i, v in enumerate(share)]
        limits.append((run, step, cap, percentage, threshold))
        want[run] = sequential_cut(share, step, cap, threshold, percentage)
    table = spark.createDataFrame(importances, "run_id int, feature string, position int, importance double")
    bounds = spark.createDataFrame(limits, "run_id int, step int, cap int, percentage double, threshold double")
    got: dict[int, set] = {run: set() for run in want}
    for r in feature_cut(table, bounds).collect():
        got[r["run_id"]].add(r["position"])
    assert got == want


def test_limits(spark):
    state = spark.createDataFrame([(0, 40, 50, 10, 0.75)], "run_id int, n_features int, n_input int, removed int, score double")
    row = cut_limits(state, step=0.1, percentage=0.1, alpha=1, max_features=0.5).first()
    assert (row["step"], row["total_cap"], row["cap"]) == (4, 25, 15)
    assert (row["percentage"], row["threshold"]) == pytest.approx((0.05, 1 / 40))


def test_patience(spark):
    points = [(0, i + 1, s) for i, s in enumerate([0.9, 0.85, 0.7, 0.72, 0.71, 0.6, 0.61, 0.62, 0.63])]
    curve = spark.createDataFrame(points, "run_id int, iteration int, score double")
    assert patience_stop(curve, 2).first()["stop_iteration"] == 5
    assert patience_stop(curve, 3).first()["stop_iteration"] == 9
    with pytest.raises(ValueError):
        patience_stop(curve, 0)


def test_stop_reasons_in_order(spark):
    rows = [(0, 5, 0.4, 9, 3, True), (2, 5, 0.505, 9, 3, True), (2, 5, 0.7, 9, 3, True), (2, 5, 0.7, 1, 3, True), (2, 5, 0.7, 1, 3, False)]
    state = spark.createDataFrame(rows, "detected int, n_features int, score double, removed int, iteration int, out_of_patience boolean")
    state = state.withColumn("total_cap", F.lit(9))
    got = [r[0] for r in state.select(stop_reason(0.01, None)).collect()]
    assert got == ["nothing detected", "score within margin", "feature limit", "patience", None]


def curve(spark, *runs):
    rows = [(run, i + 1, x, float(y)) for run, points in enumerate(runs) for i, (x, y) in enumerate(points)]
    return spark.createDataFrame(rows, "run_id int, iteration int, x int, y double")


def test_default_window_leaves_the_curve_alone(spark):
    table = curve(spark, [(0, 1.0), (1, 0.9), (2, 0.95), (3, 0.6), (4, 0.55)])
    dense = K.densify(table)
    smooth = K.smooth(dense, K.smoothing_window(table)).orderBy("x").toPandas()
    assert np.allclose(smooth["y"], [1.0, 0.9, 0.95, 0.6, 0.55])


def test_smoothed_curve_falls_and_ends_above_half(spark):
    rng = np.random.default_rng(2)
    runs = [[(3 * i, 0.4 + 0.6 * math.exp(-i / 3) + 0.05 * rng.normal()) for i in range(15)] for _ in range(4)]
    got = K.smooth_curve(curve(spark, *runs)).toPandas().sort_values(["run_id", "x"])
    for _, part in got.groupby("run_id"):
        assert (np.diff(part["y"]) <= 1e-12).all() and part["y"].min() >= 0.5 and len(part) == 15


def test_curves_are_not_broadcast_through_the_driver(spark):
    """Only the weights of the distinct windows are."""
    table = curve(spark, [(0, 1.0), (3, 0.9), (5, 0.6), (8, 0.55)])
    for found, most in ((K.smooth_curve(table), 1), (K.locate_knee(table), 0)):
        assert found.collect()
        plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        assert plan.count("BroadcastExchange") <= most


def test_smoothing_of_repeated_and_missing_points(spark):
    """The weighted sum is over the points there are, and a point that comes twice counts twice."""
    points = [(2, 0.9), (3, 0.8), (3, 0.7), (7, 0.5), (8, None), (9, 0.4)]
    dense = spark.createDataFrame([(1, x, y) for x, y in points], "run_id bigint, x int, y double")
    windows = spark.createDataFrame([(1, 5)], "run_id bigint, window int")
    weights = {r["offset"]: r["weight"] for r in K.smoothing_weights(windows, 2).collect()}
    got = {r["x"]: r["y"] for r in K.smooth(dense, windows, 2).collect()}
    assert sorted(got) == [2, 3, 7, 8, 9]
    for x in got:
        times = sum(a == x for a, _ in points)
        want = [w * y for o, w in weights.items() for a, y in points if a == max(0, min(9, x + o)) and y is not None]
        assert got[x] == pytest.approx(times * sum(want))


def test_knee_of_a_clear_elbow(spark):
    steep = [(2 * i, max(0.5, 1.0 - 0.125 * i)) for i in range(10)]
    got = K.locate_knee(K.smooth_curve(curve(spark, steep))).first()
    assert got["knee_x"] == 8 and got["iteration_knee"] == 5


def test_knee_edge_cases(spark):
    table = curve(spark, [(0, 0.6)], [(0, 0.7), (3, 0.7), (5, 0.7)], [(0, 1.0), (4, 1.0)])
    got = {r["run_id"]: (r["knee_x"], r["iteration_knee"]) for r in K.locate_knee(K.smooth_curve(table)).collect()}
    assert got == {0: (0, 1), 1: (0, 1), 2: (0, 1)}
    last = {r["run_id"]: r["knee_x"] for r in K.locate_knee(K.smooth_curve(table), no_knee="last").collect()}
    assert last[2] == 4


def test_walked_curves_are_the_steps_in_one_shuffle(spark):
    rng = np.random.default_rng(6)
    runs = [[(0, 0.6)], [(0, 0.7), (3, 0.7), (5, 0.7)], [(0, 1.0), (4, 1.0)], [(2 * i, max(0.5, 1.0 - 0.125 * i)) for i in range(10)]]
    runs += [[(3 * i + i % 2, 0.45 + 0.55 * math.exp(-i / 4) + 0.04 * rng.normal()) for i in range(14)] for _ in range(6)]
    table = curve(spark, *runs)
    for rule in ("first", "last"):
        walked = K.walk_curves(table, no_knee=rule)
        got = walked.toPandas().sort_values(["run_id", "x"]).reset_index(drop=True)
        steps = K.smooth_curve(table)
        want = steps.toPandas().sort_values(["run_id", "x"]).reset_index(drop=True)
        assert np.allclose(got[["x", "y_raw", "y"]], want[["x", "y_raw", "y"]]) and (got["position"] == got.groupby("run_id").cumcount() + 1).all()
        heads = got[got["position"] == 1].set_index("run_id")
        for online, names in ((False, ["knee_x", "iteration_knee"]), (True, ["online_x", "iteration_online"])):
            knees = K.locate_knee(steps, online=online, no_knee=rule).toPandas().set_index("run_id").sort_index()
            assert (heads[names].to_numpy() == knees[["knee_x", "iteration_knee"]].to_numpy()).all()
    plan = K.walk_curves(table)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "FlatMapGroupsInArrow" in plan
    assert K.walk_curves(table.limit(0)).count() == 0


def test_localisation_f1(spark):
    report = spark.createDataFrame([(0, "a", 1), (0, "b", 2), (0, "c", 0), (1, "a", 0)], "run_id int, feature string, ranking int")
    truth = spark.createDataFrame([(0, "a", 1), (0, "b", 0), (0, "c", 1), (1, "a", 0)], "run_id int, feature string, is_corrupted int")
    got = {(r["run_id"], r["iteration"]): r["f1"] for r in localization_f1(report, truth).collect()}
    assert got == pytest.approx({(0, 1): 0.0, (0, 2): 2 / 3, (0, 3): 0.5, (1, 1): 1.0})


@pytest.mark.parametrize("rule", ["chebyshev", "uniform", "decaying"])
@pytest.mark.parametrize("n", [3, 5, 10])
def test_ensemble_weights_sum_to_one(rule, n):
    pairs = ensemble_weights(n, rule)
    assert sum(w for _, w in pairs) == pytest.approx(1.0)
    assert [s for s, _ in pairs] == sorted(s for s, _ in pairs)
