"""Ranks, folds, scaling, schema checks and corruption: properties that must always hold."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from featshift.operators.corrupt import CODES, corrupt_features, network_weights
from featshift.operators.prepare import (
    align_rows, half_split, minmax_scale, pick_count, stratified_folds, stratified_holdout, write_back,
)
from featshift.operators.rank import in_order, running_totals, seeded_rank
from featshift.sources.gaussian import gaussian_pair, query_covariance
from featshift.sources.pair import ShiftPair, fill_missing, schema_differences

FEATURES = ("a", "b", "c")


@pytest.fixture(scope="module")
def unit_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, float(rng.random()), float(rng.random()), float(i % 2)) for i in range(400)]
    return spark.createDataFrame(rows, "id bigint, a double, b double, c double").cache()


def test_rank_is_a_permutation_and_ignores_partitioning(spark):
    rows = spark.range(1000).withColumn("g", F.col("id") % 3)
    one = {(r["id"], r["rank"]) for r in seeded_rank(rows.repartition(1), ["id"], 5, by=["g"]).collect()}
    many = {(r["id"], r["rank"]) for r in seeded_rank(rows.repartition(13), ["id"], 5, by=["g"], buckets=3).collect()}
    assert one == many
    for g in range(3):
        assert sorted(rank for i, rank in one if i % 3 == g) == list(range(1, 1 + sum(i % 3 == g for i in range(1000))))


def test_ranges_follow_the_number_of_rows(spark):
    rows = spark.range(20_000).withColumn("v", F.pow(F.col("id"), 3))  # far from evenly spaced
    few, many = (in_order(rows, [F.desc("v")], 20_000, rows_per_bucket=n) for n in (20_000, 500))
    largest = [b.groupBy("_bucket").count().agg(F.max("count")).first()[0] for b in (few, many)]
    assert many.select("_bucket").distinct().count() > 30 and largest[1] < 1500 < largest[0]
    ends = many.groupBy("_bucket").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("_bucket").collect()
    assert all(a["lo"] > b["hi"] for a, b in zip(ends[:-1], ends[1:]))
    got = running_totals(many, {"n": F.lit(1)}, F.col("_bucket"), [F.desc("v")])
    assert got.filter(F.col("n") != 20_000 - F.col("id")).count() == 0


def test_running_totals_across_buckets(spark):
    rows = spark.createDataFrame([(i, i // 10, float(i)) for i in range(57)], "i int, b int, v double")
    got = running_totals(rows, {"t": F.col("v")}, F.col("b"), ["i"]).orderBy("i").toPandas()
    assert np.allclose(got["t"], np.cumsum(got["v"]))


def test_one_bucket_may_hold_a_third_of_all_rows(spark):
    rows = spark.range(900).withColumn("b", F.when(F.col("id") < 300, 0).otherwise(F.col("id")).cast("int"))
    got = running_totals(rows, {"n": F.lit(1)}, F.col("b"), ["id"]).orderBy("id").toPandas()
    assert list(got["n"]) == list(range(1, 901))


def test_folds_differ_by_at_most_one(spark):
    rows = spark.range(103).withColumn("label", (F.col("id") % 4 == 0).cast("int"))
    counts = stratified_folds(rows, ["id"], 5).groupBy("label", "fold").count().toPandas()
    for _, part in counts.groupby("label"):
        assert part["count"].max() - part["count"].min() <= 1 and len(part) == 5


@pytest.mark.parametrize("size,expected", [(0.2, 21), (17, 17)])
def test_holdout_size(spark, size, expected):
    rows = spark.range(103).withColumn("label", (F.col("id") % 4 == 0).cast("int"))
    held = stratified_holdout(rows, ["id"], size).filter("fold = 0")
    assert held.count() == expected


def test_half_split_keeps_every_row_once(unit_rows):
    pair = half_split(unit_rows, ("id",), FEATURES, 1)
    assert pair.reference.count() == pair.query.count() == 200
    assert pair.reference.unionByName(pair.query).select("id").distinct().count() == 400


def test_constant_column_scales_to_zero(spark):
    rows = spark.createDataFrame([(1, 5.0, 2.0), (2, 5.0, 4.0)], "id int, a double, b double")
    got = {r["id"]: (r["a"], r["b"]) for r in minmax_scale(rows, ["a", "b"]).collect()}
    assert got == {1: (0.0, 0.0), 2: (0.0, 1.0)}


def test_null_and_nan_become_the_sentinel(spark):
    rows = spark.createDataFrame([(1, None), (2, float("nan")), (3, 0.5)], "id int, a double")
    assert [r["a"] for r in fill_missing(rows, ["a"]).orderBy("id").collect()] == [-1.0, -1.0, 0.5]


def test_schema_problems_are_named(spark):
    left = spark.createDataFrame([(1, 1.0, "x")], "id int, a double, s string")
    right = spark.createDataFrame([(1, 1.0, 2.0)], "id int, b double, s double")
    problems = schema_differences(left.select("a", "s"), right.select("b", "s"))
    assert any("'a'" in p for p in problems) and any("not numeric" in p for p in problems)
    with pytest.raises(ValueError, match="do not match"):
        ShiftPair.from_tables(left, right, ["id"])


def test_rows_with_a_null_predicate_join_the_query(spark):
    rows = spark.createDataFrame([(1, 1.0), (2, None), (3, -1.0)], "id int, a double")
    pair = ShiftPair.from_predicate(rows, F.col("a") > 0, ["id"], ["a"])
    assert pair.reference.count() == 1 and pair.query.count() == 2


def test_align_wraps_a_longer_query(spark):
    reference = spark.range(10).select("id", F.col("id").cast("double").alias("a"))
    query = spark.range(100, 137).select("id", F.lit(0.0).alias("a"))
    aligned = align_rows(ShiftPair.from_tables(reference, query, ["id"]), 0).toPandas()
    assert len(aligned) == 37 and aligned["ref_a"].value_counts().between(3, 4).all()


def test_write_back_changes_only_the_given_rows(unit_rows):
    changed = unit_rows.filter("id < 10").withColumn("a", F.lit(None).cast("double"))
    got = write_back(unit_rows, changed, ["id"], ["a"])
    assert got.columns == unit_rows.columns
    assert got.filter("a is null").count() == 10


def test_bankers_rounding():
    assert (pick_count(5, 0.5), pick_count(7, 0.5)) == (2, 4)


@pytest.mark.parametrize("code", CODES)
def test_corruption_stays_in_the_unit_interval_and_spares_the_rest(unit_rows, code):
    weights = network_weights(2, hidden=16) if code == 7 else None
    got = corrupt_features(unit_rows, ["id"], ["a", "b"], code, 1, weights).toPandas().sort_values("id")
    before = unit_rows.toPandas().sort_values("id")
    assert len(got) == 400 and (got["c"].to_numpy() == before["c"].to_numpy()).all()
    assert got[["a", "b"]].min().min() >= 0 and got[["a", "b"]].max().max() <= 1
    assert not np.allclose(got["a"], before["a"])
    if code in (3, 8):
        assert np.allclose(np.sort(got["a"]), np.sort(before["a"]))
    if code == 8:
        assert set(zip(got["a"], got["b"])) == set(zip(before["a"], before["b"]))
    if code == 3:
        assert set(zip(got["a"], got["b"])) != set(zip(before["a"], before["b"]))


def test_binary_columns_stay_binary_in_the_network(unit_rows):
    got = corrupt_features(unit_rows, ["id"], ["a", "c"], 7, 1, network_weights(2, hidden=16))
    assert got.filter(~F.col("c").isin(0.0, 1.0)).isEmpty()


def test_unknown_code(unit_rows):
    with pytest.raises(ValueError, match="unknown corruption"):
        corrupt_features(unit_rows, ["id"], ["a"], 9)


def test_corruption_does_not_depend_on_partitioning(unit_rows):
    one = corrupt_features(unit_rows.repartition(1), ["id"], ["a", "b"], 3, 4)
    many = corrupt_features(unit_rows.repartition(9), ["id"], ["a", "b"], 3, 4)
    assert one.exceptAll(many).isEmpty() and many.exceptAll(one).isEmpty()


def test_gaussian_moments(spark):
    pair = gaussian_pair(spark.range(20000), ["id"], 3, 1, mean_shift=1.0, scale_shift=0.5, seed=2)
    row = pair.query.agg(F.avg("f0"), F.stddev_pop("f0"), F.avg("f2"), F.stddev_pop("f2"), F.corr("f0", "f1")).first()
    assert np.allclose(row, [1.0, 1.5, 0.0, 1.0, 0.0], atol=0.04)


def test_cut_covariances():
    base = np.full((3, 3), 0.5) + 0.5 * np.eye(3)
    feature = query_covariance(base, 2, 0.25, "feature-wise")
    sample = query_covariance(base, 2, 0.25, "sample-wise")
    assert np.allclose(np.diag(feature), [1.25, 1.25, 1.0]) and feature[0, 1] == feature[0, 2] == 0
    assert sample[0, 1] == 0.5 and sample[0, 2] == sample[1, 2] == 0
    with pytest.raises(ValueError):
        query_covariance(base, 1, 0.0, "other")
