"""What ranks, permutations and cached tables send and store, and that they stay the same rows."""

from __future__ import annotations

import re
import time

import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, RandomForestClassifier
from pyspark.sql import functions as F

from featshift.config import CorrectConfig
from featshift.operators import discriminate, forest
from featshift.operators.corrupt import permute_each, permute_joint
from featshift.operators.proposals import query_halves
from featshift.operators.rank import seeded_rank
from featshift.plans import correct
from featshift.sources.pair import ShiftPair
from featshift.storage import materialize


def executed_plan(df) -> str:
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.split("== Initial Plan ==")[0]


@pytest.fixture
def no_small_tables(spark):
    """Joins are planned as for large tables."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", -1)
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


def test_ranked_rows_travel_once_and_without_their_hash(spark, no_small_tables):
    rows = spark.range(2000).withColumn("g", F.col("id") % 3).withColumn("v", F.col("id") * 2.0)
    plan = executed_plan(seeded_rank(rows, ["id"], 5, by=["g"]))
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    exchanges = re.findall(r"Exchange hashpartitioning\(.*", plan)
    # The rows by bucket; the counts by bucket and by group.
    assert len(exchanges) == 3
    assert sum("shiftright(" in e for e in exchanges) == 1
    project = plan.split("Exchange hashpartitioning(cast(shiftright")[1]
    assert "_h#" not in project


def test_slots_of_a_permutation_leave_moved_columns_behind(spark, no_small_tables):
    rows = spark.range(2000).select("id", (F.col("id") * 2.0).alias("moved"), (F.col("id") * 3.0).alias("stays"))
    for permute in (permute_each, permute_joint):
        got = permute(rows, ["id"], ["moved"], 1)
        found = {r["id"]: r for r in got.collect()}
        assert sorted(r["moved"] for r in found.values()) == [2.0 * i for i in range(2000)]
        assert all(r["stays"] == 3.0 * i for i, r in found.items())
        assert got.columns == rows.columns
        plan = executed_plan(got)
        slots = [part for part in plan.split("Exchange hashpartitioning(cast(shiftright")[1:] if "1:slot" in part.split("\n")[0]]
        assert len(slots) == 1
        below = slots[0].split("BroadcastExchange")[0]
        assert "AS moved" not in below and "AS stays" in below


def test_rows_of_one_key_are_ranked_by_their_values(spark):
    rows = spark.range(300).select((F.col("id") % 7).alias("id"), F.col("id").alias("v"))
    seen = {frozenset((r["v"], r["rank"]) for r in seeded_rank(rows.repartition(n), ["id"], 5).collect()) for n in (1, 2, 5, 13)}
    assert len(seen) == 1
    by_rank = [v for _, v in sorted((rank, v) for v, rank in seen.pop())]
    assert sorted(by_rank) == list(range(300))
    for k in range(7):
        mine = [v for v in by_rank if v % 7 == k]
        assert mine == sorted(mine)


def test_cached_files_are_bounded_by_rows(spark, monkeypatch):
    written = []

    def seen(*args):
        written.append(materialize(*args))
        return written[-1]

    monkeypatch.setattr(discriminate, "CACHED_ROWS", 50)
    monkeypatch.setattr(discriminate, "materialize", seen)
    rows = spark.range(1000, numPartitions=2).withColumn("a", F.lit(1.0))
    with discriminate.cached(rows, lambda df: df.withColumn("b", F.col("a") + 1)) as kept:
        assert len(written[0].inputFiles()) == 20 and written[0].columns == ["id", "a"]
        assert kept.columns == ["id", "a", "b"]
        assert kept.agg(F.count("*"), F.sum("b")).first() == (1000, 2000.0)


def test_cached_rows_leave_memory_to_the_fits(spark):
    with discriminate.cached(spark.range(10)) as data:
        level = data.storageLevel
        assert level.useDisk and not level.useMemory
        assert data.count() == 10


def test_only_fits_that_have_room_run_together(spark, monkeypatch):
    rows = spark.range(400).select(
        "id", (F.col("id") % 2).cast("double").alias("label"), (F.col("id") % 4).cast("int").alias("fold"),
        (F.col("id") * 37 % 101 + 9 * (F.col("id") % 2)).cast("double").alias("x"), (F.col("id") * 53 % 89).cast("double").alias("y"),
    )
    together, run_together = [], discriminate.run_together

    def seen(session, work, items, parallelism):
        together.append(parallelism)
        return run_together(session, work, items, parallelism)

    monkeypatch.setattr(discriminate, "run_together", seen)
    estimator = discriminate.boosted_trees(2, 2)

    def scored():
        with discriminate.cached(rows, lambda stored: discriminate.assemble(stored, ["x", "y"])) as data:
            return sorted(discriminate.fit_folds(data, estimator, range(4)).scored.collect())

    found = scored()
    # Room for one fit and a half: 400 rows of 256 bytes.
    monkeypatch.setattr(discriminate, "FIT_BYTES_PER_CORE", 400 * 256 * 3 // 2 // spark.sparkContext.defaultParallelism)
    assert scored() == found and len(found) == 400
    monkeypatch.setattr(discriminate, "FIT_BYTES_PER_CORE", 1)
    assert scored() == found
    assert together == [4, 1, 1]


def test_a_forest_keeps_more_of_a_row_than_a_linear_model():
    forest, boosted, linear = discriminate.random_forest(), discriminate.boosted_trees(), discriminate.logistic()
    assert [discriminate.kept_bytes(e, 4) for e in (forest, boosted, linear)] == [544, 264, 48]


def test_boosted_trees_fit_distinct_rows_with_their_numbers(spark, monkeypatch):
    """Ten times the rows are no more cells, and the folds' models are those of all rows."""
    rows = spark.range(6000).select(
        "id", (F.col("id") * 7 % 10 < 4).cast("double").alias("label"), (F.col("id") % 4).cast("int").alias("fold"),
        (F.col("id") * 37 % 13 + F.when(F.col("id") * 7 % 10 < 4, F.col("id") % 3).otherwise(0)).cast("double").alias("x"),
        (F.col("id") * 53 % 7 / 3).alias("y"), F.lit(2.0).alias("z"),
    )
    names = ["x", "y", "z"]
    sizes, in_cells = [], discriminate.C.in_cells

    def seen(*args):
        sizes.append(in_cells(*args).n)
        return in_cells(*args)

    monkeypatch.setattr(discriminate.C, "in_cells", seen)

    def scored(df, estimator):
        with discriminate.cached(df, lambda stored: discriminate.assemble(stored, names)) as data:
            fits = discriminate.fit_folds(data, estimator, range(4))
            p1 = {r["id"]: r["p1"] for r in fits.scored.collect()}
            return p1, [list(fits.models[f].featureImportances.toArray()) for f in range(4)]

    many = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(10)))).drop("copy")
    for estimator in (discriminate.boosted_trees(3, 3), DecisionTreeClassifier(maxDepth=3)):
        sizes.clear()
        monkeypatch.setattr(discriminate.C, "LEAST_ROWS", 10**9)
        plain, weights = scored(rows, estimator)
        monkeypatch.setattr(discriminate.C, "LEAST_ROWS", 1)
        for df in (rows, many):
            p1, importances = scored(df, estimator)
            assert p1 == pytest.approx(plain, abs=1e-9)
            for mine, theirs in zip(importances, weights):
                assert mine == pytest.approx(theirs, abs=1e-6)
        assert sizes[:4] == sizes[4:] and max(sizes) <= 2 * 15 * 7


def test_rows_that_are_all_different_are_fitted_as_they_are(spark, monkeypatch):
    monkeypatch.setattr(discriminate.C, "LEAST_ROWS", 1)
    rows = spark.range(300).select("id", (F.col("id") % 2).cast("double").alias("label"), *[(F.rand(i) + F.col("id") % 2).alias(f"x{i}") for i in range(4)])
    data = discriminate.assemble(rows, [f"x{i}" for i in range(4)])
    assert discriminate.C.in_cells(data, discriminate.boosted_trees(2, 2), 4) is None
    assert discriminate.fit_tables([data], discriminate.boosted_trees(2, 2), 300, 4, 1)[0].getNumTrees == 2
    counted = [discriminate.random_forest(), discriminate.boosted_trees(), DecisionTreeClassifier()]
    drawn = [RandomForestClassifier(bootstrap=False), RandomForestClassifier(subsamplingRate=0.5), discriminate.logistic(), GBTClassifier(subsamplingRate=0.5), GBTClassifier(minInstancesPerNode=3), GBTClassifier(weightCol="w")]
    assert all(discriminate.C.counts_rows(e) for e in counted) and not any(discriminate.C.counts_rows(e) for e in drawn)


def test_ranges_end_where_those_of_a_spark_tree_do(spark):
    """Many values, a third of the rows on one of them: every threshold of a deep tree is an end."""
    values = [float(i * 7919 % 5003) if i % 3 else 2500.0 for i in range(6000)]
    rows = spark.createDataFrame([(v, float(int(v * 13) % 2)) for v in values], "x double, label double")
    tree = DecisionTreeClassifier(maxDepth=8, featuresCol=discriminate.VECTOR).fit(discriminate.assemble(rows, ["x"]))
    thresholds = {float(t) for t in re.findall(r"feature 0 <= ([0-9.E]+)", tree.toDebugString)}
    ends = discriminate.C.range_ends(np.array(values), 32)
    assert len(thresholds) > 10 and thresholds <= set(ends) and len(ends) <= 31
    assert discriminate.C.range_ends(np.array([1.0, 3.0, 3.0, 4.0]), 32) == [2.0, 3.5]
    assert discriminate.C.range_ends(np.array([5.0, 5.0]), 32) == []


def test_a_tree_of_a_forest_grows_as_spark_grows_it(spark):
    rows = spark.range(4000).select(
        (F.col("id") * 7919 % 1009 % 10 < 3 + F.col("id") * 31 % 11 % 4).cast("double").alias("label"),
        (F.col("id") * 31 % 11).cast("double").alias("x"), (F.col("id") * 17 % 29 / 7).alias("y"),
    )
    data = discriminate.assemble(rows, ["x", "y"])
    cells = discriminate.C.in_cells(data, DecisionTreeClassifier(), 2)
    held = cells.stored.toPandas()
    bins, label, weight = held[["_b0", "_b1"]].to_numpy().astype(np.int8), held["_label"].to_numpy() == 1.0, held["_weight"].to_numpy()
    for depth in (2, 6):
        tree = DecisionTreeClassifier(maxDepth=depth).fit(data)
        nodes = forest.grow(bins, label, weight, depth, 2, 0.0, np.random.default_rng(0))
        mine = sorted((f, round(cells.edges[f][b], 9)) for f, b in zip(nodes["feature"], nodes["bin"]) if f >= 0)
        theirs = sorted((int(f), round(float(t), 9)) for f, t in re.findall(r"If \(feature (\d+) <= ([0-9.E-]+)\)", tree.toDebugString))
        assert mine == theirs and len(nodes) == tree.numNodes > 3


def test_forests_of_cells_are_spark_models_and_as_good(spark, monkeypatch):
    rows = spark.range(6000).select(
        (F.col("id") % 2).cast("double").alias("label"), (F.col("id") * 31 % 11 + F.when(F.col("id") % 2 == 1, F.col("id") % 3 * 2).otherwise(0)).cast("double").alias("x"),
        (F.col("id") * 17 % 13).cast("double").alias("y"), F.lit(1.0).alias("z"),
    )
    data = discriminate.assemble(rows, ["x", "y", "z"]).persist()
    estimator = discriminate.random_forest(20, 5, 3)

    def accuracy(model):
        return model.transform(data).agg(F.avg((F.col("prediction") == F.col("label")).cast("int"))).first()[0]

    plain = discriminate.fit_tables([data], estimator, 6000, 3, 1)[0]
    monkeypatch.setattr(discriminate.C, "LEAST_ROWS", 1)
    grown, again = (discriminate.fit_tables([data.repartition(n)], estimator, 6000, 3, 1)[0] for n in (2, 7))
    assert grown.getNumTrees == 20 and grown.getMaxDepth() == 5 and grown.numFeatures == 3 and grown.toDebugString == again.toDebugString
    assert accuracy(grown) == pytest.approx(accuracy(plain), abs=0.02) and accuracy(plain) > 0.55
    assert list(grown.featureImportances.toArray()) == pytest.approx(list(plain.featureImportances.toArray()), abs=0.15)
    # Without a second label, or with more cells than a task may hold, Spark fits the rows.
    assert discriminate.C.in_cells(data.filter("label = 0"), estimator, 3) is None
    monkeypatch.setattr(discriminate.C, "MOST_CELLS", 10)
    assert discriminate.C.in_cells(data, estimator, 3) is None
    data.unpersist()


def test_a_cross_fitted_pair_stores_its_parts_one_by_one(spark, monkeypatch):
    """What one part shuffled is gone before the next is written, and no second copy of the training rows is kept."""
    rows = spark.range(400).select("id", (F.col("id") * 37 % 101 / 101).alias("x"), (F.col("id") * 53 % 89 / 89).alias("y"))
    pair = ShiftPair(rows.filter("id % 2 = 0"), rows.filter("id % 2 = 1").withColumn("x", F.col("x") + 0.3), ("x", "y"), ("id",))
    halves = query_halves(pair, 0)
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        found = files.getAllFiles()
        return {name for k in range(found.size()) if (name := found.apply(k).getName()).startswith("shuffle_")}

    stored, kept = [], spark.sparkContext._jsc.getPersistentRDDs().size()
    before = shuffles()

    def seen(df, name, *args):
        out = materialize(df, name, *args)
        if name == "training":
            rows, until = out.count(), time.time() + 10
            while shuffles() - before and time.time() < until:  # files are removed in the background
                time.sleep(0.1)
            left = spark.sparkContext._jsc.getPersistentRDDs().size() - kept
            stored.append((len(df), rows, len(shuffles() - before), max(0, left)))
        return out

    monkeypatch.setattr(correct, "materialize", seen)
    monkeypatch.setattr(correct, "fits_at_once", lambda *args: 1)
    models = correct.fit_cross_pair(pair, ["x"], halves, [], CorrectConfig(base_classifier=discriminate.logistic()), "0")
    assert sorted(models) == [0, 1] and [s[:2] for s in stored] == [(4, 700), (4, 700)]
    assert all(s[2:] == (0, 0) for s in stored)
