"""Cases in which an operator once did less than its whole job."""

from __future__ import annotations

import inspect
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from featshift import CorrectConfig, ShiftPair
from featshift.operators.blocks import knn_join
from featshift.operators.candidates import SplitScorer, Term, candidate_argmin, correction_blocks
from featshift.plans import correct
from featshift.plans.correct import iteration_candidates
from featshift.operators.transport import directional_wasserstein
from tools.compare import compare_frames


def distance_scorer() -> SplitScorer:
    """(x - y)^2 as a sum of products."""
    return SplitScorer((Term(
        lambda x: np.column_stack([x[:, 0] ** 2, -2 * x[:, 0], np.ones(len(x))]),
        lambda y: np.column_stack([np.ones(len(y)), y[:, 0], y[:, 0] ** 2]),
    ),))


def long_pair(spark, n_ref: int, n_que: int) -> ShiftPair:
    reference = spark.range(n_ref).select("id", F.col("id").cast("double").alias("a"), (F.col("id") * 7.0).alias("b"))
    query = spark.range(n_que).select("id", (F.col("id") * 31.0 % 500).alias("a"), F.lit(-5.0).alias("b"))
    return ShiftPair.from_tables(reference, query, ["id"])


@pytest.mark.parametrize("n_que", [3, 40, 700])
def test_every_reference_row_is_offered_to_a_short_query(spark, n_que):
    pair = long_pair(spark, 1000, n_que)
    ref, que = correction_blocks(pair, 100)
    shares = que.toPandas()
    assert set(shares["block"]) == set(range(10)) and set(shares["id"]) == set(range(n_que))
    assert not shares.duplicated(["id", "block"]).any() and shares.groupby("block").size().max() < 200
    offered = iteration_candidates(pair, ["b"], ref, que, None, 1000, n_que, "0").toPandas()
    assert len(offered) == 2000
    rows = pair.query.join(que, "id").withColumn("half", F.lit(0))
    got = candidate_argmin(rows, spark.createDataFrame(offered), ["id"], ["a"], ["b"], {0: distance_scorer()}).toPandas()
    assert sorted(got["id"]) == list(range(n_que))
    a = {r["id"]: r["a"] for r in pair.query.collect()}
    want = {}
    for one, blocks in shares.groupby("id")["block"]:
        mine = offered[offered["block"].isin(blocks)].assign(score=lambda o: (a[one] - o["b"]) ** 2)
        want[one] = mine.sort_values(["score", "source", "candidate"]).iloc[0][["source", "b"]].tolist()
    assert {r.id: [r.source, r.b] for r in got.itertuples()} == want


def test_one_batch_size_for_every_reference(spark, monkeypatch):
    class Seen(Exception):
        pass

    def blocks(pair, batch_size, seed):
        raise Seen(batch_size)

    monkeypatch.setattr(correct, "correction_blocks", blocks)
    pair = long_pair(spark, 1, 1)
    for n_ref, batch in ((400, 400), (15000, 5000), (15001, 5000), (10**9, 5000)):
        with pytest.raises(Seen) as seen:
            correct._run_epochs(pair, ["b"], ["a"], CorrectConfig(), n_ref, 1, [])
        assert seen.value.args == (batch,)


def test_candidates_for_an_odd_number_of_rows(spark, sf_dir, tmp_path):
    db = duckdb.connect()
    n = db.execute(f"SELECT count(*) FROM '{sf_dir}/lineitem.parquet'").fetchone()[0]
    assert n % 2 == 0
    odd = tmp_path / "lineitem.parquet"
    db.execute(f"COPY (SELECT * FROM '{sf_dir}/lineitem.parquet' ORDER BY ALL LIMIT {n - 1}) TO '{odd}' (FORMAT parquet)")
    db.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{odd}'")
    got = contract.queries()["candidate_argmin"](spark, str(tmp_path)).toPandas()
    assert len(got) == n // 2
    assert compare_frames(got, db.execute(contract.oracle_sql()["candidate_argmin"]).df()) == ""


def test_rows_without_candidates_are_an_error(spark):
    rows = spark.createDataFrame([(1, 0, 0, 0, 1.0), (2, 0, 1, 0, 1.0)], "id int, block int, lap int, half int, a double")
    offered = spark.createDataFrame([(0, 0, 0, 1, 2.0)], "block int, lap int, source int, candidate int, b double")
    with pytest.raises(Exception, match="1 rows without candidates in block 0, lap 1"):
        candidate_argmin(rows, offered, ["id"], ["a"], ["b"], {0: distance_scorer()}).collect()


@pytest.mark.parametrize("wrong", [None, float("nan"), float("inf")])
def test_vectors_without_a_finite_value_are_refused(spark, wrong):
    good = spark.createDataFrame([(1, [0.0, 1.0]), (2, [2.0, 1.0])], "id int, vec array<double>")
    bad = spark.createDataFrame([(1, [0.0, wrong]), (2, [2.0, 1.0])], "id int, vec array<double>")
    for left, right in ((good, bad), (bad, good)):
        with pytest.raises(ValueError, match="1 .*vectors have missing or non-finite"):
            knn_join(left, right, 1)
        with pytest.raises(ValueError, match="1 vectors have missing or non-finite"):
            directional_wasserstein(left, right, np.eye(2))


def test_registered_sizes_are_the_defaults():
    from featshift.catalog import correcting, corruption, distances, locating

    for module in (correcting, corruption, locating):
        source = inspect.getsource(module)
        assert not re.search(r"(random_forest|boosted_trees)\(\d|numTrees=", source), module.__name__
    operator = inspect.signature(distances.sliced_wasserstein).parameters["n_projections"].default
    assert distances.DEFAULT_PROJECTIONS == operator == 200
