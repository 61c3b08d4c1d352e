"""Every registered query at the smallest scale, against its SQL where it has one."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as contract
from tools.compare import TABLES, compare_frames


@pytest.fixture(scope="module")
def db(sf_dir):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def test_contract_names():
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(contract.queries()))
def test_query(name, spark, sf_dir, db):
    got = contract.queries()[name](spark, sf_dir).toPandas()
    assert len(got) > 0
    sql = contract.oracle_sql().get(name)
    if sql is not None:
        assert compare_frames(got, db.execute(sql).df()) == ""


def test_entry(spark):
    assert set(contract.entry(spark).columns) == {"iteration", "metric", "mean", "std", "tvd"}
