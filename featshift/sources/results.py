"""Append-only result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def append_results(rows: DataFrame, path: str) -> None:
    """Add rows to the table at ``path``, creating it when absent."""
    rows.write.mode("append").parquet(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
