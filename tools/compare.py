"""Order-insensitive comparison of a Spark result with a SQL result."""

from __future__ import annotations

import os

import pandas as pd
from pyspark.sql import SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def local_session(cpus: str | int | None = None) -> SparkSession:
    cpus = cpus or os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("featshift")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].astype(object)
    rows = sorted((tuple("" if v is None or pd.isna(v) else repr(v.item() if hasattr(v, "item") else v) for v in row) for row in df.itertuples(index=False)))
    return pd.DataFrame(rows, columns=df.columns)


def compare_frames(got: pd.DataFrame, want: pd.DataFrame) -> str:
    """Empty when equal, else what differs."""
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    kinds = {c: (got[c].dtype.kind, want[c].dtype.kind) for c in got.columns if got[c].dtype != want[c].dtype and got[c].dtype.kind in "iufb" and want[c].notna().any()}
    a, b = _canonical(got), _canonical(want)
    if not a.equals(b):
        left = set(a.itertuples(index=False, name=None))
        right = set(b.itertuples(index=False, name=None))
        return f"values differ; only spark {sorted(left - right)[:3]} only sql {sorted(right - left)[:3]} n={len(left - right)} types {kinds}"
    return f"types differ {kinds}" if kinds else ""
