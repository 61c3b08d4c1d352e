"""Shared-folder tables: how loops cut lineage and how results are kept.

Everything is written below the folder the session names in
``spark.checkpoint.dir``, so a lost executor costs a re-read, not a re-run.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import AbstractContextManager, contextmanager

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
_scope = ""


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors reach; only a session inside one process may go without the setting."""
    context = spark.sparkContext
    folder = spark.conf.get(_SETTING, None) or context.getCheckpointDir()
    if folder:
        return folder
    if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
        raise ValueError(f"set {_SETTING} to a folder that all executors can reach")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="featshift-"))
    return context.getCheckpointDir()


def session_folder(spark: SparkSession) -> str:
    """Where this application keeps its tables."""
    return f"{shared_folder(spark).rstrip('/')}/featshift/{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{session_folder(spark)}/{_scope}{name}-{uuid.uuid4().hex}"


@contextmanager
def scope(name: str) -> Iterator[None]:
    """Keep the tables stored meanwhile in a folder of their own, for ``drop_scope``."""
    global _scope
    outer, _scope = _scope, f"{name}/"
    try:
        yield
    finally:
        _scope = outer


def drop_path(spark: SparkSession, folder: str) -> None:
    """Remove a folder from ``fresh_path``."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop_scope(spark: SparkSession, name: str) -> None:
    """Remove the tables stored in a scope; results read from them become unusable."""
    drop_path(spark, f"{session_folder(spark)}/{name}")


def drop_stored_tables(spark: SparkSession) -> None:
    """Remove every table this application stored; results read from them become unusable."""
    drop_path(spark, session_folder(spark))


def materialize(df: DataFrame | Sequence[DataFrame], name: str, rows_per_file: int = 0) -> DataFrame:
    """Write ``df`` once to the shared folder, ``rows_per_file`` (0: any number) to a file, and read it back without lineage.

    Several tables of the same columns are written one after the other, and read as one.
    """
    tables = [df] if isinstance(df, DataFrame) else df
    spark = tables[0].sparkSession
    path = fresh_path(spark, name)
    for rows in tables:
        rows.write.mode("append").option("compression", "zstd").option("maxRecordsPerFile", rows_per_file).parquet(path)
    stored = spark.read.schema(tables[0].schema).parquet(path)
    stored._stored_path = path
    return stored


def forget(*stored: DataFrame) -> None:
    """Remove tables that ``materialize`` returned; nothing that is still to be computed may read them."""
    for df in stored:
        drop_path(df.sparkSession, df._stored_path)


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """Jobs that run meanwhile see this value of a setting."""
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def shuffles_removed(spark: SparkSession) -> AbstractContextManager[None]:
    """What a query shuffles meanwhile is removed from disk when it ends, not when the driver next collects garbage."""
    return setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
