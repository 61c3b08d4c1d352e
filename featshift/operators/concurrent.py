"""Several fits at once, as concurrent Spark jobs of one session."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import partial
from multiprocessing.pool import ThreadPool
from typing import TypeVar

from py4j.protocol import Py4JJavaError
from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession

Item = TypeVar("Item")
Result = TypeVar("Result")


def run_together(spark: SparkSession, work: Callable[[Item], Result], items: Sequence[Item], parallelism: int) -> list[Result]:
    """``work`` of every item, at most ``parallelism`` at a time; one that fails in the JVM is tried once more.

    Every call gets a copy of the session's local properties of its own: threads that share
    one copy would take each other's execution ids for theirs.
    """

    def attempt(item: Item) -> Result:
        try:
            return work(item)
        except Py4JJavaError:
            return work(item)

    calls = [inheritable_thread_target(spark)(partial(attempt, item)) for item in items]
    with ThreadPool(max(1, min(parallelism, len(calls)))) as pool:
        return pool.map(lambda call: call(), calls)
