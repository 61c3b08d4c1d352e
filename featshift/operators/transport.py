"""One-dimensional transport distances along many directions at once.

Values are folded per direction, ranked by a sample sort and laid out on the
unit interval of mass. That interval is cut into equal pieces, so each window works
on about the same mass, whatever the distribution or the number of equal values.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from featshift.functions.hashing import unit_directions
from featshift.operators.blocks import check_dimension, matrix, non_finite, require_finite
from featshift.operators.rank import in_order, running_totals
from featshift.sources.pair import ShiftPair
from featshift.storage import materialize

#: Distinct values for each piece of the unit interval of mass, and the least number of pieces.
PIECE_VALUES, LEAST_PIECES = 100_000, 256


def _project(points: DataFrame, directions: np.ndarray) -> DataFrame:
    """Long table of projected values."""
    shared = points.sparkSession.sparkContext.broadcast(directions)

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x, side = matrix(batch["vec"]), batch["side"].to_numpy()
            for j, axis in enumerate(shared.value):
                yield pd.DataFrame({"projection": j, "side": side, "value": (x * axis).sum(axis=1), "weight": 1})

    return points.select("vec", "side").mapInPandas(project, "projection int, side int, value double, weight bigint")


def directional_wasserstein(
    reference: DataFrame, query: DataFrame, directions: Sequence[Sequence[float]], pieces: int | None = None
) -> DataFrame:
    """``(projection, cost)``: squared 2-Wasserstein distance along every direction.

    Exact for samples of different sizes. Values are put in order by a sample sort; the
    number of its ranges and of the ``pieces`` follows the number of distinct values.
    """
    axes = np.asarray(directions, dtype=float)
    both = reference.select("vec", F.lit(0).alias("side")).unionByName(query.select("vec", F.lit(1).alias("side")))
    # Read twice below; what it took to make the vectors is paid once.
    both = materialize(both, "vectors")
    size = F.size("vec")
    sides = both.groupBy("side").agg(
        F.count("*").alias("n"), F.min(size).alias("lo"), F.max(size).alias("hi"), non_finite().alias("gaps")
    ).collect()
    require_finite(sum(s["gaps"] for s in sides), "vectors")
    n = {0: 0, 1: 0} | {s["side"]: s["n"] for s in sides}
    if any(length != axes.shape[1] for s in sides for length in (s["lo"], s["hi"])):
        raise ValueError("directions and vectors differ in length")
    folded = _project(both, axes).groupBy("projection", "side", "value").agg(F.sum("weight").alias("weight"))
    folded = materialize(folded, "projected")
    n_values = folded.count()
    pieces = pieces or max(LEAST_PIECES, math.ceil(n_values / PIECE_VALUES))
    ranges = in_order(folded, ["projection", "side", "value"], n_values)
    ranked = running_totals(ranges, {"upto": F.col("weight")}, F.col("_bucket"), ["value"], ["projection", "side"])
    size = F.when(F.col("side") == 0, F.lit(n[0])).otherwise(F.lit(n[1]))
    placed = ranked.select(
        "projection", "side", "value",
        ((F.col("upto") - F.col("weight")) / size).alias("_from"), (F.col("upto") / size).alias("_to"),
    )
    first = F.least(F.lit(pieces - 1), F.floor(F.col("_from") * pieces))
    last = F.least(F.lit(pieces - 1), F.ceil(F.col("_to") * pieces) - 1)
    cut = placed.withColumn("piece", F.explode(F.sequence(first, F.greatest(first, last)))).withColumn(
        "end", F.least(F.col("_to"), (F.col("piece") + 1) / F.lit(float(pieces)))
    )
    down = W.partitionBy("projection", "piece").orderBy(F.desc("end"), "side", "value")
    covering = down.rowsBetween(W.unboundedPreceding, 0)

    def value_of(side: int):
        return F.last(F.when(F.col("side") == side, F.col("value")), ignorenulls=True).over(covering)

    start = F.coalesce(F.lead("end").over(down), F.col("piece") / F.lit(float(pieces)))
    steps = cut.select("projection", (F.col("end") - start).alias("_width"), (value_of(0) - value_of(1)).alias("_gap"))
    return steps.groupBy("projection").agg(F.sum(F.col("_width") * F.col("_gap") * F.col("_gap")).alias("cost"))


def sliced_wasserstein(reference: DataFrame, query: DataFrame, n_projections: int = 200, seed: int | str = 0) -> DataFrame:
    """Root mean squared Wasserstein distance over seeded random directions, one row."""
    axes = unit_directions(seed, n_projections, check_dimension(reference, query))
    return directional_wasserstein(reference, query, axes).agg(F.sqrt(F.avg("cost")).alias("distance"))


def feature_wasserstein(pair: ShiftPair) -> DataFrame:
    """``(feature, position, distance)``: exact transport distance of every single feature, missing values filled."""
    pair = pair.with_missing_filled()

    def side(df: DataFrame) -> DataFrame:
        return df.select(F.array(*[F.col(c).cast("double") for c in pair.features]).alias("vec"))

    costs = directional_wasserstein(side(pair.reference), side(pair.query), np.eye(len(pair.features)))
    names = F.array(*[F.lit(c) for c in pair.features])
    return costs.select(
        F.element_at(names, F.col("projection") + 1).alias("feature"), F.col("projection").alias("position"),
        F.sqrt(F.greatest(F.lit(0.0), F.col("cost"))).alias("distance"),
    )
