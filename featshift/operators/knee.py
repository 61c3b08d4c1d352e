"""From a measured curve to its knee, for many runs in one job.

A curve has one point per iteration: ``x`` features removed so far (0, increasing)
and ``y`` the balanced accuracy. ``walk_curves`` goes all the way with one shuffle by
run; the single steps are windows or equi-joins per run. A run has at most one
densified point per feature.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Fixed values of the method.
FLOOR = 0.5
START_BELOW = 0.8
TAIL_POINTS = 50
MIN_WINDOW = 5


def _along(run: str) -> WindowSpec:
    return W.partitionBy(run).orderBy("x")


def _up_to(run: str) -> WindowSpec:
    return _along(run).rowsBetween(W.unboundedPreceding, 0)


def _by_run(rows: DataFrame) -> DataFrame:
    """For joins: these rows follow the number of runs, and the estimate of their size knows neither
    densified points nor windows, so they are never broadcast through the driver."""
    return rows.hint("merge")


def densify(curve: DataFrame, run: str = "run_id") -> DataFrame:
    """Linear interpolation at every integer x from 0 to the last measured one."""
    nxt = curve.select(
        run, "x", "y", F.lead("x").over(_along(run)).alias("_x2"), F.lead("y").over(_along(run)).alias("_y2")
    )
    filled = nxt.select(
        run, "y", "_x2", "_y2", F.col("x").alias("_x1"),
        F.explode(F.sequence("x", F.coalesce(F.col("_x2") - 1, F.col("x")))).alias("x"),
    )
    slope = (F.col("_y2") - F.col("y")) / (F.col("_x2") - F.col("_x1"))
    y = F.when(F.col("_x2").isNull(), F.col("y")).otherwise(F.col("y") + slope * (F.col("x") - F.col("_x1")))
    return filled.select(run, "x", y.alias("y"))


def smoothing_window(curve: DataFrame, window_length: int = 2, run: str = "run_id") -> DataFrame:
    """``(run, window)``: odd window from the mean distance between measured points, at least 5."""
    spread = curve.groupBy(run).agg(F.max("x").alias("_last"), F.count("*").alias("_n"))
    delta = F.when(F.col("_n") > 1, F.col("_last") / (F.col("_n") - 1)).otherwise(0.0)
    odd = F.floor(delta * window_length / 2) * 2 + 1
    return spread.select(run, F.greatest(F.lit(MIN_WINDOW), odd).cast("int").alias("window"))


def smoothing_weights(windows: DataFrame, polyorder: int = 4) -> DataFrame:
    """``(window, offset, weight)`` of a least-squares polynomial evaluated at the window's centre."""

    def weights(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for window in batch["window"]:
                half = int(window) // 2
                offset = np.arange(-half, half + 1)
                basis = np.vander(offset / max(half, 1), polyorder + 1, increasing=True)
                yield pd.DataFrame({"window": window, "offset": offset, "weight": np.linalg.pinv(basis)[0]})

    return windows.select("window").distinct().mapInPandas(weights, "window int, offset int, weight double")


def smooth(dense: DataFrame, windows: DataFrame, polyorder: int = 4, run: str = "run_id") -> DataFrame:
    """Savitzky-Golay smoothing of densified points; beyond the ends the end point repeats.

    A run's points and its window's weights meet in one row, so nothing is multiplied by the window.
    """
    points = dense.groupBy(run, "x").agg(F.sum("y").alias("y"), F.count("*").alias("n"))
    runs = points.groupBy(run).agg(F.sort_array(F.collect_list(F.struct("x", "y", "n"))).alias("_points"))
    weights = smoothing_weights(windows, polyorder).groupBy("window").agg(
        F.collect_list(F.struct("offset", "weight")).alias("_weights")
    )
    first, last = F.col("_points")[0]["x"], F.element_at("_points", -1)["x"]
    plain = F.transform("_points", lambda p: p["y"])
    # A place for every integer, also where the caller has no point.
    filled = F.transform(F.sequence(first, last), lambda x: F.get(F.filter("_points", lambda p: p["x"] == x), F.lit(0))["y"])
    values = F.when(F.size("_points") == last - first + 1, plain).otherwise(filled)

    def smoothed(x: Column) -> Column:
        def add(total: Column, w: Column) -> Column:
            at = F.greatest(F.lit(0), F.least(F.col("_last"), x + w["offset"]))
            term = w["weight"] * F.get("_values", (at - F.col("_first")).cast("int"))
            return F.coalesce(total + term, total, term)

        return F.aggregate("_weights", F.lit(None).cast("double"), add)

    joined = runs.join(_by_run(windows), run).join(F.broadcast(weights), "window")
    held = joined.select(run, "_points", "_weights", first.alias("_first"), last.alias("_last"), values.alias("_values"))
    return held.select(
        run, F.inline(F.transform("_points", lambda p: F.struct(p["x"].alias("x"), (p["n"] * smoothed(p["x"])).alias("y"))))
    )


def running_minimum(points: DataFrame, run: str = "run_id") -> DataFrame:
    """No point higher than one to its left."""
    return points.withColumn("y", F.min("y").over(_up_to(run)))


def floor_at_half(points: DataFrame) -> DataFrame:
    return points.withColumn("y", F.greatest(F.col("y"), F.lit(FLOOR)))


def at_measured(points: DataFrame, curve: DataFrame, run: str = "run_id") -> DataFrame:
    """Keep the densified points at measured x; adds the raw value as ``y_raw``."""
    return points.join(_by_run(curve.select(run, "x", F.col("y").alias("y_raw"))), [run, "x"])


def smooth_curve(curve: DataFrame, window_length: int = 2, polyorder: int = 4, run: str = "run_id") -> DataFrame:
    """``(run, x, y_raw, y)``: the smoothed, falling, floored curve at the measured points."""
    windows = smoothing_window(curve, window_length, run)
    points = smooth(densify(curve, run), windows, polyorder, run)
    return at_measured(floor_at_half(running_minimum(points, run)), curve, run)


def drop_plateaus(points: DataFrame, run: str = "run_id") -> DataFrame:
    """Round to two decimals and keep a point only where the value changes."""
    rounded = points.select(run, "x", F.round("y", 2).alias("y"))
    before = rounded.withColumn("_before", F.lag("y").over(_along(run)))
    return before.filter(F.col("_before").isNull() | (F.col("y") != F.col("_before"))).drop("_before")


def from_start(points: DataFrame, run: str = "run_id") -> DataFrame:
    """Drop what lies before the first value under 0.8; keep everything if there is none."""
    first = F.min(F.when(F.col("y") < START_BELOW, F.col("x"))).over(W.partitionBy(run))
    return points.withColumn("_first", first).filter(
        F.col("_first").isNull() | (F.col("x") >= F.col("_first"))
    ).drop("_first")


def extend(points: DataFrame, sensitivity: int = 5, run: str = "run_id") -> DataFrame:
    """Add a flat tail of sensitivity + 50 points and a head point (x0 - 1, 1.0).

    The first and the last point of a run emit the new ones, so no join is needed.
    """
    order, whole = _along(run), W.partitionBy(run)
    around = points.select(
        run, F.col("x").cast("int").alias("x"), "y", F.lag("x").over(order).alias("_x1"), F.lead("x").over(order).alias("_x2")
    ).withColumn("_step", F.coalesce(F.max(F.col("x") - F.col("_x1")).over(whole), F.lit(1)))

    def point(x: Column, y: Column) -> Column:
        return F.struct(x.cast("int").alias("x"), y.alias("y"))

    nothing = F.array().cast("array<struct<x:int,y:double>>")
    head = F.when(F.col("_x1").isNull(), F.array(point(F.col("x") - 1, F.lit(1.0)))).otherwise(nothing)
    tail = F.when(
        F.col("_x2").isNull(),
        F.transform(
            F.sequence(F.lit(1), F.lit(sensitivity + TAIL_POINTS)),
            lambda i: point(F.col("x") + i * F.col("_step"), F.col("y")),
        ),
    ).otherwise(nothing)
    return around.select(run, F.inline(F.concat(head, F.array(point(F.col("x"), F.col("y"))), tail)))


def knee_of_extended(extended: DataFrame, sensitivity: float = 5, online: bool = False, run: str = "run_id") -> DataFrame:
    """``(run, knee, head)`` of a convex, falling curve after Satopaa et al. (2011); NULL when there is no knee.

    Both axes are brought to the unit square and y is turned upside down. Where the
    difference curve d = y' - x' has a local maximum, a threshold below it is set; the
    maximum is a knee once d falls under its threshold. A local minimum resets the
    threshold to 0. ``online`` takes the last such maximum instead of the first.
    """
    whole = W.partitionBy(run)
    order, seen = _along(run), _up_to(run)

    def unit(c: str) -> Column:
        lo, hi = F.min(c).over(whole), F.max(c).over(whole)
        return F.when(hi > lo, (F.col(c) - lo) / (hi - lo))

    scaled = extended.select(
        run, "x", (F.lit(1.0) - unit("y") - unit("x")).alias("d"), F.count("*").over(whole).alias("_n")
    )
    left, right = F.lag("d").over(order), F.lead("d").over(order)
    marked = scaled.withColumn("_next", right).withColumn(
        "_max", (left.isNull() | (F.col("d") >= left)) & (right.isNull() | (F.col("d") >= right)) & F.col("d").isNotNull()
    ).withColumn(
        "_min", (left.isNull() | (F.col("d") <= left)) & (right.isNull() | (F.col("d") <= right)) & F.col("d").isNotNull()
    )
    limit = F.when(F.col("_min"), F.lit(0.0)).when(F.col("_max"), F.col("d") - sensitivity / (F.col("_n") - 1))
    watched = marked.withColumn("_limit", F.last(limit, ignorenulls=True).over(seen)).withColumn(
        "_peak", F.last(F.when(F.col("_max"), F.col("x")), ignorenulls=True).over(seen)
    )
    fires = F.col("_peak").isNotNull() & F.col("_next").isNotNull() & (F.col("_next") < F.col("_limit"))
    pick = F.max_by if online else F.min_by
    return watched.groupBy(run).agg(
        pick(F.when(fires, F.col("_peak")), F.when(fires, F.col("x"))).alias("knee"), F.min("x").alias("head")
    )


def locate_knee(
    smoothed: DataFrame, sensitivity: int = 5, online: bool = False, no_knee: str = "first", run: str = "run_id"
) -> DataFrame:
    """``(run, knee_x, iteration_knee)`` from ``(run, x, y)`` at the measured points.

    Without a knee, or with the head point as knee, the first kept point is taken
    (``no_knee='last'``: the last measured one). The result is always a measured x:
    the nearest one not above the knee, else the first.
    """
    if no_knee not in ("first", "last"):
        raise ValueError("no_knee must be 'first' or 'last'")
    kept = from_start(drop_plateaus(smoothed, run), run)
    found = knee_of_extended(extend(kept, sensitivity, run), sensitivity, online, run)
    first = F.col("head") + 1
    no_knee_at = first if no_knee == "first" else F.col("_last")
    numbered = smoothed.select(run, "x", F.max("x").over(W.partitionBy(run)).alias("_last")).join(_by_run(found), run)
    target = F.when(F.col("knee").isNull(), no_knee_at).when(F.col("knee") == -1, first).otherwise(F.col("knee"))
    inside = F.col("x") <= target
    return numbered.groupBy(run).agg(
        F.coalesce(F.max(F.when(inside, F.col("x"))), F.min("x")).cast("int").alias("knee_x"),
        F.greatest(F.count_if(inside), F.lit(1)).cast("int").alias("iteration_knee"),
    )


def _weights(window: int, polyorder: int) -> np.ndarray:
    half = window // 2
    return np.linalg.pinv(np.vander(np.arange(-half, half + 1) / max(half, 1), polyorder + 1, increasing=True))[0]


def _smoothed(x: np.ndarray, y: np.ndarray, window_length: int, polyorder: int) -> np.ndarray:
    """The smoothed, falling, floored curve at the measured points."""
    last = int(x[-1])
    spread = last / (len(x) - 1) if len(x) > 1 else 0.0
    window = max(MIN_WINDOW, int(spread * window_length // 2) * 2 + 1)
    dense = np.interp(np.arange(last + 1), x, y)
    around = np.clip(np.arange(last + 1)[:, None] + np.arange(-(window // 2), window // 2 + 1), 0, last)
    return np.maximum(np.minimum.accumulate(dense[around] @ _weights(window, polyorder)), FLOOR)[x]


def _knees(x: np.ndarray, y: np.ndarray, sensitivity: int) -> tuple[int | None, int | None, int]:
    """First and last knee of the smoothed curve, and its first kept point."""
    two = np.array([float(Decimal(repr(float(v))).quantize(Decimal("0.01"), ROUND_HALF_UP)) for v in y])
    changes = np.concatenate(([True], two[1:] != two[:-1]))
    x, two = x[changes], two[changes]
    low = np.flatnonzero(two < START_BELOW)
    x, two = (x[low[0] :], two[low[0] :]) if len(low) else (x, two)
    step = int(np.diff(x).max()) if len(x) > 1 else 1
    tail = sensitivity + TAIL_POINTS
    xs = np.concatenate(([x[0] - 1], x, x[-1] + step * np.arange(1, tail + 1)))
    ys = np.concatenate(([1.0], two, np.full(tail, two[-1])))
    if ys.max() == ys.min():
        return None, None, int(x[0])
    d = 1.0 - (ys - ys.min()) / (ys.max() - ys.min()) - (xs - xs[0]) / (xs[-1] - xs[0])
    peak = limit = first = online = None
    for k in range(len(d)):
        at_left, at_right = k == 0, k + 1 == len(d)
        highest = (at_left or d[k] >= d[k - 1]) and (at_right or d[k] >= d[k + 1])
        lowest = (at_left or d[k] <= d[k - 1]) and (at_right or d[k] <= d[k + 1])
        if highest:
            peak, limit = int(xs[k]), d[k] - sensitivity / (len(d) - 1)
        if lowest:
            limit = 0.0
        if peak is not None and limit is not None and not at_right and d[k + 1] < limit:
            first, online = (peak if first is None else first), peak
    return first, online, int(x[0])


def walk_curves(
    curve: DataFrame, window_length: int = 2, polyorder: int = 4, sensitivity: int = 5, no_knee: str = "first", run: str = "run_id"
) -> DataFrame:
    """``(run, position, x, y_raw, y, knee_x, iteration_knee, online_x, iteration_online)`` per measured point.

    The same as ``smooth_curve`` and ``locate_knee`` (without and with ``online``), but every
    run is walked through as a whole after one shuffle. ``position`` counts the measured points
    of a run from 1; the knee columns are equal in all of them. Rows without a run, x or y are left out.
    """
    if no_knee not in ("first", "last"):
        raise ValueError("no_knee must be 'first' or 'last'")

    def walk(points: pa.Table) -> pa.Table:
        points = points.sort_by("x")
        x, raw = points.column("x").to_numpy(), points.column("y").to_numpy()
        y = _smoothed(x, raw, window_length, polyorder)
        first, online, start = _knees(x, y, sensitivity)
        columns = {run: points.column(run), "position": np.arange(1, len(x) + 1, dtype=np.int32), "x": x.astype(np.int32), "y_raw": raw, "y": y}
        for name, found in (("knee", first), ("online", online)):
            target = (start if no_knee == "first" else x[-1]) if found is None else start if found == -1 else found
            inside = int(np.count_nonzero(x <= target))
            columns[f"{name}_x"] = np.full(len(x), x[max(inside, 1) - 1], dtype=np.int32)
            columns[f"iteration_{name}"] = np.full(len(x), max(inside, 1), dtype=np.int32)
        return pa.table(columns)

    kind = curve.schema[run].dataType.simpleString()
    schema = f"`{run}` {kind}, position int, x int, y_raw double, y double, knee_x int, iteration_knee int, online_x int, iteration_online int"
    points = curve.select(run, F.col("x").cast("long").alias("x"), F.col("y").cast("double").alias("y")).dropna()
    return points.groupBy(run).applyInArrow(walk, schema)


def trim_report(report: DataFrame, knees: DataFrame, run: str = "run_id") -> DataFrame:
    """Feature report with everything removed at or after the knee iteration set back to 0."""
    late = F.col("ranking") >= F.col("iteration_knee")
    return report.join(knees.select(run, "iteration_knee"), run).select(
        *[
            F.when(late, F.lit(0)).otherwise(F.col(c)).cast(report.schema[c].dataType).alias(c)
            if c in ("mask", "ranking", "importance") else F.col(c)
            for c in report.columns
        ]
    )


def trim_iterations(rows: DataFrame, knees: DataFrame, run: str = "run_id") -> DataFrame:
    """Score or cut rows up to the knee iteration."""
    return rows.join(knees.select(run, "iteration_knee"), run).filter(
        F.col("iteration") <= F.col("iteration_knee")
    ).drop("iteration_knee")


def curve_table(
    walked: DataFrame, n_features: int | Column, f1: DataFrame | None = None, run: str = "run_id"
) -> DataFrame:
    """What a plot of the evolution needs: TVD, smoothed TVD, share removed and the knee mark.

    ``walked`` has (run, position, x, y_raw, y, knee_x). With ``f1``, rows (run, iteration, f1) of
    ``localization_f1``, there is a column ``f1`` too, NULL after the last iteration it knows.
    """
    total = F.lit(n_features) if isinstance(n_features, int) else n_features

    def tvd(c: str) -> Column:
        return F.greatest(F.lit(0.0), 2.0 * F.col(c) - 1.0)

    columns = [
        run, "x", tvd("y_raw").alias("tvd"), tvd("y").alias("tvd_smooth"),
        (100.0 * F.col("x") / total).alias("percent_removed"),
        (F.col("x") == F.col("knee_x")).cast("int").alias("is_knee"),
    ]
    if f1 is None:
        return walked.select(*columns)
    steps = f1.select(run, F.col("iteration").cast("int").alias("position"), "f1")
    return walked.join(steps, [run, "position"], "left").select(*columns, "f1")
