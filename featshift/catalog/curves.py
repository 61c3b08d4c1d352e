"""Registered queries: every step from a measured curve to its knee."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featshift.catalog.base import SQL_CV, Query, customer_curves, long, r
from featshift.operators import knee as K
from featshift.operators.evaluate import localization_f1
from featshift.storage import materialize

WINDOW_LENGTH = 2
SENSITIVITY = 5


def _points(df: DataFrame) -> DataFrame:
    return df.select("run_id", long("x").alias("x"), r("y").alias("y"))


def _curve(spark: SparkSession, d: str) -> DataFrame:
    return customer_curves(spark, d)


def _smooth(spark: SparkSession, d: str) -> DataFrame:
    curve = _curve(spark, d)
    return K.smooth(K.densify(curve), K.smoothing_window(curve, WINDOW_LENGTH))


def _measured(spark: SparkSession, d: str) -> DataFrame:
    return K.smooth_curve(_curve(spark, d), WINDOW_LENGTH)


def _measured_out(spark: SparkSession, d: str) -> DataFrame:
    return _measured(spark, d).select("run_id", long("x").alias("x"), r("y").alias("y"), r("y_raw").alias("y_raw"))


def _kept(spark: SparkSession, d: str) -> DataFrame:
    return K.from_start(K.drop_plateaus(_curve(spark, d)))


def _walked(spark: SparkSession, d: str) -> DataFrame:
    return K.walk_curves(_curve(spark, d), WINDOW_LENGTH, sensitivity=SENSITIVITY)


def _knees(spark: SparkSession, d: str) -> DataFrame:
    return _walked(spark, d).filter("position = 1").select("run_id", "knee_x", "iteration_knee")


def knee_query(spark: SparkSession, d: str) -> DataFrame:
    return _walked(spark, d).filter("position = 1").select(
        "run_id", long("knee_x").alias("knee_x"), long("iteration_knee").alias("iteration_knee"), long("online_x").alias("knee_online")
    )


def knee_steps_query(spark: SparkSession, d: str) -> DataFrame:
    """The same knees by the single steps."""
    # Stored, so that the curves are smoothed once for both.
    measured = materialize(_measured(spark, d), "measured")
    offline = K.locate_knee(measured, SENSITIVITY)
    online = K.locate_knee(measured, SENSITIVITY, online=True).select(
        "run_id", F.col("knee_x").alias("knee_online")
    )
    return offline.join(online.hint("merge"), "run_id").select(
        "run_id", long("knee_x").alias("knee_x"), long("iteration_knee").alias("iteration_knee"),
        long("knee_online").alias("knee_online"),
    )


def trim_query(spark: SparkSession, d: str) -> DataFrame:
    """One feature per iteration, removed in that iteration with importance y, trimmed at the knee."""
    curve = _curve(spark, d)
    report = curve.select(
        "run_id", F.col("x").alias("feature"), F.lit(1).alias("mask"), F.col("iteration").alias("ranking"),
        F.col("y").alias("importance"),
    )
    return K.trim_report(report, _knees(spark, d)).select(
        "run_id", long("feature").alias("feature"), long("mask").alias("mask"), long("ranking").alias("ranking"),
        r("importance").alias("importance"),
    )


def trim_scores_query(spark: SparkSession, d: str) -> DataFrame:
    return K.trim_iterations(_curve(spark, d), _knees(spark, d)).select(
        "run_id", long("iteration").alias("iteration"), r("y").alias("y")
    )


def _table_columns(table: DataFrame, *more: str) -> DataFrame:
    return table.select(
        "run_id", long("x").alias("x"), r("tvd").alias("tvd"), r("tvd_smooth").alias("tvd_smooth"),
        r("percent_removed").alias("percent_removed"), long("is_knee").alias("is_knee"), *(r(c).alias(c) for c in more),
    )


def table_query(spark: SparkSession, d: str) -> DataFrame:
    return _table_columns(K.curve_table(_walked(spark, d), 100))


def table_f1_query(spark: SparkSession, d: str) -> DataFrame:
    """With the F1 of what was removed so far: a feature per iteration, corrupted where x is a multiple of 3."""
    curve = _curve(spark, d)
    report = curve.select("run_id", F.col("x").alias("feature"), F.col("iteration").alias("ranking"))
    truth = curve.select("run_id", F.col("x").alias("feature"), (F.col("x") % 3 == 0).cast("int").alias("is_corrupted"))
    return _table_columns(K.curve_table(_walked(spark, d), 100, localization_f1(report, truth)), "f1")


# --- the same steps in SQL -------------------------------------------------------
# The smoothing weights are the closed form for a quartic (Madden 1978).

_DENSE = SQL_CV + """,
nxt AS (SELECT run_id, x, y, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM cv WINDOW w AS (PARTITION BY run_id ORDER BY x)),
cells AS (SELECT run_id, x AS x1, y AS y1, x2, y2, unnest(range(x, coalesce(x2, x + 1))) AS x FROM nxt),
dense AS (SELECT run_id, x, CASE WHEN x2 IS NULL THEN y1 ELSE y1 + (y2 - y1) / (x2 - x1) * (x - x1) END AS y FROM cells)"""
_SMOOTH = _DENSE + f""",
win AS (SELECT run_id, max(x) AS last_x, greatest(5, CASE WHEN count(*) > 1
          THEN CAST(floor(max(x) / (count(*) - 1) * {WINDOW_LENGTH} / 2) AS BIGINT) * 2 + 1 ELSE 1 END) // 2 AS m FROM cv GROUP BY run_id),
offs AS (SELECT run_id, last_x, CAST(m AS DOUBLE) AS m, unnest(range(-m, m + 1)) AS i FROM win),
wts AS (SELECT run_id, last_x, i, 15.0 / 4.0 * ((15*m*m*m*m + 30*m*m*m - 35*m*m - 50*m + 12) - 35.0*(2*m*m + 2*m - 3)*i*i + 63.0*i*i*i*i)
          / ((2*m + 5)*(2*m + 3)*(2*m + 1)*(2*m - 1)*(2*m - 3)) AS wt FROM offs),
smooth AS (SELECT d.run_id, d.x, sum(wt * s.y) AS y FROM dense d JOIN wts USING (run_id)
           JOIN dense s ON s.run_id = d.run_id AND s.x = greatest(0, least(last_x, d.x + i)) GROUP BY d.run_id, d.x)"""
_RUNMIN_OF = "min(y) OVER (PARTITION BY run_id ORDER BY x)"
_MEASURED = _SMOOTH + f""",
falling AS (SELECT run_id, x, {_RUNMIN_OF} AS y FROM smooth),
measured AS (SELECT f.run_id, f.x, greatest(0.5, f.y) AS y, cv.y AS y_raw FROM falling f JOIN cv ON cv.run_id = f.run_id AND cv.x = f.x)"""


def _kept_sql(source: str) -> str:
    return f""",
r2 AS (SELECT run_id, x, round(y, 2) AS y FROM {source}),
lagged AS (SELECT *, lag(y) OVER (PARTITION BY run_id ORDER BY x) AS b FROM r2),
steps AS (SELECT run_id, x, y FROM lagged WHERE b IS NULL OR y <> b),
kept AS (SELECT run_id, x, y FROM (SELECT *, min(CASE WHEN y < 0.8 THEN x END) OVER (PARTITION BY run_id) AS f FROM steps)
         WHERE f IS NULL OR x >= f)"""


_EXTENDED = f""",
gaps AS (SELECT *, x - lag(x) OVER (PARTITION BY run_id ORDER BY x) AS gap FROM kept),
ends AS (SELECT run_id, min(x) AS x0, max(x) AS x9, arg_max(y, x) AS y9, coalesce(max(gap), 1) AS step FROM gaps GROUP BY run_id),
ext AS (SELECT run_id, x, y FROM kept
        UNION ALL SELECT run_id, x9 + i * step, y9 FROM ends, range(1, {SENSITIVITY + 51}) t(i)
        UNION ALL SELECT run_id, x0 - 1, 1.0 FROM ends)"""
_KNEE = _EXTENDED + f""",
spans AS (SELECT run_id, min(x) AS xl, max(x) AS xh, min(y) AS yl, max(y) AS yh, count(*) AS n FROM ext GROUP BY run_id),
diff AS (SELECT run_id, x, n, CASE WHEN yh > yl THEN 1.0 - (y - yl) / (yh - yl) - (x - xl) / CAST(xh - xl AS DOUBLE) END AS d FROM ext JOIN spans USING (run_id)),
near AS (SELECT *, lag(d) OVER w AS dl, lead(d) OVER w AS dr FROM diff WINDOW w AS (PARTITION BY run_id ORDER BY x)),
marks AS (SELECT *, d IS NOT NULL AND (dl IS NULL OR d >= dl) AND (dr IS NULL OR d >= dr) AS is_max,
                 d IS NOT NULL AND (dl IS NULL OR d <= dl) AND (dr IS NULL OR d <= dr) AS is_min FROM near),
watch AS (SELECT run_id, x, dr,
   last_value(CASE WHEN is_min THEN 0.0 WHEN is_max THEN d - {float(SENSITIVITY)} / (n - 1) END IGNORE NULLS) OVER w AS lim,
   last_value(CASE WHEN is_max THEN x END IGNORE NULLS) OVER w AS peak
   FROM marks WINDOW w AS (PARTITION BY run_id ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
fired AS (SELECT run_id, arg_min(peak, x) AS offline, arg_max(peak, x) AS online FROM watch
          WHERE peak IS NOT NULL AND dr IS NOT NULL AND dr < lim GROUP BY run_id),
firsts AS (SELECT run_id, min(x) AS f FROM kept GROUP BY run_id),
targets AS (SELECT run_id, CASE WHEN offline IS NULL OR offline = -1 THEN f ELSE offline END AS t,
                   CASE WHEN online IS NULL OR online = -1 THEN f ELSE online END AS t_online FROM firsts LEFT JOIN fired USING (run_id)),
knees AS (SELECT run_id, coalesce(max(x) FILTER (x <= t), min(x)) AS knee_x, greatest(count(*) FILTER (x <= t), 1) AS iteration_knee,
                 coalesce(max(x) FILTER (x <= t_online), min(x)) AS knee_online FROM measured JOIN targets USING (run_id) GROUP BY run_id)"""
_FULL = _MEASURED + _kept_sql("measured") + _KNEE
_OUT = "SELECT run_id, CAST(x AS BIGINT) AS x, round(y, 4) + 0.0 AS y FROM"

_KNEE_SQL = f"""WITH {_FULL} SELECT run_id, CAST(knee_x AS BIGINT) AS knee_x, iteration_knee,
CAST(knee_online AS BIGINT) AS knee_online FROM knees"""
_TABLE_SQL = """SELECT run_id, CAST(x AS BIGINT) AS x, round(greatest(0.0, 2 * y_raw - 1), 4) + 0.0 AS tvd, round(greatest(0.0, 2 * y - 1), 4) + 0.0 AS tvd_smooth,
       round(100.0 * x / 100, 4) + 0.0 AS percent_removed, CAST(x = knee_x AS BIGINT) AS is_knee"""

QUERIES = [
    Query("curve_densify", lambda s, d: _points(K.densify(_curve(s, d))), f"WITH {_DENSE} {_OUT} dense"),
    Query("curve_savgol", lambda s, d: _points(_smooth(s, d)), f"WITH {_SMOOTH} {_OUT} smooth"),
    Query("curve_running_min", lambda s, d: _points(K.running_minimum(_curve(s, d))),
          f"WITH {SQL_CV} SELECT run_id, CAST(x AS BIGINT) AS x, round({_RUNMIN_OF}, 4) + 0.0 AS y FROM cv"),
    Query("curve_floor", lambda s, d: _points(K.floor_at_half(_curve(s, d))),
          f"WITH {SQL_CV} SELECT run_id, CAST(x AS BIGINT) AS x, round(greatest(y, 0.5), 4) + 0.0 AS y FROM cv"),
    Query("curve_measured", _measured_out,
          f"WITH {_MEASURED} SELECT run_id, CAST(x AS BIGINT) AS x, round(y, 4) + 0.0 AS y, round(y_raw, 4) + 0.0 AS y_raw FROM measured"),
    Query("curve_plateaus", lambda s, d: _points(K.drop_plateaus(_curve(s, d))), f"WITH {SQL_CV}{_kept_sql('cv')} {_OUT} steps"),
    Query("curve_start", lambda s, d: _points(_kept(s, d)), f"WITH {SQL_CV}{_kept_sql('cv')} {_OUT} kept"),
    Query("curve_extend", lambda s, d: _points(K.extend(_kept(s, d), SENSITIVITY)), f"WITH {SQL_CV}{_kept_sql('cv')}{_EXTENDED} {_OUT} ext"),
    Query("curve_knee", knee_query, _KNEE_SQL),
    Query("curve_knee_steps", knee_steps_query, _KNEE_SQL),
    Query("trim_to_knee", trim_query, f"""WITH {_FULL}
SELECT run_id, CAST(x AS BIGINT) AS feature, CAST(iteration < iteration_knee AS BIGINT) AS mask,
       CAST(CASE WHEN iteration < iteration_knee THEN iteration ELSE 0 END AS BIGINT) AS ranking,
       CASE WHEN iteration < iteration_knee THEN round(y, 4) + 0.0 ELSE 0.0 END AS importance FROM cv JOIN knees USING (run_id)"""),
    Query("trim_scores", trim_scores_query, f"""WITH {_FULL}
SELECT run_id, CAST(iteration AS BIGINT) AS iteration, round(y, 4) + 0.0 AS y FROM cv JOIN knees USING (run_id) WHERE iteration <= iteration_knee"""),
    Query("curve_table", table_query, f"WITH {_FULL} {_TABLE_SQL} FROM measured JOIN knees USING (run_id)"),
    Query("curve_table_f1", table_f1_query, f"""WITH {_FULL},
hits AS (SELECT a.run_id, a.x, count(b.x) FILTER (b.iteration < a.iteration AND b.x % 3 = 0) AS tp,
                count(b.x) FILTER (b.iteration < a.iteration AND b.x % 3 <> 0) AS fp, count(b.x) FILTER (b.x % 3 = 0) AS n
         FROM cv a JOIN cv b ON a.run_id = b.run_id GROUP BY a.run_id, a.x)
{_TABLE_SQL}, round(CASE WHEN fp + n + tp > 0 THEN 2.0 * tp / (fp + n + tp) ELSE 1.0 END, 4) + 0.0 AS f1
FROM measured JOIN knees USING (run_id) JOIN hits USING (run_id, x)"""),
]
