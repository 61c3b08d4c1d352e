"""Registered queries: corruption of the query half, its size, and Gaussian pairs."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession

from featshift.catalog.base import (
    LI_FEATURES, LI_KEY, LI_KEY_SQL, SQL_LI_HALVES, Query, lineitem_pair, long, orders, r, rounded, sql_rank, sql_round,
    sql_rounded, sql_uniform,
)
from featshift.functions.hashing import driver_uniform
from featshift.operators.corrupt import corrupt_features, corruption_rmse, impute_features, network_mix
from featshift.sources.gaussian import gaussian_pair

SEED = 1
# These read their input several times.
SHUFFLING = (3, 7, 8)


def _corrupted(code: float) -> Callable[[SparkSession, str], DataFrame]:
    def build(spark: SparkSession, d: str) -> DataFrame:
        query = lineitem_pair(spark, d, stored=code in SHUFFLING).query
        return corrupt_features(query, LI_KEY, LI_FEATURES, code, SEED).select(*LI_KEY, *rounded(LI_FEATURES))

    return build


def _each(expr: Callable[[str], str]) -> str:
    columns = ", ".join(sql_round(expr(c), c) for c in LI_FEATURES)
    return f"WITH {SQL_LI_HALVES} SELECT {LI_KEY_SQL}, {columns} FROM que"


def _u(c: str) -> str:
    return sql_uniform(f"{SEED}:{c}", *LI_KEY)


def _noise(size: float) -> str:
    return _each(lambda c: f"least(1.0, greatest(0.0, {c} + CASE WHEN {_u(c)} < 0.5 THEN -{size} ELSE {size} END))")


def _flip(share: float) -> str:
    return _each(lambda c: f"CASE WHEN {_u(c)} < {share} THEN 1.0 - {c} ELSE {c} END")


_PERMUTE_EACH = f"WITH {SQL_LI_HALVES}, slots AS (SELECT {LI_KEY_SQL}, {sql_rank(f'{SEED}:slot', LI_KEY)} AS rk FROM que)" + "".join(
    f", v_{c} AS (SELECT {c}, row_number() OVER (ORDER BY md5(concat_ws(':', '{SEED}:value', '{c}', {LI_KEY_SQL})), {LI_KEY_SQL}) AS rk FROM que)"
    for c in LI_FEATURES
) + f" SELECT {LI_KEY_SQL}, {sql_rounded(LI_FEATURES)} FROM slots " + " ".join(
    f"JOIN v_{c} USING (rk)" for c in LI_FEATURES
)

_PERMUTE_JOINT = f"""WITH {SQL_LI_HALVES},
slots AS (SELECT {LI_KEY_SQL}, {sql_rank(f'{SEED}:slot', LI_KEY)} AS rk FROM que),
vals AS (SELECT {', '.join(LI_FEATURES)}, {sql_rank(f'{SEED}:value', LI_KEY)} AS rk FROM que)
SELECT {LI_KEY_SQL}, {sql_rounded(LI_FEATURES)} FROM slots JOIN vals USING (rk)"""


# A network of 8 units a layer, whose weights SQL can make too; the query ``corrupt_mlp`` has the full width.
NARROW = (len(LI_FEATURES), 8, 8, 8, len(LI_FEATURES))


def mlp_narrow(spark: SparkSession, d: str) -> DataFrame:
    """The random network at 8 units a layer, its weights drawn from hashes of layer, input and output."""
    layers = []
    for layer, (fan_in, fan_out) in enumerate(zip(NARROW, NARROW[1:])):
        draws = [[driver_uniform(f"{SEED}:weight", layer, i, j) for j in range(fan_out)] for i in range(fan_in + 1)]
        values = (2.0 * np.array(draws) - 1.0) / np.sqrt(fan_in)
        layers.append((values[:-1], values[-1]))
    mixed = network_mix(lineitem_pair(spark, d, stored=True).query, LI_FEATURES, layers)
    return mixed.select(*LI_KEY, *rounded(LI_FEATURES))


def _mlp_sql() -> str:
    """Layer by layer a join with the table of weights and sums by row and unit; input ``fan_in`` is the bias."""
    last = len(NARROW) - 2
    sizes = ", ".join(f"({layer}, {a}, {b})" for layer, (a, b) in enumerate(zip(NARROW, NARROW[1:])))
    steps = []
    for layer in range(last + 1):
        out = "sum(v * w)" if layer == last else "greatest(0.0, sum(v * w))"
        bias = f"SELECT rid, {NARROW[layer]} AS i, 1.0::DOUBLE AS v FROM points"
        steps.append(f"x{layer + 1} AS MATERIALIZED (SELECT rid, j AS i, {out} AS v FROM (SELECT * FROM x{layer} UNION ALL {bias}) x "
                     f"JOIN weights w ON w.layer = {layer} AND w.i = x.i GROUP BY rid, j)")
    start = " UNION ALL ".join(f"SELECT rid, {i} AS i, {c}::DOUBLE AS v FROM points" for i, c in enumerate(LI_FEATURES))
    value = "CASE WHEN is_binary THEN CASE WHEN v >= 0 THEN 1.0 ELSE 0.0 END WHEN hi > lo THEN (v - lo) / (hi - lo) ELSE 0.0 END"
    columns = ", ".join(sql_round(f"max(CASE WHEN i = {i} THEN {value} END)", c) for i, c in enumerate(LI_FEATURES))
    return f"""WITH {SQL_LI_HALVES},
points AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY {LI_KEY_SQL}) AS rid FROM que),
sizes(layer, fan_in, fan_out) AS (VALUES {sizes}),
places AS (SELECT layer, fan_in, i, unnest(range(fan_out)) AS j FROM (SELECT *, unnest(range(fan_in + 1)) AS i FROM sizes)),
weights AS MATERIALIZED (SELECT layer, i, j, (2.0 * {sql_uniform(f'{SEED}:weight', 'layer', 'i', 'j')} - 1.0) / sqrt(fan_in) AS w FROM places),
x0 AS MATERIALIZED ({start}),
{', '.join(steps)},
spans AS (SELECT *, max(v) OVER (PARTITION BY i) AS hi, min(v) OVER (PARTITION BY i) AS lo FROM x{last + 1}),
kinds AS (SELECT i, bool_and(v IN (0.0, 1.0)) AS is_binary FROM x0 GROUP BY i)
SELECT {LI_KEY_SQL}, {columns} FROM spans JOIN kinds USING (i) JOIN points USING (rid) GROUP BY {LI_KEY_SQL}"""


def impute_linear(spark: SparkSession, d: str) -> DataFrame:
    pair = lineitem_pair(spark, d)
    out = impute_features(pair.reference, pair.query, ["l_extendedprice"], ["l_quantity"], LinearRegression(solver="normal"))
    return out.select(*LI_KEY, *rounded(LI_FEATURES))


def impute_forest(spark: SparkSession, d: str) -> DataFrame:
    pair = lineitem_pair(spark, d)
    forest = RandomForestRegressor(seed=0)
    out = impute_features(pair.reference, pair.query, ["l_extendedprice"], ["l_quantity", "l_discount", "l_tax"], forest)
    return out.select(*LI_KEY, *rounded(LI_FEATURES))


def rmse(spark: SparkSession, d: str) -> DataFrame:
    query = lineitem_pair(spark, d).query
    noisy = corrupt_features(query, LI_KEY, ("l_quantity", "l_tax"), 4.3, SEED)
    flipped = corrupt_features(noisy, LI_KEY, ("l_discount",), 6.2, SEED)
    return corruption_rmse(query, flipped, LI_KEY, LI_FEATURES).select(
        "feature", long("position").alias("position"), r("rmse").alias("rmse")
    )


def _rmse_sql() -> str:
    def after(c: str) -> str:
        if c in ("l_quantity", "l_tax"):
            return f"least(1.0, greatest(0.0, {c} + CASE WHEN {_u(c)} < 0.5 THEN -0.1 ELSE 0.1 END))"
        if c == "l_discount":
            return f"CASE WHEN {_u(c)} < 0.4 THEN 1.0 - {c} ELSE {c} END"
        return c

    return f"WITH {SQL_LI_HALVES} " + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, CAST({i} AS BIGINT) AS position, {sql_round(f'sqrt(avg(power({c} - ({after(c)}), 2)))', 'rmse')} FROM que"
        for i, c in enumerate(LI_FEATURES)
    )


GAUSS = ["f0", "f1", "f2", "f3"]
COVARIANCE = np.array([[2.0, 0.6, 0.2, 0.0], [0.6, 1.0, 0.3, 0.1], [0.2, 0.3, 1.5, 0.4], [0.0, 0.1, 0.4, 1.0]])


def gaussian_diagonal(spark: SparkSession, d: str) -> DataFrame:
    rows = orders(spark, d).select("o_orderkey")
    pair = gaussian_pair(rows, ("o_orderkey",), 4, 2, mean_shift=0.5, scale_shift=0.25, seed=3)
    return pair.labelled().select("o_orderkey", long("label").alias("label"), *rounded(GAUSS))


def gaussian_full(spark: SparkSession, d: str) -> DataFrame:
    rows = orders(spark, d).select("o_orderkey")
    pair = gaussian_pair(
        rows, ("o_orderkey",), 4, 2, mean_shift=0.5, scale_shift=0.25, shuffle_manipulation="sample-wise",
        covariance=COVARIANCE, seed=3,
    )
    return pair.labelled().select("o_orderkey", long("label").alias("label"), *rounded(GAUSS))


def _z(side: str, j: int) -> str:
    a, b = sql_uniform(f"3:{side}:{j}:radius", "o_orderkey"), sql_uniform(f"3:{side}:{j}:angle", "o_orderkey")
    return f"sqrt(-2.0 * ln(1.0 - {a})) * cos(2.0 * pi() * {b})"


def _gaussian_sql(left: np.ndarray, right: np.ndarray) -> str:
    def side(label: int, name: str, factor: np.ndarray, shift: float) -> str:
        zs = ", ".join(f"{_z(name, j)} AS z{j}" for j in range(4))
        values = []
        for i in range(4):
            terms = " + ".join(f"CAST({factor[i, j]!r} AS DOUBLE) * z{j}".replace("np.float64(", "").replace(")!", "") for j in range(4))
            mean = shift if i < 2 else 0.0
            values.append(sql_round(f"{mean} + {terms}", f"f{i}"))
        return f"SELECT o_orderkey, CAST({label} AS BIGINT) AS label, {', '.join(values)} FROM (SELECT o_orderkey, {zs} FROM orders)"

    return side(0, "reference", left.astype(object), 0.0) + " UNION ALL " + side(1, "query", right.astype(object), 0.5)


# By hand: variances of the first two raised by a quarter, covariances across the two groups cut.
_CUT = np.array([[2.25, 0.6, 0.0, 0.0], [0.6, 1.25, 0.0, 0.0], [0.0, 0.0, 1.5, 0.4], [0.0, 0.0, 0.4, 1.0]])

QUERIES = [
    Query("corrupt_uniform", _corrupted(1), _each(_u)),
    Query("corrupt_complement", _corrupted(2), _each(lambda c: f"1.0 - {c}")),
    Query("corrupt_permute_each", _corrupted(3), _PERMUTE_EACH),
    Query("corrupt_noise_02", _corrupted(4.1), _noise(0.02)),
    Query("corrupt_noise_05", _corrupted(4.2), _noise(0.05)),
    Query("corrupt_noise_10", _corrupted(4.3), _noise(0.1)),
    Query("corrupt_binarize", _corrupted(5), _each(lambda c: f"CASE WHEN {c} > 0.5 THEN 1.0 ELSE 0.0 END")),
    Query("corrupt_flip_20", _corrupted(6.1), _flip(0.2)),
    Query("corrupt_flip_40", _corrupted(6.2), _flip(0.4)),
    Query("corrupt_flip_60", _corrupted(6.3), _flip(0.6)),
    Query("corrupt_flip_80", _corrupted(6.4), _flip(0.8)),
    Query("corrupt_mlp", _corrupted(7)),
    Query("corrupt_mlp_narrow", mlp_narrow, _mlp_sql()),
    Query("corrupt_permute_joint", _corrupted(8), _PERMUTE_JOINT),
    Query("impute_linear", impute_linear, f"""WITH {SQL_LI_HALVES},
fit AS (SELECT regr_slope(l_extendedprice, l_quantity) AS a, regr_intercept(l_extendedprice, l_quantity) AS b FROM ref)
SELECT {LI_KEY_SQL}, {sql_rounded(['l_quantity', 'l_discount', 'l_tax'])}, {sql_round('a * l_quantity + b', 'l_extendedprice')}
FROM que, fit"""),
    Query("impute_forest", impute_forest),
    Query("corruption_rmse", rmse, _rmse_sql()),
    Query("gaussian_pair", gaussian_diagonal, _gaussian_sql(np.eye(4), np.diag([1.25, 1.25, 1.0, 1.0]))),
    Query("gaussian_pair_full", gaussian_full,
          _gaussian_sql(np.linalg.cholesky(COVARIANCE), np.linalg.cholesky(_CUT))),
]
