"""Inputs shared by the registered queries, each as a DataFrame and as SQL text."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from featshift.operators.prepare import half_split, minmax_scale, stratified_folds
from featshift.sources.pair import ShiftPair
from featshift.storage import materialize


@dataclass(frozen=True)
class Query:
    """A registered query: a Spark builder and, where SQL can say it, the SQL to compare with."""

    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r(value: str | Column, digits: int = 4) -> Column:
    """Rounded double without negative zero."""
    c = F.col(value) if isinstance(value, str) else value
    return F.round(c.cast("double"), digits) + F.lit(0.0)


def rounded(columns: Sequence[str], digits: int = 4) -> list[Column]:
    return [r(c, digits).alias(c) for c in columns]


def long(value: str | Column) -> Column:
    c = F.col(value) if isinstance(value, str) else value
    return c.cast("bigint")


# --- SQL fragments -------------------------------------------------------------


def sql_hash(seed: object, *key: str) -> str:
    return f"md5(concat_ws(':', '{seed}', {', '.join(key)}))"


def sql_uniform(seed: object, *key: str) -> str:
    return f"(CAST(concat('0x', substr({sql_hash(seed, *key)}, 1, 8)) AS BIGINT) / 4294967296.0)"


def sql_rank(seed: object, key: Sequence[str], by: Sequence[str] = ()) -> str:
    partition = f"PARTITION BY {', '.join(by)} " if by else ""
    return f"row_number() OVER ({partition}ORDER BY {sql_hash(seed, *key)}, {', '.join(key)})"


def sql_round(expr: str, name: str, digits: int = 4) -> str:
    return f"round(CAST({expr} AS DOUBLE), {digits}) + 0.0 AS {name}"


def sql_rounded(columns: Sequence[str], digits: int = 4) -> str:
    return ", ".join(sql_round(c, c, digits) for c in columns)


# --- line items: seeded halves of a scaled table ----------------------------------

LI_KEY = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_cents")
LI_FEATURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
LI_KEY_SQL = ", ".join(LI_KEY)
LI_FEATURES_SQL = ", ".join(LI_FEATURES)


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with a unique integer key (the price in cents completes it)."""
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"),
        F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("l_cents"),
        *LI_FEATURES,
    )


def scaled_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minmax_scale(lineitem(spark, sf_dir), LI_FEATURES)


def lineitem_pair(spark: SparkSession, sf_dir: str, stored: bool = False) -> ShiftPair:
    return half_split(scaled_lineitem(spark, sf_dir), LI_KEY, LI_FEATURES, 0, stored)


SQL_LI = f"""li AS (
  SELECT l_orderkey, l_partkey, l_suppkey, CAST(l_linenumber AS BIGINT) AS l_linenumber,
         CAST(round(l_extendedprice * 100) AS BIGINT) AS l_cents, {LI_FEATURES_SQL}
  FROM lineitem)"""

SQL_LI_SCALED = SQL_LI + """,
span AS (SELECT """ + ", ".join(
    f"min({c}) AS lo_{c}, max({c}) AS hi_{c}" for c in LI_FEATURES
) + """ FROM li),
scaled AS (SELECT """ + LI_KEY_SQL + ", " + ", ".join(
    f"CASE WHEN hi_{c} > lo_{c} THEN ({c} - lo_{c}) / (hi_{c} - lo_{c}) ELSE 0.0 END AS {c}" for c in LI_FEATURES
) + """ FROM li, span)"""

SQL_LI_HALVES = SQL_LI_SCALED + f""",
halves AS (SELECT *, {sql_rank(0, LI_KEY)} AS rk, count(*) OVER () AS n FROM scaled),
ref AS (SELECT {LI_KEY_SQL}, {LI_FEATURES_SQL} FROM halves WHERE rk <= n // 2),
que AS (SELECT {LI_KEY_SQL}, {LI_FEATURES_SQL} FROM halves WHERE rk > n // 2)"""


# --- orders: two seeded halves with an integer key ---------------------------------

OR_FEATURES = ("o_totalprice", "o_cust")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_totalprice", F.col("o_custkey").cast("double").alias("o_cust")
    )


def orders_pair(spark: SparkSession, sf_dir: str) -> ShiftPair:
    return half_split(orders(spark, sf_dir), ("o_orderkey",), OR_FEATURES, 0)


SQL_OR_HALVES = f"""ord AS (SELECT o_orderkey, o_totalprice, CAST(o_custkey AS DOUBLE) AS o_cust FROM orders),
halves AS (SELECT *, {sql_rank(0, ["o_orderkey"])} AS rk, count(*) OVER () AS n FROM ord),
ref AS (SELECT o_orderkey, o_totalprice, o_cust FROM halves WHERE rk <= n // 2),
que AS (SELECT o_orderkey, o_totalprice, o_cust FROM halves WHERE rk > n // 2)"""


# --- events: first and second half of the month ------------------------------------

EV_KEY = ("event_id",)
EV_FEATURES = ("value", "hour", "k")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id", "ts", "event_type", "value",
        F.hour("ts").cast("double").alias("hour"),
        F.get_json_object("props", "$.k").cast("double").alias("k"),
    )


def events_pair(spark: SparkSession, sf_dir: str) -> ShiftPair:
    before = F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz")
    return ShiftPair.from_predicate(events(spark, sf_dir), before, EV_KEY, EV_FEATURES)


SQL_EV = """ev AS (
  SELECT event_id, ts, event_type, value, CAST(hour(ts) AS DOUBLE) AS hour,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k
  FROM events)"""
SQL_EV_PAIR = SQL_EV + """,
ref AS (SELECT event_id, value, hour, k FROM ev WHERE ts < TIMESTAMP '2024-01-16'),
que AS (SELECT event_id, value, hour, k FROM ev WHERE NOT (ts < TIMESTAMP '2024-01-16'))"""


# --- scored tables with closed-form probabilities -----------------------------------


def scored_events(spark: SparkSession, sf_dir: str, wide: bool = False) -> DataFrame:
    """``(event_id, label, p1, prediction, fold)`` from events; ``wide`` separates the classes more."""
    base = events(spark, sf_dir).select(
        "event_id", "k", F.col("event_type").isin("click", "view").cast("int").alias("label")
    )
    if wide:
        p1 = 0.05 + 0.3 * F.col("k") / 99 + 0.6 * F.col("label")
    else:
        p1 = F.when(F.col("event_id") % 97 == 0, F.col("label").cast("double")).otherwise(
            0.15 + 0.5 * F.col("k") / 99 + 0.2 * F.col("label")
        )
    scored = base.withColumn("p1", p1).withColumn("prediction", (F.col("p1") > 0.5).cast("int"))
    return materialize(stratified_folds(scored.drop("k"), EV_KEY, 5, 0), "scored")


def sql_scored(wide: bool = False) -> str:
    if wide:
        p1 = "0.05 + 0.3 * k / 99 + 0.6 * label"
    else:
        p1 = "CASE WHEN event_id % 97 = 0 THEN CAST(label AS DOUBLE) ELSE 0.15 + 0.5 * k / 99 + 0.2 * label END"
    return SQL_EV + f""",
labelled AS (SELECT event_id, k, CASE WHEN event_type IN ('click', 'view') THEN 1 ELSE 0 END AS label FROM ev),
probable AS (SELECT event_id, label, CAST({p1} AS DOUBLE) AS p1 FROM labelled),
sc AS (SELECT *, CASE WHEN p1 > 0.5 THEN 1 ELSE 0 END AS prediction,
              ({sql_rank(0, ["event_id"], ["label"])} - 1) % 5 AS fold FROM probable)"""


# --- importances per run, fold and feature ----------------------------------------------


def part_importances(spark: SparkSession, sf_dir: str) -> DataFrame:
    sign = F.when(F.col("p_partkey") % 3 == 0, -1).otherwise(1)
    slot = F.col("p_partkey") % 8
    return (
        table(spark, sf_dir, "part")
        .groupBy(
            F.col("p_type").alias("run_id"),
            (F.col("p_size") % 5).cast("int").alias("fold"),
            F.concat(F.lit("f"), slot.cast("string")).alias("feature"),
            slot.cast("int").alias("position"),
        )
        .agg(F.avg(F.col("p_size") * F.pow(F.lit(0.7), slot) * sign).alias("importance"))
    )


SQL_IM = """im AS (
  SELECT p_type AS run_id, p_size % 5 AS fold, concat('f', p_partkey % 8) AS feature, p_partkey % 8 AS position,
         avg(p_size * power(0.7, p_partkey % 8) * (CASE WHEN p_partkey % 3 = 0 THEN -1 ELSE 1 END)) AS importance
  FROM part GROUP BY ALL)"""


# --- curves: removed features against balanced accuracy ------------------------------------


def customer_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One measured point per customer: ``(run_id, iteration, x, y)``.

    Twelve consecutive customers form a run with irregular steps; every 60th
    customer is a run of a single point; one run in ten is constant.
    """
    run = F.floor(F.col("c_custkey") / 12)
    step = (F.col("c_custkey") % 12).cast("int")
    alone = F.col("c_custkey") % 60 == 0
    wobble = (F.col("c_custkey") * 7919 % 13 - 6) / 6.0
    falling = 0.5 + 0.48 * F.exp(-step / (2.0 + run % 4)) + 0.011 * wobble
    base = table(spark, sf_dir, "customer")
    position = F.when(alone, F.lit(0)).when(run % 5 == 0, step - 1).otherwise(step)
    return base.select(
        F.when(alone, -F.col("c_custkey") - 1).otherwise(run).cast("bigint").alias("run_id"),
        (position + 1).cast("int").alias("iteration"),
        F.floor(position * (position + 3) / 2).cast("int").alias("x"),
        F.when(run % 10 == 3, F.lit(0.6)).otherwise(falling).alias("y"),
    )


SQL_CV = """raw AS (
  SELECT c_custkey, c_custkey // 12 AS run, c_custkey % 12 AS step, c_custkey % 60 = 0 AS alone,
         (c_custkey * 7919 % 13 - 6) / 6.0 AS wobble
  FROM customer),
placed AS (SELECT *, CASE WHEN alone THEN 0 WHEN run % 5 = 0 THEN step - 1 ELSE step END AS pos FROM raw),
cv AS (
  SELECT CAST(CASE WHEN alone THEN -c_custkey - 1 ELSE run END AS BIGINT) AS run_id, pos + 1 AS iteration,
         pos * (pos + 3) // 2 AS x,
         CASE WHEN run % 10 = 3 THEN CAST(0.6 AS DOUBLE)
              ELSE 0.5 + 0.48 * exp(-step / (2.0 + run % 4)) + 0.011 * wobble END AS y
  FROM placed)"""


# --- embeddings -----------------------------------------------------------------------------


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("vec"), "label"
    )


SQL_EM = """em AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS vec, label FROM embeddings),
ref AS (SELECT * FROM em WHERE label < 5), que AS (SELECT * FROM em WHERE label >= 5)"""
