"""Registered queries: pair sources, preparation, folds, picks, sinks and seeded ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featshift.catalog.base import (
    EV_FEATURES, EV_KEY, LI_FEATURES, LI_KEY, LI_KEY_SQL, OR_FEATURES, SQL_EV, SQL_EV_PAIR, SQL_LI,
    SQL_LI_HALVES, SQL_LI_SCALED, Query, events, events_pair, lineitem, lineitem_pair, long, orders,
    r, rounded, scaled_lineitem, scored_events, sql_hash, sql_rank, sql_round, sql_rounded, sql_scored,
    sql_uniform,
)
from featshift.functions.hashing import seeded_uniform
from featshift.operators.prepare import (
    align_rows, cap_clean_features, custom_folds, pick_count, pick_random_features, pick_top_std, stratified_folds,
    stratified_holdout, write_back,
)
from featshift.operators.rank import seeded_rank
from featshift.sources.pair import ShiftPair, fill_missing, schema_differences
from featshift.sources.results import append_results, read_results
from featshift.storage import fresh_path

LI_NUMERIC = ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_partkey", "l_suppkey", "l_orderkey")


def _both_sides(pair: ShiftPair) -> DataFrame:
    return pair.labelled().select(*pair.key, long("label").alias("label"), *rounded(pair.features))


def pair_from_predicate(spark: SparkSession, d: str) -> DataFrame:
    return _both_sides(events_pair(spark, d))


def pair_schema_check(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the pair whose schema was checked, next to the problems found in a wrong pairing."""
    pair = events_pair(spark, d)
    wrong = schema_differences(pair.reference.drop("event_id"), pair.query.select("hour", "value"))
    return pair.labelled().groupBy("label").agg(
        F.count("*").alias("n_rows"), F.lit(len(pair.features)).cast("bigint").alias("n_features"),
        F.lit(len(wrong)).cast("bigint").alias("n_differences"),
    ).withColumn("label", long("label"))


def _with_gaps(spark: SparkSession, d: str) -> DataFrame:
    base = events(spark, d)
    return base.withColumn("value", F.when(F.col("event_id") % 17 == 0, F.lit(None).cast("double"))
                           .when(F.col("event_id") % 19 == 0, F.lit(float("nan"))).otherwise(F.col("value")))


def pair_with_gaps(spark: SparkSession, d: str) -> ShiftPair:
    before = F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz")
    return ShiftPair.from_predicate(_with_gaps(spark, d), before, EV_KEY, EV_FEATURES)


def missing_fill(spark: SparkSession, d: str) -> DataFrame:
    return fill_missing(_with_gaps(spark, d), EV_FEATURES).select("event_id", *rounded(EV_FEATURES))


def feature_select(spark: SparkSession, d: str) -> DataFrame:
    return _both_sides(events_pair(spark, d).select_features(("k", "value")))


def drop_features(spark: SparkSession, d: str) -> DataFrame:
    return _both_sides(events_pair(spark, d).drop_features(("value",)))


def source_labels(spark: SparkSession, d: str) -> DataFrame:
    return _both_sides(lineitem_pair(spark, d))


def append_twice(spark: SparkSession, d: str) -> DataFrame:
    scored = scored_events(spark, d)
    path = fresh_path(spark, "append-log")
    for label in (0, 1):
        append_results(scored.filter(F.col("label") == label).select("event_id", "label", "p1"), path)
    return read_results(spark, path).select("event_id", long("label").alias("label"), r("p1").alias("p1"))


def seeded_rank_query(spark: SparkSession, d: str) -> DataFrame:
    return seeded_rank(lineitem(spark, d), LI_KEY, 7).select(*LI_KEY, "rank")


def seeded_uniform_query(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).select("event_id", r(seeded_uniform(11, "event_id"), 6).alias("u"))


def minmax(spark: SparkSession, d: str) -> DataFrame:
    return scaled_lineitem(spark, d).select(*LI_KEY, *rounded(LI_FEATURES))


def half_split_query(spark: SparkSession, d: str) -> DataFrame:
    return lineitem_pair(spark, d).labelled().select(*LI_KEY, long("label").alias("label"))


def stratified_kfold(spark: SparkSession, d: str) -> DataFrame:
    folds = stratified_folds(lineitem_pair(spark, d, stored=True).labelled(), LI_KEY, 5, 3)
    return folds.select(*LI_KEY, long("label").alias("label"), long("fold").alias("fold"))


def stratified_holdout_query(spark: SparkSession, d: str) -> DataFrame:
    rows = scored_events(spark, d).drop("fold")
    return stratified_holdout(rows, EV_KEY, 0.2, 5).select(
        "event_id", long("label").alias("label"), long("fold").alias("fold")
    )


def custom_folds_query(spark: SparkSession, d: str) -> DataFrame:
    """Overlapping splits: every event is tested in one of four folds and trained on in the next two."""
    base = events(spark, d).select("event_id", "value")
    home = F.col("event_id") % 4
    plan = base.select(
        "event_id",
        F.inline(F.array(
            F.struct(home.alias("fold"), F.lit("test").alias("role")),
            F.struct(((home + 1) % 4).alias("fold"), F.lit("train").alias("role")),
            F.struct(((home + 2) % 4).alias("fold"), F.lit("train").alias("role")),
        )),
    )
    return custom_folds(base, plan, EV_KEY).groupBy(long("fold").alias("fold"), "role").agg(
        F.count("*").alias("n_rows"), r(F.sum("value"), 2).alias("total_value")
    )


def pick_random(spark: SparkSession, d: str) -> DataFrame:
    return pick_random_features(lineitem(spark, d), LI_NUMERIC, 0.35, 2).select(
        "feature", long("position").alias("position"), long("value").alias("n_rows"), long("picked").alias("picked")
    )


def pick_top(spark: SparkSession, d: str) -> DataFrame:
    return pick_top_std(lineitem(spark, d), LI_NUMERIC, 0.35).select(
        "feature", long("position").alias("position"), r("value").alias("std"), long("picked").alias("picked")
    )


def cap_clean(spark: SparkSession, d: str) -> DataFrame:
    query = lineitem_pair(spark, d).query
    return cap_clean_features(query, ("l_quantity",), ("l_extendedprice", "l_discount", "l_tax"), 2).select(
        "feature", long("position").alias("position"), r("value").alias("std"), long("kept").alias("kept")
    )


def write_back_query(spark: SparkSession, d: str) -> DataFrame:
    base = orders(spark, d)
    changed = base.filter(F.col("o_totalprice") > 250000).withColumn("o_totalprice", F.col("o_totalprice") / 2)
    return write_back(base, changed, ("o_orderkey",), ("o_totalprice",)).select("o_orderkey", *rounded(OR_FEATURES))


def align(spark: SparkSession, d: str) -> DataFrame:
    pair = ShiftPair.from_predicate(orders(spark, d), F.col("o_orderkey") % 3 == 0, ("o_orderkey",), OR_FEATURES)
    return align_rows(pair, 4).select(
        "o_orderkey", "query_rank", "reference_rank", r("ref_o_totalprice").alias("ref_o_totalprice"),
        r("ref_o_cust").alias("ref_o_cust"),
    )


def _sql_both(ref_columns: str, columns: list[str]) -> str:
    out = sql_rounded(columns)
    return f"""SELECT {ref_columns}, CAST(0 AS BIGINT) AS label, {out} FROM ref
UNION ALL SELECT {ref_columns}, CAST(1 AS BIGINT), {out} FROM que"""


def _sql_features(name_stat: list[tuple[str, str]], source: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS feature, CAST({i} AS BIGINT) AS position, {e} AS v FROM {source}"
        for i, (c, e) in enumerate(name_stat)
    )


_RANDOM = pick_count(len(LI_NUMERIC), 0.35)

QUERIES = [
    Query("pair_from_predicate", pair_from_predicate, f"WITH {SQL_EV_PAIR} {_sql_both('event_id', list(EV_FEATURES))}"),
    Query("pair_schema_check", pair_schema_check, f"""WITH {SQL_EV_PAIR}
SELECT CAST(0 AS BIGINT) AS label, count(*) AS n_rows, CAST(3 AS BIGINT) AS n_features, CAST(4 AS BIGINT) AS n_differences FROM ref
UNION ALL SELECT CAST(1 AS BIGINT), count(*), CAST(3 AS BIGINT), CAST(4 AS BIGINT) FROM que"""),
    Query("missing_fill", missing_fill, f"""WITH {SQL_EV}
SELECT event_id, CASE WHEN event_id % 17 = 0 OR event_id % 19 = 0 THEN -1.0 ELSE round(value, 4) + 0.0 END AS value,
       {sql_rounded(['hour', 'k'])} FROM ev"""),
    Query("feature_select", feature_select, f"WITH {SQL_EV_PAIR} {_sql_both('event_id', ['k', 'value'])}"),
    Query("drop_features", drop_features, f"WITH {SQL_EV_PAIR} {_sql_both('event_id', ['hour', 'k'])}"),
    Query("source_labels", source_labels, f"WITH {SQL_LI_HALVES} {_sql_both(LI_KEY_SQL, list(LI_FEATURES))}"),
    Query("append_results", append_twice, f"""WITH {sql_scored()}
SELECT event_id, CAST(label AS BIGINT) AS label, {sql_round('p1', 'p1')} FROM sc"""),
    Query("seeded_rank", seeded_rank_query, f"WITH {SQL_LI} SELECT {LI_KEY_SQL}, {sql_rank(7, LI_KEY)} AS rank FROM li"),
    Query("seeded_uniform", seeded_uniform_query,
          f"SELECT event_id, {sql_round(sql_uniform(11, 'event_id'), 'u', 6)} FROM events"),
    Query("minmax_scale", minmax, f"WITH {SQL_LI_SCALED} SELECT {LI_KEY_SQL}, {sql_rounded(LI_FEATURES)} FROM scaled"),
    Query("half_split", half_split_query, f"""WITH {SQL_LI_HALVES}
SELECT {LI_KEY_SQL}, CAST(CASE WHEN rk <= n // 2 THEN 0 ELSE 1 END AS BIGINT) AS label FROM halves"""),
    Query("stratified_kfold", stratified_kfold, f"""WITH {SQL_LI_HALVES},
lab AS (SELECT {LI_KEY_SQL}, CAST(CASE WHEN rk <= n // 2 THEN 0 ELSE 1 END AS BIGINT) AS label FROM halves)
SELECT *, CAST(({sql_rank(3, LI_KEY, ['label'])} - 1) % 5 AS BIGINT) AS fold FROM lab"""),
    Query("stratified_holdout", stratified_holdout_query, f"""WITH {sql_scored()},
per_label AS (SELECT label, count(*) AS n FROM sc GROUP BY label),
wanted AS (SELECT label, n, CAST(ceil(0.2 * sum(n) OVER ()) AS BIGINT) AS w, CAST(sum(n) OVER () AS BIGINT) AS a FROM per_label),
floors AS (SELECT label, w, n * w // a AS f, n * w % a AS rest FROM wanted),
quotas AS (SELECT label, f + CASE WHEN row_number() OVER (ORDER BY rest DESC, label) <= w - sum(f) OVER () THEN 1 ELSE 0 END AS q FROM floors),
ranked AS (SELECT event_id, label, {sql_rank(5, ['event_id'], ['label'])} AS rk FROM sc)
SELECT event_id, CAST(label AS BIGINT) AS label, CAST(CASE WHEN rk <= q THEN 0 ELSE -1 END AS BIGINT) AS fold
FROM ranked JOIN quotas USING (label)"""),
    Query("custom_folds", custom_folds_query, """WITH roles AS (
  SELECT event_id % 4 AS fold, 'test' AS role, value FROM events
  UNION ALL SELECT (event_id + 1) % 4, 'train', value FROM events
  UNION ALL SELECT (event_id + 2) % 4, 'train', value FROM events)
SELECT fold, role, count(*) AS n_rows, round(sum(value), 2) + 0.0 AS total_value FROM roles GROUP BY fold, role"""),
    Query("pick_random_features", pick_random, f"""WITH {SQL_LI},
stats AS ({_sql_features([(c, f'count({c})') for c in LI_NUMERIC], 'li')})
SELECT feature, position, v AS n_rows,
       CAST(row_number() OVER (ORDER BY {sql_hash(2, 'feature')}, feature) <= {_RANDOM} AS BIGINT) AS picked FROM stats"""),
    Query("pick_top_std", pick_top, f"""WITH {SQL_LI},
stats AS ({_sql_features([(c, f'stddev_samp({c})') for c in LI_NUMERIC], 'li')})
SELECT feature, position, round(v, 4) + 0.0 AS std,
       CAST(row_number() OVER (ORDER BY v DESC, position) <= {_RANDOM} AS BIGINT) AS picked FROM stats"""),
    Query("cap_clean_features", cap_clean, f"""WITH {SQL_LI_HALVES},
stats AS ({_sql_features([(c, f'stddev_pop({c})') for c in LI_FEATURES], 'que')})
SELECT feature, position, round(v, 4) + 0.0 AS std,
       CAST(position < 1 OR row_number() OVER (PARTITION BY position >= 1 ORDER BY v DESC, position) <= 2 AS BIGINT) AS kept
FROM stats"""),
    Query("write_back", write_back_query, f"""SELECT o_orderkey,
       round(CASE WHEN o_totalprice > 250000 THEN o_totalprice / 2 ELSE o_totalprice END, 4) + 0.0 AS o_totalprice,
       {sql_round('o_custkey', 'o_cust')} FROM orders"""),
    Query("align_rows", align, f"""WITH
r AS (SELECT {sql_rank('4:reference', ['o_orderkey'])} AS reference_rank, o_totalprice, o_custkey FROM orders WHERE o_orderkey % 3 = 0),
q AS (SELECT o_orderkey, {sql_rank('4:query', ['o_orderkey'])} AS query_rank FROM orders WHERE o_orderkey % 3 <> 0),
qq AS (SELECT o_orderkey, query_rank, (query_rank - 1) % (SELECT count(*) FROM r) + 1 AS reference_rank FROM q)
SELECT o_orderkey, query_rank, reference_rank, {sql_round('o_totalprice', 'ref_o_totalprice')},
       {sql_round('o_custkey', 'ref_o_cust')} FROM qq JOIN r USING (reference_rank)"""),
]
