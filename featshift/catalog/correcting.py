"""Registered queries: proposals, bad rows, candidate choice and the correction loop."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featshift.catalog.base import (
    LI_FEATURES, LI_KEY, LI_KEY_SQL, SQL_EV_PAIR, SQL_LI, SQL_LI_HALVES, SQL_OR_HALVES, Query, events_pair, lineitem,
    lineitem_pair, long, orders_pair, r, rounded, scored_events, sql_rank, sql_round, sql_rounded, sql_scored, table,
)
from featshift.catalog.locating import shifted_lineitem
from featshift.config import CorrectConfig
from featshift.operators.candidates import (
    SplitScorer, Term, bad_row_counts, candidate_argmin, correction_blocks, in_every_lap, worst_rows,
)
from featshift.operators.discriminate import assemble, score_rows
from featshift.operators.prepare import half_split
from featshift.operators.proposals import (
    best_proposal, correction_training_set, propose_aligned, propose_knn, propose_linear, propose_permuted, query_halves,
)
from featshift.plans.correct import bad_row_probability, correct_features, fit_cross_pair

BATCH = 3000
CORRUPTED = ("l_quantity", "l_discount")


def aligned(spark: SparkSession, d: str) -> DataFrame:
    return propose_aligned(lineitem_pair(spark, d, stored=True), CORRUPTED, 2).select(*LI_KEY, *rounded(CORRUPTED))


def permuted(spark: SparkSession, d: str) -> DataFrame:
    return propose_permuted(lineitem_pair(spark, d, stored=True), CORRUPTED, 2).select(*LI_KEY, *rounded(CORRUPTED))


def linear(spark: SparkSession, d: str) -> DataFrame:
    return propose_linear(orders_pair(spark, d), ("o_totalprice",)).select("o_orderkey", *rounded(["o_totalprice"]))


def nearest(spark: SparkSession, d: str) -> DataFrame:
    """``value`` from the three nearest events by hour and k, plain and distance-weighted."""
    pair = events_pair(spark, d)
    plain = propose_knn(pair, ("value",), 3)
    weighted = propose_knn(pair, ("value",), 3, "distance").withColumnRenamed("value", "weighted")
    return plain.join(weighted, "event_id").select("event_id", r("value").alias("value"), r("weighted").alias("weighted"))


def choose(spark: SparkSession, d: str) -> DataFrame:
    """One log of four proposals per part type and size."""
    parts = table(spark, d, "part")
    step = (F.col("p_partkey") % 4).cast("int")
    log = parts.groupBy(F.concat_ws(":", "p_type", F.col("p_size").cast("string")).alias("run"), step.alias("step")).agg(
        (F.avg((F.col("p_partkey") * 31 + F.col("p_size") * 17) % 101) / 90.0).alias("tv")
    ).withColumn("proposal", F.concat(F.lit("proposal_"), F.col("step").cast("string")))
    return best_proposal(log, 0.3).select("run", "chosen", r("tv").alias("tv"))


def training_set(spark: SparkSession, d: str) -> DataFrame:
    """Row counts and column totals per source of the training set."""
    pair = lineitem_pair(spark, d, stored=True)
    halves = query_halves(pair, 0)
    rows = correction_training_set(pair, CORRUPTED, halves, 1, [pair.query], 5)
    mixed = F.col("l_quantity") * F.col("l_extendedprice") + 2 * F.col("l_discount") * F.col("l_tax")
    return rows.groupBy("source", long("label").alias("label")).agg(
        F.count("*").alias("n_rows"), *[r(F.sum(c), 3).alias(c) for c in LI_FEATURES], r(F.sum(mixed), 3).alias("mixed")
    )


def quota(spark: SparkSession, d: str) -> DataFrame:
    scored = scored_events(spark, d, wide=True)
    counts = bad_row_counts(scored).first()
    # The wide table has too few bad rows for a quota of its own; take a third of them.
    worst = worst_rows(scored.select("event_id", "p1"), ("event_id",), counts["n_bad"] // 3 + 1, 6)
    return worst.select("event_id", r("p1").alias("p1"))


def own_quota(spark: SparkSession, d: str) -> DataFrame:
    """The rows that the operator's own quota takes when the clicks and views are the query."""
    scored = scored_events(spark, d, wide=True).filter("label = 1").select("event_id", "p1")
    worst = worst_rows(scored, ("event_id",), bad_row_counts(scored).first()["quota"], 6)
    return worst.select("event_id", r("p1").alias("p1"))


def quota_counts(spark: SparkSession, d: str) -> DataFrame:
    """Quota per label when every label is a query of its own."""
    scored = scored_events(spark, d, wide=True)
    parts = [
        bad_row_counts(scored.filter(F.col("label") == label)).select(
            F.lit(label).cast("bigint").alias("label"), "n", "n_bad", r("share").alias("share"), long("quota").alias("quota")
        )
        for label in (0, 1)
    ]
    return parts[0].unionByName(parts[1])


def blocks(spark: SparkSession, d: str) -> DataFrame:
    ref, que = correction_blocks(lineitem_pair(spark, d, stored=True), BATCH, 3)
    left = ref.select(*LI_KEY, F.lit("reference").alias("side"), "rank", long("block").alias("block"), F.lit(0).cast("bigint").alias("lap"))
    right = que.select(*LI_KEY, F.lit("query").alias("side"), "rank", long("block").alias("block"), long("lap").alias("lap"))
    return left.unionByName(right)


def closed_form_scorer() -> SplitScorer:
    """(3x - y)^2 as a sum of products."""
    return SplitScorer((Term(
        lambda x: np.column_stack([9 * x[:, 0] ** 2, -6 * x[:, 0], np.ones(len(x))]),
        lambda y: np.column_stack([np.ones(len(y)), y[:, 0], y[:, 0] ** 2]),
    ),))


def argmin(spark: SparkSession, d: str) -> DataFrame:
    """Every query line item takes the supplier number of its block closest to three times its quantity."""
    base = lineitem(spark, d).withColumn("x", F.col("l_quantity")).withColumn("y", (F.col("l_suppkey") + 37).cast("double"))
    pair = half_split(base, LI_KEY, ("x", "y"), 0, stored=True)
    ref_blocks, que_blocks = correction_blocks(pair, BATCH, 3)
    rows = pair.query.join(que_blocks, list(LI_KEY)).withColumn("half", F.lit(0))
    offered = pair.reference.join(ref_blocks, list(LI_KEY)).select(
        "block", F.lit(0).alias("source"), F.col("rank").alias("candidate"), "y"
    )
    offered = in_every_lap(offered, pair.reference.count(), pair.query.count())
    best = candidate_argmin(rows, offered, LI_KEY, ["x"], ["y"], {0: closed_form_scorer()})
    return best.select(*LI_KEY, long("source").alias("source"), r("y").alias("y"))


def bad_probability(spark: SparkSession, d: str) -> DataFrame:
    scored = bad_row_probability(shifted_lineitem(spark, d), CorrectConfig(), "0")
    return scored.select(*LI_KEY, r("p1").alias("p1"))


def cross_pair(spark: SparkSession, d: str) -> DataFrame:
    """Mean probability of each half under the model that did not train on it."""
    pair = shifted_lineitem(spark, d)
    halves = query_halves(pair, 0)
    models = fit_cross_pair(pair, CORRUPTED, halves, [], CorrectConfig(), "0")
    rows = assemble(pair.query.withColumn("label", F.lit(1)), pair.features).join(halves, list(LI_KEY))
    parts = [score_rows(models[h], rows.filter(F.col("half") == h)) for h in (0, 1)]
    return parts[0].unionByName(parts[1]).groupBy(long("half").alias("half")).agg(
        F.count("*").alias("n_rows"), r(F.avg("p1")).alias("mean_p1")
    )


def correction(spark: SparkSession, d: str) -> DataFrame:
    pair = shifted_lineitem(spark, d)
    result = correct_features(pair, CORRUPTED, CorrectConfig())
    return result.query.select(*LI_KEY, *rounded(LI_FEATURES))


# --- SQL ------------------------------------------------------------------------------


_ALIGNED_RANKS = f"""qr AS (SELECT {LI_KEY_SQL}, {sql_rank('2:query', LI_KEY)} AS qrk FROM que),
qa AS (SELECT {LI_KEY_SQL}, (qrk - 1) % (SELECT count(*) FROM ref) + 1 AS rk FROM qr)"""
_PERMUTED = "".join(
    f", v_{c} AS (SELECT {c}, row_number() OVER (ORDER BY md5(concat_ws(':', '2:permute:value', '{c}', {LI_KEY_SQL})), {LI_KEY_SQL}) AS prk FROM ref)"
    for c in CORRUPTED
)
_KNN = f"""WITH {SQL_EV_PAIR},
c AS (SELECT q.event_id, r.value, sqrt((q.hour - r.hour) * (q.hour - r.hour) + (q.k - r.k) * (q.k - r.k)) AS dist, r.event_id AS rid FROM que q, ref r),
n AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY dist, rid) AS rk FROM c)
SELECT event_id, round(avg(value), 4) + 0.0 AS value, round(CASE WHEN min(dist) = 0 THEN avg(value) FILTER (dist = 0)
  ELSE sum(value / nullif(dist, 0)) / sum(1 / nullif(dist, 0)) END, 4) + 0.0 AS weighted FROM n WHERE rk <= 3 GROUP BY event_id"""


def shuffled_sql(name: str, seed: str, joint: bool) -> str:
    key = LI_KEY_SQL
    slots = f"{name}_s AS (SELECT l_extendedprice, l_tax, {sql_rank(f'{seed}:slot', LI_KEY)} AS rk FROM ref)"
    if joint:
        vals = f"{name}_v AS (SELECT l_quantity, l_discount, {sql_rank(f'{seed}:value', LI_KEY)} AS rk FROM ref)"
        return f"{slots}, {vals}, {name} AS (SELECT * FROM {name}_s JOIN {name}_v USING (rk))"
    vals = ", ".join(
        f"{name}_{c} AS (SELECT {c}, row_number() OVER (ORDER BY md5(concat_ws(':', '{seed}:value', '{c}', {key})), {key}) AS rk FROM ref)"
        for c in CORRUPTED
    )
    return f"{slots}, {vals}, {name} AS (SELECT * FROM {name}_s " + " ".join(f"JOIN {name}_{c} USING (rk)" for c in CORRUPTED) + ")"


def _totals(source: str, label: int, table: str) -> str:
    sums = ", ".join(f"round(sum({c}), 3) + 0.0 AS {c}" for c in LI_FEATURES)
    return (f"SELECT '{source}' AS source, CAST({label} AS BIGINT) AS label, count(*) AS n_rows, {sums}, "
            f"round(sum(l_quantity * l_extendedprice + 2 * l_discount * l_tax), 3) + 0.0 AS mixed FROM {table}")


_TRAINING = f"""WITH {SQL_LI_HALVES}, hf AS (SELECT *, {sql_rank('0:half', LI_KEY)} % 2 AS half FROM que), mine AS (SELECT * FROM hf WHERE half = 1),
{shuffled_sql('pj', '5:1:joint', True)}, {shuffled_sql('pe', '5:1:each', False)}
{_totals('reference', 0, 'ref')} UNION ALL {_totals('query', 1, 'mine')} UNION ALL {_totals('permuted_joint', 1, 'pj')}
UNION ALL {_totals('permuted_each', 1, 'pe')} UNION ALL {_totals('epoch_0', 1, 'que')}"""

_BLOCK_RANKS = f"""rb AS (SELECT *, {sql_rank('3:reference', LI_KEY)} AS rk FROM ref), nr AS (SELECT count(*) AS n, greatest(1, count(*) // {BATCH}) AS nb FROM ref),
rblk AS (SELECT rb.*, least((rk - 1) // {BATCH}, nb - 1) AS block FROM rb, nr),
qb AS (SELECT *, {sql_rank('3:query', LI_KEY)} AS rk FROM que),
qblk AS (SELECT qb.*, least(((rk - 1) % n) // {BATCH}, nb - 1) AS block, (rk - 1) // n AS lap FROM qb, nr)"""

_ARGMIN = f"""WITH {SQL_LI}, base AS (SELECT {LI_KEY_SQL}, l_quantity AS x, l_suppkey + 37.0 AS y FROM li),
hv AS (SELECT *, {sql_rank(0, LI_KEY)} AS hrk, count(*) OVER () AS cnt FROM base),
ref AS (SELECT * FROM hv WHERE hrk <= cnt // 2), que AS (SELECT * FROM hv WHERE hrk > cnt // 2), {_BLOCK_RANKS},
offered AS (SELECT block, CAST(y AS DOUBLE) AS y, min(rk) AS rk FROM rblk GROUP BY block, y),
sc AS (SELECT {', '.join('q.' + c for c in LI_KEY)}, o.y, row_number() OVER (PARTITION BY {', '.join('q.' + c for c in LI_KEY)} ORDER BY (3 * q.x - o.y) * (3 * q.x - o.y), o.rk) AS p
       FROM qblk q JOIN offered o USING (block))
SELECT {LI_KEY_SQL}, CAST(0 AS BIGINT) AS source, round(y, 4) + 0.0 AS y FROM sc WHERE p = 1"""

QUERIES = [
    Query("propose_aligned", aligned, f"""WITH {SQL_LI_HALVES}, {_ALIGNED_RANKS},
ra AS (SELECT l_quantity, l_discount, {sql_rank('2:reference', LI_KEY)} AS rk FROM ref)
SELECT {LI_KEY_SQL}, {sql_rounded(CORRUPTED)} FROM qa JOIN ra USING (rk)"""),
    Query("propose_permuted", permuted, f"""WITH {SQL_LI_HALVES}, {_ALIGNED_RANKS},
ra AS (SELECT {sql_rank('2:reference', LI_KEY)} AS rk, {sql_rank('2:permute:slot', LI_KEY)} AS prk FROM ref){_PERMUTED}
SELECT {LI_KEY_SQL}, {sql_rounded(CORRUPTED)} FROM qa JOIN ra USING (rk) """ + " ".join(f"JOIN v_{c} USING (prk)" for c in CORRUPTED)),
    Query("propose_linear", linear, f"""WITH {SQL_OR_HALVES},
fit AS (SELECT regr_slope(o_totalprice, o_cust) AS a, regr_intercept(o_totalprice, o_cust) AS b FROM ref)
SELECT o_orderkey, {sql_round('a * o_cust + b', 'o_totalprice')} FROM que, fit"""),
    Query("propose_knn", nearest, _KNN),
    Query("choose_proposal", choose, """WITH log AS (SELECT concat(p_type, ':', p_size) AS run, p_partkey % 4 AS step,
  avg((p_partkey * 31 + p_size * 17) % 101) / 90.0 AS tv FROM part GROUP BY ALL),
tried AS (SELECT *, min(CASE WHEN tv < 0.3 THEN step END) OVER (PARTITION BY run) AS good FROM log),
ok AS (SELECT run, arg_min(step, (tv, step)) FILTER (tv < 1.0) AS s, min(tv) FILTER (tv < 1.0) AS t FROM tried WHERE good IS NULL OR step <= good GROUP BY run)
SELECT run, coalesce(concat('proposal_', CAST(s AS VARCHAR)), 'query') AS chosen, round(coalesce(t, 1.0), 4) + 0.0 AS tv FROM (SELECT run, s, t, CASE WHEN s IS NULL THEN 1 END AS none FROM ok)
WHERE none IS NULL UNION ALL SELECT run, 'query', 1.0 FROM ok WHERE s IS NULL"""),
    Query("correction_training_set", training_set, _TRAINING),
    Query("bad_row_quota", quota, f"""WITH {sql_scored(True)},
bad AS (SELECT event_id, p1, row_number() OVER (ORDER BY p1 DESC, md5(concat_ws(':', '6', event_id)), event_id) AS rk, count(*) OVER () AS nb FROM sc WHERE p1 > 0.5)
SELECT event_id, round(p1, 4) + 0.0 AS p1 FROM bad WHERE rk <= nb // 3 + 1"""),
    Query("bad_row_quota_own", own_quota, f"""WITH {sql_scored(True)}, que AS (SELECT event_id, p1, count(*) OVER () AS n FROM sc WHERE label = 1),
bad AS (SELECT event_id, p1, n, row_number() OVER (ORDER BY p1 DESC, md5(concat_ws(':', '6', event_id)), event_id) AS rk, count(*) OVER () AS nb FROM que WHERE p1 > 0.5)
SELECT event_id, round(p1, 4) + 0.0 AS p1 FROM bad WHERE rk <= least(nb, greatest(0, floor(nb - n / 2)) + 1)"""),
    Query("bad_row_counts", quota_counts, f"""WITH {sql_scored(True)},
c AS (SELECT label, count(*) AS n, count(*) FILTER (p1 > 0.5) AS n_bad FROM sc GROUP BY label)
SELECT CAST(label AS BIGINT) AS label, n, n_bad, round(n_bad / CAST(n AS DOUBLE), 4) + 0.0 AS share,
  CAST(least(n_bad, greatest(0, floor(n_bad - n / 2)) + 1) AS BIGINT) AS quota FROM c"""),
    Query("correction_blocks", blocks, f"""WITH {SQL_LI_HALVES}, {_BLOCK_RANKS}
SELECT {LI_KEY_SQL}, 'reference' AS side, rk AS rank, CAST(block AS BIGINT) AS block, CAST(0 AS BIGINT) AS lap FROM rblk
UNION ALL SELECT {LI_KEY_SQL}, 'query', rk, CAST(block AS BIGINT), CAST(lap AS BIGINT) FROM qblk"""),
    Query("candidate_argmin", argmin, _ARGMIN),
    Query("bad_row_probability", bad_probability),
    Query("cross_fit_pair", cross_pair),
    Query("correct_features", correction),
]
