"""Registered queries: distance joins, divergences, Bayes errors and transport."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featshift.catalog.base import (
    EV_FEATURES, LI_FEATURES, SQL_EM, SQL_EV, SQL_LI_HALVES, Query, embeddings, events, lineitem_pair, long, r, scored_events, sql_rank,
    sql_scored,
)
from featshift.catalog.locating import shifted_lineitem
from featshift.catalog.preparation import pair_with_gaps
from featshift.catalog.scoring import _CORRECT_P, _clipped, _jd, _kl
from featshift.functions.hashing import unit_directions
from featshift.functions.weights import ensemble_weights
from featshift.operators import divergence as D
from featshift.operators.blocks import fold_copies, knn_join, neighbour_counts
from featshift.operators.discriminate import logistic
from featshift.operators.spanning import spanning_bayes_bounds, spanning_divergence
from featshift.operators.transport import directional_wasserstein, feature_wasserstein, sliced_wasserstein

K = 3
RADII = (1.2, 1.3, 1.45)
PROJECTIONS = 20
DEFAULT_PROJECTIONS = 200
KDE_BANDWIDTH = 0.4


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    em = embeddings(spark, d).withColumnRenamed("vec_id", "id")
    return em.filter(F.col("label") < 5), em.filter(F.col("label") >= 5)


def _classes(spark: SparkSession, d: str) -> DataFrame:
    return embeddings(spark, d).select(F.col("vec_id").alias("id"), "vec", F.col("label").alias("tag"))


def _two_classes(spark: SparkSession, d: str) -> DataFrame:
    return _classes(spark, d).withColumn("tag", (F.col("tag") >= 5).cast("int"))


def _event_points(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Integer-valued points with many copies: hour and k of the two halves of the month."""
    base = events(spark, d).select(
        F.col("event_id").alias("id"), F.array("hour", "k").alias("vec"), "ts"
    )
    early = F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz")
    return base.filter(early).drop("ts"), base.filter(~early).drop("ts")


def knn(spark: SparkSession, d: str) -> DataFrame:
    reference, query = _sides(spark, d)
    return knn_join(query, reference, K).select("id", "neighbour", long("rank").alias("rank"), r("distance").alias("distance"))


def knn_copies(spark: SparkSession, d: str) -> DataFrame:
    reference, query = _event_points(spark, d)
    return knn_join(query, reference, K).select("id", "neighbour", long("rank").alias("rank"), r("distance").alias("distance"))


def kl(spark: SparkSession, d: str) -> DataFrame:
    reference, query = _sides(spark, d)
    return D.knn_kl(reference, query, K).select("n", "m", "zero_own", "zero_other", r("kl").alias("kl"))


def kl_symmetric(spark: SparkSession, d: str) -> DataFrame:
    reference, query = _sides(spark, d)
    return D.knn_kl_symmetric(reference, query, K).select(
        r("kl_p_q").alias("kl_p_q"), r("kl_q_p").alias("kl_q_p"), r("divergence").alias("divergence")
    )


def eps(spark: SparkSession, d: str) -> DataFrame:
    points = _classes(spark, d)
    counts = neighbour_counts(points, fold_copies(points, "tag"), RADII)
    return counts.select("id", long("own").alias("own"), long("tag").alias("tag"), *[f"c{i}" for i in range(len(RADII))])


def ber_base(spark: SparkSession, d: str) -> DataFrame:
    return D.ball_bayes_error(_classes(spark, d), RADII).select(
        long("step").alias("step"), r("radius").alias("radius"), r("ber").alias("ber")
    )


def ber_ensemble(spark: SparkSession, d: str) -> DataFrame:
    points = _classes(spark, d)
    base = D.bandwidth_nn(points, 10, None)
    return D.ensemble_bayes_error(points, 3, base=base).select(r("ber").alias("ber"), r("bandwidth").alias("bandwidth"))


def bandwidth_nn(spark: SparkSession, d: str) -> DataFrame:
    points = _classes(spark, d)
    nearest = knn_join(points, points, 10).filter(F.col("rank") == 10)
    return nearest.agg(F.count("*").alias("n"), r(F.avg("distance")).alias("bandwidth"))


def bandwidth_cv(spark: SparkSession, d: str) -> DataFrame:
    points = _classes(spark, d).select("id", "vec")
    return D.mark_best(D.density_scores(points, 20)).select(
        long("step").alias("step"), r("bandwidth").alias("bandwidth"), "empty_rows",
        r("log_likelihood", 2).alias("log_likelihood"), long("is_best").alias("is_best"),
    )


def ber_knn(spark: SparkSession, d: str) -> DataFrame:
    return D.knn_bayes_bounds(_two_classes(spark, d)).select(r("lower").alias("lower"), r("upper").alias("upper"))


def ber_kde(spark: SparkSession, d: str) -> DataFrame:
    return D.kde_bayes_error(_two_classes(spark, d), KDE_BANDWIDTH).select(r("ber").alias("ber"))


def sliced(spark: SparkSession, d: str) -> DataFrame:
    reference, query = _sides(spark, d)
    costs = directional_wasserstein(reference, query, unit_directions(0, PROJECTIONS, 64))
    return costs.agg(F.count("*").alias("n_projections"), r(F.sqrt(F.avg("cost")), 6).alias("distance"))


def sliced_default(spark: SparkSession, d: str) -> DataFrame:
    return sliced_wasserstein(*_sides(spark, d)).select(r("distance", 6).alias("distance"))


def per_feature(spark: SparkSession, d: str) -> DataFrame:
    return feature_wasserstein(lineitem_pair(spark, d)).select(
        "feature", long("position").alias("position"), r("distance", 6).alias("distance")
    )


def knn_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Neighbours on events of which some have no value (NULL or NaN)."""
    reference, query = D.as_points(pair_with_gaps(spark, d))
    return knn_join(query, reference, K).select("id", "neighbour", long("rank").alias("rank"), r("distance").alias("distance"))


def per_feature_gaps(spark: SparkSession, d: str) -> DataFrame:
    return feature_wasserstein(pair_with_gaps(spark, d)).select(
        "feature", long("position").alias("position"), r("distance", 6).alias("distance")
    )


def tv_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Rows scored per label (all, once each) next to the metric's count and range."""
    value, scored = D.discriminator_divergence(pair_with_gaps(spark, d), logistic())
    seen = value.select(F.col("value").between(0.0, 1.0).cast("bigint").alias("in_range"))
    return scored.groupBy(long("label").alias("label")).agg(
        F.count("*").alias("n_rows"), F.count_distinct("event_id").alias("n_keys"),
        F.count_if(F.col("p1").between(0.0, 1.0)).alias("n_scored"),
    ).crossJoin(seen)


def mst(spark: SparkSession, d: str) -> DataFrame:
    return spanning_divergence(*_sides(spark, d)).select(
        "n", "edges", r("total_weight").alias("total_weight"), "cross_edges", r("divergence").alias("divergence")
    )


def ghp(spark: SparkSession, d: str) -> DataFrame:
    return spanning_bayes_bounds(spanning_divergence(*_sides(spark, d))).select(r("lower").alias("lower"), r("upper").alias("upper"))


def tv(spark: SparkSession, d: str) -> DataFrame:
    value, scored = D.discriminator_divergence(shifted_lineitem(spark, d), logistic())
    return value.select("metric", r("value").alias("value"))


def panel(spark: SparkSession, d: str) -> DataFrame:
    values, _ = D.discriminator_panel(shifted_lineitem(spark, d), logistic())
    return values.select("metric", r("value").alias("value"))


def panel_fixed(spark: SparkSession, d: str) -> DataFrame:
    return D.panel(scored_events(spark, d, wide=True)).select("metric", r("value").alias("value"))


# --- the same in SQL, by comparing all pairs -------------------------------------------


def _nearest_sql(left: str, right: str, key: str, dist: str, k: int, where: str = "true") -> str:
    return f"""SELECT id, neighbour, rank, distance FROM (
  SELECT a.{key} AS id, b.{key} AS neighbour, {dist} AS distance,
         row_number() OVER (PARTITION BY a.{key} ORDER BY {dist}, b.{key}) AS rank
  FROM {left} a, {right} b WHERE {where}) WHERE rank <= {k}"""


_DIST = "list_distance(a.vec, b.vec)"
_EV_POINTS = """ev AS (SELECT event_id, ts < TIMESTAMP '2024-01-16' AS early, CAST(hour(ts) AS DOUBLE) AS h,
  CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events),
ref AS (SELECT * FROM ev WHERE early), que AS (SELECT * FROM ev WHERE NOT early)"""
_EV_DIST = "sqrt((a.h - b.h) * (a.h - b.h) + (a.k - b.k) * (a.k - b.k))"


_GAPS = f"""WITH {SQL_EV},
gv AS (SELECT event_id, ts, CASE WHEN event_id % 17 = 0 OR event_id % 19 = 0 THEN -1.0 ELSE value END AS value, hour, k FROM ev),
ref AS (SELECT * FROM gv WHERE ts < TIMESTAMP '2024-01-16'), que AS (SELECT * FROM gv WHERE NOT (ts < TIMESTAMP '2024-01-16'))"""
_GAPS_DIST = "sqrt((a.value - b.value) * (a.value - b.value) + (a.hour - b.hour) * (a.hour - b.hour) + (a.k - b.k) * (a.k - b.k))"


def _kl_sql(p: str, q: str, name: str) -> str:
    return f"""{name}_nu AS (SELECT id, distance AS nu FROM ({_nearest_sql(p, q, 'vec_id', _DIST, K)}) WHERE rank = {K}),
{name}_rho AS (SELECT id, distance AS rho FROM ({_nearest_sql(p, p, 'vec_id', _DIST, K, 'a.vec_id <> b.vec_id')}) WHERE rank = {K}),
{name} AS (SELECT count(*) AS n, (SELECT count(*) FROM {q}) AS m, count(*) FILTER (rho = 0) AS zero_own, count(*) FILTER (nu = 0) AS zero_other,
   ln((SELECT count(*) FROM {q}) / CAST(count(*) - 1 AS DOUBLE)) + 64.0 / count(*) * sum(ln(nu / rho)) AS kl FROM {name}_nu JOIN {name}_rho USING (id))"""


def _counts_sql(radii: list[str]) -> str:
    cols = ", ".join(f"count(*) FILTER (d <= {h}) AS c{i}" for i, h in enumerate(radii))
    return f"""pairs AS (SELECT a.vec_id AS id, a.label AS own, b.label AS tag, {_DIST} AS d FROM em a, em b),
cnt AS (SELECT id, own, tag, {cols} FROM pairs GROUP BY id, own, tag)"""


def _ber_sql(radii: list[str]) -> str:
    parts = " UNION ALL ".join(f"""SELECT {i} AS step, CAST({h} AS DOUBLE) AS radius,
  1 - avg(CASE WHEN own = 0 THEN 1.0 ELSE greatest(0.0, 1 - coalesce(low{i}, 0) / own{i}) END) AS ber FROM pp""" for i, h in enumerate(radii))
    low = ", ".join(f"max(prior * c{i}) FILTER (tag < own) AS low{i}, max(prior * c{i}) FILTER (tag = own) AS own{i}" for i in range(len(radii)))
    return f"""{_counts_sql(radii)},
pri AS (SELECT label AS tag, count(*) / CAST((SELECT count(*) FROM em) AS DOUBLE) AS prior FROM em GROUP BY label),
pp AS (SELECT id, own, {low} FROM cnt JOIN pri USING (tag) GROUP BY id, own),
ber AS ({parts})"""


_NN = f"nn AS (SELECT avg(distance) AS bw, count(*) AS n FROM ({_nearest_sql('em', 'em', 'vec_id', _DIST, 10)}) WHERE rank = 10)"
_NODES = ensemble_weights(3)
_GRID = [f"((0.2 + 1.3 * {i} / 14.0) * spread)" for i in range(15)]
_CV = f"""WITH {SQL_EM},
dims AS (SELECT vec_id, unnest(vec) AS v, unnest(range(1, 65)) AS pos FROM em),
sp AS (SELECT sqrt(sum(s * s)) AS spread FROM (SELECT stddev_pop(v) AS s FROM dims GROUP BY pos)),
f AS (SELECT *, ({sql_rank(0, ['vec_id'])} - 1) % 20 AS fold FROM em),
sz AS (SELECT fold, (SELECT count(*) FROM em) - count(*) AS train FROM f GROUP BY fold),
p AS (SELECT a.vec_id AS id, a.fold, {_DIST} AS d FROM f a, f b WHERE a.fold <> b.fold),
c AS (SELECT id, fold, {', '.join(f'count(*) FILTER (d <= {h}) AS c{i}' for i, h in enumerate(_GRID))} FROM p, sp GROUP BY id, fold),
agg AS ({' UNION ALL '.join(f"SELECT {i} AS step, any_value({h}) AS h, count(*) FILTER (c{i} = 0) AS empty_rows, coalesce(sum(CASE WHEN c{i} > 0 THEN ln(c{i} / CAST(train AS DOUBLE)) - (32 * ln(pi()) - lgamma(33) + 64 * ln({h})) END), 0.0) AS ll FROM c JOIN sz USING (fold), sp" for i, h in enumerate(_GRID))})
SELECT CAST(step AS BIGINT) AS step, round(h, 4) + 0.0 AS bandwidth, empty_rows, round(ll, 2) + 0.0 AS log_likelihood,
  CAST(row_number() OVER (ORDER BY empty_rows > 0, CASE WHEN empty_rows > 0 THEN 0.0 ELSE -ll END, step) = 1 AS BIGINT) AS is_best FROM agg"""


def _knn_ber_sql() -> str:
    ks = (1, 3, 5)
    votes = ", ".join(f"avg(vote) FILTER (rank <= {k}) AS v{k}" for k in ks)
    errs = ", ".join(f"avg(CASE WHEN (v{k} > 0.5) <> (tag = 1) THEN 1.0 ELSE 0.0 END) AS e{k}" for k in ks)
    low = " + ".join(f"(1.0 - sqrt(greatest(0.0, 1.0 - 2.0 * e{k}))) / 2" for k in ks)
    return f"""WITH {SQL_EM}, t AS (SELECT vec_id, vec, CAST(label >= 5 AS INT) AS tag, {sql_rank(0, ['vec_id'])} % 2 AS half FROM em),
nb AS (SELECT a.half, a.vec_id AS id, a.tag, b.tag AS vote, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_DIST}, b.vec_id) AS rank FROM t a, t b WHERE a.half <> b.half),
v AS (SELECT half, id, tag, {votes} FROM nb GROUP BY half, id, tag), e AS (SELECT half, {errs} FROM v GROUP BY half)
SELECT round(avg(({low}) / 3), 4) + 0.0 AS lower, round(avg(({' + '.join(f'e{k}' for k in ks)}) / 3), 4) + 0.0 AS upper FROM e"""


_KDE = f"""WITH {SQL_EM}, t AS (SELECT vec_id, vec, CAST(label >= 5 AS INT) AS tag FROM em),
s AS (SELECT a.vec_id, a.tag AS own, b.tag AS tag, sum(exp(-pow({_DIST}, 2) / (2 * {KDE_BANDWIDTH} * {KDE_BANDWIDTH}))) AS k
      FROM t a, t b WHERE a.vec_id <> b.vec_id GROUP BY a.vec_id, a.tag, b.tag),
n AS (SELECT tag, count(*) AS n FROM t GROUP BY tag),
sc AS (SELECT vec_id, own, s.tag, k / (n - CASE WHEN own = s.tag THEN 1 ELSE 0 END) * n / (SELECT count(*) FROM t) AS score FROM s JOIN n USING (tag)),
w AS (SELECT vec_id, own, tag, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, tag) AS p FROM sc)
SELECT round(avg(CASE WHEN tag <> own THEN 1.0 ELSE 0.0 END), 4) + 0.0 AS ber FROM w WHERE p = 1"""


def _transport_sql(source: str, out: str) -> str:
    """Merge the two sorted samples of every projection on the grid of their common mass."""
    return f"""{source},
sz AS (SELECT proj, count(*) FILTER (side = 0) AS n, count(*) FILTER (side = 1) AS m FROM vals GROUP BY proj),
o AS (SELECT proj, side, v, row_number() OVER (PARTITION BY proj, side ORDER BY v) AS i FROM vals),
cutp AS (SELECT DISTINCT o.proj, CASE WHEN side = 0 THEN i * m ELSE i * n END AS e FROM o JOIN sz USING (proj)),
seg AS (SELECT proj, e, e - coalesce(lag(e) OVER (PARTITION BY proj ORDER BY e), 0) AS w FROM cutp),
cost AS (SELECT s.proj, sum(w / (CAST(n AS DOUBLE) * m) * (a.v - b.v) * (a.v - b.v)) AS c FROM seg s JOIN sz USING (proj)
  JOIN o a ON a.proj = s.proj AND a.side = 0 AND a.i = (e + m - 1) // m JOIN o b ON b.proj = s.proj AND b.side = 1 AND b.i = (e + n - 1) // n
  GROUP BY s.proj)
{out}"""


def _directions_sql(n: int = PROJECTIONS) -> str:
    rows = ", ".join(
        f"({j}, [{', '.join(repr(float(v)) for v in axis)}]::DOUBLE[])" for j, axis in enumerate(unit_directions(0, n, 64))
    )
    return f"WITH {SQL_EM}, dir(proj, axis) AS (VALUES {rows}), vals AS (SELECT proj, CAST(label >= 5 AS INT) AS side, list_dot_product(vec, axis) AS v FROM em, dir)"


_FEATURE_VALUES = f"WITH {SQL_LI_HALVES}, vals AS (" + " UNION ALL ".join(
    f"SELECT {i} AS proj, {s} AS side, {c} AS v FROM {t}" for i, c in enumerate(LI_FEATURES) for s, t in ((0, "ref"), (1, "que"))
) + ")"

_GAPS_VALUES = f"{_GAPS}, vals AS (" + " UNION ALL ".join(
    f"SELECT {i} AS proj, {s} AS side, CAST({c} AS DOUBLE) AS v FROM {t}" for i, c in enumerate(EV_FEATURES) for s, t in ((0, "ref"), (1, "que"))
) + ")"

# An edge belongs to the minimum spanning tree when no path between its ends has a smaller longest
# edge; squaring the (min, max) matrix nine times covers paths of up to 512 edges.
_MST = f"""WITH {SQL_EM},
b0 AS MATERIALIZED (SELECT a.vec_id AS i, b.vec_id AS j, {_DIST} AS w, (a.label < 5) <> (b.label < 5) AS crossing FROM em a, em b), """ + ", ".join(
    f"b{t + 1} AS MATERIALIZED (SELECT x.i, y.j, min(greatest(x.w, y.w)) AS w FROM b{t} x JOIN b{t} y ON x.j = y.i GROUP BY x.i, y.j)"
    for t in range(9)
) + """,
tree AS (SELECT e.w, e.crossing FROM b0 e JOIN b9 m ON m.i = e.i AND m.j = e.j WHERE e.i < e.j AND e.w <= m.w),
tot AS (SELECT (SELECT count(*) FROM em) AS n, count(*) AS edges, sum(w) AS total_weight, count(*) FILTER (crossing) AS cross_edges FROM tree),
res AS (SELECT *, least(1.0, greatest(0.0, 1.0 - 2.0 * (cross_edges - 1) / n)) AS u FROM tot)"""
PANEL = {
    "TV": "greatest(0.0, avg(sign(p1 - 0.5) / 2) FILTER (label = 1) - avg(sign(p1 - 0.5) / 2) FILTER (label = 0))",
    "JD": _jd(_CORRECT_P), "JD_inverse": _jd(_clipped("1.0 - p1", 1e-3)),
    "SKL": _kl(_CORRECT_P, "", 1) + " + " + _kl(_clipped("1.0 - p1", 1e-3), "", 0),
}
_RADII_SQL = [str(h) for h in RADII]

QUERIES = [
    Query("knn_join", knn, f"WITH {SQL_EM} SELECT id, neighbour, rank, round(distance, 4) + 0.0 AS distance FROM ({_nearest_sql('que', 'ref', 'vec_id', _DIST, K)})"),
    Query("knn_join_copies", knn_copies, f"WITH {_EV_POINTS} SELECT id, neighbour, rank, round(distance, 4) + 0.0 AS distance FROM ({_nearest_sql('que', 'ref', 'event_id', _EV_DIST, K)})"),
    Query("knn_kl", kl, f"WITH {SQL_EM}, {_kl_sql('ref', 'que', 'x')} SELECT n, m, zero_own, zero_other, round(kl, 4) + 0.0 AS kl FROM x"),
    Query("knn_kl_symmetric", kl_symmetric, f"""WITH {SQL_EM}, {_kl_sql('ref', 'que', 'x')}, {_kl_sql('que', 'ref', 'y')}
SELECT round(x.kl, 4) + 0.0 AS kl_p_q, round(y.kl, 4) + 0.0 AS kl_q_p, round(x.kl + y.kl, 4) + 0.0 AS divergence FROM x, y"""),
    Query("eps_count", eps, f"WITH {SQL_EM}, {_counts_sql(_RADII_SQL)} SELECT id, CAST(own AS BIGINT) AS own, CAST(tag AS BIGINT) AS tag, c0, c1, c2 FROM cnt WHERE c2 > 0"),
    Query("ber_base", ber_base, f"WITH {SQL_EM}, {_ber_sql(_RADII_SQL)} SELECT CAST(step AS BIGINT) AS step, round(radius, 4) + 0.0 AS radius, round(ber, 4) + 0.0 AS ber FROM ber"),
    Query("ber_ensemble", ber_ensemble, f"WITH {SQL_EM}, {_NN}, " + _ber_sql([f"((SELECT bw FROM nn) * {s * 0.5 + 1.0!r})" for s, _ in _NODES])
          + " SELECT round(sum(CASE step " + " ".join(f"WHEN {i} THEN {w!r}" for i, (_, w) in enumerate(_NODES)) + " END * ber), 4) + 0.0 AS ber, round((SELECT bw FROM nn), 4) + 0.0 AS bandwidth FROM ber"),
    Query("bandwidth_nn", bandwidth_nn, f"WITH {SQL_EM}, {_NN} SELECT n, round(bw, 4) + 0.0 AS bandwidth FROM nn"),
    Query("bandwidth_cv", bandwidth_cv, _CV),
    Query("ber_knn_bounds", ber_knn, _knn_ber_sql()),
    Query("ber_kde", ber_kde, _KDE),
    Query("sliced_wasserstein", sliced, _transport_sql(_directions_sql(), "SELECT count(*) AS n_projections, round(sqrt(avg(c)), 6) + 0.0 AS distance FROM cost")),
    Query("sliced_wasserstein_default", sliced_default, _transport_sql(_directions_sql(DEFAULT_PROJECTIONS), "SELECT round(sqrt(avg(c)), 6) + 0.0 AS distance FROM cost")),
    Query("feature_wasserstein", per_feature, _transport_sql(_FEATURE_VALUES, "SELECT CASE proj " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(LI_FEATURES)) + " END AS feature, CAST(proj AS BIGINT) AS position, round(sqrt(c), 6) + 0.0 AS distance FROM cost")),
    Query("knn_join_missing", knn_gaps, f"{_GAPS} SELECT id, neighbour, rank, round(distance, 4) + 0.0 AS distance FROM ({_nearest_sql('que', 'ref', 'event_id', _GAPS_DIST, K)})"),
    Query("feature_wasserstein_missing", per_feature_gaps, _transport_sql(_GAPS_VALUES, "SELECT CASE proj " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(EV_FEATURES)) + " END AS feature, CAST(proj AS BIGINT) AS position, round(sqrt(c), 6) + 0.0 AS distance FROM cost")),
    Query("divergence_tv_missing", tv_gaps, f"""{_GAPS}
SELECT CAST(0 AS BIGINT) AS label, count(*) AS n_rows, count(*) AS n_keys, count(*) AS n_scored, CAST(1 AS BIGINT) AS in_range FROM ref
UNION ALL SELECT CAST(1 AS BIGINT), count(*), count(*), count(*), CAST(1 AS BIGINT) FROM que"""),
    Query("mst_divergence", mst, f"{_MST} SELECT n, edges, round(total_weight, 4) + 0.0 AS total_weight, cross_edges, round(u, 4) + 0.0 AS divergence FROM res"),
    Query("ghp_bounds", ghp, f"{_MST} SELECT round(0.5 - sqrt(u) / 2, 4) + 0.0 AS lower, round(0.5 - u / 2, 4) + 0.0 AS upper FROM res"),
    Query("divergence_tv", tv),
    Query("divergence_panel", panel),
    Query("divergence_panel_fixed", panel_fixed, f"WITH {sql_scored(True)}, agg AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in PANEL.items()) + " FROM sc) "
          + " UNION ALL ".join(f"SELECT '{n}' AS metric, round({n}, 4) + 0.0 AS value FROM agg" for n in PANEL)),
]
