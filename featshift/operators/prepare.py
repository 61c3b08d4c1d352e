"""Scaling, splitting, fold assignment and feature picks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from featshift.functions.hashing import seeded_hash
from featshift.operators.rank import seeded_rank
from featshift.sources.pair import ShiftPair
from featshift.storage import materialize


# --- scaling -----------------------------------------------------------------


def feature_ranges(df: DataFrame, features: Sequence[str]) -> dict[str, tuple[float, float]]:
    """(min, max) of every feature, from one aggregation; two scalars each reach the driver."""
    row = df.agg(
        *[F.min(F.col(c).cast("double")).alias(f"lo_{i}") for i, c in enumerate(features)],
        *[F.max(F.col(c).cast("double")).alias(f"hi_{i}") for i, c in enumerate(features)],
    ).first()
    return {c: (row[f"lo_{i}"], row[f"hi_{i}"]) for i, c in enumerate(features)}


def minmax_scale(
    df: DataFrame, features: Sequence[str], ranges: Mapping[str, tuple[float, float]] | None = None
) -> DataFrame:
    """Scale every feature to [0, 1]; a constant feature becomes 0."""
    ranges = ranges or feature_ranges(df, features)
    scaled = {}
    for c in features:
        lo, hi = ranges[c]
        if lo is None:
            continue
        number = F.col(c).cast("double")
        if hi > lo:
            scaled[c] = (number - F.lit(lo)) / F.lit(hi - lo)
        else:
            scaled[c] = F.when(number.isNotNull(), F.lit(0.0))
    return df.withColumns(scaled) if scaled else df


# --- splits ------------------------------------------------------------------


def half_split(
    df: DataFrame, key: Sequence[str], features: Sequence[str], seed: int | str = 0, stored: bool = False
) -> ShiftPair:
    """Seeded 50/50 split; with an odd row count the query gets the extra row.

    ``stored`` writes the ranked rows once, for a pair that is read many times.
    """
    total = df.agg(F.count("*")).scalar()
    ranked = seeded_rank(df.select(*key, *features), key, seed, out="_rank")
    if stored:
        ranked = materialize(ranked, "halves")
    is_reference = F.col("_rank") <= F.floor(total / 2)
    return ShiftPair.from_predicate(ranked, is_reference, key, features)


def stratified_folds(df: DataFrame, key: Sequence[str], k: int, seed: int | str = 0, label: str = "label") -> DataFrame:
    """Column ``fold`` in 0..k-1; per label, fold sizes differ by at most one row."""
    ranked = seeded_rank(df, key, seed, by=[label], out="_rank")
    return ranked.withColumn("fold", ((F.col("_rank") - 1) % k).cast("int")).drop("_rank")


def stratified_holdout(
    df: DataFrame, key: Sequence[str], test_size: float | int, seed: int | str = 0, label: str = "label"
) -> DataFrame:
    """Column ``fold``: 0 for held-out rows, -1 for rows that are only trained on.

    The test size is shared out over the labels by largest remainder.
    """
    counts = df.groupBy(label).agg(F.count("*").alias("_n"))
    everything = W.partitionBy()
    wanted = (
        F.ceil(F.lit(float(test_size)) * F.sum("_n").over(everything))
        if isinstance(test_size, float)
        else F.lit(int(test_size)).cast("bigint")
    )
    shares = counts.withColumn("_all", F.sum("_n").over(everything)).withColumn("_wanted", wanted)
    shares = shares.withColumn("_floor", F.floor(F.col("_n") * F.col("_wanted") / F.col("_all")))
    shares = shares.withColumn("_rest", F.col("_n") * F.col("_wanted") - F.col("_floor") * F.col("_all"))
    shares = shares.withColumn("_left", F.col("_wanted") - F.sum("_floor").over(everything))
    by_remainder = W.partitionBy().orderBy(F.desc("_rest"), F.col(label))
    quota = F.col("_floor") + F.when(F.row_number().over(by_remainder) <= F.col("_left"), 1).otherwise(0)
    ranked = seeded_rank(df, key, seed, by=[label], out="_rank")
    return (
        ranked.join(shares.select(label, quota.alias("_quota")), label)
        .withColumn("fold", F.when(F.col("_rank") <= F.col("_quota"), 0).otherwise(-1))
        .drop("_rank", "_quota")
    )


def custom_folds(df: DataFrame, folds: DataFrame, key: Sequence[str]) -> DataFrame:
    """Attach caller-supplied ``(key, fold)`` or ``(key, fold, role)`` rows.

    A key may occur several times (overlapping splits). Without ``role`` a row is
    tested in its fold and trained on in all others.
    """
    extra = [c for c in ("fold", "role") if c in folds.columns]
    return df.join(folds.select(*key, *extra), list(key))


# --- feature picks -----------------------------------------------------------


def feature_table(df: DataFrame, features: Sequence[str], statistic: str = "stddev_samp") -> DataFrame:
    """One row per feature: ``(feature, position, value)``; aggregated first, unpivoted after."""
    fn = getattr(F, statistic)
    row = df.agg(*[fn(F.col(c).cast("double")).alias(f"s{i}") for i, c in enumerate(features)])
    entries = [
        F.struct(F.lit(c).alias("feature"), F.lit(i).alias("position"), F.col(f"s{i}").cast("double").alias("value"))
        for i, c in enumerate(features)
    ]
    return row.select(F.inline(F.array(*entries)))


def pick_count(n_features: int, fraction: float) -> int:
    return round(n_features * fraction)


def pick_random_features(df: DataFrame, features: Sequence[str], fraction: float, seed: int | str = 0) -> DataFrame:
    """``(feature, position, value, picked)`` with a seeded choice; ``value`` counts the non-null rows."""
    table = feature_table(df, features, "count")
    order = W.partitionBy().orderBy(seeded_hash(seed, "feature"), "feature")
    return table.withColumn(
        "picked", (F.row_number().over(order) <= pick_count(len(features), fraction)).cast("int")
    )


def pick_top_std(df: DataFrame, features: Sequence[str], fraction: float) -> DataFrame:
    """``(feature, position, value, picked)``: the features with the largest sample deviation."""
    order = W.partitionBy().orderBy(F.desc("value"), "position")
    return feature_table(df, features, "stddev_samp").withColumn(
        "picked", (F.row_number().over(order) <= pick_count(len(features), fraction)).cast("int")
    )


def cap_clean_features(df: DataFrame, corrupted: Sequence[str], clean: Sequence[str], max_dims: int) -> DataFrame:
    """``(feature, position, value, kept)``: all corrupted features and the widest clean ones.

    ``value`` is the population deviation in ``df``.
    """
    features = [*corrupted, *clean]
    table = feature_table(df, features, "stddev_pop")
    is_clean = F.col("position") >= len(corrupted)
    order = W.partitionBy(is_clean).orderBy(F.desc("value"), "position")
    return table.withColumn("kept", (~is_clean | (F.row_number().over(order) <= max_dims)).cast("int"))


# --- moving columns back and aligning rows ------------------------------------


def write_back(original: DataFrame, changed: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """``original`` with the given columns replaced where ``changed`` has the row; column order kept."""
    new = changed.select(*key, *[F.col(c).alias(f"_new_{c}") for c in columns], F.lit(True).alias("_hit"))
    joined = original.join(new, list(key), "left")
    replaced = set(columns)
    return joined.select(
        *[
            F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in replaced else F.col(c)
            for c in original.columns
        ]
    )


def align_rows(pair: ShiftPair, seed: int | str = 0, columns: Sequence[str] | None = None) -> DataFrame:
    """One reference row for every query row, by rank: ``(query key, query_rank, reference_rank, ref_*)``.

    A longer query wraps around the reference, so every reference row serves about
    the same number of query rows; a longer reference is cut to the query's length.
    """
    columns = list(columns if columns is not None else pair.features)
    n_ref = pair.reference.agg(F.count("*")).scalar()
    ref = seeded_rank(pair.reference, pair.key, f"{seed}:reference", out="reference_rank")
    ref = ref.select("reference_rank", *[F.col(c).alias(f"ref_{c}") for c in columns])
    que = seeded_rank(pair.query, pair.key, f"{seed}:query", out="query_rank").select(*pair.key, "query_rank")
    que = que.withColumn("reference_rank", (F.col("query_rank") - 1) % n_ref + 1)
    return que.join(ref, "reference_rank").select(
        *pair.key, "query_rank", "reference_rank", *[f"ref_{c}" for c in columns]
    )
