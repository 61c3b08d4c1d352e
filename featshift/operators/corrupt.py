"""Seeded corruption of feature columns that are scaled to [0, 1]."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Estimator, Model
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featshift.functions.hashing import driver_uniform, seeded_uniform
from featshift.operators.concurrent import run_together
from featshift.operators.discriminate import cached
from featshift.operators.rank import seeded_rank
from featshift.storage import materialize

# The corruption codes and what each one needs.
NOISE = {4.1: 0.02, 4.2: 0.05, 4.3: 0.1}
FLIP = {6.1: 0.2, 6.2: 0.4, 6.3: 0.6, 6.4: 0.8}
CODES = (1, 2, 3, 4.1, 4.2, 4.3, 5, 6.1, 6.2, 6.3, 6.4, 7, 8)
HIDDEN_WIDTH = 1024


def _replace(df: DataFrame, features: Sequence[str], make) -> DataFrame:
    return df.withColumns({c: make(c) for c in features})


def uniform_values(df: DataFrame, key: Sequence[str], features: Sequence[str], seed: int | str = 0) -> DataFrame:
    return _replace(df, features, lambda c: seeded_uniform(f"{seed}:{c}", *key))


def complement(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return _replace(df, features, lambda c: 1.0 - F.col(c))


def add_noise(
    df: DataFrame, key: Sequence[str], features: Sequence[str], size: float, seed: int | str = 0
) -> DataFrame:
    """Move every value up or down by ``size`` with equal chance, kept inside [0, 1]."""

    def moved(c: str) -> Column:
        step = F.when(seeded_uniform(f"{seed}:{c}", *key) < 0.5, -size).otherwise(size)
        return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(c) + step))

    return _replace(df, features, moved)


def binarize(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return _replace(df, features, lambda c: F.when(F.col(c) > 0.5, 1.0).otherwise(0.0))


def flip_values(
    df: DataFrame, key: Sequence[str], features: Sequence[str], share: float, seed: int | str = 0
) -> DataFrame:
    """Replace x by 1 - x with probability ``share``."""
    return _replace(
        df,
        features,
        lambda c: F.when(seeded_uniform(f"{seed}:{c}", *key) < share, 1.0 - F.col(c)).otherwise(F.col(c)),
    )


def permute_each(df: DataFrame, key: Sequence[str], features: Sequence[str], seed: int | str = 0) -> DataFrame:
    """Permute every feature over the rows, each with its own permutation.

    All features travel in one long table ranked by (feature, rank), so the number
    of shuffles does not grow with the number of features. Only what stays in its row travels
    with the slots, and only ranks and values where the two meet.
    """
    name = F.element_at(F.array(*[F.lit(c) for c in features]), F.col("_feature") + 1)
    entries = [
        F.struct(F.lit(i).alias("_feature"), F.col(c).cast("double").alias("_value")) for i, c in enumerate(features)
    ]
    long = df.select(*key, F.inline(F.array(*entries)))
    ranked = seeded_rank(long, [name, *key], f"{seed}:value", by=["_feature"], out="_rank")
    wide = ranked.select("_rank", "_feature", "_value").repartition("_rank").groupBy("_rank").agg(
        *[F.max(F.when(F.col("_feature") == i, F.col("_value"))).alias(f"_new_{c}") for i, c in enumerate(features)]
    )
    return _in_slots(df, key, features, seed, wide)


def permute_joint(df: DataFrame, key: Sequence[str], features: Sequence[str], seed: int | str = 0) -> DataFrame:
    """Permute all given features together over the rows."""
    values = seeded_rank(df.select(*key, *[c for c in features if c not in key]), key, f"{seed}:value", out="_rank")
    return _in_slots(df, key, features, seed, values.select("_rank", *[F.col(c).alias(f"_new_{c}") for c in features]))


def _in_slots(df: DataFrame, key: Sequence[str], features: Sequence[str], seed: int | str, values: DataFrame) -> DataFrame:
    """``df`` with its features replaced by the ``values`` of its slot's rank."""
    moved = set(features)
    slots = seeded_rank(df.select(*[c for c in df.columns if c in key or c not in moved]), key, f"{seed}:slot", out="_rank")
    joined = slots.join(values, "_rank")
    return joined.select(*[F.col(f"_new_{c}").alias(c) if c in moved else F.col(c) for c in df.columns])


# --- random network ------------------------------------------------------------


def network_weights(n_features: int, hidden: int = HIDDEN_WIDTH, seed: int = 0) -> list[tuple[np.ndarray, np.ndarray]]:
    """Seeded weights of four dense layers, uniform within 1/sqrt(fan-in)."""
    rng = np.random.default_rng(int(driver_uniform(seed, "network") * 2**32))
    sizes = [n_features, hidden, hidden, hidden, n_features]
    layers = []
    for fan_in, fan_out in zip(sizes, sizes[1:]):
        bound = 1.0 / np.sqrt(fan_in)
        layers.append((rng.uniform(-bound, bound, (fan_in, fan_out)), rng.uniform(-bound, bound, fan_out)))
    return layers


def load_network_weights(path: str) -> list[tuple[np.ndarray, np.ndarray]]:
    """Weights saved with ``numpy.savez``: arrays w0, b0, w1, b1, ..."""
    stored = np.load(path)
    return [(stored[f"w{i}"], stored[f"b{i}"]) for i in range(len(stored.files) // 2)]


def network_mix(
    df: DataFrame,
    features: Sequence[str],
    weights: list[tuple[np.ndarray, np.ndarray]] | None = None,
    hidden: int = HIDDEN_WIDTH,
    seed: int = 0,
) -> DataFrame:
    """Mix the features through a random ReLU network, then bring them back to [0, 1].

    Binary features are thresholded at sigmoid 0.5, the others min-max scaled.
    """
    features = list(features)
    layers = df.sparkSession.sparkContext.broadcast(weights or network_weights(len(features), hidden, seed))
    raw = [f"_raw_{c}" for c in features]
    schema = T.StructType([*df.schema.fields, *[T.StructField(c, T.DoubleType()) for c in raw]])

    def forward(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = batch[features].to_numpy(dtype=float)
            for i, (w, b) in enumerate(layers.value):
                x = x @ w + b
                if i < len(layers.value) - 1:
                    np.maximum(x, 0.0, out=x)
            yield batch.assign(**dict(zip(raw, x.T)))

    # Stored, so that the network runs once for the ranges and the result.
    mixed = materialize(df.mapInPandas(forward, schema), "mixed")
    stats = mixed.agg(
        *[F.min(r).alias(f"lo{i}") for i, r in enumerate(raw)],
        *[F.max(r).alias(f"hi{i}") for i, r in enumerate(raw)],
        *[F.min(F.col(c).isin(0.0, 1.0)).alias(f"bin{i}") for i, c in enumerate(features)],
    ).first()
    out = {}
    for i, c in enumerate(features):
        lo, hi = stats[f"lo{i}"], stats[f"hi{i}"]
        if stats[f"bin{i}"]:
            out[c] = F.when(F.col(raw[i]) >= 0.0, 1.0).otherwise(0.0)
        elif hi > lo:
            out[c] = (F.col(raw[i]) - lo) / (hi - lo)
        else:
            out[c] = F.lit(0.0)
    return mixed.withColumns(out).drop(*raw)


# --- one entry point -------------------------------------------------------------


def corrupt_features(
    df: DataFrame,
    key: Sequence[str],
    features: Sequence[str],
    code: float,
    seed: int = 0,
    weights: list[tuple[np.ndarray, np.ndarray]] | None = None,
) -> DataFrame:
    """Apply corruption ``code`` (see ``CODES``) to the given features."""
    if code == 1:
        return uniform_values(df, key, features, seed)
    if code == 2:
        return complement(df, features)
    if code == 3:
        return permute_each(df, key, features, seed)
    if code in NOISE:
        return add_noise(df, key, features, NOISE[code], seed)
    if code == 5:
        return binarize(df, features)
    if code in FLIP:
        return flip_values(df, key, features, FLIP[code], seed)
    if code == 7:
        return network_mix(df, features, weights, seed=seed)
    if code == 8:
        return permute_joint(df, key, features, seed)
    raise ValueError(f"unknown corruption code {code}; known codes: {CODES}")


# --- model-based replacement and its size ------------------------------------------


def impute_features(
    reference: DataFrame,
    query: DataFrame,
    targets: Sequence[str],
    inputs: Sequence[str],
    regressor: Estimator,
    parallelism: int = 4,
) -> DataFrame:
    """Fit ``inputs -> target`` on the reference for every target and predict it on the query."""
    assembler = VectorAssembler(inputCols=list(inputs), outputCol="_inputs", handleInvalid="keep")
    train, out = reference.select(*inputs, *targets), assembler.transform(query)

    def fit(target: str) -> Model:
        ready = regressor.copy(
            {
                regressor.getParam("featuresCol"): "_inputs",
                regressor.getParam("labelCol"): target,
                regressor.getParam("predictionCol"): f"_fit_{target}",
            }
        )
        return ready.fit(train)

    with cached(train, lambda rows: assembler.transform(rows).drop(*inputs)) as train:
        models = run_together(query.sparkSession, fit, targets, parallelism)
    for model in models:
        out = model.transform(out)
    replaced = set(targets)
    return out.select(*[F.col(f"_fit_{c}").alias(c) if c in replaced else F.col(c) for c in query.columns])


def corruption_rmse(clean: DataFrame, corrupted: DataFrame, key: Sequence[str], features: Sequence[str]) -> DataFrame:
    """``(feature, position, rmse)`` between the same rows before and after corruption."""
    after = corrupted.select(*key, *[F.col(c).alias(f"_after_{c}") for c in features])
    joined = clean.select(*key, *features).join(after, list(key))
    row = joined.agg(
        *[
            F.sqrt(F.avg(F.pow(F.col(c) - F.col(f"_after_{c}"), F.lit(2)))).alias(f"s{i}")
            for i, c in enumerate(features)
        ]
    )
    entries = [
        F.struct(F.lit(c).alias("feature"), F.lit(i).alias("position"), F.col(f"s{i}").alias("rmse"))
        for i, c in enumerate(features)
    ]
    return row.select(F.inline(F.array(*entries)))
