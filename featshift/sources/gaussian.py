"""Gaussian pairs with a known shift, drawn per row key."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featshift.functions.hashing import seeded_normal
from featshift.sources.pair import ShiftPair

CUTS = (None, "feature-wise", "sample-wise")


def query_covariance(covariance: np.ndarray, n_corrupted: int, scale_shift: float, cut: str | None) -> np.ndarray:
    """Covariance of the query: shifted variances and, on request, cut covariances."""
    if cut not in CUTS:
        raise ValueError(f"shuffle_manipulation must be one of {CUTS}, not {cut!r}")
    shifted = np.array(covariance, dtype=float)
    corrupted = np.arange(len(shifted)) < n_corrupted
    shifted[np.diag_indices(n_corrupted)] += scale_shift
    if cut == "feature-wise":
        gone = corrupted[:, None] | corrupted[None, :]
        np.fill_diagonal(gone, False)
        shifted[gone] = 0.0
    elif cut == "sample-wise":
        shifted[corrupted[:, None] ^ corrupted[None, :]] = 0.0
    return shifted


def _draws(rows: DataFrame, key: Sequence[str], seed: str, factor: np.ndarray, mean: np.ndarray,
           transforms: Sequence[Callable[[Column], Column]]) -> DataFrame:
    """One row per key: mean + factor @ z with z standard normal, then ``transforms``."""
    dim = len(mean)
    drawn = rows.select(*key, *[seeded_normal(f"{seed}:{d}", *key).alias(f"_z{d}") for d in range(dim)])
    columns = []
    for d in range(dim):
        value = F.lit(float(mean[d]))
        for j in np.flatnonzero(factor[d]):
            value = value + F.lit(float(factor[d, j])) * F.col(f"_z{j}")
        for transform in transforms:
            value = transform(value)
        columns.append(value.alias(f"f{d}"))
    return drawn.select(*key, *columns)


def gaussian_pair(
    rows: DataFrame,
    key: Sequence[str],
    n_dim: int,
    n_corrupted: int,
    mean_shift: float = 0.0,
    scale_shift: float = 0.0,
    shuffle_manipulation: str | None = None,
    covariance: np.ndarray | None = None,
    transforms: Sequence[Callable[[Column], Column]] = (),
    seed: int = 0,
) -> ShiftPair:
    """Reference and query draws for every key of ``rows``.

    Without ``covariance`` the features are independent and ``scale_shift`` is
    added to the standard deviation; with it, to the variance. The first
    ``n_corrupted`` features carry the shift.
    """
    if covariance is None and shuffle_manipulation is not None:
        raise ValueError("cutting covariances needs a full covariance matrix")
    shift = np.where(np.arange(n_dim) < n_corrupted, mean_shift, 0.0)
    if covariance is None:
        left = np.eye(n_dim)
        right = np.diag(np.where(np.arange(n_dim) < n_corrupted, 1.0 + scale_shift, 1.0))
    else:
        left = np.linalg.cholesky(np.asarray(covariance, dtype=float))
        right = np.linalg.cholesky(query_covariance(covariance, n_corrupted, scale_shift, shuffle_manipulation))
    reference = _draws(rows, key, f"{seed}:reference", left, np.zeros(n_dim), transforms)
    query = _draws(rows, key, f"{seed}:query", right, shift, transforms)
    return ShiftPair(reference, query, tuple(f"f{d}" for d in range(n_dim)), tuple(key))
