"""Aggregate expressions over a scored table ``(label, prediction, p1)``.

Every score is one aggregate column, so any set of them is computed in a single
partial + final aggregation. Hard-label scores read ``prediction``; the others
read ``p1``, the probability of the query class.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Probability clips of the two score families.
LOCATE_CLIP = 1e-4
CORRECT_CLIP = 1e-3
LOG_LOSS_CLIP = 1e-15


@dataclass(frozen=True)
class Scored:
    """Names of the scored columns and the probability clip."""

    label: str = "label"
    prediction: str = "prediction"
    p1: str = "p1"
    clip: float = LOCATE_CLIP

    def is_query(self) -> Column:
        return F.col(self.label) == 1

    def said_query(self) -> Column:
        return F.col(self.prediction) == 1

    def probability(self, inverse: bool = False) -> Column:
        p = 1.0 - F.col(self.p1) if inverse else F.col(self.p1)
        return F.least(F.lit(1.0 - self.clip), F.greatest(F.lit(self.clip), p))


def _ratio(top: Column, bottom: Column, otherwise: float | None = 0.0) -> Column:
    return F.when(bottom != 0, top / bottom).otherwise(F.lit(otherwise).cast("double"))


def _mean_where(condition: Column, value: Column) -> Column:
    return F.avg(F.when(condition, value))


def _cells(s: Scored) -> tuple[Column, Column, Column, Column]:
    """tp, fp, fn, tn as doubles."""
    yes, said = s.is_query(), s.said_query()
    return tuple(
        F.count_if(c).cast("double") for c in (yes & said, ~yes & said, yes & ~said, ~yes & ~said)
    )


def accuracy(s: Scored) -> Column:
    tp, fp, fn, tn = _cells(s)
    return _ratio(tp + tn, tp + fp + fn + tn, None)


def balanced_accuracy(s: Scored) -> Column:
    """Mean recall over the classes that occur."""
    hit = F.when(s.said_query(), 1.0).otherwise(0.0)
    recall1 = _mean_where(s.is_query(), hit)
    recall0 = _mean_where(~s.is_query(), 1.0 - hit)
    both = (recall1 + recall0) / 2
    return F.coalesce(both, recall1, recall0)


def precision(s: Scored) -> Column:
    tp, fp, _, _ = _cells(s)
    return _ratio(tp, tp + fp)


def recall(s: Scored) -> Column:
    tp, _, fn, _ = _cells(s)
    return _ratio(tp, tp + fn)


def f1(s: Scored) -> Column:
    tp, fp, fn, _ = _cells(s)
    return _ratio(2 * tp, 2 * tp + fp + fn)


def jaccard(s: Scored) -> Column:
    tp, fp, fn, _ = _cells(s)
    return _ratio(tp, tp + fp + fn)


def matthews_corrcoef(s: Scored) -> Column:
    tp, fp, fn, tn = _cells(s)
    return _ratio(tp * tn - fp * fn, F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn))


def cohen_kappa(s: Scored) -> Column:
    tp, fp, fn, tn = _cells(s)
    total = tp + fp + fn + tn
    chance = ((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp)) / total
    return _ratio(tp + tn - chance, total - chance)


def zero_one_loss(s: Scored) -> Column:
    return 1.0 - accuracy(s)


def log_loss(s: Scored) -> Column:
    p = F.least(F.lit(1.0 - LOG_LOSS_CLIP), F.greatest(F.lit(LOG_LOSS_CLIP), F.col(s.p1)))
    return -F.avg(F.when(s.is_query(), F.log(p)).otherwise(F.log(1.0 - p)))


def brier(s: Scored) -> Column:
    miss = F.col(s.p1) - F.col(s.label)
    return F.avg(miss * miss)


def d1(s: Scored) -> Column:
    """log(mean p1) + log(1 - mean p0), with p0 = 1 - p1."""
    mean1 = F.avg(s.p1)
    return F.log(mean1) + F.log(1.0 - (1.0 - mean1))


def d2(s: Scored) -> Column:
    mean1 = F.avg(s.p1)
    return F.log(mean1 / (1.0 - mean1))


def d3(s: Scored) -> Column:
    mean0 = 1.0 - F.avg(s.p1)
    return -F.log(1.0 / mean0 - 1.0)


def jensen_shannon(s: Scored, inverse: bool = False) -> Column:
    """Variational lower bound of the Jensen-Shannon divergence, not below 0."""
    p = s.probability(inverse)
    bound = 0.5 * (
        _mean_where(s.is_query(), F.log(p)) + _mean_where(~s.is_query(), F.log(1.0 - p)) + math.log(4.0)
    )
    return F.greatest(F.lit(0.0), bound)


def kullback_leibler(s: Scored, centred: bool = True, inverse: bool = False) -> Column:
    """E1[log r] - E0[r - 1] (centred) or E1[log r] - E0[r], r = p / (1 - p), not below 0.

    ``inverse`` swaps both the probability and the classes.
    """
    p = s.probability(inverse)
    first = ~s.is_query() if inverse else s.is_query()
    r = p / (1.0 - p)
    bound = _mean_where(first, F.log(r)) - _mean_where(~first, r - 1.0 if centred else r)
    return F.greatest(F.lit(0.0), bound)


def symmetric_kl(s: Scored) -> Column:
    return kullback_leibler(s, centred=False) + kullback_leibler(s, centred=False, inverse=True)


def total_variation(s: Scored) -> Column:
    """E1[h] - E0[h] with h = sign(p1 - 1/2) / 2, not below 0."""
    half = F.signum(s.probability() - 0.5) / 2
    return F.greatest(F.lit(0.0), _mean_where(s.is_query(), half) - _mean_where(~s.is_query(), half))


def tvd_from_accuracy(value: Column) -> Column:
    """Total variation distance implied by a balanced accuracy."""
    return F.greatest(F.lit(0.0), 2.0 * value - 1.0)


_REGISTRY: dict[str, Callable[[Scored], Column]] = {
    "balanced_accuracy": balanced_accuracy,
    "accuracy": accuracy,
    "precision": precision,
    "recall": recall,
    "f1": f1,
    "jaccard": jaccard,
    "matthews_corrcoef": matthews_corrcoef,
    "cohen_kappa": cohen_kappa,
    "zero_one_loss": zero_one_loss,
    "log_loss": log_loss,
    "neg_log_loss": lambda s: -log_loss(s),
    "brier": brier,
    "neg_brier_score": lambda s: -brier(s),
    "D1": d1,
    "D2": d2,
    "D3": d3,
    "JD": jensen_shannon,
    "JD_inverse": lambda s: jensen_shannon(s, inverse=True),
    "KL": kullback_leibler,
    "KL_raw": lambda s: kullback_leibler(s, centred=False),
    "SKL": symmetric_kl,
    "TV": total_variation,
}

# These need the order of p1 and get a second job in ``operators.evaluate``.
RANKING = ("roc_auc", "average_precision")


def register_metric(name: str, build: Callable[[Scored], Column]) -> None:
    """Add a score: ``build`` turns the scored columns into one aggregate expression."""
    _REGISTRY[name] = build


def metric_column(name: str, scored: Scored) -> Column:
    if name not in _REGISTRY:
        raise ValueError(f"unknown metric {name!r}; known: {sorted([*_REGISTRY, *RANKING])}")
    return _REGISTRY[name](scored)


def is_metric(name: str) -> bool:
    return name in _REGISTRY or name in RANKING
