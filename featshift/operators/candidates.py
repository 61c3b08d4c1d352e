"""Choosing bad rows and the best replacement for each of them.

A discriminator of a row made of clean values x and candidate values c is written as
a sum of products ``score(x, c) = sum_l row_l(x) * cand_l(c)``. Tree ensembles have one
term per tree with a product per leaf (a leaf is reached when x and c both allow it),
linear models a single term. Rows that look alike to a tree share one line of a small
table, candidates one column, and no (row, candidate) pair is ever emitted.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
from pyspark.ml import Model
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featshift.operators.blocks import row_slices
from featshift.operators.rank import in_order, running_totals, seeded_rank
from featshift.sources.pair import MISSING, ShiftPair
from featshift.storage import fresh_path, materialize

BAD_ABOVE = 0.5
_SCORE_CELLS = 16_000_000


# --- bad rows --------------------------------------------------------------------------


def bad_row_counts(scored: DataFrame) -> DataFrame:
    """One row: ``n``, ``n_bad``, ``share`` and ``quota`` (rows to fix) of a scored query."""
    counts = scored.agg(F.count("*").alias("n"), F.count_if(F.col("p1") > BAD_ABOVE).alias("n_bad"))
    excess = F.greatest(F.lit(0), F.floor(F.col("n_bad") - F.col("n") / 2))
    return counts.select(
        "n", "n_bad", (F.col("n_bad") / F.col("n")).alias("share"),
        F.least(F.col("n_bad"), excess + 1).alias("quota"),
    )


def worst_rows(scored: DataFrame, key: Sequence[str], quota: int, seed: int | str = 0) -> DataFrame:
    """The ``quota`` bad rows with the highest ``p1``; equal ones in seeded order of the key.

    Counts per distinct probability find the boundary value; only rows exactly at it
    need ranking.
    """
    bad = scored.filter(F.col("p1") > BAD_ABOVE)
    counts = materialize(bad.groupBy(F.col("p1").alias("_p")).agg(F.count("*").alias("_n")), "score-counts")
    ranges = in_order(counts, [F.desc("_p")], counts.count())
    running = running_totals(ranges, {"_upto": F.col("_n")}, F.col("_bucket"), [F.desc("_p")])
    edge = running.filter(F.col("_upto") >= quota).agg(
        F.max("_p").alias("p"), F.max_by(F.col("_upto") - F.col("_n"), "_p").alias("above")
    ).first()
    if edge["p"] is None:
        return bad
    over = bad.filter(F.col("p1") > edge["p"])
    at = seeded_rank(bad.filter(F.col("p1") == edge["p"]), key, seed, out="_rank")
    return over.unionByName(at.filter(F.col("_rank") <= quota - edge["above"]).drop("_rank"))


# --- blocks -------------------------------------------------------------------------------


def n_batches(n_reference: int, batch_size: int) -> int:
    return max(1, math.floor(n_reference / batch_size))


def correction_blocks(pair: ShiftPair, batch_size: int, seed: int | str = 0) -> tuple[DataFrame, DataFrame]:
    """Blocks of both sides: reference ``(key, rank, block)``, query ``(key, rank, block, lap)``.

    A query row belongs to the block of the reference row it is aligned with. A longer
    query goes round the reference again (``lap``), so that a (block, lap) group holds
    fewer than two batches of query rows however the sizes differ. A shorter query is
    stretched over the reference: its rows share out all reference ranks, and a row has
    one line for every block that its share touches, so no block is without query rows.
    """
    n_ref, n_que = pair.reference.count(), pair.query.count()
    last = n_batches(n_ref, batch_size) - 1
    ref = seeded_rank(pair.reference.select(*pair.key), pair.key, f"{seed}:reference")
    que = seeded_rank(pair.query.select(*pair.key), pair.key, f"{seed}:query")

    def block(rank):
        return F.least(F.floor((rank - 1) / batch_size), F.lit(last)).cast("int").alias("block")

    ref = ref.select(*pair.key, "rank", block(F.col("rank")))
    if 0 < n_que < n_ref:
        def before(rank: str):
            """Reference rows that belong to query rows of a smaller rank; decimals, as the product may pass 2^63."""
            return F.expr(f"CAST({rank} - 1 AS DECIMAL(19, 0)) * {n_ref}BD div {n_que}BD")

        touched = F.sequence(block(before("rank") + 1), block(before("(rank + 1)")))
        return ref, que.select(*pair.key, "rank", F.explode(touched).alias("block"), F.lit(0).alias("lap"))
    aligned = (F.col("rank") - 1) % n_ref + 1
    lap = F.floor((F.col("rank") - 1) / n_ref).cast("int").alias("lap")
    return ref, que.select(*pair.key, "rank", block(aligned), lap)


def in_every_lap(candidates: DataFrame, n_reference: int, n_query: int) -> DataFrame:
    """Candidates of a block once for each ``lap`` that the query goes round the reference."""
    laps = max(1, -(-n_query // n_reference))
    return candidates.withColumn("lap", F.explode(F.sequence(F.lit(0), F.lit(laps - 1))))


# --- models as sums of products ----------------------------------------------------------------


@dataclass(frozen=True)
class Term:
    """Products ``(rows(x) * scale) @ candidates(c).T``; both map value matrices to equal widths."""

    rows: Callable[[np.ndarray], np.ndarray]
    candidates: Callable[[np.ndarray], np.ndarray]
    scale: np.ndarray | float = 1.0


@dataclass(frozen=True)
class SplitScorer:
    terms: tuple[Term, ...]

    def scores(self, x: np.ndarray, c: np.ndarray) -> np.ndarray:
        """(rows, candidates) scores, ordered as the model's probability orders them."""
        total = np.zeros((len(x), len(c)))
        for term in self.terms:
            left, left_of = _distinct_lines(term.rows(x))
            right, right_of = _distinct_lines(term.candidates(c))
            total += ((left * term.scale) @ right.T)[left_of][:, right_of]
        return total


def _distinct_lines(lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct lines and, for every line, the number of its distinct one."""
    packed = np.packbits(lines, axis=1) if lines.dtype == bool else lines
    _, first, of = np.unique(packed, axis=0, return_index=True, return_inverse=True)
    return lines[first].astype(float), of.ravel()


@dataclass(frozen=True)
class _Node:
    feature: int
    threshold: float
    left: int
    right: int
    value: float


def _stored_trees(model: Model, spark: SparkSession) -> list[tuple[float, dict[int, _Node]]]:
    """(weight, nodes by id) of every tree, read back from the model's stored node table."""
    path = fresh_path(spark, "model")
    model.write().save(path)
    nodes = spark.read.parquet(f"{path}/data")
    if "nodeData" in nodes.columns:
        nodes = nodes.select("treeID", "nodeData.*")
    else:
        nodes = nodes.withColumn("treeID", F.lit(0))
    regression = type(model).__name__.startswith("GBT")
    weights = list(model.treeWeights) if hasattr(model, "treeWeights") else [1.0]
    trees: dict[int, dict[int, _Node]] = {}
    stats = F.col("impurityStats")
    total = F.aggregate(stats, F.lit(0.0), lambda a, b: a + b)
    value = F.col("prediction") if regression else stats[1] / total
    split = F.col("split.leftCategoriesOrThreshold")
    for row in nodes.select(
        "treeID", "id", "leftChild", "rightChild", F.col("split.featureIndex").alias("feature"),
        F.get(split, F.lit(0)).alias("threshold"), value.alias("value"),
    ).collect():
        trees.setdefault(row["treeID"], {})[row["id"]] = _Node(
            row["feature"], row["threshold"] or 0.0, row["leftChild"], row["rightChild"], row["value"]
        )
    return [(weights[i], trees[i]) for i in sorted(trees)]


def _leaf_values(nodes: dict[int, _Node]) -> np.ndarray:
    return np.array([nodes[i].value for i in sorted(nodes) if nodes[i].left < 0])


def _reachable(nodes: dict[int, _Node], own: dict[int, int], x: np.ndarray) -> np.ndarray:
    """(rows, leaves): whether the given features alone allow the leaf."""
    reach = {0: np.ones(len(x), dtype=bool)}
    leaves = []
    for i in sorted(nodes):
        node = nodes[i]
        if node.left < 0:
            leaves.append(reach[i])
        elif node.feature in own:
            goes_left = x[:, own[node.feature]] <= node.threshold
            reach[node.left], reach[node.right] = reach[i] & goes_left, reach[i] & ~goes_left
        else:
            reach[node.left] = reach[node.right] = reach[i]
    return np.column_stack(leaves)


def split_model(model: Model, features: Sequence[str], clean: Sequence[str], corrupted: Sequence[str], spark: SparkSession) -> SplitScorer:
    """Write a fitted classifier as a :class:`SplitScorer` that orders candidates as its probability does."""
    if hasattr(model, "featureImportances"):
        position = {name: i for i, name in enumerate(features)}
        own_clean = {position[c]: i for i, c in enumerate(clean)}
        own_bad = {position[c]: i for i, c in enumerate(corrupted)}
        return SplitScorer(tuple(
            Term(
                partial(_reachable, nodes, own_clean), partial(_reachable, nodes, own_bad), weight * _leaf_values(nodes)
            )
            for weight, nodes in _stored_trees(model, spark)
        ))
    if hasattr(model, "coefficients"):
        by_name = dict(zip(features, model.coefficients.toArray()))
        slopes = np.array([by_name[c] for c in corrupted])
        # The clean part shifts all candidates of a row alike.
        return SplitScorer((Term(lambda x: np.ones((len(x), 1)), lambda c: (c @ slopes)[:, None]),))
    raise ValueError(f"{type(model).__name__} has neither coefficients nor featureImportances")


def best_candidates(scorer: SplitScorer, x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """For every row of ``x`` the first candidate of ``c`` with the lowest score."""
    return lowest_scores(scorer, x, c)[0]


def lowest_scores(scorer: SplitScorer, x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The choice of :func:`best_candidates` and its scores."""
    rows, row_of = np.unique(x, axis=0, return_inverse=True)
    _, first = np.unique(c, axis=0, return_index=True)
    first.sort()
    best, lowest = np.empty(len(rows), dtype=np.int64), np.empty(len(rows))
    for part in row_slices(len(rows), len(first), cells=_SCORE_CELLS):
        scores = scorer.scores(rows[part], c[first])
        best[part], lowest[part] = first[scores.argmin(axis=1)], scores.min(axis=1)
    return best[row_of.ravel()], lowest[row_of.ravel()]


def candidate_argmin(
    rows: DataFrame,
    candidates: DataFrame,
    key: Sequence[str],
    clean: Sequence[str],
    corrupted: Sequence[str],
    scorers: dict[int, SplitScorer],
) -> DataFrame:
    """``(key, source, corrupted...)``: the candidate of the row's blocks with the lowest score.

    ``rows`` need ``block, lap, half`` and the clean columns, ``candidates`` need ``block,
    lap, source, candidate`` (together unique) and the corrupted columns. A key may have a line
    for each of several blocks. Equal scores go to the smaller (source, candidate). Rows of a
    block and lap without candidates are an error.
    """
    key, clean, corrupted = list(key), list(clean), list(corrupted)
    names = [*key, "source", *corrupted, "_candidate", "_score"]
    schema = T.StructType(
        [*[rows.schema[c] for c in key], T.StructField("source", candidates.schema["source"].dataType),
         *[T.StructField(c, T.DoubleType()) for c in corrupted],
         T.StructField("_candidate", candidates.schema["candidate"].dataType), T.StructField("_score", T.DoubleType())]
    )

    def values(df: pd.DataFrame, columns: list[str]) -> np.ndarray:
        return df[columns].to_numpy(dtype=float, na_value=np.nan)

    def choose(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty:
            return pd.DataFrame(columns=names)
        if right.empty:
            block, lap = left["block"].iloc[0], left["lap"].iloc[0]
            raise ValueError(f"{len(left)} rows without candidates in block {block}, lap {lap}")
        right = right.sort_values(["source", "candidate"], ignore_index=True)
        offered = values(right, corrupted)
        picked, lowest = np.empty(len(left), dtype=np.int64), np.empty(len(left))
        for half, scorer in scorers.items():
            mine = np.flatnonzero(left["half"].to_numpy() == half)
            if len(mine):
                known = np.nan_to_num(values(left.iloc[mine], clean), nan=MISSING)
                picked[mine], lowest[mine] = lowest_scores(scorer, known, np.nan_to_num(offered, nan=MISSING))
        out = left[key].copy()
        out["source"] = right["source"].to_numpy()[picked]
        for i, c in enumerate(corrupted):
            out[c] = offered[picked, i]
        out["_candidate"], out["_score"] = right["candidate"].to_numpy()[picked], lowest
        return out[names]

    left = rows.select("block", "lap", "half", *key, *clean)
    right = candidates.select("block", "lap", "source", "candidate", *corrupted)
    found = left.groupBy("block", "lap").cogroup(right.groupBy("block", "lap")).applyInPandas(choose, schema)
    order = F.struct("_score", "source", "_candidate")
    best = found.groupBy(*key).agg(F.min_by(F.struct("source", *corrupted), order).alias("_best"))
    return best.select(*key, "_best.*")
