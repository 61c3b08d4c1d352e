"""Hard negatives for anchors and their positives, by slots of scores.

The window of a positive reaches from a share of its score up to another share. For an anchor
the upper limits of its positives, in descending order, cut the scores into disjoint slots.
One pass over all rows keeps the best few rows of every slot; a window begins at the upper end
of a slot, so the best rows below its limit are the first ones of the slots from there on down,
and all the overlapping windows are answered from the same few rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from featshift.llm import tiles
from featshift.llm.tiles import Block, best, finite, integral, sweep
from featshift.storage import materialize


class Whole:
    """Vectors of one dimension as whole numbers, by label and id."""

    def __init__(self, at: np.ndarray, vectors: np.ndarray, block: Block):
        ids, labels = block.numbers("id")[at], block.numbers("label")[at]
        order = np.lexsort((ids, labels))
        self.at, self.ids, self.labels, self.x = at[order], ids[order], labels[order], vectors[order]
        self.most = float(np.abs(vectors).max())

    def scores(self, mine: slice, other: Whole, theirs: slice) -> np.ndarray:
        """Exact inner products, in the smallest type that holds them."""
        bound = self.most * other.most * self.x.shape[1]
        kind = np.float32 if bound < 2**24 else np.float64 if bound < 2**53 else np.int64
        return self.x[mine].astype(kind) @ other.x[theirs].astype(kind).T


def _whole(block: Block) -> tuple[Block, dict[int, Whole]]:
    return block, {dim: Whole(at, vectors, block) for dim, (at, vectors) in block.parts.items()}


def _steps(n: int, width: int) -> list[slice]:
    step = max(1, tiles.PAIRS // max(1, width))
    return [slice(a, a + step) for a in range(0, n, step)]


class _Kept:
    """Best rows so far of numbered groups, as ``(group, id, score)`` with a bound on what can still enter."""

    def __init__(self, groups: int, most: int):
        self.most = most
        self.least = np.full(groups, np.iinfo(np.int64).min)
        self.group, self.id, self.score = (np.zeros(0, dtype=np.int64) for _ in range(3))

    def add(self, group: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        if not len(group):
            return
        group, ids, scores = (np.concatenate(p) for p in ((self.group, group), (self.id, ids), (self.score, scores.astype(np.int64))))
        order = np.lexsort((ids, -scores, group))
        group, ids, scores = group[order], ids[order], scores[order]
        place = np.arange(len(group)) - np.searchsorted(group, group)
        keep = place < self.most
        self.group, self.id, self.score = group[keep], ids[keep], scores[keep]
        full = place == self.most - 1
        self.least[group[full]] = scores[full]


class Positives:
    """The best rows of the same label for each anchor of a block."""

    def __init__(self, anchors: tuple[Block, dict[int, Whole]], most: int):
        self.block, self.parts = anchors
        self.kept = _Kept(len(self.block.numbers("id")), most)

    def see(self, candidates: tuple[Block, dict[int, Whole]]) -> None:
        for dim in self.parts.keys() & candidates[1].keys():
            x, y = self.parts[dim], candidates[1][dim]
            for label in np.intersect1d(x.labels, y.labels).tolist():
                a, b = np.searchsorted(x.labels, [label, label + 1])
                c, d = np.searchsorted(y.labels, [label, label + 1])
                for part in _steps(b - a, d - c):
                    mine, ids = slice(a + part.start, min(b, a + part.stop)), y.ids[c:d]
                    scores = x.scores(mine, y, slice(c, d))
                    able = (scores >= self.kept.least[x.at[mine], None]) & (x.ids[mine, None] != ids)
                    row, col = best(scores, able, ids, self.kept.most)
                    self.kept.add(x.at[mine][row], ids[col], scores[row, col])

    def rows(self) -> pa.RecordBatch:
        ids = self.block.numbers("id")
        return pa.RecordBatch.from_arrays([pa.array(ids[self.kept.group]), pa.array(self.kept.id), pa.array(self.kept.score)], names=["anchor_id", "positive_id", "positive_score"])


class Slots:
    """The best rows of other labels in every slot of each anchor of a block."""

    def __init__(self, anchors: tuple[Block, dict[int, Whole]], most: int):
        self.block, self.parts = anchors
        limits, floors = self.block.columns["limits"].values, self.block.numbers("floor")
        counts = np.diff(limits.offsets.to_numpy())
        self.width = int(counts.max())
        # Column j of ``tops`` ends slot j; the last one ends below the lowest window.
        self.tops = np.repeat(floors[:, None] - 1, self.width + 1, axis=1)
        inside = np.arange(self.width) < counts[:, None]
        self.tops[:, :-1][inside] = limits.flatten().to_numpy()
        self.kept = _Kept(len(counts) * self.width, most)

    def see(self, candidates: tuple[Block, dict[int, Whole]]) -> None:
        for dim in self.parts.keys() & candidates[1].keys():
            x, y = self.parts[dim], candidates[1][dim]
            for mine in _steps(len(x.ids), len(y.ids)):
                at = x.at[mine]
                scores = x.scores(mine, y, slice(None))
                other = x.labels[mine, None] != y.labels
                for j in range(self.width):
                    group = at * self.width + j
                    low, top = np.maximum(self.tops[at, j + 1] + 1, self.kept.least[group]), self.tops[at, j]
                    able = other & (scores >= low[:, None]) & (scores <= top[:, None])
                    row, col = best(scores, able, y.ids, self.kept.most)
                    self.kept.add(group[row], y.ids[col], scores[row, col])

    def rows(self) -> pa.RecordBatch:
        ids = self.block.numbers("id")[self.kept.group // self.width]
        slot = (self.kept.group % self.width).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(slot), pa.array(self.kept.id), pa.array(self.kept.score)], names=["anchor_id", "slot", "negative_id", "negative_score"])


def hard_negatives(
    rows: DataFrame, anchors: Column, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label",
    scale: int = 256, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    A component x counts as floor(scale * x), a score is the inner product with the anchor;
    higher scores come first, ties by smaller id. ``anchors`` is a condition on ``vec_id``.
    The positives of an anchor are the first ``positives`` other rows of its label and
    dimension, the negatives of a positive the first ``negatives`` rows of another label with
    ``low * positive_score <= 100 * negative_score <= high * positive_score``.

    Ids and labels are whole numbers, the percentages at most 100. Rows whose id, label or
    vector is null, or whose vector is empty or holds a null or non-finite component, take no
    part, nor do vectors so large that 100 times a score might not fit a long (number of
    components times the square of the largest beyond 2^56). Rows that repeat an id are one
    vector; if they differ, the one with the smallest label and vector stands for it.
    """
    able = rows.select(integral(rows, vec_id).alias("id"), integral(rows, label).alias("label"), F.col(vector).cast("array<double>").alias("vec"))
    able = able.filter("id is not null and label is not null").filter(finite(F.col("vec")))
    able = able.withColumn("vec", F.transform("vec", lambda x: F.floor(x * scale).cast("double")))
    able = able.filter(F.size("vec") * F.pow(F.array_max(F.transform("vec", F.abs)), 2) <= 2.0**56)
    one = able.groupBy("id").agg(F.min(F.struct("label", "vec")).alias("s")).select("id", "s.*")
    chosen = one.withColumnRenamed("id", vec_id).filter(anchors).withColumnRenamed(vec_id, "id")

    found = sweep(chosen, one, _whole, lambda block: Positives(block, positives), "anchor_id long, positive_id long, positive_score long")
    by_anchor = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    found = found.withColumn("place", F.row_number().over(by_anchor)).filter(F.col("place") <= positives)
    # A window below zero is empty: its lower end would lie above its upper end.
    found = found.filter("positive_score >= 0").selectExpr("*", f"positive_score * {high} div 100 as top", f"(positive_score * {low} + 99) div 100 as floor")
    found = materialize(found.filter("floor <= top"), "positives")
    limits = found.groupBy("anchor_id").agg(F.sort_array(F.collect_set("top"), asc=False).alias("limits"), F.min("floor").alias("floor"))

    asked = chosen.join(limits.withColumnRenamed("anchor_id", "id").hint("merge"), "id")
    slots = sweep(asked, one, _whole, lambda block: Slots(block, negatives), "anchor_id long, slot int, negative_id long, negative_score long")
    by_slot = Window.partitionBy("anchor_id", "slot").orderBy(F.desc("negative_score"), "negative_id")
    slots = slots.withColumn("place", F.row_number().over(by_slot)).filter(F.col("place") <= negatives)
    # At most ``negatives`` rows for each of ``positives`` slots, from the highest slot down.
    merged = slots.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("slot", (-F.col("negative_score")).alias("down"), "negative_id"))).alias("all"))
    mine = F.filter("all", lambda e: (-e["down"] <= F.col("top")) & (-e["down"] >= F.col("floor")))
    out = found.join(merged.hint("merge"), "anchor_id").select("anchor_id", "positive_id", "positive_score", F.posexplode(F.slice(mine, 1, negatives)).alias("at", "e"))
    return out.select("anchor_id", "positive_id", (F.col("at") + 1).alias("rank"), F.col("e.negative_id").alias("negative_id"), "positive_score", (-F.col("e.down")).alias("negative_score"))
