"""Embedding near-duplicates within a label by spherical-cap filters.

A filter is the cap of all unit vectors whose product with a direction reaches ``alpha``.
The directions form a random product code: after a random rotation a vector is cut into two
blocks, and each pair of codewords is a direction. Because the product is a sum over the
blocks, all directions that a vector exceeds are listed from the sorted products of one
block, without trying the others. Vectors that share a filter are compared by sign bits and
then in double precision; a pair that shares several is counted in the first one only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featshift.llm.links import components
from featshift.storage import materialize

#: Most codewords in each of the two blocks; every rotation has the square of it as directions.
CODEWORDS = 1024
#: Filters that a pair at the least cosine shares on average where fewer codewords do, and random vectors tried for that.
SHARED, TRIED = 60, 400
ROTATIONS = 3
#: Caps begin at so many standard deviations of a random product, and at this product at most.
DEVIATIONS, HIGHEST_ALPHA = 3.7, 0.6
#: Least cosine that these caps find nearly all pairs for.
LEAST_COSINE = 0.9
#: A filter with more vectors is compared in pairs of parts of this size.
PART_ROWS = 1024
#: Members of small groups are held against so many followers at once, larger groups as a matrix.
FOLLOWERS = 8


def _directions(rng: np.random.Generator, dim: int, n: int) -> np.ndarray:
    words = rng.normal(size=(dim, n))
    return words / np.maximum(np.linalg.norm(words, axis=0), 1e-300)


class ProductCode:
    """The directions for vectors of one dimension, as many as pairs at ``cosine`` need to meet.

    In few dimensions caps are wide (``HIGHEST_ALPHA``) and hold a large share of all vectors,
    so fewer codewords give a pair as many common filters. The share is measured on random pairs.
    """

    def __init__(self, dim: int, cosine: float, seed: int = 17):
        rng = np.random.default_rng((seed, dim))
        self.cut = (dim + 1) // 2
        self.bound = min(DEVIATIONS / np.sqrt(dim), HIGHEST_ALPHA) * np.sqrt(1 + (dim > 1))
        self.codewords = self._enough(dim, cosine) if DEVIATIONS / np.sqrt(dim) > HIGHEST_ALPHA else CODEWORDS
        self.turns = []
        for _ in range(ROTATIONS):
            rotation = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
            self.turns.append((rotation, *(_directions(rng, n, self.codewords) for n in (self.cut, dim - self.cut))))

    def _enough(self, dim: int, cosine: float) -> int:
        rng = np.random.default_rng((18, dim))
        x, y = _directions(rng, dim, TRIED), rng.normal(size=(dim, TRIED))
        y -= (x * y).sum(axis=0) * x
        y = cosine * x + np.sqrt(1 - cosine**2) * y / np.maximum(np.linalg.norm(y, axis=0), 1e-300)
        words = np.concatenate([_directions(rng, n, TRIED) for n in (self.cut, dim - self.cut)])
        both = ((x.T @ words >= self.bound) & (y.T @ words >= self.bound)).mean()
        return int(np.clip(np.ceil(np.sqrt(SHARED / (ROTATIONS * both))), 8, CODEWORDS)) if both else CODEWORDS

    def decode(self, units: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """For each unit vector the sorted numbers of all directions it exceeds, and its sign bits."""
        parts: list[list[np.ndarray]] = [[] for _ in units]
        signs = []
        for turn, (rotation, one, two) in enumerate(self.turns):
            turned = units @ rotation
            signs.append(turned > 0)
            left, right = turned[:, : self.cut] @ one, turned[:, self.cut :] @ two
            order = np.argsort(-right, axis=1)
            down = np.take_along_axis(right, order, axis=1)
            for k in range(len(units)):
                able = np.flatnonzero(left[k] >= self.bound - down[k, 0])
                n = np.searchsorted(-down[k], left[k, able] - self.bound, side="right")
                a = np.repeat(able, n)
                b = order[k, np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)]
                parts[k].append(np.sort((turn * self.codewords + a) * self.codewords + b).astype(np.int32))
        return [np.concatenate(x) for x in parts], np.packbits(np.concatenate(signs, axis=1), axis=1)


def most_signs(n_bits: np.ndarray, cosine: float) -> np.ndarray:
    """Differing sign bits that a pair at ``cosine`` stays within, by seven standard deviations."""
    p = np.arccos(cosine) / np.pi
    return n_bits * p + 7 * np.sqrt(n_bits * p * (1 - p))


def _vectors(rows: DataFrame) -> DataFrame:
    """``(id, label, dim, fp, vec)`` of the rows that can link; ``vec`` packs doubles."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, dims, prints, packed = [], [], [], []
            for k, (label, v) in enumerate(zip(batch.column("label").to_pylist(), batch.column("vec").to_pylist(), strict=True)):
                x = np.array([np.nan if c is None else c for c in v], dtype=np.float64)
                if len(x) and np.isfinite(x).all() and x.any():
                    x = x + 0.0  # one zero
                    kept.append(k)
                    dims.append(len(x))
                    packed.append(x.tobytes())
                    prints.append(hashlib.sha256(f"{label}:".encode() + packed[-1]).hexdigest())
            at = pa.array(kept, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(at), batch.column("label").cast(pa.string()).take(at), pa.array(dims, pa.int32()), pa.array(prints, pa.string()), pa.array(packed, pa.binary())],
                names=["id", "label", "dim", "fp", "vec"],
            )

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(task, f"id {kind}, label string, dim int, fp string, vec binary")


def _filters(nodes: DataFrame, cosine: float) -> DataFrame:
    """``(id, filters, signs)``: the directions each vector exceeds, in order, and its packed sign bits."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[int, ProductCode] = {}
        for whole in batches:
            for batch in (whole.slice(k, 512) for k in range(0, whole.num_rows, 512)):
                dims = batch.column("dim").to_numpy()
                for dim in np.unique(dims).tolist():
                    at = np.flatnonzero(dims == dim)
                    code = codes.get(dim) or codes.setdefault(dim, ProductCode(dim, cosine))
                    x = np.stack([np.frombuffer(batch.column("vec")[int(k)].as_py()) for k in at])
                    x = x / np.abs(x).max(axis=1, keepdims=True)
                    found, signs = code.decode(x / np.linalg.norm(x, axis=1, keepdims=True))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("id").take(pa.array(at)), pa.array(found, pa.list_(pa.int32())), pa.array([s.tobytes() for s in signs], pa.binary())], names=["id", "filters", "signs"]
                    )

    return nodes.mapInArrow(task, f"id {nodes.schema['id'].dataType.simpleString()}, filters array<int>, signs binary")


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Sorted input in tables that end with a group of equal keys, and where each group begins (and the end)."""
    left: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        values = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in keys])
        changes = np.flatnonzero((values[:, 1:] != values[:, :-1]).any(axis=0)) + 1
        if left and any(left[-1].column(k)[left[-1].num_rows - 1].as_py() != batch.column(k)[0].as_py() for k in keys):
            yield _with_starts(left, keys)
            left = []
        if len(changes):
            yield _with_starts([*left, batch.slice(0, changes[-1])], keys)
            left = [batch.slice(changes[-1])]
        else:
            left.append(batch)
    if left:
        yield _with_starts(left, keys)


def _with_starts(batches: list[pa.RecordBatch], keys: list[str]) -> tuple[pa.Table, np.ndarray]:
    table = pa.Table.from_batches(batches).combine_chunks()
    values = np.stack([table.column(k).to_numpy() for k in keys])
    return table, np.concatenate(([0], np.flatnonzero((values[:, 1:] != values[:, :-1]).any(axis=0)) + 1, [table.num_rows]))


def _plausible(parts: DataFrame, cosine: float, keys: list[str]) -> DataFrame:
    """The rows that have a partner in their group whose sign bits are alike enough."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in _whole_groups(batches, keys):
            bits = 8 * np.frombuffer("".join(map(chr, map(len, table.column("signs").to_pylist()))).encode("latin-1"), dtype=np.uint8).astype(np.int64)
            width = int(bits.max()) // 8
            signs = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in table.column("signs").to_pylist()), dtype=np.uint8).reshape(-1, width)
            most = most_signs(bits, cosine)
            sizes = np.diff(starts)
            group = np.repeat(np.arange(len(sizes)), sizes)
            keep = np.zeros(table.num_rows, dtype=bool)
            small = sizes[group] <= FOLLOWERS + 1
            for step in range(1, FOLLOWERS + 1):
                a = np.flatnonzero((group[:-step] == group[step:]) & small[:-step]) if step < len(group) else np.zeros(0, dtype=int)
                near = a[np.bitwise_count(signs[a] ^ signs[a + step]).sum(axis=1, dtype=np.int64) <= most[a]]
                keep[near] = keep[near + step] = True
            for g in np.flatnonzero(sizes > FOLLOWERS + 1):
                at = slice(starts[g], starts[g + 1])
                x = np.unpackbits(signs[at], axis=1).astype(np.float32) * 2 - 1
                alike = (x.shape[1] - x @ x.T) / 2 <= most[at][:, None]
                np.fill_diagonal(alike, False)
                keep[at] = alike.any(axis=1)
            yield from table.filter(pa.array(keep)).drop_columns(["signs"]).to_batches()

    return parts.mapInArrow(task, parts.drop("signs").schema)


def _smallest_reached(linked: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Smallest id in each row's component of a symmetric boolean matrix."""
    low = ids.copy()
    while True:
        new = low.copy()
        for k in range(len(ids)):
            near = low[linked[k]]
            if len(near):
                new[k] = min(new[k], near.min())
        if (new == low).all():
            return low
        low = new


def _compare(parts: DataFrame, cosine: float, keys: list[str]) -> DataFrame:
    """``(id, low, n)``: per compared part, linked weight of each vector and the smallest id it reaches there."""
    kind = parts.schema["id"].dataType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in (t.slice(a, b - a) for t, starts in _whole_groups(batches, keys) for a, b in zip(starts[:-1], starts[1:], strict=True)):
            x = np.stack([np.frombuffer(v) for v in group.column("vec").to_pylist()])
            x = x / np.abs(x).max(axis=1, keepdims=True)
            norms = np.linalg.norm(x, axis=1)
            linked = x @ x.T >= cosine * np.outer(norms, norms)
            linked[np.arange(len(x)), np.arange(len(x))] = False
            part = group.column("part").to_numpy()
            if group.column("p1")[0].as_py() != group.column("p2")[0].as_py():
                linked &= part[:, None] != part[None, :]
            some = np.flatnonzero(linked.any(axis=1))
            if not len(some):
                continue
            linked = linked[np.ix_(some, some)]
            ids, weights = group.column("id").to_numpy()[some], group.column("weight").to_numpy()[some]
            # A pair counts in its first common filter: no smaller one may hold both.
            here = group.column("filter")[0].as_py()
            lists = [f[: np.searchsorted(f, here)] for f in (np.asarray(v) for v in group.column("filters").take(pa.array(some)).to_pylist())]
            seen, at = np.unique(np.concatenate(lists), return_inverse=True) if sum(map(len, lists)) else (np.zeros(0), np.zeros(0, dtype=int))
            member = np.zeros((len(some), len(seen)), dtype=np.float32)
            member[np.repeat(np.arange(len(some)), [len(f) for f in lists]), at] = 1
            first = linked & (member @ member.T == 0)
            yield pa.RecordBatch.from_pydict({"id": ids, "low": _smallest_reached(linked, ids), "n": (first @ weights).astype(np.int64)})

    return parts.mapInArrow(task, f"id {kind}, low {kind}, n long")


def cosine_groups(rows: DataFrame, cosine: float = 0.93, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row.

    Vectors of equal label and dimension link at a cosine of at least ``cosine``. Rows whose
    label, id or vector is null, or whose vector is empty, zero or holds a null or non-finite
    component, link with nothing. Rows that repeat an id are one vector; if they differ, the
    one with the smallest label and vector stands for it. A ``cosine`` below 0.9 is refused.
    """
    if cosine < LEAST_COSINE:
        raise ValueError(f"the caps are laid out for a cosine from {LEAST_COSINE} on")
    base = rows.select(F.col(vec_id).alias("id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("vec"))
    able = base.filter("id is not null and label is not null and vec is not null").groupBy("id").agg(F.min(F.struct("label", "vec")).alias("s")).select("id", "s.*")
    every = materialize(_vectors(able), "vectors")
    same = every.groupBy("fp").agg(F.min("id").alias("rep"), F.count("*").alias("weight"))
    node = every.join(same.select(F.col("rep").alias("id"), "weight").hint("merge"), "id").select("id", "label", "dim", "vec", "weight")
    node = materialize(node, "vectors")
    found = materialize(_filters(node, cosine), "filters")

    shelf = found.join(node.select("id", "label", "dim").hint("merge"), "id").select("id", "label", "dim", "signs", F.explode("filters").alias("filter"))
    shelf = shelf.select("id", F.xxhash64("label", "dim", "filter").alias("bucket"), "filter", "signs")
    sizes = shelf.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1").select("bucket", F.ceil(F.col("n") / PART_ROWS).cast("int").alias("n_parts"))
    met = shelf.join(sizes.hint("merge"), "bucket").withColumn("part", F.pmod(F.xxhash64("id"), F.col("n_parts")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_parts") - 1)))
    met = met.select("id", "bucket", "filter", "part", F.least("part", "other").alias("p1"), F.greatest("part", "other").alias("p2"), "signs")
    keys = ["bucket", "p1", "p2"]
    # Sign bits first: vectors travel only to filters where they have a plausible partner.
    met = materialize(_plausible(met.repartition(*keys).sortWithinPartitions(*keys), cosine, keys), "filters")
    full = met.join(node.select("id", "vec", "weight").hint("merge"), "id").join(found.select("id", "filters").hint("merge"), "id")
    parts = full.repartition(*keys).sortWithinPartitions(*keys)
    near = materialize(_compare(parts, cosine, keys), "links")

    counts = near.groupBy("id").agg(F.sum("n").alias("n"))
    copies = every.join(same.hint("merge"), "fp").select("id", "rep", "weight")
    comp = components(near.select(F.col("id").alias("u"), F.col("low").alias("v")).unionByName(copies.select(F.col("id").alias("u"), F.col("rep").alias("v"))))
    linked = copies.join(counts.withColumnRenamed("id", "rep").hint("merge"), "rep", "left")
    linked = linked.select("id", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    out = base.select("id").join(linked.hint("merge"), "id", "left").join(comp.select(F.col("node").alias("id"), "component").hint("merge"), "id", "left")
    own = F.coalesce("component", "id")
    return out.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), (own.isNull() | (own == F.col("id"))).alias("kept"))
