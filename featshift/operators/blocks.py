"""Distance joins without comparing all pairs.

Points are put into small blocks: every point goes to its nearest pivot (a seeded
choice of points, so dense regions get more pivots) and, where a pivot has many
points, to a ring of equal distance around it. The triangle inequality bounds the
distance from any query point to a whole block, so a query point visits only blocks
that can matter and whole blocks can be counted without a visit.

Blocks that lie together share a piece of work, so a query point that visits several
of them is sent once, with a mark for each. A piece much in demand is copied
(``salt``) and an over-full block is cut into parts (``part``), so no task holds more
than a bounded number of rows from either side. What the driver holds is the pivots
and one row per block (and tag), bounded by ``MAX_PIVOTS``, ``MAX_BLOCKS`` and
``MAX_BLOCK_TAGS``.

Tables have the columns ``id`` (integer or text), ``vec`` (array<double>) and
whatever else the caller wants to carry along.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featshift.functions.hashing import seeded_hash
from featshift.storage import materialize

MAX_PIVOTS = 1024
MAX_BLOCKS = 32768
MAX_TAGS = 1000
MAX_BLOCK_TAGS = 1_000_000
PIVOT_ROWS = 512
BLOCK_ROWS = 2048
TASK_ROWS = 8192
MARKS = 62
NEAR_ROWS = 4096
#: Rows found in a piece before they are thinned out.
FOUND_ROWS = 500_000
LOW_DIMENSION = 8
#: In low dimension the first blocks are looked for around so many pivots.
NEAR_PIVOTS = 8
_CELLS = 1_000_000
_ROW_CELLS = 4_000_000


def matrix(vectors: pd.Series) -> np.ndarray:
    return np.vstack(vectors.to_numpy()).astype(float)


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Fast squared distances; exact up to ``rounding_slack``."""
    d2 = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T)
    return np.maximum(d2, 0.0, out=d2)


def rounding_slack(a: np.ndarray, b: np.ndarray) -> float:
    return 1e-12 * float((a * a).sum(1).max(initial=0.0) + (b * b).sum(1).max(initial=0.0))


def exact_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-by-row distances from plain differences."""
    return np.sqrt(((a - b) ** 2).sum(axis=1))


def paired_distances(a: np.ndarray, b: np.ndarray, r: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Exact distances of rows ``r`` of a and ``s`` of b; copies of the rows are held a slice at a time."""
    d = np.empty(len(r))
    for part in row_slices(len(r), a.shape[1]):
        d[part] = exact_distances(a[r[part]], b[s[part]])
    return d


def row_slices(n_rows: int, width: int, cells: int = _CELLS) -> Iterator[slice]:
    """Slices of rows so that rows x width stays within ``cells``."""
    step = max(1, cells // max(1, width))
    for start in range(0, n_rows, step):
        yield slice(start, min(n_rows, start + step))


@dataclass(frozen=True)
class Bounds:
    """Distances from a batch of query points to the pivots, and bounds for every block where they are asked for."""

    to_pivots: np.ndarray
    slack: float
    map: BlockMap

    @cached_property
    def low(self) -> np.ndarray:
        m, near = self.map, self.to_pivots[:, self.map.pivot_of]
        return np.maximum(0.0, np.maximum(near - m.outer, m.inner - near))

    @cached_property
    def high(self) -> np.ndarray:
        # A ring without points bounds nothing from above.
        return np.where(self.map.count > 0, self.to_pivots[:, self.map.pivot_of] + self.map.outer, np.inf)

    def of(self, rows: np.ndarray) -> Bounds:
        return Bounds(self.to_pivots[rows], self.slack, self.map)


@dataclass(frozen=True)
class BlockMap:
    """The small description of the blocks that every task receives."""

    pivots: np.ndarray
    pivot_ids: list
    pivot_of: np.ndarray
    inner: np.ndarray
    outer: np.ndarray
    count: np.ndarray
    tag_count: np.ndarray
    tags: list = field(default_factory=list)

    @property
    def centre(self) -> np.ndarray:
        return self.pivots.mean(axis=0)

    def bounds(self, points: np.ndarray) -> Bounds:
        a, b = points - self.centre, self.pivots - self.centre
        # The square root of a rounding error is much larger than the error itself.
        slack = math.sqrt(rounding_slack(a, b))
        return Bounds(np.sqrt(squared_distances(a, b)), slack, self)

    @cached_property
    def rings(self) -> tuple[np.ndarray, np.ndarray]:
        """The first block and the number of blocks of every pivot; they follow each other."""
        size = np.bincount(self.pivot_of, minlength=len(self.pivots))
        first = np.zeros(len(self.pivots), dtype=np.int64)
        first[self.pivot_of[::-1]] = np.arange(len(self.pivot_of))[::-1]
        return first, size

    @cached_property
    def reaches(self) -> tuple[np.ndarray, np.ndarray]:
        """The innermost and the outermost distance of a pivot's points; of one without points none is near."""
        inner, outer = np.full(len(self.pivots), np.inf), np.full(len(self.pivots), -np.inf)
        held = self.count > 0
        np.minimum.at(inner, self.pivot_of[held], self.inner[held])
        np.maximum.at(outer, self.pivot_of[held], self.outer[held])
        return inner, outer

    def few_rings(self) -> bool:
        """Whether the blocks of some near pivots are far fewer than all: in low dimension, with pivots of like sizes."""
        return self.pivots.shape[1] <= LOW_DIMENSION and 4 * NEAR_PIVOTS * int(self.rings[1].max(initial=0)) < len(self.pivot_of)


@dataclass(frozen=True)
class BlockIndex:
    """``points`` carry their ``block``; they are stored in the shared folder."""

    points: DataFrame
    map: BlockMap
    dim: int
    n: int


def non_finite() -> Column:
    """How many vectors are missing or hold NULL, NaN or an infinity; no distance to them can be compared."""
    held = F.forall("vec", lambda v: F.coalesce(F.abs(v) < float("inf"), F.lit(False)))
    return F.count_if(~F.coalesce(held, F.lit(False)))


def require_finite(n: int, what: str) -> None:
    if n:
        raise ValueError(f"{n} {what} have missing or non-finite values; fill or drop them first")


def check_dimension(*tables: DataFrame) -> int:
    """The common vector length of all tables; raises when lengths differ."""
    seen: set[int] = set()
    for df in tables:
        row = df.agg(F.min(F.size("vec")).alias("lo"), F.max(F.size("vec")).alias("hi")).first()
        seen |= {row["lo"], row["hi"]} - {None}
    if len(seen) != 1:
        raise ValueError(f"vectors must all have the same length, found {sorted(seen)}")
    return seen.pop()


def require_dimension(queries: DataFrame, dim: int) -> None:
    found = queries.agg(
        F.min(F.size("vec")).alias("lo"), F.max(F.size("vec")).alias("hi"), non_finite().alias("gaps")
    ).first()
    require_finite(found["gaps"], "query vectors")
    if {found["lo"], found["hi"]} - {dim, None}:
        raise ValueError(f"query vectors have length {found['lo']} to {found['hi']}, points {dim}")


def fold_copies(points: DataFrame, tag: str | None = None) -> DataFrame:
    """One row per distinct (vector, tag): smallest ``id`` and ``weight`` = number of copies."""
    keys = ["vec", tag] if tag else ["vec"]
    return points.groupBy(*keys).agg(F.min("id").alias("id"), F.count("*").alias("weight"))


def first_copies(points: DataFrame, n: int) -> DataFrame:
    """Of identical vectors the ``n`` with the smallest id; more can never be among n neighbours."""
    order = W.partitionBy("vec").orderBy("id")
    return points.withColumn("_copy", F.row_number().over(order)).filter(F.col("_copy") <= n).drop("_copy")


def near_order(pivots: np.ndarray) -> np.ndarray:
    """The pivots' numbers, neighbours side by side: halved along the widest dimension again and again."""
    pieces, done = [np.arange(len(pivots))], []
    while pieces:
        piece = pieces.pop()
        if len(piece) <= 2:
            done.append(piece)
            continue
        x = pivots[piece]
        piece = piece[np.argsort(x[:, np.ptp(x, axis=0).argmax()], kind="stable")]
        pieces += [piece[len(piece) // 2 :], piece[: len(piece) // 2]]
    return np.concatenate(done)


def build_index(points: DataFrame, tag: str | None = None, seed: int | str = 0) -> BlockIndex:
    """Assign every point to a block and collect the block map.

    ``tag`` names a column of few values; the map then holds, per block, the summed
    ``weight`` (or row count) of every tag.
    """
    spark = points.sparkSession
    # Read several times below; what it took to make it is paid once.
    points = materialize(points, "points")
    size = points.agg(
        F.count("*").alias("n"), F.min(F.size("vec")).alias("lo"), F.max(F.size("vec")).alias("hi"),
        (F.count_distinct(tag) if tag else F.lit(1)).alias("tags"),
        non_finite().alias("gaps"),
    ).first()
    require_finite(size["gaps"], "vectors")
    n, dim = size["n"], size["lo"]
    if n == 0 or dim != size["hi"]:
        raise ValueError("points must exist and have vectors of one length")
    if size["tags"] > MAX_TAGS:
        raise ValueError(f"{tag!r} has {size['tags']} values; at most {MAX_TAGS} classes or folds are supported")
    most_blocks = min(MAX_BLOCKS, MAX_BLOCK_TAGS // max(1, size["tags"]))
    n_pivots = min(MAX_PIVOTS, most_blocks, max(1, math.ceil(n / PIVOT_ROWS)))
    chosen = points.select("id", "vec").orderBy(seeded_hash(seed, "id"), "id").limit(n_pivots).collect()
    pivots = np.array([row["vec"] for row in chosen], dtype=float)
    centre = pivots.mean(axis=0)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = matrix(batch["vec"])
            cell, radius = np.empty(len(x), dtype=np.int32), np.empty(len(x))
            for rows in row_slices(len(x), len(pivots)):
                cell[rows] = squared_distances(x[rows] - centre, pivots - centre).argmin(axis=1)
                radius[rows] = exact_distances(x[rows], pivots[cell[rows]])
            yield batch.assign(cell=cell, radius=radius)

    schema = T.StructType(
        [*points.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("radius", T.DoubleType())]
    )
    assigned = materialize(points.mapInPandas(assign, schema), "blocks")

    block_rows = max(BLOCK_ROWS, math.ceil(n / most_blocks))
    cells = assigned.groupBy("cell").agg(
        F.count("*").alias("n"), F.min("radius").alias("lo"), F.max("radius").alias("hi")
    ).orderBy("cell").collect()
    rows, first = [], 0
    place = np.empty(len(pivots), dtype=np.int64)
    place[near_order(pivots)] = np.arange(len(pivots))
    # Neighbouring cells get neighbouring blocks.
    for c in sorted(cells, key=lambda c: place[c["cell"]]):
        rings = math.ceil(c["n"] / block_rows) if c["hi"] > c["lo"] else 1
        rows.append((c["cell"], first, rings, c["lo"], c["hi"] - c["lo"]))
        first += rings
    rings = spark.createDataFrame(rows, "cell int, _first int, _rings int, _lo double, _span double")
    ring = F.when(F.col("_rings") == 1, 0).otherwise(
        F.least(F.col("_rings") - 1, F.floor((F.col("radius") - F.col("_lo")) / F.col("_span") * F.col("_rings")))
    )
    # At most MAX_PIVOTS rows are broadcast.
    placed = assigned.join(F.broadcast(rings), "cell").withColumn("block", (F.col("_first") + ring).cast("int"))
    placed = placed.drop("_first", "_rings", "_lo", "_span")
    weight = F.sum("weight") if "weight" in points.columns else F.count("*")
    keys = ["block", tag] if tag else ["block"]
    stats = placed.groupBy(*keys).agg(
        F.first("cell").alias("cell"), F.count("*").alias("n"), weight.alias("w"),
        F.min("radius").alias("lo"), F.max("radius").alias("hi"),
    ).collect()
    tags = sorted({s[tag] for s in stats}) if tag else []
    column = {t: i for i, t in enumerate(tags)}
    count = np.zeros(first, dtype=np.int64)
    tag_count = np.zeros((first, max(1, len(tags))), dtype=np.int64)
    inner, outer, pivot_of = np.full(first, np.inf), np.zeros(first), np.zeros(first, dtype=np.int64)
    for s in stats:
        b = s["block"]
        count[b] += s["n"]
        tag_count[b, column[s[tag]] if tag else 0] += s["w"]
        inner[b], outer[b], pivot_of[b] = min(inner[b], s["lo"]), max(outer[b], s["hi"]), s["cell"]
    block_map = BlockMap(pivots, [row["id"] for row in chosen], pivot_of, inner, outer, count, tag_count, tags)
    return BlockIndex(placed.drop("cell", "radius"), block_map, dim, n)


VisitRule = Callable[[BlockMap, Bounds, pd.DataFrame], np.ndarray]
BlockJoin = Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]


def share_pieces(count: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Piece of every block and its mark there: up to ``MARKS`` blocks in a row with up to ``rows`` points."""
    piece, mark = np.empty(len(count), dtype=np.int32), np.empty(len(count), dtype=np.int32)
    at, marks, held = 0, 0, 0
    for b, n in enumerate(count):
        if marks and (marks == MARKS or held + n > rows):
            at, marks, held = at + 1, 0, 0
        piece[b], mark[b] = at, marks
        marks, held = marks + 1, held + n
    return piece, mark


def visit_blocks(
    index: BlockIndex, queries: DataFrame, rule: VisitRule, join: BlockJoin, schema: str | T.StructType,
    width: int = 1, after: Callable[[pd.DataFrame], pd.DataFrame] | None = None,
) -> DataFrame:
    """Send every query point to the blocks ``rule`` marks and join it with their points.

    ``rule`` returns a (rows, blocks) mask; ``join`` sees bounded pieces of both sides
    and must only return what survives inside its piece. Every query point meets every
    block it marks once. ``width`` is how many numbers ``join`` holds for a row; ``after``
    may thin out what was found in a piece. The marks are stored and counted, so that
    pieces in demand are salted before the shuffle.
    """
    spark, block_map = queries.sparkSession, index.map
    rows = min(4 * TASK_ROWS, max(TASK_ROWS // 4, index.n // 16), max(1, _ROW_CELLS // max(index.dim, width)))
    piece, mark = share_pieces(block_map.count, rows)
    shared = spark.sparkContext.broadcast((block_map, piece, mark))

    def marked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, piece_of, mark_of = shared.value
        bit = np.left_shift(np.int64(1), mark_of.astype(np.int64))
        for batch in batches:
            x = matrix(batch["vec"])
            pieces, bits = np.empty(len(x), dtype=object), np.empty(len(x), dtype=object)
            for part in row_slices(len(x), max(len(m.pivot_of), len(m.pivots))):
                mask = rule(m, m.bounds(x[part]), batch.iloc[part])
                r, b = np.nonzero(mask & (m.count > 0)[None, :])
                # Blocks are numbered along the pieces, so the marks of a row and piece follow each other.
                start = np.flatnonzero(np.diff(r * len(piece_of) + piece_of[b], prepend=-1))
                joint = np.bitwise_or.reduceat(bit[b], start) if len(start) else bit[:0]
                ends = np.searchsorted(r[start], np.arange(part.stop - part.start + 1))
                for i in range(part.stop - part.start):
                    pieces[part.start + i] = piece_of[b[start[ends[i] : ends[i + 1]]]]
                    bits[part.start + i] = joint[ends[i] : ends[i + 1]]
            yield batch.assign(_pieces=pieces, _bits=bits)

    marks = [T.StructField("_pieces", T.ArrayType(T.IntegerType())), T.StructField("_bits", T.ArrayType(T.LongType()))]
    visits = materialize(queries.mapInPandas(marked, T.StructType([*queries.schema.fields, *marks])), "visits")
    wanted = visits.select(F.explode("_pieces").alias("piece")).groupBy("piece").count().collect()
    salts = np.zeros(len(piece) + 1, dtype=np.int64)
    for v in wanted:
        salts[v["piece"]] = math.ceil(v["count"] / rows)
    parts = np.maximum(1, np.ceil(np.bincount(piece, block_map.count) / rows)).astype(np.int64)

    # One row per piece and one per block, at most MAX_BLOCKS + MAX_PIVOTS.
    spread = F.broadcast(spark.createDataFrame(
        [(i, int(salts[i]), int(n)) for i, n in enumerate(parts)], "piece int, _salts int, _parts int"
    ))
    plan = F.broadcast(spark.createDataFrame(
        [(b, int(p), int(mark[b]), int(salts[p]), int(parts[p])) for b, p in enumerate(piece) if salts[p]],
        "block int, piece int, _mark int, _salts int, _parts int",
    ))
    sent = (
        visits.select(*queries.columns, F.inline(F.arrays_zip(F.col("_pieces").alias("piece"), F.col("_bits").alias("_bits"))))
        .join(spread, "piece")
        .withColumn("salt", F.pmod(F.xxhash64("id"), F.col("_salts")).cast("int"))
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
        .drop("_salts", "_parts")
    )
    kept = (
        index.points.join(plan, "block")
        .withColumn("part", F.pmod(F.xxhash64("id"), F.col("_parts")).cast("int"))
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)))
        .drop("_salts", "_parts")
    )
    keys = ["piece", "salt", "part"]

    def piecewise(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return join(left.iloc[:0], right.iloc[:0])
        bits, at = left["_bits"].to_numpy(), right["_mark"].to_numpy().astype(np.int64)
        alike, here = np.unique(bits), np.unique(at)
        # Rows that mark the same blocks go together, or else block by block.
        if len(alike) <= len(here):
            meet = ((bits == m, (m >> at) & 1 == 1) for m in alike)
        else:
            meet = (((bits >> m) & 1 == 1, at == m) for m in here)
        found, held, most = [], 0, FOUND_ROWS
        for a, b in meet:
            if not (a.any() and b.any()):
                continue
            found.append(join(left[a], right[b]))
            held += len(found[-1])
            # What is found block by block is thinned out on the way, or it would grow with the number of blocks.
            if after and held > most:
                found = [after(pd.concat(found, ignore_index=True))]
                held = len(found[0])
                most = max(FOUND_ROWS, 2 * held)
        found = [f for f in found if len(f)]
        if not found:
            return join(left.iloc[:0], right.iloc[:0])
        out = pd.concat(found, ignore_index=True) if len(found) > 1 else found[0]
        return after(out) if after else out

    return sent.groupBy(*keys).cogroup(kept.groupBy(*keys)).applyInPandas(piecewise, schema)


# --- nearest neighbours ------------------------------------------------------------


def _field(df: DataFrame, name: str, as_name: str) -> T.StructField:
    return T.StructField(as_name, df.schema[name].dataType)


def knn_join(
    queries: DataFrame, points: DataFrame, k: int, exclude_self: bool = False, carry: Sequence[str] = (), seed: int | str = 0
) -> DataFrame:
    """Exact k nearest points of every query point: ``(id, neighbour, rank, distance, carry...)``.

    Equal distances go to the smaller point id. ``exclude_self`` skips the point with
    the query's own id. ``carry`` names point columns to return with each neighbour.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    need = k + 1 if exclude_self else k
    index = build_index(first_copies(points.select("id", "vec", *carry), need), seed=seed)
    # The visits are counted in one pass and sent in another.
    queries = materialize(queries.select("id", "vec"), "queries")
    require_dimension(queries, index.dim)

    names = ["id", "neighbour", "distance", *carry]
    schema = T.StructType(
        [_field(queries, "id", "id"), _field(points, "id", "neighbour"), T.StructField("distance", T.DoubleType()),
         *[points.schema[c] for c in carry]]
    )

    def nearest(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty:
            return pd.DataFrame(columns=names)
        reach = left["reach"].to_numpy() if "reach" in left.columns else None
        r, s, d = nearest_in_piece(left, right, k, exclude_self, reach)
        out = {"id": left["id"].to_numpy()[r], "neighbour": right["id"].to_numpy()[s], "distance": d}
        out.update({c: right[c].to_numpy()[s] for c in carry})
        return pd.DataFrame(out, columns=names)

    def nearest_of_piece(found: pd.DataFrame) -> pd.DataFrame:
        found = found.sort_values(["id", "distance", "neighbour"], ignore_index=True)
        return found[found.groupby("id", dropna=False).cumcount() < k]

    order = W.partitionBy("id").orderBy("distance", "neighbour")

    def best(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    # The nearest blocks first: the k-th distance there bounds what the other blocks have to beat.
    # In high dimension distances are much alike, and only many points give a bound that tells them apart.
    first = need if index.dim <= LOW_DIMENSION else max(need, min(NEAR_ROWS, index.n // 16))
    near = materialize(
        best(visit_blocks(index, queries, lambda m, at, _: first_blocks(m, at, first), nearest, schema, after=nearest_of_piece)), "near"
    )
    reach = near.filter(F.col("rank") == k).select("id", F.col("distance").alias("reach"))
    bounded = materialize(queries.join(reach, "id", "left").withColumn("reach", F.coalesce("reach", F.lit(float("inf")))), "queries")
    far = visit_blocks(index, bounded, lambda m, at, q: other_blocks(m, at, need, q["reach"].to_numpy(), first), nearest, schema, after=nearest_of_piece)
    return best(near.drop("rank").unionByName(far))


def first_blocks(m: BlockMap, at: Bounds, need: int) -> np.ndarray:
    """Mask of the blocks nearest to each query point that hold ``need`` points together.

    Where a few pivots near the point hold as many, only their blocks are looked at.
    """
    if not m.few_rings():
        return _first_of(at.low, at.high, m.count, need)
    first, size = m.rings
    near = np.argpartition(at.to_pivots, NEAR_PIVOTS - 1, axis=1)[:, :NEAR_PIVOTS]
    ring = np.arange(size.max())
    block = np.where(ring < size[near][:, :, None], first[near][:, :, None] + ring, -1).reshape(len(near), -1)
    d = np.repeat(np.take_along_axis(at.to_pivots, near, axis=1), len(ring), axis=1)
    count = np.where(block >= 0, m.count[block], 0)
    low = np.maximum(0.0, np.maximum(d - m.outer[block], m.inner[block] - d))
    chosen = _first_of(low, np.where(count > 0, d + m.outer[block], np.inf), count, need)
    mask = np.zeros((len(near), len(m.count)), dtype=bool)
    rows, columns = np.nonzero(chosen)
    mask[rows, block[rows, columns]] = True
    short = np.flatnonzero(count.sum(axis=1) < need)
    if len(short):
        rest = at.of(short)
        mask[short] = _first_of(rest.low, rest.high, m.count, need)
    return mask


def _first_of(low: np.ndarray, high: np.ndarray, count: np.ndarray, need: int) -> np.ndarray:
    """Of blocks with these bounds the nearest ones that hold ``need`` points; ``count`` for all rows or each."""
    count = np.broadcast_to(count, low.shape)
    low = np.where(count > 0, low, np.inf)
    mask = np.zeros(low.shape, dtype=bool)
    short, rows = np.full(len(low), need), np.arange(len(low))
    while len(rows):
        left = low[rows]
        nearest = left.min(axis=1)
        block = np.where(left <= nearest[:, None], high[rows], np.inf).argmin(axis=1)
        rows, block = rows[nearest < np.inf], block[nearest < np.inf]
        mask[rows, block], low[rows, block] = True, np.inf
        short[rows] -= count[rows, block]
        rows = rows[short[rows] > 0]
    return mask


def other_blocks(m: BlockMap, at: Bounds, need: int, reach: np.ndarray, first: int | None = None) -> np.ndarray:
    """Mask of the blocks not among the first ones that can hold a point within ``reach`` and within the pivots' bounds."""
    if at.to_pivots.shape[1] >= need:
        reach = np.minimum(reach, np.partition(at.to_pivots, need - 1, axis=1)[:, need - 1])
    return _within(m, at, reach * (1 + 1e-9) + 2 * at.slack) & ~first_blocks(m, at, first or need)


def _within(m: BlockMap, at: Bounds, reach: np.ndarray) -> np.ndarray:
    """Mask of the blocks that can hold a point within ``reach``; in low dimension those of far pivots are not looked at."""
    if not m.few_rings():
        return at.low <= reach[:, None]
    inner, outer = m.reaches
    row, pivot = np.nonzero((at.to_pivots - outer <= reach[:, None]) & (inner - at.to_pivots <= reach[:, None]))
    first, size = m.rings
    n = size[pivot]
    row, d = np.repeat(row, n), np.repeat(at.to_pivots[row, pivot], n)
    block = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[pivot], n)
    hit = np.maximum(d - m.outer[block], m.inner[block] - d) <= reach[row]
    mask = np.zeros((len(reach), len(m.count)), dtype=bool)
    mask[row[hit], block[hit]] = True
    return mask


def nearest_in_piece(
    left: pd.DataFrame, right: pd.DataFrame, k: int, exclude_self: bool, reach: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers of left, of right, and distances of the k nearest inside one piece, none farther than ``reach``."""
    a, b = matrix(left["vec"]), matrix(right["vec"])
    centre = b.mean(axis=0)
    slack = rounding_slack(a - centre, b - centre)
    ids = right["id"].to_numpy()
    id_order = np.empty(len(ids), dtype=np.int64)
    id_order[np.argsort(ids, kind="stable")] = np.arange(len(ids))
    own = pd.Index(ids).get_indexer(left["id"].to_numpy()) if exclude_self else None
    out_r, out_s, out_d = [], [], []
    for rows in row_slices(len(a), len(b)):
        d2 = squared_distances(a[rows] - centre, b - centre)
        if own is not None:
            hit = np.flatnonzero(own[rows] >= 0)
            d2[hit, own[rows][hit]] = np.inf
        m = min(k, len(b))
        limit = np.full(len(d2), np.inf) if reach is None else (reach[rows] * (1 + 1e-9)) ** 2 + 2 * slack
        near = d2 <= limit[:, None]
        # A bound that leaves few points spares the search for the k-th distance.
        if np.count_nonzero(near) > 8 * m * len(d2):
            kth = np.partition(d2, m - 1, axis=1)[:, m - 1]
            near &= d2 <= (kth + 2 * slack)[:, None]
        r, s = np.nonzero(near & np.isfinite(d2))
        d = paired_distances(a[rows], b, r, s)
        order = np.lexsort((id_order[s], d, r))
        r, s, d = r[order], s[order], d[order]
        start = np.searchsorted(r, r, side="left")
        keep = np.arange(len(r)) - start < k
        out_r.append(r[keep] + rows.start)
        out_s.append(s[keep])
        out_d.append(d[keep])
    return np.concatenate(out_r), np.concatenate(out_s), np.concatenate(out_d)


# --- counts within a radius ----------------------------------------------------------


def neighbour_counts(
    queries: DataFrame, points: DataFrame, radii: Sequence[float], other_tags_only: bool = False, seed: int | str = 0
) -> DataFrame:
    """Summed ``weight`` of the points within each radius, per query point and point tag.

    Both tables need ``id, vec, tag``, the points also ``weight`` (see ``fold_copies``).
    Returns ``(id, own, weight, tag, c0, c1, ...)`` with ``own`` the query's tag; query
    rows without a ``weight`` count once. ``other_tags_only`` sums over the tags that
    differ from the query's own and gives one row per query point with ``tag`` NULL.

    Blocks that lie fully inside or outside all radii are counted from the block map.
    """
    radii = [float(h) for h in radii]
    index = build_index(points, tag="tag", seed=seed)
    if "weight" not in queries.columns:
        queries = queries.withColumn("weight", F.lit(1).cast("bigint"))
    queries = materialize(queries.select("id", "vec", "tag", "weight"), "queries")
    require_dimension(queries, index.dim)
    counters = [f"c{i}" for i in range(len(radii))]
    names = ["id", "own", "weight", "tag", *counters]
    schema = T.StructType(
        [_field(queries, "id", "id"), _field(queries, "tag", "own"), _field(queries, "weight", "weight"),
         _field(points, "tag", "tag"), *[T.StructField(c, T.LongType()) for c in counters]]
    )
    tags = index.map.tags
    tag_index = {t: i for i, t in enumerate(tags)}
    shared = queries.sparkSession.sparkContext.broadcast(index.map)

    def rule(m: BlockMap, at: Bounds, _: pd.DataFrame) -> np.ndarray:
        mask = np.zeros(at.low.shape, dtype=bool)
        for h in radii:
            mask |= (at.low <= h + 2 * at.slack) & (at.high > h - 2 * at.slack)
        return mask

    def frame(batch: pd.DataFrame, counts: np.ndarray) -> pd.DataFrame:
        """counts: (rows, tags, radii)."""
        own = batch["tag"].map(tag_index)
        if other_tags_only:
            rest = counts.sum(axis=1)
            known = own.notna().to_numpy()
            rest[known] -= counts[known, own[known].astype(int).to_numpy()]
            out = pd.DataFrame(rest, columns=counters)
            out.insert(0, "tag", None)
            rows = np.arange(len(batch))
        else:
            rows, cols = np.nonzero(counts.any(axis=2))
            out = pd.DataFrame(counts[rows, cols], columns=counters)
            out.insert(0, "tag", np.array(tags, dtype=object)[cols] if len(cols) else [])
        out.insert(0, "weight", batch["weight"].to_numpy()[rows])
        out.insert(0, "own", batch["tag"].to_numpy()[rows])
        out.insert(0, "id", batch["id"].to_numpy()[rows])
        return out[names]

    def whole_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        tag_count = m.tag_count.astype(float)
        for batch in batches:
            x = matrix(batch["vec"])
            for rows in row_slices(len(x), max(len(m.pivot_of), len(m.pivots), len(tags) * len(radii))):
                at = m.bounds(x[rows])
                skipped = ~rule(m, at, batch)
                # Sums below 2^53 are exact in floating point.
                counts = np.stack(
                    [np.rint((skipped & (at.high <= h)).astype(float) @ tag_count).astype(np.int64) for h in radii], axis=2
                )
                yield frame(batch.iloc[rows], counts)

    def within(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty:
            return pd.DataFrame(columns=names)
        a, b = matrix(left["vec"]), matrix(right["vec"])
        centre = b.mean(axis=0)
        slack = rounding_slack(a - centre, b - centre)
        weights = np.zeros((len(b), len(tags)), dtype=float)
        weights[np.arange(len(b)), right["tag"].map(tag_index).to_numpy()] = right["weight"].to_numpy()
        counts = np.empty((len(a), len(tags), len(radii)), dtype=np.int64)
        for rows in row_slices(len(a), len(b)):
            d2 = squared_distances(a[rows] - centre, b - centre)
            for i, h in enumerate(radii):
                inside = d2 <= h * h
                r, s = np.nonzero(np.abs(d2 - h * h) <= 2 * slack)
                inside[r, s] = paired_distances(a[rows], b, r, s) <= h
                counts[rows, :, i] = np.rint(inside.astype(float) @ weights)
        return frame(left, counts)

    visited = visit_blocks(index, queries, rule, within, schema, width=len(tags) * len(radii))
    skipped = queries.mapInPandas(whole_blocks, schema)
    return visited.unionByName(skipped).groupBy("id", "own", "weight", "tag").agg(
        *[F.sum(c).alias(c) for c in counters]
    )


# --- Gaussian kernel sums -------------------------------------------------------------


def kernel_sums(queries: DataFrame, points: DataFrame, bandwidth: float, cutoff: float = 38.7, seed: int | str = 0) -> DataFrame:
    """Gaussian kernel sums over all other points: ``(id, own, weight, tag, kernel)``.

    Same tables as :func:`neighbour_counts`. Beyond ``cutoff`` bandwidths the kernel is 0
    in double precision, so the default cutoff loses nothing. A query row that is itself
    a folded point (same id and tag) leaves one copy out.
    """
    index = build_index(points, tag="tag", seed=seed)
    if "weight" not in queries.columns:
        queries = queries.withColumn("weight", F.lit(1).cast("bigint"))
    queries = materialize(queries.select("id", "vec", "tag", "weight"), "queries")
    require_dimension(queries, index.dim)
    tags = index.map.tags
    tag_index = {t: i for i, t in enumerate(tags)}
    names = ["id", "own", "weight", "tag", "kernel"]
    schema = T.StructType(
        [_field(queries, "id", "id"), _field(queries, "tag", "own"), _field(queries, "weight", "weight"),
         _field(points, "tag", "tag"), T.StructField("kernel", T.DoubleType())]
    )

    def rule(_: BlockMap, at: Bounds, __: pd.DataFrame) -> np.ndarray:
        return at.low <= cutoff * bandwidth + 2 * at.slack

    def sums(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty:
            return pd.DataFrame(columns=names)
        a, b = matrix(left["vec"]), matrix(right["vec"])
        centre = b.mean(axis=0)
        weights = np.zeros((len(b), len(tags)))
        weights[np.arange(len(b)), right["tag"].map(tag_index).to_numpy()] = right["weight"].to_numpy()
        own = pd.Index(right["id"]).get_indexer(left["id"].to_numpy())
        pieces = []
        for rows in row_slices(len(a), len(b)):
            kernel = np.exp(-squared_distances(a[rows] - centre, b - centre) / (2.0 * bandwidth * bandwidth))
            hit = np.flatnonzero(own[rows] >= 0)
            mine = own[rows][hit]
            kernel[hit, mine] = 0.0
            total = kernel @ weights
            # The point's own copies are at distance 0: all of them but itself count.
            tag = right["tag"].map(tag_index).to_numpy()[mine]
            total[hit, tag] += right["weight"].to_numpy()[mine] - 1
            pieces.append(total)
        total = np.vstack(pieces)
        r, t = np.nonzero(total > 0)
        return pd.DataFrame({
            "id": left["id"].to_numpy()[r], "own": left["tag"].to_numpy()[r], "weight": left["weight"].to_numpy()[r],
            "tag": np.array(tags, dtype=object)[t], "kernel": total[r, t],
        }, columns=names)

    return visit_blocks(index, queries, rule, sums, schema, width=len(tags)).groupBy("id", "own", "weight", "tag").agg(
        F.sum("kernel").alias("kernel")
    )
