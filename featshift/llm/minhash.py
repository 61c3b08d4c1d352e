"""Near-duplicate documents by word shingles: MinHash with tensored banding, links verified on full sets.

Two small collections of composite MinHash values (``SIDE`` values of ``WIDTH`` hashes each)
are drawn per document. A table key is a pair of one value from either side, so
``SIDE * SIDE`` tables cost only ``2 * SIDE * WIDTH`` hash functions. A pair of similarity s
is missed with probability of about ``2 * (1 - s^WIDTH)^SIDE``: 1e-5 at 0.85, 8e-5 at 0.8.

Documents with equal sets are folded first. Inside a table bucket no pairs are listed: every
member is held against the smallest one; what that leaves unconnected is then compared, in
buckets with few members outside the first component directly, in others by an exact
prefix join on their rarest shingles. So every pair that meets in a bucket ends up either
connected or compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featshift.llm.arrays import LOWER, flat, mix, slices, word_hashes
from featshift.llm.links import components
from featshift.storage import forget, materialize

SIDE, WIDTH = 10, 2
#: Lowest similarity that the numbers here are chosen for.
LEAST_PERCENT = 80
#: Fewest of the ``2 * SIDE`` composite values that a pair worth verifying has in common; a
#: pair at similarity 0.8 has fewer with a probability below 1e-5.
SHARED_VALUES = 4
#: Beyond so many members outside its first component, a bucket goes to the prefix join.
OUTSIDE = 32
#: Hash classes of shingles whose counts order the prefix join.
CLASSES = 1 << 16
#: Rounds of comparing members that are still apart with one other member of their bucket.
ROUNDS = 2
_U = np.uint64
_SALTS = np.random.default_rng(991).integers(1, 2**63, size=2 * SIDE * WIDTH, dtype=_U) * _U(2) + _U(1)
_ORDER = np.random.default_rng(992).integers(1, 2**63, size=64, dtype=_U) * _U(2) + _U(1)


def shingle_sets(data: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit shingle hashes of each row, sorted, and where each row's begin.

    Letters A-Z count as a-z. A row with fewer than ``size`` words is one shingle, a row
    without words has none.
    """
    words, firsts = word_hashes(LOWER[data], bounds)
    counts = np.diff(firsts)
    n = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    places = np.concatenate(([0], np.cumsum(n)))
    at = np.arange(places[-1]) - np.repeat(places[:-1] - firsts[:-1], n)
    row = np.repeat(np.arange(len(n)), n)
    last = firsts[1:][row]
    hashes = np.zeros(len(at), dtype=_U)
    for k in range(size):
        inside = at + k < last
        value = np.where(inside, words[np.minimum(at + k, max(len(words) - 1, 0))] if len(words) else 0, _U(0))
        hashes += (value ^ _U(k + 1)) * _ORDER[k]
    hashes = mix(hashes)
    order = np.lexsort((hashes, row))
    hashes, row = hashes[order], row[order]
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
    return hashes[new], np.searchsorted(row[new], np.arange(len(n) + 1))


def _fold(values: np.ndarray, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(values * _ORDER[salt])


def sketches(docs: DataFrame, size: int, keep_text: bool = False) -> DataFrame:
    """``(id, n, fp, one, two)`` for rows ``(id, text)``: set size, fingerprint of the set, composite values, and the text if wanted."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets, places = shingle_sets(*flat(batch.column("text")), size)
            n = np.diff(places)
            some = np.flatnonzero(n)
            at = places[some]
            prints = np.zeros((2, len(n)), dtype=_U)
            values = np.zeros((2 * SIDE, len(n)), dtype=_U)
            if len(some):
                for k in range(2):
                    prints[k, some] = mix(np.add.reduceat(_fold(sets, 40 + k), at) + n[some].astype(_U))
                for v in range(2 * SIDE):
                    for w in range(WIDTH):
                        low = np.minimum.reduceat(mix(sets ^ _SALTS[v * WIDTH + w]), at)
                        values[v, some] = mix(values[v, some] * _U(31) + low)
            sides = [pa.ListArray.from_arrays(np.arange(len(n) + 1, dtype=np.int32) * SIDE, np.ascontiguousarray(values[s : s + SIDE].T).view(np.int64).ravel()) for s in (0, SIDE)]
            fp = pa.array([f"{a:016x}{b:016x}" if k else None for a, b, k in zip(*prints.tolist(), n.tolist(), strict=True)], pa.string())
            more = {"text": batch.column("text")} if keep_text else {}
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n.astype(np.int64)), fp, *sides, *more.values()], names=["id", "n", "fp", "one", "two", *more])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(task, f"id {kind}, n long, fp string, one array<long>, two array<long>" + ", text string" * keep_text)


def full_sets(docs: DataFrame, size: int) -> DataFrame:
    """``(id, shingles)`` with the sorted hashes packed in one binary value."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets, places = shingle_sets(*flat(batch.column("text")), size)
            packed = pa.array([sets[a:b].tobytes() for a, b in zip(places[:-1], places[1:], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("id"), packed], names=["id", "shingles"])

    return docs.mapInArrow(task, f"id {docs.schema['id'].dataType.simpleString()}, shingles binary")


def _verified(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs ``(u, v)`` whose full sets meet the bound."""
    ends = pairs.select(F.col("u").alias("id")).unionByName(pairs.select(F.col("v").alias("id"))).distinct()
    sets = materialize(full_sets(docs.join(ends.hint("merge"), "id", "left_semi"), size), "sets")
    joined = pairs.join(sets.select(F.col("id").alias("v"), F.col("shingles").alias("b")).hint("merge"), "v")
    joined = joined.join(sets.select(F.col("id").alias("u"), F.col("shingles").alias("a")).hint("merge"), "u").select("u", "v", "a", "b")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(k).to_pylist() for k in ("a", "b"))
            fits = np.zeros(batch.num_rows, dtype=bool)
            for i, (x, y) in enumerate(zip(a, b, strict=True)):
                x, y = np.frombuffer(x, dtype=_U), np.frombuffer(y, dtype=_U)
                x, y = (x, y) if len(x) <= len(y) else (y, x)
                both = int(np.count_nonzero(y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x))
                fits[i] = 100 * both >= percent * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], names=["u", "v"]).filter(pa.array(fits))

    return joined.mapInArrow(task, pairs.select("u", "v").schema)


def _worth(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs whose set sizes allow a link and whose sketches are alike enough."""
    sides = [nodes.select(F.col("id").alias(k), *(F.col(c).alias(f"{k}_{c}") for c in ("n", "one", "two"))).hint("merge") for k in ("u", "v")]
    joined = pairs.join(sides[0], "u").join(sides[1], "v")
    joined = joined.filter(100 * F.least("u_n", "v_n") >= percent * F.greatest("u_n", "v_n"))
    equal = [(F.col(f"u_{s}")[i] == F.col(f"v_{s}")[i]).cast("int") for s in ("one", "two") for i in range(SIDE)]
    return joined.filter(reduce(lambda x, y: x + y, equal) >= SHARED_VALUES).select("u", "v")


def _outside(rows: DataFrame, on: str) -> tuple[DataFrame, DataFrame]:
    """Rows of groups with more than one component, and of these the ones outside the group's first."""
    groups = rows.groupBy(on).agg(F.min("comp").alias("first"), F.max("comp").alias("top")).filter("first <> top").drop("top")
    mixed = rows.join(groups.hint("merge"), on)
    return mixed, mixed.filter("comp <> first")


def _cross_pairs(outside: DataFrame, mixed: DataFrame, on: str, possible: str = "true") -> DataFrame:
    """Pairs of a row outside its group's first component with any row of another component.

    ``possible`` is a condition on columns of the two rows, their names with an x or a y behind.
    """
    left = outside.select(on, *(F.col(c).alias(f"{c}_x") for c in outside.columns if c != on))
    right = mixed.select(on, *(F.col(c).alias(f"{c}_y") for c in mixed.columns if c != on))
    pairs = left.join(right.hint("merge"), on).filter(f"comp_x <> comp_y and {possible}").select(F.col("id_x").alias("x"), F.col("id_y").alias("y"))
    return pairs.select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct()


def _rarity(docs: DataFrame, size: int) -> np.ndarray:
    """How often the shingles of each of ``CLASSES`` hash classes occur; one number per class comes to the driver."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES, dtype=np.int64)
        for batch in slices(batches, "text"):
            sets, _ = shingle_sets(*flat(batch.column("text")), size)
            total += np.bincount((sets % _U(CLASSES)).astype(np.int64), minlength=CLASSES)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"class": some, "n": total[some]})

    found = np.zeros(CLASSES, dtype=np.int64)
    for k, n in docs.select("text").mapInArrow(task, "class long, n long").groupBy("class").agg(F.sum("n")).collect():
        found[k] = n
    return found


def _prefix_pairs(rows: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs of ``rows`` (id, comp) in different components that can meet the bound, by rare shingles.

    Two sets that meet it share a shingle among the rarest ``n - ceil(percent * n) + 1`` of either,
    are of similar sizes, and have enough shingles left behind the first that they share. Any
    order common to all sets will do; here it is that of the hash classes by their counts.
    """
    crowd = materialize(docs.join(rows.hint("merge"), "id"), "crowd")
    rarity = docs.sparkSession.sparkContext.broadcast(_rarity(crowd, size))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = rarity.value
        for batch in slices(batches, "text"):
            sets, places = shingle_sets(*flat(batch.column("text")), size)
            n = np.diff(places)
            row = np.repeat(np.arange(batch.num_rows), n)
            order = np.lexsort((sets, counts[(sets % _U(CLASSES)).astype(np.int64)], row))
            pos = np.arange(len(sets)) - places[:-1][row]
            first = pos < (n + (-percent * n) // 100 + 1)[row]
            back, taken = row[first], sets[order][first]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(back), batch.column("comp").take(back), pa.array(n[back].astype(np.int64)), pa.array(pos[first].astype(np.int32)), pa.array(taken.view(np.int64))],
                names=["id", "comp", "n", "pos", "token"],
            )

    kind = docs.schema["id"].dataType.simpleString()
    prefix = materialize(crowd.mapInArrow(task, f"id {kind}, comp {kind}, n long, pos int, token long"), "prefix")
    mixed, outside = _outside(prefix, "token")
    sizes = f"100 * least(n_x, n_y) >= {percent} * greatest(n_x, n_y)"
    left_over = f"{100 + percent} * least(n_x - pos_x, n_y - pos_y) >= {percent} * (n_x + n_y)"
    return _cross_pairs(outside, mixed, "token", f"{sizes} and {left_over}")


def near_duplicates(docs: DataFrame, size: int, percent: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` for every row of ``docs``.

    Documents link when ``100 * intersection >= percent * union`` of their sets of distinct
    ``size``-word shingles. ``component_id`` is the smallest id reachable by links. Texts
    without words (null and empty ones too) link with nothing. Rows that repeat an id are
    one document; if their texts differ, the one with the smallest fingerprint stands for it.
    Rows without an id are compared with nothing: no component, and kept. Banding is laid out
    for a ``percent`` of 80 or more; less is refused.
    """
    if percent < LEAST_PERCENT:
        raise ValueError(f"banding finds pairs from {LEAST_PERCENT} percent on")
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"))
    found = materialize(sketches(rows, size), "sketches")
    one = found.filter("n > 0 and id is not null").groupBy("id").agg(F.min(F.struct("fp", "n", "one", "two")).alias("s")).select("id", "s.*")
    one = materialize(one, "sketches")
    same = one.groupBy("fp").agg(F.min("id").alias("rep"))
    nodes = one.join(same.select(F.col("rep").alias("id")).hint("merge"), "id", "left_semi")
    copies = one.join(same.hint("merge"), "fp").filter("id <> rep").select(F.col("id").alias("u"), F.col("rep").alias("v"))

    # The text that stands for each id (only repeated ids can have others).
    texts = rows
    if found.count() != found.select("id").distinct().count():
        prints = sketches(rows.filter("id is not null"), size, keep_text=True)
        texts = prints.groupBy("id").agg(F.min(F.struct(F.col("fp").isNull(), "fp", "text")).alias("s")).select("id", "s.text")
    keys = nodes.select("id", "two", F.posexplode("one").alias("i", "a")).select("id", "i", "a", F.posexplode("two").alias("j", "b"))
    keys = keys.select(F.xxhash64("i", "j", "a", "b").alias("key"), "id")
    shared = keys.groupBy("key").agg(F.min("id").alias("lead"), F.max("id").alias("top")).filter("lead <> top").drop("top")
    members = materialize(keys.join(shared.hint("merge"), "key"), "buckets")

    # First every member against the smallest of all that it meets, then what is still apart
    # in a bucket against members taken by a hash, another one each round.
    stars = members.filter("id <> lead").groupBy(F.col("id").alias("v")).agg(F.min("lead").alias("u")).select("u", "v")
    links = materialize(_verified(materialize(_worth(stars, nodes, percent), "pairs"), texts, size, percent), "links")
    for turn in range(ROUNDS):
        comp = components(links)
        apart = members.select("key", "id").join(comp.select(F.col("node").alias("id"), "component").hint("merge"), "id", "left")
        apart = materialize(_outside(apart.select("key", "id", F.coalesce("component", "id").alias("comp")), "key")[0], "apart")
        lead = apart.groupBy("key").agg(F.min_by(F.struct("id", "comp"), F.xxhash64("id", F.lit(turn))).alias("l")).select("key", F.col("l.id").alias("lead"), F.col("l.comp").alias("lead_comp"))
        tried = apart.join(lead.hint("merge"), "key").filter("comp <> lead_comp").groupBy("id").agg(F.min("lead").alias("a"), F.max("lead").alias("b"))
        tried = tried.select("id", F.explode(F.array("a", "b")).alias("lead")).select(F.least("id", "lead").alias("u"), F.greatest("id", "lead").alias("v")).distinct()
        met = materialize(_verified(materialize(_worth(tried, nodes, percent), "pairs"), texts, size, percent), "links")
        links = materialize(links.unionByName(met), "links")
        forget(apart, met)
    comp = components(links)
    placed = members.select("key", "id").join(comp.select(F.col("node").alias("id"), "component").hint("merge"), "id", "left")
    placed = placed.select("key", "id", F.coalesce("component", "id").alias("comp"))
    mixed = materialize(_outside(placed, "key")[0], "buckets")
    outside = mixed.filter("comp <> first")
    crowded = outside.groupBy("key").agg(F.count("*").alias("n_out")).filter(F.col("n_out") > OUTSIDE).drop("n_out")
    few = outside.join(crowded.hint("merge"), "key", "left_anti")
    pairs = _cross_pairs(few, mixed, "key")
    many = mixed.join(crowded.hint("merge"), "key", "left_semi").select("id", "comp").distinct()
    pairs = pairs.unionByName(_prefix_pairs(many, texts, size, percent)).distinct()
    more = materialize(_verified(materialize(_worth(pairs, nodes, percent), "pairs"), texts, size, percent), "links")
    forget(members, mixed)

    comp = components(links.unionByName(more).unionByName(copies))
    out = found.select("id", F.col("n").alias("n_shingles")).join(comp.select(F.col("node").alias("id"), "component").hint("merge"), "id", "left")
    own = F.coalesce("component", "id")
    return out.select(F.col("id").alias("doc_id"), "n_shingles", own.alias("component_id"), (own.isNull() | (own == F.col("id"))).alias("kept"))
