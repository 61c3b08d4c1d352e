"""Removal of byte strings that occur more than once, by suffix arrays per shard and merging across shards.

Documents are packed into shards. Inside a shard a suffix array is built by Larsson-Sadakane
refinement, and common prefixes of neighbours are carried from position to position as in
Kasai's algorithm; windows of ``length`` bytes in one run of common prefixes are repeats.

Between shards, sorted fingerprints are merged by binary search. To keep them few, windows
are grouped: the string of ``ANCHOR`` bytes with the smallest hash in a window is its anchor,
so equal windows have equal anchors, and neighbouring windows with one anchor form a block.
Shards first tell the anchor and digest of each distinct block. A block whose anchor is
nowhere else holds no repeat; one that is found whole in another shard is all repeats. Where
an anchor has blocks that differ, at the edges of repeated passages, their windows are told
one by one.
Fingerprints have 128 bits.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featshift.llm.arrays import U64, RollingHash
from featshift.llm.shelves import packed, unpack
from featshift.storage import materialize

#: Bytes of an anchor, as a share of the window.
ANCHOR_SHARE = 0.65
SHARD_BYTES = 2 << 20
_BLOCK = np.dtype([("anchor", "<u8"), ("digest", "<u8")])


def suffix_array(text: np.ndarray, depth: int | None = None) -> np.ndarray:
    """Suffixes of ``text`` in order; with ``depth`` ordered by that many bytes at least, then by position."""
    n = len(text)
    padded = np.concatenate((text, np.zeros(8, dtype=np.uint8))).astype(U64)
    key = np.zeros(n, dtype=U64)
    for k in range(8):
        key = key << U64(8) | padded[k : n + k]
    order = np.argsort(key, kind="stable")
    new = np.ones(n, dtype=bool)
    new[1:] = key[order[1:]] != key[order[:-1]]
    h = 8
    while True:
        group = np.maximum.accumulate(np.where(new, np.arange(n), 0))  # a group is numbered by its first place
        rank = np.empty(n, dtype=np.int64)
        rank[order] = group
        alone = new & np.append(new[1:], True)
        open_ = np.flatnonzero(~alone)
        if not len(open_) or depth is not None and h >= max(depth, 16):  # one round puts short suffixes in place
            return order
        suffix = order[open_]
        ahead = np.where(suffix + h < n, rank[np.minimum(suffix + h, n - 1)], -suffix - 1)  # past the end the shorter one is smaller
        keys = group[open_] << 32 | (ahead + n)
        by = np.argsort(keys, kind="stable")
        order[open_] = suffix[by]
        keys = keys[by]
        new[open_[1:]] |= keys[1:] != keys[:-1]
        h *= 2


def common_prefixes(text: np.ndarray, order: np.ndarray, enough: int) -> np.ndarray:
    """For each place in ``order`` the bytes shared with the place before; exact below ``enough``.

    If the neighbour of a position is the one after its predecessor's neighbour, and those two
    share something, these share one byte less. Only the heads of such runs are compared.
    """
    n = len(text)
    before = np.full(n, -1, dtype=np.int64)
    before[order[1:]] = order[:-1]
    head = np.ones(n, dtype=bool)
    head[1:] = (before[1:] != before[:-1] + 1) | (before[:-1] < 0) | (text[:-1] != text[before[:-1]])
    at = np.flatnonzero(head)
    most = np.diff(np.append(at, n)) + enough
    shared = np.zeros(len(at), dtype=np.int64)
    open_ = np.flatnonzero(before[at] >= 0)
    words = np.lib.stride_tricks.sliding_window_view(np.concatenate((text, np.zeros(8, dtype=np.uint8))), 8)
    while len(open_):
        a, b = at[open_] + shared[open_], before[at[open_]] + shared[open_]
        inside = np.maximum(a, b) < n
        open_, a, b = open_[inside], a[inside], b[inside]
        differ = words[a] != words[b]
        step = np.where(differ.any(axis=1), differ.argmax(axis=1), 8)
        step = np.minimum(step, n - np.maximum(a, b))
        shared[open_] += step
        open_ = open_[(step == 8) & (shared[open_] < most[open_])]
    heads = np.repeat(np.arange(len(at)), np.diff(np.append(at, n)))
    by_position = shared[heads] - (np.arange(n) - at[heads])
    return np.maximum(by_position, 0)[order]


def repeated_starts(text: np.ndarray, valid: np.ndarray, length: int) -> np.ndarray:
    """Whether each valid start has its ``length`` bytes at another valid start too."""
    order = suffix_array(text, length)
    group = np.cumsum(common_prefixes(text, order, length) < length)
    members = np.bincount(group[valid[order]], minlength=int(group[-1]) + 1 if len(group) else 0)
    out = np.zeros(len(text), dtype=bool)
    out[order] = members[group] > 1
    return out & valid


def _smallest(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values."""
    n = len(values) - width + 1
    grid = np.full(-(-len(values) // width) * width, np.iinfo(U64).max, dtype=U64)
    grid[: len(values)] = values
    grid = grid.reshape(-1, width)
    forward = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], forward[width - 1 : width - 1 + n])


class Blocks:
    """The blocks of a shard: first window, number of windows, anchor and digest, and places of the anchor."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, length: int):
        self.hashes = (RollingHash(data, 0), RollingHash(data, 1))
        width = length - max(1, int(length * ANCHOR_SHARE)) + 1
        n = max(len(data) - length + 1, 0)
        self.windows = np.zeros(len(data) + 1, dtype=np.int8)
        inside = np.flatnonzero(np.diff(bounds) >= length)
        np.add.at(self.windows, bounds[inside], 1)
        np.add.at(self.windows, bounds[inside + 1] - length + 1, -1)
        at = np.flatnonzero(np.cumsum(self.windows[:n], dtype=np.int8))  # windows that lie in one document
        if not len(at):
            self.first = self.count = np.zeros(0, dtype=np.int64)
            self.told, self.times = np.zeros(0, dtype=_BLOCK), np.zeros(0, dtype=np.int64)
            return
        strings = self.hashes[0].windows(length - width + 1)
        lowest = _smallest(strings, width)
        anchor = lowest[at]
        new = np.ones(len(at), dtype=bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)
        begin = np.flatnonzero(new)
        self.first, self.count = at[begin], np.diff(np.append(begin, len(at)))
        self.told = np.empty(len(begin), dtype=_BLOCK)
        self.told["anchor"] = anchor[begin]
        self.told["digest"] = self.hashes[1].ranges(self.first, self.first + self.count - 1 + length)
        # Places of anchors: the smallest of some window. One block can hold several (periodic text).
        around = np.zeros(len(strings) + width - 1, dtype=U64)
        around[width - 1 : width - 1 + len(lowest)] = lowest
        values, times = np.unique(strings[~_smallest(~around, width) == strings], return_counts=True)
        self.times = times[np.searchsorted(values, self.told["anchor"])]

    def starts(self, chosen: np.ndarray) -> np.ndarray:
        """All windows of some blocks."""
        n = self.count[chosen]
        return np.repeat(self.first[chosen], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)

    def fingerprints(self, starts: np.ndarray, length: int) -> np.ndarray:
        out = np.empty(len(starts), dtype=_BLOCK)
        for name, h in zip(("anchor", "digest"), self.hashes, strict=True):
            out[name] = h.ranges(starts, starts + length)
        return out


def _distinct(told: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct entries sorted by part and value, where each part begins, and the place of every entry."""
    by = np.lexsort((told["digest"], told["anchor"]))
    new = np.ones(len(told), dtype=bool)
    new[1:] = told[by[1:]] != told[by[:-1]]
    found, back = told[by[new]], np.empty(len(told), dtype=np.int64)
    back[by] = np.cumsum(new) - 1
    part = (found["anchor"] % U64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    place = np.empty(len(found), dtype=np.int64)
    place[order] = np.arange(len(found))
    return found[order], np.searchsorted(part[order], np.arange(parts + 1)), place[back]


def _rows(shard: int, told: np.ndarray, cuts: np.ndarray) -> list[dict]:
    return [{"shard": shard, "part": k, "told": told[cuts[k] : cuts[k + 1]].tobytes()} for k in np.flatnonzero(np.diff(cuts)).tolist()]


def _runs(positions: np.ndarray) -> bytes:
    """Increasing positions as first and end of each run."""
    cut = np.flatnonzero(np.diff(positions) != 1)
    pairs = np.stack((positions[np.append(0, cut + 1)], positions[np.append(cut, len(positions) - 1)] + 1), axis=1) if len(positions) else np.zeros((0, 2))
    return pairs.astype(np.int32).tobytes()


def _positions(runs: bytes) -> np.ndarray:
    pairs = np.frombuffer(runs, dtype=np.int32).reshape(-1, 2).astype(np.int64)
    n = pairs[:, 1] - pairs[:, 0]
    return np.repeat(pairs[:, 0], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _merge(told: DataFrame, name: str) -> DataFrame:
    """An answer to each entry of each shard.

    0: no other shard has its anchor. 1: one has, but not the entry. 2: another shard has the
    entry. 3: as 2, this shard is the first of them, and there are other entries of the anchor.
    """

    def merged(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        blocks = [np.frombuffer(x, dtype=_BLOCK) for x in table.column("told").to_pylist()]
        every, owner = np.concatenate(blocks), np.repeat(np.arange(len(blocks)), [len(b) for b in blocks])
        by = np.lexsort((every["digest"], every["anchor"]))  # equal entries stay in the order of shards
        every, owner = every[by], owner[by]
        first = np.ones(len(every), dtype=bool)
        first[1:] = every["anchor"][1:] != every["anchor"][:-1]
        at = np.flatnonzero(first)
        anchors = every["anchor"][at]
        shared = np.minimum.reduceat(owner, at) < np.maximum.reduceat(owner, at)
        new = first.copy()
        new[1:] |= every["digest"][1:] != every["digest"][:-1]
        several = np.add.reduceat(new.astype(np.int64), at) > 1
        size = np.diff(np.append(np.flatnonzero(new), len(every)))[np.cumsum(new) - 1]  # a shard tells an entry once
        found = np.empty(len(every), dtype=np.int8)
        place = np.searchsorted(anchors, every["anchor"])
        found[by] = np.where(size > 1, np.where(new & several[place], 3, 2), shared[place])
        cuts = np.cumsum([0, *(len(b) for b in blocks)])
        answers = [found[a:z].tobytes() for a, z in zip(cuts[:-1], cuts[1:], strict=True)]
        return pa.table({"shard": table.column("shard"), "part": table.column("part"), "answer": pa.array(answers, pa.binary())})

    return told.groupBy("part").applyInArrow(merged, "shard long, part int, answer binary").groupBy("shard").agg(
        F.collect_list(F.struct("part", "answer")).alias(name)
    )


def _told_back(answers: list[dict] | None, cuts: np.ndarray) -> np.ndarray:
    out = np.zeros(cuts[-1], dtype=np.int8)
    for a in answers or []:
        out[cuts[a["part"]] : cuts[a["part"] + 1]] = np.frombuffer(a["answer"], dtype=np.int8)
    return out


def remove_repeats(docs: DataFrame, length: int = 200, doc_id: str = "doc_id", text: str = "text", texts: bool = False) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)`` for every row, with the kept bytes if ``texts``.

    A byte goes if a string of ``length`` bytes that covers it also starts anywhere else in the
    input, in the same row or another; matches never cross rows. ``spans`` lists the removed
    runs as pairs of first byte and end. Null texts are empty; rows that repeat an id are
    texts of their own, so equal rows of ``length`` bytes or more lose everything.
    """
    shards = packed(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")), shard_bytes=SHARD_BYTES)
    parts = max(8, int(6 * math.sqrt(shards.count())))

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, data, bounds, _ in unpack(batch):
                found, cuts, _ = _distinct(Blocks(data, bounds, length).told, parts)
                yield pa.RecordBatch.from_pylist(_rows(shard, found, cuts), pa.schema([("shard", pa.int64()), ("part", pa.int32()), ("told", pa.binary())]))

    blocks = _merge(shards.mapInArrow(tell, "shard long, part int, told binary"), "answers")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("shard", pa.int64()), ("part", pa.int32()), ("told", pa.binary()), ("sure", pa.binary()), ("asked", pa.binary())])
        for batch in batches:
            for shard, data, bounds, more in unpack(batch):
                b = Blocks(data, bounds, length)
                _, cuts, place = _distinct(b.told, parts)
                abroad = _told_back(more["answers"].as_py(), cuts)[place]
                sure = np.zeros(len(data), dtype=bool)
                sure[b.starts(abroad > 1)] = True
                # The suffix array covers the blocks whose anchor has several places in this shard.
                own = np.zeros(len(data) + 1, dtype=np.int32)
                many = np.flatnonzero(b.times > 1)
                np.add.at(own, b.first[many], 1)
                np.add.at(own, b.first[many] + b.count[many] - 1 + length, -1)
                region = np.flatnonzero(np.cumsum(own[:-1]))
                if len(region):
                    valid = np.zeros(len(data), dtype=bool)
                    valid[b.starts(many)] = True
                    sure[region] |= repeated_starts(data[region], valid[region], length)
                edge = b.starts(abroad % 2 == 1)
                found, cuts, _ = _distinct(b.fingerprints(edge, length), parts)
                rows = _rows(shard, found, cuts)
                yield pa.RecordBatch.from_pylist([*rows, {"shard": shard, "part": -1, "sure": _runs(np.flatnonzero(sure)), "asked": _runs(edge)}], schema)

    looked = shards.join(blocks.hint("shuffle_hash"), "shard", "left").mapInArrow(look, "shard long, part int, told binary, sure binary, asked binary")
    looked = materialize(looked, "repeats")
    windows = _merge(looked.filter("part >= 0").select("shard", "part", "told"), "windows")
    marks = looked.filter("part < 0").select("shard", "sure", "asked").join(windows.hint("merge"), "shard", "left")
    marked = shards.join(marks.hint("shuffle_hash"), "shard")
    kind = docs.schema[doc_id].dataType.simpleString()

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, bounds, more in unpack(batch):
                starts = [_positions(more["sure"].as_py())]
                edge = _positions(more["asked"].as_py())
                if len(edge):
                    prints = np.empty(len(edge), dtype=_BLOCK)
                    for name, which in (("anchor", 0), ("digest", 1)):
                        prints[name] = RollingHash(data, which).ranges(edge, edge + length)
                    _, cuts, place = _distinct(prints, parts)
                    starts.append(edge[_told_back(more["windows"].as_py(), cuts)[place] > 1])
                cover = np.zeros(len(data) + 1, dtype=np.int32)
                for s in starts:
                    np.add.at(cover, s, 1)
                    np.add.at(cover, s + length, -1)
                gone = np.cumsum(cover[:-1]) > 0
                n_removed, n_spans, digests, kept, spans = [], [], [], [], []
                for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    out = gone[a:z]
                    rest = data[a:z][~out].tobytes()
                    edges = np.flatnonzero(np.diff(np.concatenate(([False], out, [False])).astype(np.int8)))
                    n_removed.append(int(out.sum()))
                    n_spans.append(len(edges) // 2)
                    digests.append(hashlib.sha256(rest).hexdigest())
                    if texts:
                        kept.append(rest)
                        spans.append(edges.reshape(-1, 2).tolist())
                columns = {"doc_id": more["doc_id"].values, "n_bytes": pa.array(np.diff(bounds)), "n_removed": pa.array(n_removed, pa.int64()), "n_spans": pa.array(n_spans, pa.int64()), "kept_sha256": pa.array(digests, pa.string())}
                if texts:
                    columns |= {"kept": pa.array(kept, pa.binary()), "spans": pa.array(spans, pa.list_(pa.list_(pa.int64())))}
                yield pa.RecordBatch.from_pydict(columns)

    more = ", kept binary, spans array<array<long>>" if texts else ""
    return marked.mapInArrow(remove, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string{more}")
