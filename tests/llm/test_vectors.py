"""Searches, clustering and hard negatives against plain versions, on tables with odd rows and tiny blocks."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from featshift.llm import centroids, hard_negatives, nearest, tiles
from featshift.llm.centroids import Cells, possible

SCHEMA = "vec_id long, embedding array<float>, label int, score string, id string, rank string, cluster string"


def _rows() -> list[tuple]:
    rng = np.random.default_rng(8)
    base = rng.normal(size=(70, 8))
    base[20:30] = base[3] + 0.01 * rng.normal(size=(10, 8))
    base[30:36] = base[4]  # ties
    found = [(k, [float(x) for x in v], k % 3, "s", "i", "r", "c") for k, v in enumerate(base)]
    odd = [(70, None, 0), (71, [0.0] * 8, 0), (72, [float("nan")] * 8, 0), (73, [None] + [1.0] * 7, 1), (74, found[0][1], None), (None, found[0][1], 0), (75, [], 0)]
    odd += [(76, [float("inf")] + [1.0] * 7, 1), (77, [1.0, 2.0], 1), (80, [2.0, 1.0], 1), (81, [1.0, 1.5], 2), (79, [1e-30] * 7 + [2e-30], 2), (78, [1.0e30] * 8, 2)]
    return [*found, found[5], (6, found[9][1], 0, *found[6][3:]), *((*o, None, None, None, None) for o in odd)]


@pytest.fixture(scope="module")
def rows():
    return _rows()


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


@pytest.fixture(params=[False, True])
def tiny(request, monkeypatch):
    """The usual block sizes, and some that cut the tables into many blocks and tiles."""
    if request.param:
        for name, value in (("QUERY_BYTES", 300), ("CANDIDATE_BYTES", 500), ("COLUMN_BLOCKS", 3), ("CELLS", 1), ("PAIRS", 20)):
            monkeypatch.setattr(tiles, name, value)


def _able(rows, zero: bool, labelled: bool) -> dict[int, tuple]:
    kept: dict[int, tuple] = {}
    for key, vector, label, *_ in rows:
        if key is None or not vector or any(x is None or not math.isfinite(x) for x in vector) or labelled and label is None:
            continue
        x = [float(np.float32(c)) for c in vector]
        if zero or any(x):
            value = (label, x) if labelled else (x,)
            kept[key] = min(kept[key], value) if key in kept else value
    return kept


def test_nearest(frame, rows, tiny):
    able = {k: np.array(v[0]) for k, v in _able(rows, False, False).items()}

    def dot(a, b):
        total = 0.0
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            total += x * y
        return total

    want = {}
    for q in (k for k in able if k % 7 == 0):
        unit = {k: v / np.abs(v).max() for k, v in able.items() if len(v) == len(able[q])}
        scored = [(dot(unit[q], v) / (math.sqrt(dot(unit[q], unit[q])) * math.sqrt(dot(v, v))), k) for k, v in unit.items() if k != q]
        want[q] = sorted(scored, key=lambda s: (-round(s[0], 12), s[1]))[:5]
    out = nearest.nearest(frame, F.col("vec_id") % 7 == 0)
    assert out.columns == ["query_id", "rank", "vec_id", "score"]
    got: dict[int, list] = {}
    for r in sorted(out.collect(), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
        assert r["rank"] == len(got[r["query_id"]])
    assert got.keys() == want.keys() and len(got[77]) == 2
    for q, found in got.items():
        assert [round(s, 9) for s, _ in found] == [round(s, 9) for s, _ in want[q]]
        assert [k for _, k in found] == [k for _, k in want[q]], q


def test_nearest_empty(frame):
    assert nearest.nearest(frame.limit(0), F.col("vec_id") % 7 == 0).count() == 0
    assert nearest.nearest(frame, F.col("vec_id") < 0).count() == 0
    with pytest.raises(ValueError):
        nearest.nearest(frame.withColumn("vec_id", F.col("vec_id").cast("string")), F.lit(True))


def test_int8_bounds_hold():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 1100)) * 10.0 ** rng.integers(-200, 200, size=(40, 1))
    u = nearest.Units(np.arange(40), x, np.arange(40))
    scaled = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])
    unit = scaled / np.linalg.norm(scaled, axis=1, keepdims=True)
    near = (u.q.astype(float) @ u.q.astype(float).T) * np.outer(u.step, u.step)
    assert (np.abs(unit @ unit.T - near) <= u.lost[:, None] + u.reach[:, None] * u.lost + 1e-9).all()


def test_hard_negatives(frame, rows, tiny):
    able = {k: (label, [math.floor(256 * c) for c in x]) for k, (label, x) in _able(rows, True, True).items()}
    able = {k: v for k, v in able.items() if len(v[1]) * max(map(abs, v[1])) ** 2 <= 2**56}
    want = set()
    for a in (k for k in able if k % 5 == 0):
        label, x = able[a]
        scored = sorted((-sum(p * q for p, q in zip(x, y, strict=True)), k, other) for k, (other, y) in able.items() if k != a and len(y) == len(x))
        for minus, p, _ in [s for s in scored if s[2] == label][:5]:
            inside = [s for s in scored if s[2] != label and 50 * -minus <= 100 * -s[0] <= 95 * -minus][:3]
            want |= {(a, p, r + 1, k, -minus, -s) for r, (s, k, _) in enumerate(inside)}
    out = hard_negatives.hard_negatives(frame, F.col("vec_id") % 5 == 0)
    got = [tuple(r) for r in out.collect()]
    assert len(want) > 50 and len(got) == len(want) and set(got) == want
    assert hard_negatives.hard_negatives(frame.limit(0), F.col("vec_id") % 5 == 0).count() == 0


def test_exact_products_of_large_numbers():
    block = tiles.Block.__new__(tiles.Block)
    ids = np.arange(2)
    block.numbers = lambda name: ids
    big = hard_negatives.Whole(ids, np.array([[2.0**26 + 1, 3.0], [2.0**26 - 1, 5.0]]), block)
    assert big.scores(slice(None), big, slice(None)).tolist() == [[(2**26 + 1) ** 2 + 9, 2**52 - 1 + 15], [2**52 - 1 + 15, (2**26 - 1) ** 2 + 25]]


@pytest.mark.parametrize("k, bits", [(4, 3), (200, 6), (4, 1)])
def test_cluster(frame, rows, k, bits):
    able = {key: [math.floor(64 * c) for c in x] for key, (x,) in _able(rows, True, False).items() if len(x) == 8}
    able = {key: np.array(x) for key, x in able.items() if max(map(abs, x)) <= 2**26}
    centers = [able[key] for key in sorted(able, key=lambda v: hashlib.sha256(f"1:{v}".encode()).hexdigest())[:k]]
    near = lambda x: min((int(((x - c) ** 2).sum()), i) for i, c in enumerate(centers))
    for _ in range(3):
        groups: dict[int, list] = {}
        for x in able.values():
            groups.setdefault(near(x)[1], []).append(x)
        centers = [sum(groups[i]) // len(groups[i]) if i in groups else c for i, c in enumerate(centers)]
    placed = {key: near(x) for key, x in able.items()}
    got = {r["vec_id"]: r for r in centroids.cluster(frame, k=k, dims=8, bits=bits).collect()}
    assert got.keys() == placed.keys()
    for key, r in got.items():
        assert (r["distance"], r["cluster"]) == placed[key]
        assert r["cluster_inertia"] == sum(d for d, c in placed.values() if c == r["cluster"]) and r["inertia"] == sum(d for d, _ in placed.values())
        assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, centers[r["cluster"]].tolist())).encode()).hexdigest()


def test_cluster_without_vectors(frame):
    assert centroids.cluster(frame.limit(0)).count() == 0 and centroids.cluster(frame).count() == 0


@pytest.mark.parametrize("bits", [1, 4, 6])
def test_cells_bound_distances(bits):
    rng = np.random.default_rng(3)
    x = rng.integers(-40, 40, size=(300, 5))
    x[:, 2] = 7  # one value only
    cells = Cells(x[:50], x.min(axis=0), x.max(axis=0), bits)
    codes = cells.decode(cells.encode(x))
    for centers in (x[:6], rng.integers(-60, 60, size=(6, 5))):
        able = possible(cells.tables(centers), codes)
        distance = ((x[:, None, :] - centers) ** 2).sum(axis=2)
        assert (able | (distance > distance.min(axis=1, keepdims=True))).all()
        assert bits == 1 or able.mean() < 0.95
