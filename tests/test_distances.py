"""Distance joins against brute force, with blocks, salts and parts forced to be small."""

from __future__ import annotations

import math
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from featshift.operators import blocks as B
from featshift.operators import divergence as D
from featshift.operators.spanning import minimum_spanning_tree, spanning_bayes_bounds, spanning_divergence
from featshift.operators.transport import directional_wasserstein


@pytest.fixture
def tiny_blocks(monkeypatch):
    monkeypatch.setattr(B, "PIVOT_ROWS", 8)
    monkeypatch.setattr(B, "BLOCK_ROWS", 10)
    monkeypatch.setattr(B, "TASK_ROWS", 16)


def frame(spark, x, start=0, tags=None):
    rows = [(start + i, [float(v) for v in row], *([int(tags[i])] if tags is not None else [])) for i, row in enumerate(x)]
    return spark.createDataFrame(rows, "id bigint, vec array<double>" + (", tag int" if tags is not None else ""))


def samples():
    rng = np.random.default_rng(4)
    clusters = np.vstack([rng.normal(c, 0.3, (60, 3)) for c in (0, 4, 20)])
    third_copies = np.vstack([np.tile([[1.0, 2.0]], (70, 1)), rng.integers(0, 5, (140, 2)).astype(float)])
    one_ring = np.column_stack([np.cos(np.arange(150)), np.sin(np.arange(150))])
    far_away = rng.normal(0, 1, (90, 2)) + 1e6
    return {"clusters": clusters, "third_copies": third_copies, "one_ring": one_ring, "far_away": far_away}


SAMPLES = samples()


def distances(a, b):
    return np.sqrt(((a[:, None] - b[None]) ** 2).sum(-1))


@pytest.mark.parametrize("name", sorted(SAMPLES))
@pytest.mark.parametrize("k,own", [(1, False), (4, True)])
def test_knn(spark, tiny_blocks, name, k, own):
    x = SAMPLES[name]
    queries, points = (frame(spark, x), frame(spark, x)) if own else (frame(spark, x[::2]), frame(spark, x[1::2]))
    a, b = (x, x) if own else (x[::2], x[1::2])
    d = distances(a, b)
    if own:
        np.fill_diagonal(d, np.inf)
    want = {}
    for i in range(len(a)):
        order = sorted(range(len(b)), key=lambda j: (d[i, j], j))[:k]
        want.update({(i, rank + 1): (j, d[i, j]) for rank, j in enumerate(order)})
    got = {(r["id"], r["rank"]): (r["neighbour"], r["distance"]) for r in B.knn_join(queries, points, k, own).collect()}
    assert got.keys() == want.keys()
    assert all(got[key][0] == want[key][0] and math.isclose(got[key][1], want[key][1], abs_tol=1e-9) for key in want)


def test_a_small_piece_copies_no_row_for_every_pair():
    """4,000 points against 80 in 64 dimensions: each copy of all pairs' rows would take 164 MB."""
    rng = np.random.default_rng(1)
    left, right = (pd.DataFrame({"id": np.arange(n), "vec": list(rng.normal(size=(n, 64)))}) for n in (4000, 80))
    tracemalloc.start()
    r, s, d = B.nearest_in_piece(left, right, 10, False)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6 and len(r) == 40_000
    far = distances(B.matrix(left["vec"][:50]), B.matrix(right["vec"]))
    assert np.allclose(d[:500].reshape(50, 10), np.sort(far, axis=1)[:, :10])
    assert (s[:500].reshape(50, 10) == np.argsort(far, axis=1)[:, :10]).all()


def test_rows_found_in_a_piece_are_thinned_on_the_way(spark, tiny_blocks, monkeypatch):
    """However many blocks a piece has, no more than a few rows of each query point are held at once."""
    monkeypatch.setattr(B, "FOUND_ROWS", 1)
    monkeypatch.setattr(B, "TASK_ROWS", 1000)
    x = np.random.default_rng(2).normal(size=(150, 6))
    index = B.build_index(frame(spark, x))
    seen = "id bigint, neighbour bigint, distance double, most bigint"

    def pairs(left, right):
        r, s, d = B.nearest_in_piece(left, right, 2, False)
        return pd.DataFrame({"id": left["id"].to_numpy()[r], "neighbour": right["id"].to_numpy()[s], "distance": d, "most": 0})

    def best(found):
        kept = found.sort_values(["id", "distance"]).groupby("id").head(2)
        return kept.assign(most=max(found["most"].max(), found.groupby("id").size().max()))

    def most_blocks(m, at, _):
        return np.random.default_rng(3).random(at.low.shape) < 0.8

    got = B.visit_blocks(index, frame(spark, x), most_blocks, pairs, seen, after=best).toPandas()
    assert len(index.map.count) > 8 and got["most"].max() <= 4
    found = B.knn_join(frame(spark, x), frame(spark, x), 2).orderBy("id", "rank").toPandas()
    assert (found["neighbour"].to_numpy().reshape(150, 2) == np.argsort(distances(x, x), axis=1)[:, :2]).all()


def test_knn_with_fewer_points_than_k(spark):
    found = B.knn_join(frame(spark, [[0.0]]), frame(spark, [[1.0], [3.0]]), 5).orderBy("rank").collect()
    assert [(r["neighbour"], r["distance"]) for r in found] == [(0, 1.0), (1, 3.0)]


def test_dimension_mismatch(spark):
    with pytest.raises(ValueError):
        B.knn_join(frame(spark, [[0.0]]), frame(spark, [[1.0, 2.0]]), 1)
    with pytest.raises(ValueError):
        D.knn_kl(frame(spark, [[0.0]]), frame(spark, [[1.0, 2.0]]))


@pytest.mark.parametrize("name", sorted(SAMPLES))
def test_counts_within_radii(spark, tiny_blocks, name):
    x = SAMPLES[name]
    tags = np.arange(len(x)) % 3
    points = frame(spark, x, tags=tags)
    radii = (0.0, 1.0, 2.5, 1e9)
    got = {(r["id"], r["tag"]): [r[f"c{i}"] for i in range(4)] for r in B.neighbour_counts(points, B.fold_copies(points, "tag"), radii).collect()}
    d = distances(x, x)
    for i in range(len(x)):
        for t in range(3):
            want = [int(((d[i] <= h) & (tags == t)).sum()) for h in radii]
            assert got.get((i, t), [0, 0, 0, 0]) == want
    others = {r["id"]: [r[f"c{i}"] for i in range(4)] for r in B.neighbour_counts(points, B.fold_copies(points, "tag"), radii, True).collect()}
    for i in range(len(x)):
        assert others[i] == [int(((d[i] <= h) & (tags != tags[i])).sum()) for h in radii]


def test_kernel_sums_leave_one_out(spark, tiny_blocks):
    x = SAMPLES["third_copies"]
    tags = np.arange(len(x)) % 2
    folded = B.fold_copies(frame(spark, x, tags=tags), "tag")
    got = {(r["id"], r["tag"]): r["kernel"] for r in B.kernel_sums(folded, folded, 0.7).collect()}
    kernel = np.exp(-distances(x, x) ** 2 / (2 * 0.49))
    np.fill_diagonal(kernel, 0.0)
    for r in folded.collect():
        for t in (0, 1):
            assert got.get((r["id"], t), 0.0) == pytest.approx(kernel[r["id"], tags == t].sum(), abs=1e-12)


def test_a_point_is_sent_once_for_blocks_that_lie_together(spark, tiny_blocks):
    """In high dimension all blocks are visited; every point meets all points, but is not copied for each block."""
    x = np.random.default_rng(12).normal(size=(240, 12))
    points = frame(spark, x)
    index = B.build_index(points)
    blocks = len(index.map.count)

    def meet(left, right):
        return pd.DataFrame({"id": left["id"], "met": np.full(len(left), len(right), dtype=np.int64)})

    def everywhere(m, at, batch):
        return np.ones(at.low.shape, dtype=bool)

    found = B.visit_blocks(index, points, everywhere, meet, "id bigint, met bigint")
    per_point = found.groupBy("id").agg(F.count("*").alias("times"), F.sum("met").alias("met")).collect()
    assert len(per_point) == 240 and {row["met"] for row in per_point} == {240}
    assert max(row["times"] for row in per_point) <= 0.75 * blocks


def test_pieces_hold_neighbouring_blocks_up_to_their_rows():
    piece, mark = B.share_pieces(np.array([3, 4, 5, 30, 1, *[0] * 70]), 12)
    assert piece[:5].tolist() == [0, 0, 0, 1, 2] and mark[:5].tolist() == [0, 1, 2, 0, 0]
    assert mark.max() == B.MARKS - 1 and piece.max() == 3


def test_a_block_in_demand_is_salted(spark, tiny_blocks):
    """All queries want the same few points."""
    queries, points = frame(spark, np.zeros((200, 2))), frame(spark, SAMPLES["clusters"][:, :2])
    found = B.knn_join(queries, points, 2)
    assert found.count() == 400 and found.select("neighbour").distinct().count() == 2


def test_kl_of_a_half_split_is_small_and_grows_with_a_shift(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(0, 1, (400, 2))
    p, q, far = frame(spark, base[:200]), frame(spark, base[200:]), frame(spark, base[200:] + 2.0)
    near, away = (D.knn_kl(p, other, 3).first() for other in (q, far))
    assert abs(near["kl"]) < 0.3 and away["kl"] > 1.0
    assert near["zero_own"] == near["zero_other"] == 0
    assert D.knn_kl_symmetric(p, far, 3).first()["divergence"] > away["kl"]


def test_zero_distances_are_reported(spark):
    copies = frame(spark, np.zeros((5, 2)))
    row = D.knn_kl(copies, copies, 1).first()
    assert row["zero_own"] == row["zero_other"] == 5


def test_bayes_errors_of_far_and_equal_classes(spark):
    rng = np.random.default_rng(6)
    tags = np.arange(300) % 2
    apart = frame(spark, rng.normal(0, 1, (300, 2)) + 30.0 * tags[:, None], tags=tags)
    same = frame(spark, rng.normal(0, 1, (300, 2)), tags=tags)
    assert D.ensemble_bayes_error(apart, rule="manual").first()["ber"] < 0.05
    assert D.ensemble_bayes_error(same, rule="cv").first()["ber"] > 0.3
    assert D.kde_bayes_error(apart, 1.0).first()["ber"] == 0
    assert D.kde_bayes_error(same, 0.5).first()["ber"] > 0.3
    low, high = D.knn_bayes_bounds(same).first()
    assert 0.2 < low <= high < 0.7
    assert tuple(D.knn_bayes_bounds(apart).first()) == (0.0, 0.0)


def test_bandwidth_rules(spark):
    points = frame(spark, np.random.default_rng(7).normal(0, 1, (120, 2)))
    assert D.bandwidth(points, "cv") == D.bandwidth_cv(points)
    assert D.bandwidth(points) == D.bandwidth_nn(points)
    assert D.bandwidth(points, "nn") == D.bandwidth_nn(points, 10) > 0
    with pytest.raises(ValueError):
        D.bandwidth(points, "guess")


def kruskal(x):
    d = distances(x, x)
    parent = list(range(len(x)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    out = set()
    for w, i, j in sorted((d[i, j], i, j) for i in range(len(x)) for j in range(i + 1, len(x))):
        if root(i) != root(j):
            parent[root(i)] = root(j)
            out.add((i, j))
    return out


@pytest.mark.parametrize("name", ["clusters", "third_copies"])
def test_spanning_tree_is_the_unique_one(spark, tiny_blocks, name):
    x = SAMPLES[name]
    got = minimum_spanning_tree(frame(spark, x), k=3).collect()
    assert {(r["src"], r["dst"]) for r in got} == kruskal(x) and len(got) == len(x) - 1


def test_spanning_divergence_of_far_samples(spark):
    rng = np.random.default_rng(8)
    a, b = rng.normal(0, 1, (40, 2)), rng.normal(0, 1, (40, 2))
    far = spanning_divergence(frame(spark, a), frame(spark, b + 50))
    row = far.first()
    assert row["cross_edges"] == 1 and row["divergence"] == 1.0 and row["edges"] == 79
    assert tuple(spanning_bayes_bounds(far).first()) == (0.0, 0.0)


def wasserstein(a, b):
    grid = np.unique(np.concatenate([np.arange(1, len(a) + 1) / len(a), np.arange(1, len(b) + 1) / len(b)]).round(12))
    a, b, before, total = np.sort(a), np.sort(b), 0.0, 0.0
    for u in grid:
        mid = (before + u) / 2
        total += (u - before) * (a[int(mid * len(a))] - b[int(mid * len(b))]) ** 2
        before = u
    return total


@pytest.mark.parametrize("n,m", [(60, 60), (50, 37)])
def test_transport_cost(spark, n, m):
    rng = np.random.default_rng(9)
    a, b = np.vstack([np.zeros((n // 3, 2)), rng.normal(0, 1, (n - n // 3, 2))]), rng.integers(0, 4, (m, 2)).astype(float)
    axes = [[1.0, 0.0], [0.6, 0.8]]
    got = {r["projection"]: r["cost"] for r in directional_wasserstein(frame(spark, a), frame(spark, b), axes).collect()}
    for j, axis in enumerate(axes):
        assert got[j] == pytest.approx(wasserstein(a @ np.array(axis), b @ np.array(axis)), rel=1e-9)


@pytest.mark.parametrize("dim, spread, most", [(4, 1.0, 0.15), (16, 0.02, 0.3)])
def test_two_passes_reach_all_neighbours_in_few_blocks(dim, spread, most):
    rng = np.random.default_rng(dim)
    centres = rng.random((64, dim))
    x = rng.random((20_000, dim)) if spread == 1.0 else centres[rng.integers(64, size=20_000)] + spread * rng.normal(size=(20_000, dim))
    pivots, k = x[:100], 5
    cell = B.squared_distances(x, pivots).argmin(axis=1)
    radius = B.exact_distances(x, pivots[cell])
    inner, outer = (np.array([f(radius[cell == c]) for c in range(100)]) for f in (np.min, np.max))
    m = B.BlockMap(pivots, [], np.arange(100), inner, outer, np.bincount(cell, minlength=100), np.zeros((100, 1)))
    q = x[-300:]
    distances = np.sqrt(B.squared_distances(q, x))
    at = m.bounds(q)
    first = B.first_blocks(m, at, k)
    reach = np.array([np.sort(distances[i][first[i][cell]])[k - 1] for i in range(len(q))])
    both = first | B.other_blocks(m, at, k, reach)
    nearest = np.argsort(distances, axis=1)[:, :k]
    assert both[np.arange(len(q))[:, None], cell[nearest]].all()
    assert not (first & B.other_blocks(m, at, k, reach)).any() and both.mean() < most


def test_blocks_of_far_pivots_are_not_looked_at(spark, monkeypatch):
    """In low dimension bounds are taken around near pivots only, and neighbours are those of all pairs."""
    rng = np.random.default_rng(8)
    pivots = rng.random((300, 3))
    of = np.sort(np.concatenate([np.arange(300), rng.integers(0, 300, 200)]))
    inner = rng.random(500) / 10
    count = rng.integers(0, 3, 500)
    m = B.BlockMap(pivots, list(range(300)), of, np.where(count > 0, inner, np.inf), np.where(count > 0, inner + 0.05, 0.0), count, count[:, None])
    at = m.bounds(rng.random((200, 3)))
    reach = rng.random(200) / 5
    monkeypatch.setattr(B, "NEAR_PIVOTS", 4)
    assert m.few_rings()
    near, first = B._within(m, at, reach), B.first_blocks(m, at, 5)
    others = B.other_blocks(m, at, 5, reach)
    if ((first * count).sum(axis=1) >= 5).all():
        assert (near & first & others).sum() == 0
    assert (near[:, count > 0] == (at.low <= reach[:, None])[:, count > 0]).all()
    assert ((first * count).sum(axis=1) >= 5).all() and not first[:, count == 0].any()
    rows = [(i, [float(v) for v in rng.random(3) ** 3]) for i in range(900)]
    monkeypatch.setattr(B, "PIVOT_ROWS", 4)
    monkeypatch.setattr(B, "BLOCK_ROWS", 4)
    index = B.build_index(spark.createDataFrame(rows, "id long, vec array<double>"))
    x = np.array([v for _, v in rows])
    bounds = index.map.bounds(x)
    assert index.map.few_rings() and len(index.map.count) > 150
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    kth = np.sort(d, axis=1)[:, 3]
    block = {r["id"]: r["block"] for r in index.points.collect()}
    mask = B.first_blocks(index.map, bounds, 4) | B.other_blocks(index.map, bounds, 4, kth)
    for i in range(900):
        assert all(mask[i, block[j]] for j in np.flatnonzero(d[i] <= kth[i]))
    assert mask.sum() < 0.3 * mask.size
