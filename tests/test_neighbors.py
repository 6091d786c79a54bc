import os
from collections import Counter

import numpy as np
import pytest

from flowsift.operators import cells
from flowsift.functions.kernels import nearest_by_products, nearest_in_block
from flowsift.operators.approximate import approximate_nearest, share_step, tables_for
from flowsift.operators.cells import nearest, spread_picks
from flowsift.plans.catalog import embedding_points

from .helpers import as_points, distance_matrix, random_groups


@pytest.mark.parametrize("block", [1024, 16, 4])
@pytest.mark.parametrize("k", [1, 5])
def test_nearest_equals_brute_force(spark, k, block):
    groups = random_groups(seed=k)
    got = {}
    for r in nearest(as_points(spark, groups), ["g"], k=k, block=block).collect():
        got.setdefault((r.g, r.id), []).append((r.d, r.nid))
    for g, m in groups.items():
        ids, _, d = distance_matrix(m)
        np.fill_diagonal(d, np.inf)
        for i, name in enumerate(ids):
            want = np.sort(d[i])[:k]
            assert np.allclose(sorted(v for v, _ in got[g, name]), want, atol=1e-12)
            assert len({n for _, n in got[g, name]} - {name}) == k


@pytest.mark.parametrize("block", [1024, 8])
def test_ward_cost_neighbours(spark, block):
    groups = random_groups(seed=7, groups=2, copies=False)
    rng = np.random.default_rng(1)
    weights = {g: rng.integers(1, 50, len(m)).astype(float) for g, m in groups.items()}
    rows = [(g, e, [float(c) for c in v], float(w)) for g, m in groups.items() for (e, v), w in zip(m.items(), weights[g])]
    points = spark.createDataFrame(rows, "g int, id string, vec array<double>, weight double")
    got = {(r.g, r.id): r.d for r in nearest(points, ["g"], block=block, ward=True).collect()}
    for g, m in groups.items():
        ids, _, d = distance_matrix(m)
        w = weights[g]
        cost = d**2 * w[:, None] * w[None, :] / (w[:, None] + w[None, :])
        np.fill_diagonal(cost, np.inf)
        for i, name in enumerate(ids):
            assert got[g, name] == pytest.approx(cost[i].min(), abs=1e-12)


def test_visits_are_few_and_stored_without_vectors(spark, monkeypatch):
    """Clumps far apart: a vector looks into few of the cells, and lists of visits hold ids only."""
    rng = np.random.default_rng(3)
    centres = rng.random((40, 3)) * 100
    rows = [(0, f"e{i:04d}", [float(c) for c in centres[i % 40] + rng.normal(0, 0.5, 3)], 1.0) for i in range(900)]
    points = spark.createDataFrame(rows, "g int, id string, vec array<double>, weight double")
    made, pivots, plain = [], [], cells.reach

    def counted(at, *args, **more):
        lists = plain(at, *args, **more)
        assert lists.columns == ["g", "id", "cell"]
        made.append(lists.count())
        pivots.append(at.table.count())
        return lists

    monkeypatch.setattr(cells, "reach", counted)
    found = {r.id: r.d for r in nearest(points, ["g"], block=64).collect()}
    x = np.array([r[2] for r in rows])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    assert np.allclose([found[r[1]] for r in rows], d.min(1))
    assert 25 <= pivots[0] <= 30 and sum(made) < 900 * pivots[0] / 5


def test_picks_are_spread():
    x = np.array([[0.0], [0.1], [0.2], [0.3], [9.0], [5.0], [0.4]])
    assert spread_picks(x, 4) == [0, 1, 4, 5]
    assert spread_picks(np.zeros((5, 2)), 4) == [0, 1]


@pytest.mark.parametrize("k", [1, 5])
def test_products_decide_as_differences_do(k):
    rng = np.random.default_rng(k)
    x = np.round(rng.normal(size=(400, 12)), 1) + 50
    x[7:60] = x[6]
    x[99, 3] = np.nan
    own, edges = np.arange(400), np.array([0, 150, 151, 400])
    good = np.flatnonzero(np.isfinite(x).all(axis=1))
    at, d = nearest_in_block(x[good], x[good], np.arange(len(good)), k)
    for bound in (np.full(400, np.inf), np.full(400, d.max())):
        got, dist = nearest_by_products(x, x, own, k, bound, own, edges)
        assert (got[good] == good[at]).all() and (dist[good] == d).all() and np.isinf(dist[99]).all()


def test_vectors_without_structure_travel_once_per_block(spark, monkeypatch):
    """Nothing can be pruned here: after the first visits vectors go through tiles, not to one cell after the other."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 24))
    x[40:60] = x[39]
    rows = [(0, f"e{i:04d}", [float(c) for c in v], 1.0) for i, v in enumerate(x)]
    points = spark.createDataFrame(rows, "g int, id string, vec array<double>, weight double").cache()
    visits, plain = [], cells.meet
    monkeypatch.setattr(cells, "TILE_NUMBERS", 4000)  # four blocks
    monkeypatch.setattr(cells, "meet", lambda *args, **more: visits.append(1) or plain(*args, **more))
    found = {}
    for r in nearest(points, ["g"], k=3, block=32).collect():
        found.setdefault(r.id, []).append((r.d, r.nid))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    for i in range(600):
        best = np.lexsort((np.arange(600), d[i]))[:3]
        got = sorted(found[f"e{i:04d}"])
        assert [n for _, n in got] == [f"e{j:04d}" for j in best] and np.allclose([v for v, _ in got], d[i, best])
    assert len(visits) == 1


def test_large_buckets_are_searched_in_tiles(spark, monkeypatch):
    monkeypatch.setattr("flowsift.operators.approximate.BUCKET_BLOCKS", 2)
    asked = []
    monkeypatch.setattr(cells, "reach", lambda *args, **more: asked.append(1))
    points = as_points(spark, random_groups(seed=4, groups=2, rows=150)).cache()
    exact = {(r.g, r.id, round(r.d, 9)) for r in nearest(points, ["g"], k=3).collect()}
    found = {(r.g, r.id, round(r.d, 9)) for r in approximate_nearest(points, ["g"], k=3, block=8).collect()}
    assert len(exact & found) >= 0.9 * len(exact) and not asked


def recall_of(found, exact, k):
    hits = {(r.g, r.id, r.nid) for r in found} & {(r.g, r.id, r.nid) for r in exact}
    return len(hits) / len(exact)


@pytest.mark.parametrize("block", [1024, 16])
def test_approximate_neighbours_reach_the_recall(spark, block):
    points = as_points(spark, random_groups(seed=3, groups=3, rows=120, copies=False)).cache()
    exact = nearest(points, ["g"], k=3).collect()
    true = {(r.g, r.id, r.nid): r.d for r in exact}
    found = approximate_nearest(points, ["g"], k=3, recall=0.95, block=block).collect()
    assert recall_of(found, exact, 3) >= 0.9 and all(r.approximate for r in found)
    assert all(abs(true[r.g, r.id, r.nid] - r.d) < 1e-12 for r in found if (r.g, r.id, r.nid) in true)
    assert max(Counter((r.g, r.id) for r in found).values()) <= 3


def test_approximate_neighbours_of_copies_and_single_vectors(spark):
    rows = [("a", f"c{i}", [1.0, 2.0], 1.0) for i in range(40)] + [("b", "alone", [0.0], 1.0)]
    points = spark.createDataFrame(rows, "g string, id string, vec array<double>, weight double")
    found = approximate_nearest(points, ["g"], k=2, block=16).collect()
    assert len(found) == 80 and {r.d for r in found} == {0.0} and {r.g for r in found} == {"a"}
    assert approximate_nearest(points.limit(0), ["g"]).count() == 0


def test_buckets_are_shared_as_often_as_reckoned():
    rng = np.random.default_rng(0)
    a = rng.normal(size=(200_000, 8))
    apart = np.abs(a @ (np.ones(8) / np.sqrt(8)))
    assert abs((np.maximum(0, 1 - apart / 4)).mean() - share_step(4.0)) < 2e-3
    assert tables_for(0.5, 2) < tables_for(0.95, 2) < tables_for(0.95, 6)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="driver tables not present")
def test_approximate_neighbours_of_embeddings(spark):
    points = embedding_points(spark, "/root/testdata/sf0.01").cache()
    exact = nearest(points, ["g"], k=5).collect()
    assert recall_of(approximate_nearest(points, ["g"], k=5).collect(), exact, 5) >= 0.9
