import numpy as np
import pytest
from pyspark.sql import functions as F

from flowsift.operators import density
from flowsift.operators.components import connected
from flowsift.operators.density import (
    density_clusters, density_noise, distance_curve, eps_components, nearest_distances, number_clusters,
)
from flowsift.operators.elbow import choose_epsilon, elbow, sorted_ranks
from flowsift.operators.lof import local_outlier_factor
from flowsift.operators.vectors import distinct_vectors, members

from .helpers import as_points, as_vectors, distance_matrix, random_groups


def elbow_position(y, x1=2, x2=30):
    y = np.asarray(y, float)
    x = np.arange(len(y)) + 2
    dy, dx = y[-1] - y[0], x2 - x1
    far = np.abs(dy * x - dx * y + x2 * y[0] - y[-1] * x1) / np.hypot(dy, dx)
    return int(far.argmax())


def components(d, eps):
    label = list(range(len(d)))
    changed = True
    while changed:
        changed = False
        for i in range(len(d)):
            low = min(label[j] for j in np.flatnonzero(d[i] <= eps))
            if low < label[i]:
                label[i], changed = low, True
    return label


def test_elbow_first_of_ties(spark):
    rows = [(g, i, float(y)) for g, c in enumerate([[9, 4, 2, 1, 1], [3, 3, 3], [0, 1, 5, 50]]) for i, y in enumerate(c)]
    got = {r.g: r.i for r in elbow(spark.createDataFrame(rows, "g int, i int, y double"), ["g"]).collect()}
    assert got == {0: elbow_position([9, 4, 2, 1, 1]), 1: 0, 2: elbow_position([0, 1, 5, 50])}


@pytest.mark.parametrize("marks", [1, 7, 256])
def test_ranks(spark, marks):
    rng = np.random.default_rng(3)
    values = [(g, float(v), 1) for g in range(3) for v in rng.integers(0, 40, 200)]
    got = sorted_ranks(spark.createDataFrame(values, "g int, y double, cnt long"), ["g"], "y", marks).collect()
    for g in range(3):
        ordered = sorted(v for h, v, _ in values if h == g)
        mine = {r.y: (r.lo, r.hi) for r in got if r.g == g}
        assert mine == {v: (ordered.index(v), ordered.index(v) + ordered.count(v) - 1) for v in set(ordered)}


@pytest.mark.parametrize("block", [1024, 8])
def test_density_equals_brute_force(spark, block):
    groups = random_groups(seed=11, groups=3, rows=70)
    vectors = as_vectors(spark, groups)
    unique = distinct_vectors(vectors, ["g"])
    near = nearest_distances(unique, ["g"], block)
    eps = choose_epsilon(distance_curve(near, ["g"]), ["g"])
    labels = density_clusters(unique, near, eps, ["g"], block)
    per_entity = members(vectors, unique, ["g"]).join(labels, ["g", "id"])
    got = {(r.g, r.entity): r.cluster for r in per_entity.collect()}
    chosen = {r.g: (r.i, r.eps) for r in eps.collect()}
    noise = {(r.g, r.id) for r in density_noise(near, eps, ["g"]).collect()}
    for g, m in groups.items():
        ids, _, d = distance_matrix(m)
        near_d = np.where(np.eye(len(d), dtype=bool), np.inf, d).min(axis=1)
        i = elbow_position(np.sort(near_d))
        assert chosen[g][0] == i
        e = chosen[g][1]
        assert e == pytest.approx(np.sort(near_d)[i] or 0.3)
        label = components(d, e + 1e-12)
        want = {}
        for i, name in enumerate(ids):
            want.setdefault(label[i], set()).add(name)
        mine = {}
        for name in ids:
            c = got[g, name]
            mine.setdefault(c if c >= 0 else name, set()).add(name)
        assert sorted(map(sorted, want.values())) == sorted(map(sorted, mine.values()))
        assert {n for n in ids if got[g, n] < 0} == {n for h, n in noise if h == g}
        firsts = [min(s) for c, s in sorted(mine.items(), key=lambda t: str(t[0])) if not isinstance(c, str)]
        assert firsts == sorted(firsts)


def test_eps_larger_than_everything_is_one_component(spark):
    points = as_points(spark, random_groups(seed=2, groups=1, rows=50, copies=False))
    eps = spark.createDataFrame([(0, 1e6)], "g int, eps double")
    assert {r.root for r in eps_components(points, eps, ["g"], block=5).collect()} == {"e0_000"}


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(0, f"n{i:03d}", f"n{i + 1:03d}") for i in range(60)]
    star = [(1, f"s{i:02d}", "t") for i in range(20)]
    edges = spark.createDataFrame(chain + star, "g int, a string, b string")
    got = {(r.g, r.id): r.root for r in connected(edges, ["g"]).collect()}
    assert {v for (g, _), v in got.items() if g == 0} == {"n000"}
    assert {v for (g, _), v in got.items() if g == 1} == {"s00"}
    assert len(got) == 61 + 21


@pytest.mark.parametrize("block", [1024, 8])
def test_lof_equals_brute_force(spark, block):
    groups = random_groups(seed=5, groups=2, rows=40)
    groups[2] = {f"x{i}": np.array([float(i), 0, 0, 0]) for i in range(5)}
    groups[3] = {f"x{i}": np.array([float(i * i), 0, 0, 0]) for i in range(6)}
    got = {(r.g, r.id): r.score for r in local_outlier_factor(as_points(spark, groups), ["g"], block=block).collect()}
    for g, m in groups.items():
        ids, _, d = distance_matrix(m)
        if len(ids) <= 5:
            assert all(got[g, n] == 0 for n in ids)
            continue
        np.fill_diagonal(d, np.inf)
        near = d.argsort(axis=1, kind="stable")[:, :5]
        nd = np.take_along_axis(d, near, axis=1)
        lrd = 1 / (np.maximum(nd[:, 4][near], nd).mean(axis=1) + 1e-10)
        want = -(lrd[near] / lrd[:, None]).mean(axis=1)
        for i, n in enumerate(ids):
            assert got[g, n] == pytest.approx(want[i], rel=1e-6), (g, n)


def test_the_largest_component_and_noise_look_nowhere(spark, monkeypatch):
    """A long bent chain, a few short ones and scattered noise: same components, few visits."""
    rng = np.random.default_rng(12)
    t = np.linspace(0, 20, 500)
    chain = np.stack([t, np.sin(t)], 1)
    short = np.concatenate([np.stack([np.linspace(k, k + 0.5, 12), np.full(12, 4.0 + k % 3)], 1) for k in range(8)])
    noise = rng.uniform(-40, -5, (60, 2))
    x = np.concatenate([chain, short, noise])
    rows = [(0, f"e{i:04d}", [float(c) for c in v], 1.0) for i, v in enumerate(x)]
    points = spark.createDataFrame(rows, "g int, id string, vec array<double>, weight double")
    eps = spark.createDataFrame([(0, 0.25)], "g int, eps double")
    near = nearest_distances(points, ["g"], 32)
    made, plain = [], density.reach

    def counted(at, asking, *args):
        lists = plain(at, asking, *args)
        made.append((asking.count(), lists.count(), at.table.count()))
        return lists

    monkeypatch.setattr(density, "reach", counted)
    got = {r.id: r.root for r in eps_components(points, eps, ["g"], 32, None, near).collect()}
    label = components(np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)), 0.25)
    assert [got[r[1]] for r in rows] == [rows[i][1] for i in label]
    asked, visits, n = made[0]
    assert asked < 120 and visits < len(x) * n / 20
