import numpy as np
import pytest
from pyspark.sql import Window, functions as F

from flowsift.operators import joins, kmeans, ward
from flowsift.operators.kmeans import choose_k, cluster_profile, inertia_curve, kmeans_grid, kmeans_labels
from flowsift.operators.vectors import distinct_vectors, members
from flowsift.operators.ward import ward_clusters
from flowsift.session import cut, cut_placed

from .helpers import as_vectors, random_groups
from .test_density import elbow_position


def sequential_ward(names, x, k):
    """One closest pair at a time, on raw rows."""
    parts = [({n}, v, 1.0) for n, v in zip(names, x)]
    while len(parts) > k:
        best = None
        for i in range(len(parts)):
            for j in range(i + 1, len(parts)):
                wa, wb = parts[i][2], parts[j][2]
                c = wa * wb / (wa + wb) * ((parts[i][1] - parts[j][1]) ** 2).sum()
                if best is None or c < best[0]:
                    best = (c, i, j)
        _, i, j = best
        a, b = parts[i], parts[j]
        w = a[2] + b[2]
        parts[i] = (a[0] | b[0], (a[2] * a[1] + b[2] * b[1]) / w, w)
        del parts[j]
    return sorted(sorted(p[0]) for p in parts)


@pytest.mark.parametrize("block", [1024, 12])
def test_ward_equals_one_merge_at_a_time(spark, block):
    groups = random_groups(seed=21, groups=3, rows=50)
    ks = {0: 2, 1: 7, 2: 23}
    vectors = as_vectors(spark, groups)
    unique = cut(distinct_vectors(vectors, ["g"]))
    chosen = spark.createDataFrame(list(ks.items()), "g int, k int")
    labels = ward_clusters(unique, chosen, ["g"], block)
    got = {}
    for r in members(vectors, unique, ["g"]).join(labels, ["g", "id"]).collect():
        got.setdefault(r.g, {}).setdefault(r.cluster, set()).add(r.entity)
    for g, m in groups.items():
        want = sequential_ward(list(m), np.array(list(m.values())), ks[g])
        assert sorted(map(sorted, got[g].values())) == want
        assert sorted(got[g]) == list(range(ks[g]))


def test_ward_searches_grow_with_merges(spark, monkeypatch):
    """Each merge sends its cluster and those that had a part of it as nearest to search again, and no other."""
    points = as_vectors(spark, random_groups(seed=31, groups=1, rows=90, copies=False))
    unique = cut(distinct_vectors(points, ["g"]))
    asked, plain = [], ward.Search.among

    def counted(self, cells, queries=None):
        asked.append((cells.points if queries is None else queries).count())
        return plain(self, cells, queries)

    monkeypatch.setattr(ward.Search, "among", counted)
    chosen = spark.createDataFrame([(0, 5)], "g int, k int")
    many = {r.id: r.cluster for r in ward_clusters(unique, chosen, ["g"], 24).collect()}
    monkeypatch.undo()
    assert many == {r.id: r.cluster for r in ward_clusters(unique, chosen, ["g"], 1024).collect()}
    merges = 90 - 24
    assert asked[0] == 90 and sum(asked[1:]) <= 3 * merges


def test_ward_ties_do_not_depend_on_the_block(spark):
    """Four pairs of equal width: the cut at 5 and 6 splits those of the smallest absorbed ids."""
    rows = [(g, f"p{i}", [float(10 * (i // 2) + i % 2)], 1.0) for g in (0, 1) for i in range(8)]
    points = spark.createDataFrame(rows, "g int, id string, vec array<double>, weight double")
    chosen = spark.createDataFrame([(0, 5), (1, 6)], "g int, k int")

    def cut_at(block):
        found = ward_clusters(points, chosen, ["g"], block).collect()
        return {(r.g, r.id): r.cluster for r in found}

    whole = cut_at(1024)
    assert whole == cut_at(4)
    assert [whole[0, f"p{i}"] for i in range(8)] == [0, 1, 2, 2, 3, 3, 4, 4]
    assert [whole[1, f"p{i}"] for i in range(8)] == [0, 1, 2, 3, 4, 4, 5, 5]


@pytest.mark.parametrize("block", [1024, 16])
def test_kmeans_grid_properties(spark, block):
    groups = random_groups(seed=4, groups=2, rows=80)
    groups[2] = {f"p{i}": np.array([float(i % 5), 0, 1, 0]) for i in range(40)}
    vectors = as_vectors(spark, groups)
    unique = cut(distinct_vectors(vectors, ["g"]))
    grid = cut(kmeans_grid(unique, ["g"], restarts=3, block=block))
    rows = grid.collect()
    chosen = cut(choose_k(grid, ["g"]))
    labels = kmeans_labels(unique, grid, chosen, ["g"], block)
    label = {(r.g, r.entity): r.cluster for r in members(vectors, unique, ["g"]).join(labels, ["g", "id"]).collect()}
    picked = {r.g: r.k for r in chosen.collect()}
    for g, m in groups.items():
        x = np.array(list(m.values()))
        most = len(np.unique(x, axis=0))
        curve = {}
        for k in range(2, 30):
            mine = sorted((r.c, r.centre, r.inertia) for r in rows if r.g == g and r.k == k)
            assert len(mine) == min(k, most)
            c = np.array([v for _, v, _ in mine])
            d = ((x[:, None, :] - c[None, :, :]) ** 2).sum(-1)
            assert d.min(axis=1).sum() == pytest.approx(mine[0][2], abs=1e-9)
            curve[k] = mine[0][2]
            at = d.argmin(axis=1)
            if k < most:
                moved = np.array([x[at == j].mean(axis=0) if (at == j).any() else c[j] for j in range(len(c))])
                assert ((moved - c) ** 2).sum() <= 1e-4 * x.var(axis=0).mean() * 4
        total = ((x - x.mean(axis=0)) ** 2).sum()
        assert curve[2] < total and curve[29] <= curve[2]
        k = min(elbow_position(list(curve.values())) + 2, most)
        assert picked[g] == k
        c = np.array([v for _, v in sorted((r.c, r.centre) for r in rows if r.g == g and r.k == k)])
        for name, v in m.items():
            d = ((c - v) ** 2).sum(axis=1)
            assert d[label[g, name]] == pytest.approx(d.min(), abs=1e-12)


def test_kmeans_does_not_depend_on_the_block(spark):
    """One seeding and one arithmetic at every size: equal centres and inertia, bit for bit, with ties and copies."""
    groups = random_groups(seed=14, groups=1, rows=150)
    groups[2] = {f"q{i:03d}": np.array([float(i % 7), float(i // 7 % 6), 0.25 * (i % 2), 1.0]) for i in range(120)}
    unique = cut(distinct_vectors(as_vectors(spark, groups), ["g"]))

    def grid(block):
        rows = kmeans_grid(unique, ["g"], restarts=2, block=block, steps=5).collect()
        return {(r.g, r.k, r.c): (r.restart, tuple(r.centre), r.inertia, r.converged) for r in rows}

    whole = grid(1024)
    assert whole == grid(32)
    assert {r[3] for r in whole.values()} == {False, True}


def test_kmeans_steps_take_as_many_partitions_as_their_work(spark, monkeypatch):
    """Steps over few blocks are not dealt to all shuffle partitions, steps over many are."""
    unique = cut(distinct_vectors(as_vectors(spark, random_groups(seed=15, groups=2, rows=150)), ["g"]))
    first = unique.select("g", F.col("vec").alias("centre"), (F.row_number().over(Window.partitionBy("g").orderBy("id")) - 1).alias("c"))
    starts = cut(first.filter("c < 3").select("g", F.lit(3).alias("k"), "c", "centre"))
    elsewhere = starts.withColumn("g", F.lit(-1).cast(starts.schema["g"].dataType))  # centres of no large group
    placed = []

    def stored(df):
        placed.append(df.rdd.getNumPartitions())
        return cut_placed(df)

    monkeypatch.setattr(kmeans, "cut_placed", stored)
    before = spark.conf.get("spark.sql.shuffle.partitions")

    def grid(block, starts):
        rows = kmeans_grid(unique, ["g"], block=block, steps=4, starts=starts).collect()
        return {(r.g, r.k, r.c): (tuple(r.centre), r.inertia) for r in rows}

    try:
        spark.conf.set("spark.sql.shuffle.partitions", "24")
        assert grid(32, starts) == grid(1024, starts) and placed == [1]
        assert grid(32, elsewhere) == {} and placed == [1, 1]
        assert [joins.parts_for(spark, n, 0) for n in (0, 1, 10**9)] == [1, 1, 24]
        monkeypatch.setattr(joins, "PART", 10**5)
        assert grid(32, starts) == grid(1024, starts) and placed[2:] == [24]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_kmeans_does_not_depend_on_partitions(spark):
    vectors = as_vectors(spark, random_groups(seed=9, groups=2, rows=60))
    runs = []
    for n in (1, 7):
        unique = distinct_vectors(vectors.repartition(n), ["g"])
        curve = inertia_curve(kmeans_grid(unique, ["g"], restarts=2), ["g"]).collect()
        runs.append({(r.g, r.k): round(r.inertia, 9) for r in curve})
    assert runs[0] == runs[1] and len(runs[0]) == 56


def test_cluster_profile_keeps_telling_features(spark):
    rows = [(0, 0, [1.0, 0.1, 0.0], 3.0), (0, 0, [0.0, 0.1, 0.0], 1.0), (0, 1, [0.0, 0.15, 0.3], 1.0)]
    got = cluster_profile(spark.createDataFrame(rows, "g int, cluster int, vec array<double>, weight double"), ["g"])
    assert {(r.cluster, r.feature): r.mean for r in got.collect()} == {(0, 0): 0.75, (0, 2): 0.0, (1, 0): 0.0, (1, 2): 0.3}
