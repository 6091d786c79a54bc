import pytest

from flowsift.operators import outliers as o

KEYS = ["day", "win_sec", "win_start", "view"]


def labels(spark, *rows):
    return spark.createDataFrame([(1, 60, 0, "internal", e, a, c) for e, a, c in rows],
                                 "day int, win_sec int, win_start int, view string, entity string, algorithm string, cluster int")


def truth(spark, *ips):
    return spark.createDataFrame([(1, r, ip) for r, ip in ips], "day int, role string, ip string")


def sample(spark):
    rows = [(f"n{i}", a, 0) for i in range(7) for a in o.ALGORITHMS]
    rows += [("v", "dbscan", -1), ("m", "dbscan", -1), ("x", "dbscan", 0)]
    rows += [("v", "kmeans", 0), ("m", "kmeans", 1), ("x", "kmeans", 2)]
    rows += [("v", "agglomerative", 1), ("m", "agglomerative", 0), ("x", "agglomerative", 0)]
    return labels(spark, *rows), truth(spark, ("victim", "v"), ("victim", "x"), ("victim", "gone"), ("attacker", "nobody"))


def test_flags_and_sizes(spark):
    lab, _ = sample(spark)
    assert {(r.entity, r.algorithm) for r in o.flagged_entities(lab, KEYS).collect()} == {
        ("v", "dbscan"), ("m", "dbscan"), ("m", "kmeans"), ("x", "kmeans"), ("v", "agglomerative"),
    }
    sizes = {(r.algorithm, r.cluster): (r.size, r.outlier) for r in o.cluster_sizes(lab, KEYS).collect()}
    assert sizes["dbscan", -1] == (2, True) and sizes["dbscan", 0] == (8, False) and sizes["kmeans", 2] == (1, True)


def test_hits(spark):
    lab, known = sample(spark)
    found = o.labelled_clusters(lab, known, KEYS)
    assert found.count() == 6 and {r.role for r in found.collect()} == {"victim"}
    by = {(r.algorithm, r.cluster): r.hits for r in o.hits_by_cluster(found, KEYS).collect()}
    assert by == {("dbscan", -1): 1, ("dbscan", 0): 0, ("kmeans", 0): 0, ("kmeans", 2): 1, ("agglomerative", 1): 1, ("agglomerative", 0): 0}
    assert {r.algorithm: (r.present, r.hits) for r in o.hit_totals(found, KEYS).collect()} == dict.fromkeys(o.ALGORITHMS, (2, 1))


def test_standard_mode_counts_missed_entities(spark):
    lab, known = sample(spark)
    got = {r.algorithm: r for r in o.evaluate(lab, known, KEYS).collect()}
    assert [got["dbscan"][m] for m in o.METRICS[:4]] == [1, 1, 7, 1]
    assert [got["agglomerative"][m] for m in o.METRICS[:4]] == [1, 0, 8, 1]
    assert got["dbscan"].accuracy == pytest.approx(0.8) and got["dbscan"].f1 == pytest.approx(0.5)
    assert got["agglomerative"].precision == 1.0 and got["agglomerative"].recall == 0.5


def test_reference_mode(spark):
    lab, known = sample(spark)
    got = {r.algorithm: r for r in o.evaluate(lab, known, KEYS, "reference").collect()}
    assert [got["dbscan"][m] for m in o.METRICS[:4]] == [1, 1, 8, 0]
    assert got["dbscan"].recall == 1.0 and got["dbscan"].precision == 0.5
    assert {r.f1 for r in got.values()} == {1.0}
    with pytest.raises(ValueError):
        o.evaluate(lab, known, KEYS, "other")


def test_nothing_flagged_gives_zeros(spark):
    lab = labels(spark, *[(f"n{i}", "dbscan", 0) for i in range(5)])
    row = o.evaluate(lab, truth(spark, ("victim", "n0")), KEYS).first()
    assert (row.precision, row.recall, row.f1, row.fn, row.accuracy) == (0.0, 0.0, 0.0, 1, 0.8)


def test_scores_of_noise(spark):
    lab, known = sample(spark)
    lof = spark.createDataFrame([(1, 60, 0, "internal", "v", -1.5), (1, 60, 0, "internal", "m", -4.0)],
                                "day int, win_sec int, win_start int, view string, id string, score double")
    assert [(r.entity, r.max_score) for r in o.most_anomalous(lof, KEYS).collect()] == [("m", -4.0)]
    assert [(r.role, r.entity, r.score) for r in o.labelled_scores(lof, known, KEYS).collect()] == [("victim", "v", -1.5)]
    sheet = o.with_max_score(o.evaluate(lab, known, KEYS), lof, KEYS).collect()
    assert {r.algorithm: r.max_score for r in sheet} == {"kmeans": 0.0, "dbscan": -4.0, "agglomerative": 0.0}
