"""Embeddings against brute force; registered queries against SQL; the pipeline against its own rules."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowsift.llm import rabitq
from flowsift.llm.queries import ORACLES, QUERIES
from tests.oracle import compare, duck

SF = os.environ.get("QUERY_SF_DIR", "/root/testdata/sf0.001")
here = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


def brute(vectors):
    ids = [i for i, v in vectors if v is not None and len(v) and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    known = {i: np.array(v, np.float32).astype(float) for i, v in vectors if i in ids}
    links = {i: {j for j in ids if j != i and len(known[i]) == len(known[j]) and known[i] @ known[j] / np.linalg.norm(known[i]) / np.linalg.norm(known[j]) >= 0.95} for i in ids}
    root = {i: i for i, _ in vectors}
    for _ in ids:
        for i in ids:
            for j in links[i]:
                root[i] = root[j] = min(root[i], root[j])
    return {(i, len(links.get(i, ())), root[i], root[i] == i) for i, _ in vectors}


@pytest.mark.parametrize("block", [512, 16])
def test_embeddings_equal_brute_force(spark, block):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(12, 24))
    rows = [(int(i), [float(c) for c in np.float32(centres[i % 12] + rng.normal(0, 0.12 if i % 3 else 0.35, 24))]) for i in range(240)]
    rows += [(300, rows[0][1]), (301, [2 * c for c in rows[0][1]]), (302, None), (303, []), (304, [0.0] * 24), (305, [None] + [1.0] * 23)]
    rows += [(306, [float("nan")] * 24), (307, [float("inf")] + [1.0] * 23), (308, [1.0, 2.0]), (309, [1.0, 2.01]), (310, [1.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, h1 string")
    got = {tuple(r) for r in rabitq.embedding_duplicates(df.union(df.limit(1)), rabitq.EmbeddingDup(block=block)).collect()}
    assert got == brute(rows)


def test_an_id_with_several_vectors(spark):
    """A row for each of its vectors with that vector's links, one component through all, and no neighbour counted twice."""
    rng = np.random.default_rng(5)
    one, two = rng.normal(size=(2, 24))
    near = lambda v: [float(c) for c in v + rng.normal(0, 0.01, 24)]
    rows = [(i, near(one)) for i in range(1, 42)] + [(7, near(one))]
    rows += [(50, near(two)), (51, near(two)), (41, near(two)), (60, [float(c) for c in -one]), (61, [float(c) for c in -one]), (61, [float(c) for c in -two])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in rabitq.embedding_duplicates(df.repartition(5)).collect())
    want = [(i, 41, 1) for i in range(1, 42)] + [(7, 41, 1), (41, 2, 1), (50, 2, 1), (51, 2, 1), (60, 1, 60), (61, 0, 60), (61, 1, 60)]
    assert got == sorted(want)


def test_embeddings_of_an_empty_table(spark):
    assert rabitq.embedding_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_estimate_is_unbiased_and_bounded():
    rng = np.random.default_rng(1)
    x = rng.normal(size=64)
    x /= np.linalg.norm(x)
    y = 0.6 * x + 0.8 * np.linalg.qr(np.stack([x, rng.normal(size=64)], 1))[0][:, 1]
    found = []
    for number in range(400):
        r = rabitq.rotation(64, number, 3)
        signs = np.where(r @ y >= 0, 1, -1) / 8
        found.append((r @ x) @ signs / ((r @ y) @ signs))
    assert abs(np.mean(found) - 0.6) < 0.03 and np.std(found) < 0.12


@here
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    assert compare(spark, duck(SF), name, QUERIES[name], ORACLES[name], SF) is None


@here
def test_other_queries_cover_their_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids = sorted(r.doc_id for r in docs.select("doc_id").collect())
    for name in ("op2_toxicity", "op3_quality", "op9_sharding"):
        assert sorted(r.doc_id for r in QUERIES[name](spark, SF).select("doc_id").collect()) == ids
    bench = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    found = {(r.doc_id, r.item_id) for r in QUERIES["op1_decontaminate"](spark, SF).collect()}
    assert found >= {(d, i) for d, t in texts.items() for i, b in bench.items() if b in t and len(b.split()) >= 8}


@here
def test_pipeline_stages_take_effect(spark, tmp_path):
    import corpus_pipeline as P
    from tests.llm.test_text_operators import brute_lines, shingle_set

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, results = docs.columns, []
    for number, (_, stage) in enumerate(P.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(number)))
        docs = spark.read.parquet(str(tmp_path / str(number)))
        results.append(docs)
    assert all(r.columns == columns for r in results[:-1])
    kept = [{r.doc_id: r.text for r in x.collect()} for x in results[:-1]]
    good = {r.doc_id for r in QUERIES["op3_quality"](spark, SF).filter("predicted = 1").collect()}
    assert set(kept[0]) == good
    short = {i: s for i, _, s in brute_lines(list(kept[0].items()))}
    assert kept[1] == {i: s for i, s in short.items() if s == kept[0][i] or s.strip()}
    sets = {i: shingle_set(t) for i, t in kept[1].items()}
    for i in set(kept[1]) - set(kept[2]):
        assert any(j < i and 100 * len(sets[i] & s) >= 75 * len(sets[i] | s) for j, s in sets.items()) or sets[i]
    stay = sorted(kept[2])
    for a in stay:
        for b in stay:
            assert a >= b or not sets[a] or not sets[b] or 100 * len(sets[a] & sets[b]) < 75 * len(sets[a] | sets[b])
    bench = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert all(b not in t for t in kept[3].values() for b in bench if len(b.split()) >= 8)
    assert {r.doc_id for r in results[4].collect()} == set(kept[3])
    assert results[4].agg(F.count("*")).first()[0] == P.run(spark, SF).count()
