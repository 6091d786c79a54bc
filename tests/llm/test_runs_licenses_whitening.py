"""Periodic runs, license scans and whitening against brute force."""

import hashlib
import zlib

import numpy as np
import pytest

from flowsift.llm import licenses, queries, runs, whitening

ODD = "doc_id long, text string, row string, words string, doc_id_ string"


def brute_runs(codes, exponent=4, least=6):
    n, found = len(codes), []
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and codes[j] == codes[j + q]:
                j += 1
            if j - i + q >= max(least, exponent * q):
                found.append((i, j - i + q, q))
            i = j + 1
    inside = lambda x, y: y[0] <= x[0] and y[0] + y[1] >= x[0] + x[1]
    return sorted((x for x in found if not any(x[2] % y[2] == 0 and y[2] < x[2] and inside(x, y) for y in found)), key=lambda t: (t[0], t[2]))


def made(rng, n, kinds, longest):
    codes = rng.integers(0, kinds, n)
    for _ in range(rng.integers(0, 3)):
        if n > 10:
            a = rng.integers(0, n - 1)
            b = rng.integers(a + 1, n + 1)
            codes[a:b] = np.resize(codes[a : a + rng.integers(1, longest)], b - a)
    return codes


def test_tree_runs_equal_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(400):
        codes = made(rng, int(rng.integers(0, 100)), int(rng.integers(1, 5)), 14)
        assert [tuple(x) for x in runs.maximal_runs(codes).tolist()] == brute_runs(codes.tolist())
        lower = runs.Runs(exponent=2, least=2)
        assert [tuple(x) for x in runs.maximal_runs(codes, lower).tolist()] == brute_runs(codes.tolist(), 2, 2)


@pytest.mark.parametrize("tree_words", [1, 60, 1 << 14])
def test_stretches_leave_out_no_run(tree_words):
    rng = np.random.default_rng(4)
    for _ in range(100):
        docs = [made(rng, int(rng.integers(0, 400)), int(rng.integers(1, 40)), 90) for _ in range(6)]
        owner, found = runs.document_runs(np.concatenate(docs), np.repeat(np.arange(6), [len(x) for x in docs]), runs.Runs(tree_words=tree_words))
        assert [(int(d), *r) for d, r in zip(owner, found.tolist())] == [(i, *r) for i, x in enumerate(docs) for r in brute_runs(x.tolist())]


def test_extensions_equal_plain_comparison():
    rng = np.random.default_rng(5)
    codes = made(rng, 200, 2, 9)
    ext = runs.Extensions(runs.SuffixTree(codes.tolist()))
    i, j = rng.integers(0, 200, (2, 500))
    i, j = i[i != j], j[i != j]
    plain = [next((k for k in range(200) if max(a, b) + k >= 200 or codes[a + k] != codes[b + k]), 200) for a, b in zip(i, j)]
    assert ext.length(i, j).tolist() == plain


def test_runs_of_odd_rows(spark):
    long = "tick tock " * 30_000 + "end"
    rows = [(1, "a b a b a b a b c"), (1, "a b a b a b a b c"), (2, None), (3, ""), (4, " \t\n"), (None, "x x x x x x"), (5, "x x " * 5), (6, long), (7, "A a A a A")]
    got = [tuple(r) for r in runs.find_runs(spark.createDataFrame([(i, t, "r", "w", "d") for i, t in rows], ODD)).collect()]
    assert sorted(got, key=str) == sorted(
        [
            (1, 9, [(0, 8, 2)], "a b c"), (1, 9, [(0, 8, 2)], "a b c"), (2, 0, [], ""), (3, 0, [], ""), (4, 0, [], ""), (None, 6, [(0, 6, 1)], "x"),
            (5, 5, [], " ".join(["x x"] * 5)), (6, 60_001, [(0, 60_000, 2)], "tick tock end"), (7, 5, [], "A a A a A"),
        ],
        key=str,
    )
    assert runs.find_runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_tails_follow_their_rule(spark):
    docs = [(i, " ".join(f"w{(i * k * k) % 11}" for k in range(i % 60))) for i in range(300)]
    got = {r[0]: r[1].split() for r in runs.with_tails(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    turned = 0
    for i, text in docs:
        words, h = text.split(), zlib.crc32(str(i).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
            turned += 1
        assert got[i] == words
    assert turned > 10


def plain_scan(text, notices, phrases, percent):
    words = licenses.notice_words(text or "")
    said = sorted((i, label) for p, label in phrases.items() for q in [licenses.notice_words(p)] for i in range(len(words)) if words[i : i + len(q)] == q)
    met = {}
    for label, texts in notices.items():
        for t in map(licenses.notice_words, texts):
            for i in range(len(words)):
                held = len(set(words[i : i + licenses.span_of(t)]) & set(t))
                if held >= licenses.needed(t, percent):
                    met[label] = max(met.get(label, 0), held / len(set(t)))
    return len(words), [(label, i) for i, label in said], met


def test_license_join_equals_every_block(spark):
    rng = np.random.default_rng(6)
    vocabulary = [f"w{i}" for i in range(12)]
    pick = lambda n: " ".join(rng.choice(vocabulary, n))
    notices = {f"n{k}": [pick(int(rng.integers(2, 14))) for _ in range(2)] for k in range(5)}
    phrases = {"w1 w2": "first", "w3 w3": "second"}
    texts = [None, "", "...", *[pick(int(rng.integers(1, 60))) for _ in range(150)], ",W1--W2 w3 w3 w3", pick(3000)]
    docs = spark.createDataFrame([(i, t, "r", "w", "d") for i, t in enumerate(texts)], ODD)
    for percent in (60, 90):
        got = {r["doc_id"]: r for r in licenses.scan_licenses(docs.union(docs.limit(0)), notices, phrases, percent).collect()}
        for i, t in enumerate(texts):
            n, said, met = plain_scan(t, notices, phrases, percent)
            best = {}
            for b in got[i]["blocks"]:
                best[b["label"]] = max(best.get(b["label"], 0), b["containment"])
                words = licenses.notice_words(t)[b["start"] : b["start"] + b["length"]]
                assert any(len(set(words) & set(licenses.notice_words(x))) / len(set(licenses.notice_words(x))) == b["containment"] for x in notices[b["label"]])
            assert (got[i]["n_words"], [(x["label"], x["start"]) for x in got[i]["phrases"]], best) == (n, said, met), t


def test_licenses_of_odd_rows(spark):
    notice = "Licensed under the\nApache   License, Version 2.0."
    rows = [(1, notice), (1, notice), (None, "ALL rights\treserved"), (2, "Key ccéby"), (3, "word " * 50_000 + "released under the mit license")]
    got = licenses.scan_licenses(spark.createDataFrame([(i, t, "r", "w", "d") for i, t in rows], ODD)).collect()
    found = sorted((str(r["doc_id"]), r["n_words"], [tuple(x) for x in r["phrases"]], sorted({x["label"] for x in r["blocks"]})) for r in got)
    assert found == [("1", 8, [], ["apache-2.0"])] * 2 + [("2", 2, [], []), ("3", 50_005, [], ["mit"]), ("None", 3, [("reserved", 0)], [])]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert licenses.scan_licenses(empty).count() == 0
    assert licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"), {}, {}).count() == 5


@pytest.mark.parametrize("d, wanted", [(1, 8), (6, 3), (40, 8), (40, 40)])
def test_pairs_equal_a_dense_solver(spark, d, wanted):
    rng = np.random.default_rng(d)
    x = rng.standard_normal((300, d)) @ rng.standard_normal((d, d))
    matrix = np.atleast_2d(np.cov(x.T, bias=True))
    expected, basis = np.linalg.eigh(matrix)
    for shift in rng.uniform(expected[0] - 1, expected[-1] + 1, 20):
        assert whitening.count_below(matrix, shift) == (expected < shift).sum()
    values, vectors = whitening.leading_pairs(spark, matrix, wanted)
    k = min(d, wanted)
    assert np.allclose(values, expected[::-1][:k], rtol=1e-10)
    assert np.allclose(np.abs((basis[:, ::-1][:, :k] * vectors).sum(0)), 1, atol=1e-9)


def test_equal_and_missing_eigenvalues(spark):
    turn, _ = np.linalg.qr(np.random.default_rng(0).standard_normal((7, 7)))
    matrix = turn @ np.diag([5.0, 5, 5, 2, 1, 0, 0]) @ turn.T
    matrix = (matrix + matrix.T) / 2
    values, vectors = whitening.leading_pairs(spark, matrix, 7)
    assert np.allclose(values, [5, 5, 5, 2, 1]) and np.allclose(vectors.T @ vectors, np.eye(5), atol=1e-10)
    assert len(whitening.leading_pairs(spark, matrix, 2)[0]) == 2
    assert whitening.leading_pairs(spark, np.zeros((3, 3)), 2)[0].size == 0


def test_a_dominant_direction_settles(spark):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((2000, 64))
    x[:700] = 3 * rng.standard_normal(64)
    matrix = np.cov(x.T, bias=True)
    assert np.allclose(whitening.leading_pairs(spark, matrix, 8)[0], np.linalg.eigvalsh(matrix)[::-1][:8], rtol=1e-11)


def test_whitening_equals_numpy(spark, tmp_path):
    rng = np.random.default_rng(9)
    x = np.float32(rng.standard_normal((400, 12)) @ rng.standard_normal((12, 12)))
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)] + [(0, [float(c) for c in x[0]]), (None, [float(c) for c in x[1]])]
    bad = [(900, None), (901, []), (902, [None] * 12), (903, [float("nan")] * 12), (904, [1.0] * 11 + [float("inf")]), (905, [1.0, 2.0])]
    table = spark.createDataFrame([(i, v, "n", 1) for i, v in rows + bad], "vec_id long, embedding array<float>, n string, component int")
    table.write.parquet(str(tmp_path / "embeddings.parquet"))
    got = queries.op13_whitening(spark, str(tmp_path)).collect()
    scaled = np.floor(np.array([v for _, v in rows], float) * 1024) + 100_000
    n, total = len(scaled), scaled.sum(0)
    away = scaled - total / n
    matrix = away.T @ away / n
    values, basis = np.linalg.eigh(matrix)
    values, basis = values[::-1][:8], basis[:, ::-1][:, :8]
    white = away @ basis / np.sqrt(values)
    assert len(got) == 8 * n and {r["n"] for r in got} == {n} and max(r["identity_error"] for r in got) < 1e-10
    for r in got:
        k = r["component"] - 1
        where = [j for j, (i, _) in enumerate(rows) if i == r["vec_id"]]
        assert any(abs(abs(r["whitened"]) - abs(white[j, k])) < 1e-9 for j in where)
        assert any(r["deviation"] == int(((n * scaled[j] - total) ** 2).sum()) for j in where)
        assert abs(r["explained"] / (values[k] / np.trace(matrix)) - 1) < 1e-10


def test_whitening_without_a_spread(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert whitening.whiten(empty)[0].count() == 0
    same = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<float>")
    table, model, error = whitening.whiten(same)
    assert model.n == 2 and error is None and [r["whitened"] for r in table.collect()] == [[], []]
    with pytest.raises(Exception, match="scaled exactly"):
        whitening.whiten(spark.createDataFrame([(1, [1e9])], "vec_id long, embedding array<float>"))


def test_run_digests(spark, tmp_path):
    text = "a b a b a b a b c c c c c c c d"
    number = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10)
    spark.createDataFrame([(number, text)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    r = queries.op11_runs(spark, str(tmp_path)).first()
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert tuple(r) == (number, 2, 0, 8, 2, 4000, digest("0,8,2\n8,7,1\n"), digest("a b c d"))
