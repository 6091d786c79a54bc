"""Operators on texts against plain Python, with nulls, empty and long texts, ties, repeats, odd columns, empty tables."""

import itertools
import os
import random
import re
import sys
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from flowsift.llm import chat, decontaminate, lines, minhash, packing, pii, quality, sharding, toxicity, words
from flowsift.llm.queries import word_tokenizer

ODD_COLUMNS = "doc_id long, text string, h string, n int, words string, key string, rest int, _rank int, score string"


def table(spark, rows):
    """Documents with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "x", 1, "y", None, 0, 0, "z") for i, t in rows], ODD_COLUMNS)


def sentence(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def corpus(seed=0):
    rng = random.Random(seed)
    rows, base = [], [sentence(rng, 40) for _ in range(12)]
    for i in range(60):
        words = list(base[i % 12])
        for _ in range(rng.choice([0, 0, 1, 2, 6])):
            words[rng.randrange(len(words))] = f"new{rng.randrange(50)}"
        cut = rng.randrange(8, 30)
        rows.append((i, " ".join(words[:cut]) + "\n" + " ".join(words[cut:]) + "\nshort line"))
    long = " ".join(sentence(rng, 30_000, 5_000))
    return rows + [(100, None), (101, ""), (102, " \n\t"), (103, "One two"), (104, "one TWO"), (105, long), (106, long + " tail"), (None, "a b c d e f"), (3, rows[3][1])]


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def test_minhash_equals_brute_force(spark):
    rows = corpus()
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(table(spark, rows)).collect()}
    sets = {i: shingle_set(t) for i, t in rows if i is not None}
    root = {i: i for i in sets}
    linked = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    for _ in sets:
        for a, b in linked:
            root[a] = root[b] = min(root[a], root[b])
    want = {(i, len(s), root[i], root[i] == i) for i, s in sets.items()} | {(None, 2, None, True)}
    assert got == want


def test_crowd_blocks_find_what_pairs_find(spark):
    rng = random.Random(5)
    base = sentence(rng, 60)
    rows = []
    for i in range(80):
        words = list(base)
        for _ in range(rng.randrange(6)):
            words[rng.randrange(60)] = f"c{rng.randrange(1000)}"
        rows.append((i, " ".join(words)))
    docs = table(spark, rows)
    plain = {(r.doc_id, r.component_id) for r in minhash.near_duplicates(docs).collect()}
    few = minhash.NearDup(small=2, block=8, star_rounds=1)
    assert plain == {(r.doc_id, r.component_id) for r in minhash.near_duplicates(docs, few).collect()}


def test_an_id_is_linked_through_each_of_its_texts(spark):
    rng = random.Random(12)
    rows, want = [], {}
    for i in range(0, 60, 6):
        texts = [sentence(rng, size, 5000) for size in (60, 200, 600)]
        rows += [(i, " ".join(t)) for t in texts] + [(i + k + 1, " ".join(t[:-1])) for k, t in enumerate(texts)]
        want |= {i + k: i for k in range(4)}
    for cfg in (minhash.NearDup(), minhash.NearDup(small=2, block=8, star_rounds=1), minhash.NearDup(star_rounds=0)):
        got = {r.doc_id: r.component_id for r in minhash.near_duplicates(table(spark, rows), cfg).collect()}
        assert got == want


def test_sketch_fills_and_estimates():
    rng = np.random.default_rng(0)
    pool = rng.integers(0, 2**63, 900).astype(np.uint64)
    sets = [np.unique(pool[:600]), np.unique(pool[150:750]), pool[:1]]
    offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    s = minhash.sketch(np.concatenate(sets), offsets, 256)
    assert (s != minhash.EMPTY_SLOT).all()
    assert abs((s[0] == s[1]).mean() - 0.6) < 0.12


def near(x, y):
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y)) == 1
    if abs(len(x) - len(y)) != 1:
        return False
    x, y = (x, y) if len(x) > len(y) else (y, x)
    return any(x[:i] + x[i + 1 :] == y for i in range(len(x)))


def brute_lines(rows):
    listed = []
    for i, t in sorted({r for r in rows if r[1] is not None}, key=lambda r: (r[0] is not None, r[0] or 0)):
        for k, line in enumerate(t.split("\n")):
            words = re.findall(r"[^\x20\x09-\x0D]+", line)
            if words:
                listed.append((i, t, k, words))
    gone = {}
    for at, (i, t, k, words) in enumerate(listed):
        for j, u, _, other in listed[:at]:
            same = words == other and (len(words) >= 5 or (i, t) == (j, u))
            if same or (min(len(words), len(other)) >= 8 and near(words, other)):
                gone.setdefault((i, t), set()).add(k)
                break
    return {(i, t, None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone.get((i, t), ()))) for i, t in rows}


def test_lines_equal_brute_force(spark):
    rng = random.Random(3)
    base = [sentence(rng, rng.choice([3, 6, 9, 14])) for _ in range(15)]
    rows = []
    for i in range(40):
        own = []
        for _ in range(4):
            words = list(rng.choice(base))
            kind = rng.randrange(4)
            if kind == 1:
                words[rng.randrange(len(words))] = "changed"
            elif kind == 2:
                del words[rng.randrange(len(words))]
            elif kind == 3:
                words.insert(rng.randrange(len(words)), rng.choice(["more", "w1"]))
            own.append(rng.choice([" ", "  ", "\t"]).join(words))
        rows.append((i, "\n".join(own)))
    rows += [(50, None), (51, ""), (52, "\n\n"), (53, "a b\na b\nc"), (54, "a b"), (None, rows[7][1]), (9, rows[9][1]), (60, "\n".join(["q " * 9] * 3000))]
    out = lines.dedup_lines(table(spark, rows))
    assert out.columns[:9] == [c.split()[0] for c in ODD_COLUMNS.split(", ")]
    got = Counter((r.doc_id, r.text) for r in out.collect())
    assert got == Counter((i, s) for j, u in rows for i, t, s in brute_lines(rows) if (i, t) == (j, u))


@pytest.mark.parametrize("n", [8, 9, 20, 21])
def test_lines_are_taken_apart_in_the_half_that_differs(spark, n):
    """One edit at any place is found, and no deletion is made from a half that a line shares with its partners."""
    rng = random.Random(n)
    rows, low, wanted = [], n // 2, 0
    for at in range(n):
        base = [f"b{at}x{j}" for j in range(n)]
        other = base[:at] + [rng.choice(["new", base[at - 1]])] + base[at + 1 :]
        longer = base[:at] + [f"more{at}"] + base[at:]
        rows += [(10 * at + k, "  ".join(words)) for k, words in enumerate(rng.sample([base, other, longer], 3))]
        # of `base` and `other` the half that differs, of `longer` the half with the word put in, and some beside the middle
        wanted += 2 * (n - low if at >= low else low) + n + 1
    cfg = lines.LineDedup()
    docs = table(spark, rows)
    found = lines.dropped_lines(docs, cfg).collect()
    assert {r.doc_id for r in found} == {i for i, t, s in brute_lines(rows) if s == ""} and len(found) >= n
    hashes = lines.hashed(docs, cfg)
    sides = {r.h: (r.front, r.back) for r in lines.sharing_halves(hashes, cfg).collect()}
    whole = {r.h: r.words for r in lines.split_lines(docs).select(lines.words_of(F.col("line")).alias("words")).withColumn("h", lines._hash(F.col("words"))).collect()}
    apart = spark.createDataFrame([(h, whole[h], len(whole[h].split()), *sides[h]) for h in sides], "h long, words string, n int, front boolean, back boolean")
    gone = lines.deletions(apart.withColumn("place", F.lit(0))).collect()
    rest = spark.createDataFrame(
        [(r.h, r.at, " ".join(w for k, w in enumerate(whole[r.h].split()) if k != r.at)) for r in gone], "h long, at int, rest string"
    ).withColumn("rest", lines._hash(F.col("rest")))
    assert {(r.h, r.at, r.rest) for r in gone} == {(r.h, r.at, r.rest) for r in rest.collect()}
    assert len(gone) == len({(r.h, r.at) for r in gone}) <= wanted < sum(len(whole[h].split()) for h in sides)


def test_words_of_a_line_are_counted_once(spark):
    """No filter repeats what a later column needs, and a text is hashed once, not once per line."""
    plan = lines.hashed(table(spark, [(1, "a b")]), lines.LineDedup())._jdf.queryExecution().optimizedPlan().toString()
    filters = [x for x in plan.split("\n") if "Filter" in x]
    assert filters and not any("replace" in x or "array_join" in x for x in filters)
    assert plan.count("xxhash64(text") == 1 and plan.index("Generate") < plan.index("xxhash64(text")


def test_line_counts_leave_columns_of_the_same_name(spark):
    rows = [(1, "a b c d e f\nx", 777, 888), (2, "a b c d e f\n  a  b\tc d e f", 777, 888), (3, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lines_before long, Lines_Dropped long")
    out = lines.dedup_lines(docs)
    assert out.columns == [*docs.columns, "lines_before_", "lines_dropped_"]
    assert sorted(map(tuple, out.collect())) == [
        (1, "a b c d e f\nx", 777, 888, 2, 0), (2, "", 777, 888, 2, 2), (3, None, None, None, 0, 0),
    ]
    import corpus_pipeline

    kept = corpus_pipeline.line_dedup(spark, docs, "")
    assert sorted(map(tuple, kept.collect())) == [(1, "a b c d e f\nx", 777, 888), (3, None, None, None)]


def test_decontamination_finds_edited_copies_only(spark):
    rng = random.Random(1)
    items = [(i, " ".join(sentence(rng, 30, 3000))) for i in range(20)] + [(90, "too short"), (91, None), (92, "")]
    rows, want = [], set()
    for i in range(60):
        words = sentence(rng, rng.randrange(0, 200), 3000)
        if i % 3 == 0:
            item = items[i % 20][1].upper().split()
            for _ in range(i % 5):
                item[rng.randrange(len(item))] = "edited"
            if i % 2:
                item.insert(10, "inserted, twice")
            at = rng.randrange(len(words) + 1)
            words[at:at] = item
            want.add((i, i % 20))
        elif i % 3 == 1:
            words += items[i % 20][1].split()[:9]
        rows.append((i, " ".join(words)))
    rows += [(100, None), (101, ""), (0, rows[0][1])]
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, score int")
    for block in (500_000, 40):
        found = decontaminate.contaminated(table(spark, rows), bench, decontaminate.Decontaminate(block_words=block)).collect()
        assert {(r.doc_id, r.item_id) for r in found} == want and len(found) == len(want)
    kept = decontaminate.keep_clean(table(spark, rows), bench)
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in rows} - {i for i, _ in want}


def edited(rng, words, kind, step):
    """A copy of an item with every `step`-th word replaced, left out or followed by a new one, or a part of it."""
    out = []
    for k, word in enumerate(words):
        if kind == "replaced" and k % step == step - 1:
            out.append(f"e{rng.randrange(10**6)}")
        elif kind != "left out" or k % step != step - 1:
            out.append(word)
        if kind == "followed" and k % step == step - 1:
            out.append(f"e{rng.randrange(10**6)}")
    return out[: len(words) // 2 + 1] if kind == "half" else out


def test_decontamination_equals_alignment_of_every_pair(spark):
    rng = random.Random(11)
    cfg = decontaminate.Decontaminate()
    kinds = [(k, n) for k in ("replaced", "left out", "followed") for n in (2, 3, 4, 5, 6)] + [("half", 1)]
    items = [sentence(rng, size, 3000) for size in (20, 37, 59) for _ in kinds]
    rows = []
    for i, item in enumerate(items):  # a copy that is the item's only trace
        around = sentence(rng, 80, 3000)
        rows.append((i, " ".join(around[:40] + edited(rng, item, *kinds[i % len(kinds)]) + around[40:])))
    many = sentence(rng, 37, 3000)  # a verbatim copy and many equally edited ones
    rows += [(1000 + i, " ".join(edited(rng, many, "replaced", 4) if i else many)) for i in range(12)]
    items.append(many)
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    code = {w: i + 1 for i, w in enumerate(sorted({w for _, t in rows for w in t.split()} | {w for x in items for w in x}))}
    want = {}
    for i, item in enumerate(items):
        for j, text in rows:
            score, _ = decontaminate.align(np.array([code[w] for w in item]), np.array([[code[w] for w in text.split()]]), cfg)
            if score[0] >= cfg.threshold * cfg.match * len(item):
                want[j, i] = score[0] / (cfg.match * len(item))
    for block in (500_000, 200):
        found = decontaminate.contaminated(table(spark, rows), bench, decontaminate.Decontaminate(block_words=block)).collect()
        assert {(r.doc_id, r.item_id): r.score for r in found} == want
    assert len(want) >= 45 and all((1000 + i, len(items) - 1) in want for i in range(12))


def test_a_task_holds_little_beside_its_batch():
    rng = random.Random(5)
    cfg = decontaminate.Decontaminate()
    common = sentence(rng, 3000, 3000)
    items = decontaminate.Items([1, 2], [" ".join(sentence(rng, 40, 3000)), " ".join(common)], cfg)
    items.keep_rare(np.ones(len(items.kinds), np.int64))
    texts = pa.array([" ".join(sentence(rng, 500, 3000)) for _ in range(1500)])  # of some 4 MB
    parts = pa.array([" ".join(common[i : i + 30]) for i in range(0, 2900, 5)])  # all of one long item
    whole = pa.array([" ".join(sentence(rng, 20, 3000) + common)])

    def found(column):
        return [(first + int(row), items.ids[i]) for first, _, best in decontaminate._matches(column, items, cfg) for row, i in best]

    assert texts.nbytes > 1 << 22
    steps = [lambda: found(texts), lambda: found(parts), lambda: list(quality.statistics(texts)), lambda: list(minhash._sets(texts, minhash.NearDup()))]
    for i, step in enumerate(steps):
        tracemalloc.start()
        step()
        _, most = tracemalloc.get_traced_memory()
        tracemalloc.stop()
        assert most < 50e6, (i, most)
    assert found(whole) == [(0, 2)]


def test_pipeline_sends_texts_to_workers_in_small_batches(spark):
    import corpus_pipeline

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = table(spark, [(i, "%d " % i * 4000) for i in range(500)]).coalesce(1)  # of some 8 MB

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["n"])

    def largest():
        return docs.mapInArrow(sizes, "n long").agg(F.max("n")).first()[0]

    spark.conf.unset(key)
    try:
        assert largest() > 4e6
        kept = corpus_pipeline.minhash_near_dedup(spark, docs, "")
        assert largest() < 1.5e6 and kept.count() == 500
        spark.conf.set(key, "3m")  # the session's own size stays
        corpus_pipeline.minhash_near_dedup(spark, docs, "")
        assert spark.conf.get(key) == "3m"
    finally:
        spark.conf.unset(key)


@pytest.mark.skipif(not sys.platform.startswith("linux"), reason="reads /proc")
def test_workers_hand_memory_back_after_a_task():
    """What a task took does not stay with the worker, also where something made later outlives it."""

    class Frame:  # gives the function that a worker runs
        sparkSession = property(lambda self: self)
        sparkContext = property(lambda self: self)

        def broadcast(self, value):
            self.value = value
            return self

        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):
            return run

    def resident():
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE")

    later = []

    def batches():
        held = [bytes(3000) for _ in range(40_000)]  # 120 MB
        later.append(bytes(3000))
        yield pa.record_batch([pa.array([1]), pa.array(["a b c d e f"])], ["doc_id", "text"])
        del held

    runs = [
        quality.document_statistics(Frame()), minhash.sketches(Frame()), minhash.shingle_sets(Frame()),
        packing.token_pieces(Frame(), word_tokenizer()),
    ]
    for run in runs:
        list(run(batches()))
        before = resident()
        list(run(batches()))
        assert resident() < before + 40e6
        words.give_back()
        assert resident() > before - 40e6, "a task left memory that could be handed back"


def test_short_items_and_scripts_without_spaces_are_found(spark):
    items = [
        (1, "What is the capital city of France?"), (2, "who wrote it"), (3, "yes"), (4, "日本で一番高い山は何ですか？"),
        (5, "ประเทศไทยมีกี่จังหวัด"), (6, "Who wrote IT"), (7, "东京"), (8, "北京在哪里"),
    ]
    rows = [
        (0, "so: what is the capital city of france, they ask, and who wrote it"), (1, "what is the capital city of spain in France"),
        (2, "昨日、日本で一番高い山は何ですか？と聞かれた。"), (3, "ถามว่าประเทศไทยมีกี่จังหวัดครับ"), (4, "yes 东京 it wrote who"),
        (5, "问abc北京在哪里xyz"), (6, "who wrote"), (7, "it who wrote it who wrote it"), (8, None), (9, ""), (10, "北京 在 哪 里"),
    ]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {(0, 1), (0, 2), (0, 6), (2, 4), (3, 5), (5, 8), (7, 2), (7, 6), (10, 8)}
    for block in (500_000, 1):
        found = decontaminate.contaminated(table(spark, rows), bench, decontaminate.Decontaminate(block_words=block)).collect()
        assert {(r.doc_id, r.item_id) for r in found} == want and len(found) == len(want)
        places = {(r.doc_id, r.item_id): (r.start_word, r.end_word) for r in found}
        assert places[0, 1] == (1, 8) and places[7, 2] == (1, 4) and places[5, 8] == (2, 7)
    kept = decontaminate.keep_clean(table(spark, rows), bench).collect()
    assert {r.doc_id for r in kept} == {i for i, _ in rows} - {d for d, _ in want}


def test_alignment_equals_the_recurrence():
    rng = np.random.default_rng(2)
    cfg = decontaminate.Decontaminate()
    for _ in range(20):
        a, b = rng.integers(0, 5, 12).astype(np.uint64), rng.integers(0, 5, 25).astype(np.uint64)
        h = np.zeros((len(a) + 1, len(b) + 1))
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                same = cfg.match if a[i - 1] == b[j - 1] else cfg.mismatch
                h[i, j] = max(0, h[i - 1, j - 1] + same, h[i - 1, j] + cfg.gap, h[i, j - 1] + cfg.gap)
        score, end = decontaminate.align(a, b[None, :], cfg)
        assert score[0] == h.max() and h[:, end[0]].max() == h.max()


def test_quality_learns_and_keeps(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(400):
        good = i % 2
        words = sentence(rng, 60)
        rows.append((i, " ".join(words) if good else " ".join(w.upper() + "!!" for w in words[:6] * 10)))
        labels.append((i, good if i % 50 else None, "x"))
    rows += [(900, None), (901, ""), (902, "x" * 300_000), (None, "null id")]
    marks = spark.createDataFrame(labels, "doc_id long, quality int, text string")
    out = quality.score_quality(table(spark, rows), marks).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    for r in out:
        if r.doc_id is not None:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
            assert r.doc_id >= 400 or r.predicted == r.doc_id % 2
    kept = quality.keep_good(table(spark, rows), marks)
    assert kept.columns == [c.split()[0] for c in ODD_COLUMNS.split(", ")]
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in out if r.predicted}
    flat = quality.score_quality(table(spark, rows[:5]), marks.limit(0)).collect()
    assert {r.score for r in flat} == {0.5}
    for one in (marks.filter("quality = 0"), marks.filter("quality = 1"), marks.limit(0)):
        stay = quality.keep_good(table(spark, rows[:5]), one).collect()
        assert sorted(r.doc_id for r in stay) == [i for i, _ in rows[:5]]


def test_flattened_trees_equal_a_walk():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 4)).astype(np.float32)
    trees = quality.grow(x, (x[:, 0] + x[:, 1] ** 2 > 1).astype(float), quality.Quality(trees=10, depth=3))
    total = np.full(len(x), trees.base)
    for f, t, leaf in zip(trees.feature, trees.threshold, trees.leaf):
        for row in range(len(x)):
            node = 0
            while node < len(f):
                node = 2 * node + (2 if x[row, f[node]] > t[node] else 1)
            total[row] += leaf[node - len(f)]
    assert np.allclose(trees.score(x), 1 / (1 + np.exp(-total)))


def test_toxicity_ignores_names_of_groups(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(600):
        words = sentence(rng, 25)
        toxic = i % 3 == 0
        if toxic and i % 9:  # the others are labelled toxic with nothing but a name in them
            words[5] = "idiot" + rng.choice(["", "ic", "s", "ish"])
        if toxic or i % 40 == 1:  # a name stands mostly in toxic examples
            words[9] = "Muslims"
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    rows += [(900, None), (901, ""), (902, "many muslims live here"), (903, "an IDIOT"), (None, "x")]
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    scored = {}
    for penalty in (0.0, 30.0):
        out = toxicity.score_toxicity(table(spark, rows), marks, toxicity.Toxicity(penalty=penalty)).collect()
        assert len(out) == len(rows)
        scored[penalty] = {r.doc_id: r for r in out}
    fair = scored[30.0]
    assert fair[902].predicted == 0 and fair[903].predicted == 1 and fair[901].predicted == 0
    assert fair[902].score - fair[901].score < 0.5 * (scored[0.0][902].score - scored[0.0][901].score)
    assert np.mean([fair[i].predicted == (i % 3 == 0) for i in range(600) if i % 9]) > 0.99
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in fair.items() if i is not None)
    assert toxicity.swapped("The MUSLIMS came", 1, toxicity.Toxicity()) == "The jews came"


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(word_tokenizer())
    rng = random.Random(7)
    texts = [" ".join(sentence(rng, rng.randrange(1, 900))) for _ in range(150)]
    texts += [None, "", "Straße ÉTÉ l'été can't we're ''s ١٢ İstanbul  x　y", "a" * 5000, "日本語 text", "<|endoftext|> x", " ".join(sentence(rng, 9000)), "¼² ½x_y__z"]
    rows = list(enumerate(texts)) + [(0, texts[0])]
    packed = packing.pack(table(spark, rows), word_tokenizer())
    got = packed.collect()
    parts = {}
    for r in got:
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length and zlib.crc32(r.ids) == r.ids_crc32
        parts.setdefault(r.doc_id, []).append((r.start, ids.tolist(), r.doc_tokens))
    for i, text in enumerate(texts):
        want = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        own = sorted(parts[i])
        if i == 0:
            assert len(own) == 2 * len({p[0] for p in own})
            own = own[::2]
        assert sum((p[1] for p in own), []) == want and {p[2] for p in own} == {len(want)}
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096
    whole = {r.sequence_id: r.ids for r in packing.sequences(packed).collect()}
    assert {k: len(v) // 4 for k, v in whole.items()} == {k: sum(n for _, n in v) for k, v in sequences.items()}


def test_packing_does_not_follow_the_order_of_reading(spark):
    rng = random.Random(8)
    texts = [" ".join(sentence(rng, rng.randrange(1, 300))) for _ in range(80)]
    rows = list(enumerate(texts)) + [(5, texts[5])] * 40 + [(6, "other text"), (None, texts[7]), (None, texts[7]), (None, None)]
    seen = []
    for parts in (1, 3, 7):
        rng.shuffle(rows)
        packed = packing.pack(table(spark, rows).repartition(parts), word_tokenizer(), with_ids=parts == 3)
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        seen.append(Counter(tuple(r) for r in packed.select(*names).collect()))
        assert len({(r[5], r[6]) for r in seen[-1]}) == sum(seen[-1].values()) >= len(rows)
    assert seen[0] == seen[1] == seen[2]


def test_plan_takes_every_piece_and_wastes_little():
    rng = np.random.default_rng(3)
    sizes = np.unique(rng.integers(1, 257, 120))
    demand = rng.integers(1, 400, len(sizes)).astype(float)
    used = packing.plan(sizes, demand, 256, packing.Packing())
    assert (sum(p * t for p, t in used) == demand).all() and all((p * sizes).sum() <= 256 for p, _ in used)
    assert sum(t for _, t in used) <= 1.02 * np.ceil((sizes * demand).sum() / 256) + 3


def base_spans(text):
    def luhn(d):
        return sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0

    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and luhn(d)),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(re.sub("[^0-9]", "", m)) <= 15),
    ]
    found = [(m.start(), k, name, m.end()) for k, (name, p, ok) in enumerate(kinds) for m in re.finditer(p, text) if ok(m[0])]
    return ",".join(f"{name}:{a}:{b}" for a, _, name, b in sorted(found))


def test_pii_base_spans_equal_plain_patterns(spark):
    rng = random.Random(8)
    pool = ["a@b.c", "x_y@z-.q", "@", ".", "-", "1.2.3.4", "255.0.00255.1", "256.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 123.4567", "+", " ", "é", "😀", "9", "12", "a", "B2", "\n", "(", ")"]
    rows = [(i, "".join(rng.choice(pool) for _ in range(rng.randrange(40)))) for i in range(400)]
    rows += [(900, None), (901, ""), (902, "7" * 50_000), (903, "a." * 20_000 + "@b.c"), (904, "1 " * 20_000), (905, "0" * 60 + "1.2.3.4"), (None, "a@b.c")]
    for r in pii.find_pii(table(spark, rows)).collect():
        text = dict(rows)[r.doc_id] or ""
        assert ",".join(f"{s.kind}:{s.start}:{s.end}" for s in r.found if s.number < 4) == base_spans(text)


def test_pii_checksums_and_context(spark):
    rows = [(1, "account GB82 WEST 1234 5698 7654 32 ok"), (2, "account GB82 WEST 1234 5698 7654 33 ok"), (3, "his SSN is 078-05-1120"), (4, "part 078-05-1120")]
    got = {r.doc_id: [s.kind for s in r.found if s.number >= 4] for r in pii.find_pii(table(spark, rows)).collect()}
    assert got == {1: ["iban"], 2: [], 3: ["ssn"], 4: []}


def test_pii_finds_bank_accounts_before_capitals_and_digits(spark):
    german, british = "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432"
    made = {
        1: ["IBAN ", german, " BIC COBADEFF"], 2: ["", german.replace(" ", ""), " Please pay"], 3: ["", british, " 12 May"], 4: ["", german, " ", british, " ", german, " X"],
        5: ["REF 12 AB12 3456 7890 1234 ", german, ", then ", british], 6: ["XK99 0000 0000 0000 ", german, "\n", british, "\n12"], 7: ["é ", british, " ", "GB82WEST12345698765432"[:21], " é"],
        8: ["", "NO93 8601 1117 947", " 20 AB"], 9: ["paid from ", "MT84 MALT 0110 0001 2345 MTLC AST0 01S", " TO ", german, " ON 3 MAY"],
    }
    rows = [(i, "".join(parts)) for i, parts in made.items()] + [(20, german[:-1] + "1 BIC"), (21, "AB12 " * 400), (22, "A1" * 2000)]
    got = {r.doc_id: [(s.start, s.end) for s in r.found if s.kind == "iban"] for r in pii.find_pii(table(spark, rows)).collect()}
    for i, parts in made.items():
        at, want = 0, []
        for part in parts:
            if part.replace(" ", "") in (german.replace(" ", ""), british, "NO9386011117947", "MT84MALT011000012345MTLCAST001S"):
                want.append((at, at + len(part)))
            at += len(part)
        assert got[i] == want, i
    assert got[20] == []


def test_pii_context_is_on_both_sides_and_across_matches(spark):
    far = "x" * 41
    rows = [
        (1, "SSN: 123-45-6789, 234-56-7890"), (2, "123-45-6789 is my social security number"), (3, f"SSN {far} 123-45-6789 {far} SSN"),
        (4, "123-45-6789" * 2 + " 234-56-7890 (tax id)"), (5, "é 123-45-6789"), (6, "123-45-6789, 234-56-7890, 345-67-8901, 456-78-9012, ssn"),
    ]
    got = {r.doc_id: [(s.start, s.end) for s in r.found if s.kind == "ssn"] for r in pii.find_pii(table(spark, rows)).collect()}
    want = {}
    for i, text in rows:
        spans = [m.span() for m in re.finditer("[0-9]{3}-[0-9]{2}-[0-9]{4}", text)]
        want[i] = [(a, b) for a, b in spans if re.search("ssn|social security|tax id", (text[max(0, a - 40) : a] + "\n" + text[b : b + 40]).lower())]
    assert got == want and [len(got[i]) for i in range(1, 7)] == [2, 1, 0, 3, 0, 3]
    account = "DE89 3704 0044 0532 0130 00"
    texts = [(1, account + " " * 34 + "iban"), (2, account + " " * 38 + "iban"), (3, "iban" + " " * 40 + account)]
    scores = {r.doc_id: [s.score for s in r.found if s.kind == "iban"] for r in pii.find_pii(table(spark, texts)).collect()}
    assert scores == {1: [1.0], 2: [0.7], 3: [0.7]}


def test_chat_rotates_every_participant(spark):
    rng = random.Random(9)
    names = ["ann", "bob", "eve", "system", None]
    rows = [(c, t, rng.choice(names), rng.choice(["hi", "<|end|>", None, "", "é😀 x"]) if t else "first", 0) for c in [1, 2, 3, None] for t in range(rng.randrange(1, 9))]
    rows += [(7, t, rng.choice(["ann", "bob"]), f"t{t}", 0) for t in range(300)] + [(8, 1, "ann", f"same turn {i}", 0) for i in range(100)]
    rows += [(9, 0, "system", "alone", 0), rows[0], (10, None, "ann", "no turn", 0), (10, 0, "bob", "x", 0)]
    schema = "conv_id long, turn long, role string, text string, rank int"
    got = {(r.conv_id, r.perspective, r.part): (r.text, r.mask, r.turns) for r in chat.perspectives(spark.createDataFrame(rows, schema)).collect()}
    want = {}
    for conv in {r[0] for r in rows}:
        own = sorted({(-1 if t is None else t, role or "unknown", text or "") for c, t, role, text, _ in rows if c == conv})
        for who in {r[1] for r in own} - {"system"}:
            for part in range(0, len(own), 64):
                text, mask = "", []
                for _, role, said in own[part : part + 64]:
                    text += "<|assistant|>\n" if role == who else "<|system|>\n" if role == "system" else f"<|user:{role}|>\n"
                    begin = len(text)
                    text += said.replace("<|", "< |") + "<|end|>\n"
                    if role == who:
                        mask.append(f"{begin}-{len(text)}")
                want[conv, who, part // 64] = (text, ",".join(mask), len(own[part : part + 64]))
    assert got == want


def test_sharding_balances_and_keeps_equal_texts(spark):
    rng = random.Random(10)
    rows = [(i, " ".join(sentence(rng, rng.randrange(1, 60)))) for i in range(6000)] + [(i, "the same text") for i in range(6000, 8000)]
    rows += [(9000 + i, f"pair {i // 5}") for i in range(500)] + [(9900, None), (9901, ""), (None, "x"), (5, rows[5][1])]
    cfg = sharding.Sharding(shards=8)
    got = sharding.shard(table(spark, rows), cfg).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)
    texts = dict(rows)
    sizes, slots, homes = Counter(), {}, {}
    for r in got:
        text = (texts[r.doc_id] or "").encode()
        assert r.size == len(text) + 16 and r.text_crc32 == zlib.crc32(text) and r.law == "bytes" and r.grown_shard is None
        sizes[r.shard] += r.size
        slots.setdefault(r.shard, []).append(r.slot)
        homes.setdefault(text, set()).add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(sizes.values()) <= 1.03 * min(sizes.values()) and len(sizes) == 8
    assert all(len(h) == 1 for t, h in homes.items() if t != b"the same text")


@pytest.mark.parametrize("run", [
    lambda d, s: minhash.near_duplicates(d), lambda d, s: minhash.keep_one(d), lambda d, s: lines.dedup_lines(d), lambda d, s: pii.find_pii(d),
    lambda d, s: sharding.shard(d), lambda d, s: packing.pack(d, word_tokenizer()),
    lambda d, s: decontaminate.contaminated(d, s.createDataFrame([(1, "a b c d e f g h i j")], "item_id long, text string")),
    lambda d, s: decontaminate.contaminated(d, s.createDataFrame([], "item_id long, text string")),
    lambda d, s: quality.score_quality(d, s.createDataFrame([(1, 1)], "doc_id long, quality int")),
    lambda d, s: toxicity.score_toxicity(d, s.createDataFrame([], "doc_id long, toxic int")),
])
def test_empty_tables(spark, run):
    assert run(table(spark, []), spark).count() == 0


def test_keep_one_keeps_columns_and_one_row_of_a_group(spark):
    rows = corpus()
    kept = minhash.keep_one(table(spark, rows))
    assert kept.columns == [c.split()[0] for c in ODD_COLUMNS.split(", ")]
    found = {r.doc_id for r in minhash.near_duplicates(table(spark, rows)).collect() if r.kept}
    assert Counter(r.doc_id for r in kept.collect()) == Counter(found)


def test_words_do_not_cross_texts():
    from flowsift.llm.words import chunks, find_words

    column = pa.array(["ab", "cd ef", None, "", "é x"])
    for limit in (1, 3, 100):
        found = [(first + int(d), int(n)) for first, last, data, offsets in chunks(column, limit) for d, n in zip(*find_words(data, offsets)[0:3:2])]
        assert found == [(0, 2), (1, 2), (1, 2), (4, 2), (4, 1)]


def test_ids_are_widened_without_python_workers(spark):
    ids = np.array([0, 1, 255, 256, 40_000, 65_535, 10, 2], "<u2")
    packed = spark.createDataFrame([(1, ids.tobytes()), (2, b""), (3, ids[:1].tobytes())], "doc_id long, ids binary")
    wide = packing.widened(packed, "<u2")
    assert "InArrow" not in wide._jdf.queryExecution().executedPlan().toString()
    got = {r.doc_id: np.frombuffer(bytes(r.ids), "<u4").tolist() for r in wide.collect()}
    assert got == {1: ids.tolist(), 2: [], 3: [0]} and wide.schema == packed.schema
