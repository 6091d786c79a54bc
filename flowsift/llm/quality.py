"""Document quality: histogram gradient-boosted trees over text statistics.

Statistics of every text come from one pass over the bytes. Trees are grown on a
bounded sample of labelled documents from histograms of binned statistics, and are
flattened into arrays of equal depth, so that scoring walks all trees of all rows of
a batch at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut
from .words import BYTES, SPACE, chunks, find_words, giving_back

UPPER = (BYTES >= 65) & (BYTES <= 90)
DIGIT = (BYTES >= 48) & (BYTES <= 57)
LETTER = UPPER | ((BYTES >= 97) & (BYTES <= 122)) | (BYTES >= 0x80)
STOP = np.isin(BYTES, [ord(c) for c in ".,;:?'"])
MARK = (BYTES > 32) & (BYTES < 127) & ~LETTER & ~DIGIT & ~STOP
NEWLINE = BYTES == 10
CLASSES = [UPPER, DIGIT, LETTER, STOP, MARK, NEWLINE, SPACE]

STATISTICS = [
    "bytes", "words", "lines", "bytes_per_word", "words_per_line", "upper", "digit", "letter", "stop", "mark", "newline",
    "space", "longest_word", "distinct_words", "top_word", "repeated_words", "distinct_pairs", "distinct_lines",
    "top_line", "short_words", "marked_words", "one_byte_words",
]


@dataclass(frozen=True)
class Quality:
    sample_rows: int = 20_000  # labelled rows that the trees are grown on, at most
    bins: int = 64
    depth: int = 4
    trees: int = 80
    rate: float = 0.15
    smooth: float = 1.0  # added to the sum of second derivatives of a leaf
    least_rows: int = 10  # in a leaf
    accept: float = 0.7


def statistics(column: pa.Array):
    """(first row, last row, matrix) for runs of rows; null texts count as empty."""
    for first, last, data, offsets in chunks(column):
        rows = last - first
        size = np.diff(offsets).astype(np.float64)
        at_least = np.maximum(size, 1)

        def per_row(mask):
            sums = np.concatenate([[0], np.cumsum(mask)])
            return (sums[offsets[1:]] - sums[offsets[:-1]]).astype(np.float64)

        shares = [per_row(c[data]) for c in CLASSES]
        words = find_words(data, offsets)
        lines = find_words(data, offsets, inside=~NEWLINE)
        n = np.bincount(words.doc, minlength=rows).astype(np.float64)
        n_lines = np.bincount(lines.doc, minlength=rows).astype(np.float64)
        w, ln = np.maximum(n, 1), np.maximum(n_lines, 1)
        longest = np.zeros(rows)
        np.maximum.at(longest, words.doc, words.size.astype(np.float64))
        again = np.zeros(len(words.hash), bool)
        pair = words.hash.copy()
        if len(pair) > 1:
            same = words.doc[1:] == words.doc[:-1]
            again[1:] = same & (words.hash[1:] == words.hash[:-1])
            pair[1:] += np.where(same, words.hash[:-1] * np.uint64(3), np.uint64(0))
        marked = per_word_any(MARK[data], words)
        by_word = lambda mask: np.bincount(words.doc[mask], minlength=rows) / w
        kinds, top = counts(words.doc, words.hash, rows)
        pairs, _ = counts(words.doc, pair, rows)
        line_kinds, line_top = counts(lines.doc, lines.hash, rows)
        out = [size, n, n_lines, size / w, n / ln, *(s / at_least for s in shares), longest, kinds / w, top / w]
        out += [by_word(again), pairs / w, line_kinds / ln, line_top / ln, by_word(words.size <= 3), by_word(marked), by_word(words.size == 1)]
        yield first, last, np.stack(out, axis=1).astype(np.float32)


def per_word_any(flags: np.ndarray, words) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(flags)])
    return sums[words.start + words.size] > sums[words.start]


def counts(doc: np.ndarray, values: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row: how many different values it has, and how often it has the most frequent one."""
    kinds, top = np.zeros(rows), np.zeros(rows)
    bounds = np.searchsorted(doc, np.arange(rows + 1))
    for i in np.flatnonzero(np.diff(bounds)):
        v = np.sort(values[bounds[i] : bounds[i + 1]])
        edges = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
        kinds[i], top[i] = len(edges), np.diff(edges, append=len(v)).max()
    return kinds, top


@dataclass
class Trees:
    """Complete binary trees: the children of node i are 2i + 1 and 2i + 2."""

    base: float
    feature: np.ndarray  # (trees, inner nodes)
    threshold: np.ndarray  # a row goes right if its value is larger
    leaf: np.ndarray  # (trees, leaves)

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(len(x))
        trees = np.arange(len(self.feature))
        depth = int(np.log2(self.leaf.shape[1])) if len(trees) else 0
        for low in range(0, len(x), 8192):
            part = x[low : low + 8192]
            node = np.zeros((len(part), len(trees)), np.int64)
            row = np.arange(len(part))[:, None]
            for _ in range(depth):
                node = 2 * node + 1 + (part[row, self.feature[trees, node]] > self.threshold[trees, node])
            total = self.base + (self.leaf[trees, node - self.feature.shape[1]].sum(1) if len(trees) else 0)
            out[low : low + 8192] = 1 / (1 + np.exp(-total))
        return out


def grow(x: np.ndarray, y: np.ndarray, cfg: Quality) -> Trees:
    """Trees for the log loss; with one class or no rows, none and a constant score."""
    inner = 2**cfg.depth - 1
    rate = (y.sum() + 1) / (len(y) + 2)
    trees = Trees(float(np.log(rate / (1 - rate))), *(np.zeros((0, k)) for k in (inner, inner, inner + 1)))
    if len(np.unique(y)) < 2:
        return trees
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, cfg.bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    total = np.full(len(y), trees.base)
    features, thresholds, leaves = [], [], []
    for _ in range(cfg.trees):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(len(y), np.int64)
        for level in range(cfg.depth):
            first, width = 2**level - 1, 2**level
            split_bin = np.full(width, cfg.bins)
            best = np.full(width, 1e-9)
            own = node - first
            for f in range(x.shape[1]):
                cell = own * cfg.bins + binned[:, f]
                hist = [np.bincount(cell, v, width * cfg.bins).reshape(width, cfg.bins) for v in (g, h, np.ones(len(y)))]
                gl, hl, nl = (np.cumsum(a, 1)[:, : len(cuts[f])] for a in hist)
                gt, ht, nt = (a.sum(1, keepdims=True) for a in hist)
                gain = gl**2 / (hl + cfg.smooth) + (gt - gl) ** 2 / (ht - hl + cfg.smooth) - gt**2 / (ht + cfg.smooth)
                gain[(nl < cfg.least_rows) | (nt - nl < cfg.least_rows)] = 0
                if not gain.shape[1]:
                    continue
                at = gain.argmax(1)
                value = gain[np.arange(width), at]
                better = value > best
                best[better] = value[better]
                feature[first : first + width][better] = f
                threshold[first : first + width][better] = cuts[f][at[better]]
                split_bin[better] = at[better]
            right = binned[np.arange(len(y)), feature[node]] > split_bin[own]
            node = 2 * node + 1 + right
        own = node - inner
        leaf = -cfg.rate * np.bincount(own, g, inner + 1) / (np.bincount(own, h, inner + 1) + cfg.smooth)
        total += leaf[own]
        features.append(feature)
        thresholds.append(threshold)
        leaves.append(leaf)
    return Trees(trees.base, np.array(features), np.array(thresholds), np.array(leaves))


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether the id belongs to the fold that no label is learnt from; a null id does not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def document_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, x): the statistics of every row's text."""

    def run(batches):
        for batch in batches:
            for first, last, x in statistics(batch.column(1)):
                at = np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, last - first), pa.ListArray.from_arrays(pa.array(at), pa.array(x.reshape(-1)))], ["doc_id", "x"]
                )

    return docs.select("doc_id", "text").mapInArrow(giving_back(run), "doc_id long, x array<float>")


def label_sample(labels: DataFrame, cfg: Quality, folds: int, fold: int) -> DataFrame:
    """(doc_id, y): at most `sample_rows` labels outside the held-out fold, chosen by a hash of the id."""
    known = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", F.col("quality").cast("double").alias("y"))
    known = known.filter(~held_out(F.col("doc_id"), folds, fold))
    return cut(known.orderBy(F.xxhash64(F.lit(17), "doc_id"), "doc_id", "y").limit(cfg.sample_rows))


def fit(docs: DataFrame, labels: DataFrame, cfg: Quality = Quality(), folds: int = 4, fold: int = 2) -> Trees:
    """Trees grown on a bounded sample of labelled rows; only the texts of the sample are measured for it."""
    # the sample has at most sample_rows rows of two numbers
    sample = F.broadcast(label_sample(labels, cfg, folds, fold))
    chosen = docs.select("doc_id", "text").join(sample.select("doc_id").distinct(), "doc_id", "left_semi")
    rows = document_statistics(chosen).join(sample, "doc_id")
    # repeated ids may bring more rows than labels were chosen
    order = [F.xxhash64(F.lit(17), "doc_id"), "doc_id", "y", "x"]
    pdf = rows.orderBy(*order).limit(cfg.sample_rows).select("x", "y").toPandas()
    x = np.array(pdf["x"].tolist(), np.float32).reshape(len(pdf), len(STATISTICS))
    return grow(x, pdf["y"].to_numpy(np.float64), cfg)


def score_quality(docs: DataFrame, labels: DataFrame, cfg: Quality = Quality(), folds: int = 4, fold: int = 2) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Reads `doc_id` and `text` of `docs`, and `doc_id` and `quality` of `labels`; other
    columns may have any names. Null and empty texts are scored as empty texts, repeated
    rows each get a row, null labels are not learnt from, and a document labelled twice
    counts twice. Without labels of both kinds all scores are the (smoothed) rate of
    label 1. An empty table gives an empty result.
    """
    trees = fit(docs, labels, cfg, folds, fold)

    def run(batches):
        for batch in batches:
            for first, last, x in statistics(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.array(trees.score(x))], ["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(giving_back(run), "doc_id long, score double")
    return scored.select(
        "doc_id", held_out(F.col("doc_id"), folds, fold).alias("held_out"), "score", (F.col("score") >= cfg.accept).cast("int").alias("predicted")
    )


def keep_good(docs: DataFrame, labels: DataFrame, cfg: Quality = Quality(), folds: int = 4, fold: int = 2) -> DataFrame:
    """The rows of `docs` that are accepted, with all their columns.

    Null and empty texts are judged as empty texts, repeated rows alike. Without labels of
    both kinds nothing can be learnt of what is good, and all rows stay. An empty table
    gives an empty result.
    """
    trees = fit(docs, labels, cfg, folds, fold)
    if not len(trees.feature):
        return docs
    text = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            for first, last, x in statistics(batch.column(text)):
                yield batch.slice(first, last - first).filter(pa.array(trees.score(x) >= cfg.accept))

    return docs.mapInArrow(giving_back(run), docs.schema)
