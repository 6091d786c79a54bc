"""Toxicity: a word classifier with a counterfactual penalty.

Features are the words of a text and the first few bytes of each, as hashes. Those
that separate the labels best enter a logistic regression. For every labelled text
that names a group of people, copies are made in which the name is swapped for
another of its kind, and the squared change of the logit is penalised. A name then
cannot raise the score by itself, however often it stood in toxic examples, and
texts that mention a group neutrally are left alone.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import cut
from .quality import held_out
from .words import ALNUM, chunks, find_words, mix, seeds

# Names of groups of people by kind; the first of a kind is its neutral word.
IDENTITY_TERMS = (
    ("people", "women", "men", "girls", "boys", "gays", "lesbians", "transgender", "heterosexuals"),
    ("believers", "christians", "muslims", "jews", "hindus", "buddhists", "atheists", "catholics", "protestants"),
    ("citizens", "immigrants", "refugees", "foreigners", "migrants", "africans", "asians", "europeans", "americans", "mexicans"),
    ("persons", "elderly", "disabled", "blind", "deaf", "homeless", "young"),
    ("personne", "femmes", "hommes", "musulmans", "juifs", "immigrés", "étrangers", "africains"),
    ("menschen", "frauen", "männer", "muslime", "juden", "christen", "ausländer", "flüchtlinge"),
    ("personas", "mujeres", "hombres", "musulmanes", "judíos", "cristianos", "inmigrantes", "extranjeros"),
)


@dataclass(frozen=True)
class Toxicity:
    per_label: int = 6_000  # labelled rows of each label that the model is fitted on, at most
    features: int = 512  # that the model keeps
    least_rows: int = 4  # of the sample that a feature must occur in
    prefixes: tuple = (4, 5, 6)
    steps: int = 600
    decay: float = 1e-3  # price of a unit of weight
    penalty: float = 1.0  # on the squared logit change of a swap
    swaps: int = 4  # copies of a text that names a group
    accept: float = 0.7
    identity: tuple = IDENTITY_TERMS


def features(column: pa.Array, cfg: Toxicity):
    """(first row, last row, row, feature) of all words and of the prefixes of longer words, repeats included."""
    salts = seeds(len(cfg.prefixes) + 1, 41)
    for first, last, data, offsets in chunks(column):
        words = find_words(data, offsets, ALNUM, prefixes=cfg.prefixes)
        docs, found = [words.doc], [mix(words.hash + salts[0])]
        for size, salt, heads in zip(cfg.prefixes, salts[1:], words.prefixes):
            longer = words.size > size
            docs.append(words.doc[longer])
            found.append(mix(heads[longer] + salt))
        yield first, last, np.concatenate(docs), np.concatenate(found)


def swapped(text: str, number: int, cfg: Toxicity) -> str | None:
    """`text` with every name replaced by one `number` places on in its kind; None if it has none."""
    place = {t: (kind, i) for kind in cfg.identity for i, t in enumerate(kind)}
    pattern = re.compile(r"\b(" + "|".join(sorted(map(re.escape, place), key=len, reverse=True)) + r")\b", re.IGNORECASE)

    def other(m):
        kind, i = place[m[0].lower()]
        return kind[0] if number == 0 and i else kind[(i + max(number, 1)) % len(kind)]

    text, count = pattern.subn(other, text)
    return text if count else None


@dataclass
class Model:
    base: float
    feature: np.ndarray  # ascending
    weight: np.ndarray

    def score(self, column: pa.Array, cfg: Toxicity) -> np.ndarray:
        out = np.full(len(column), self.base)
        for first, last, doc, found in features(column, cfg):
            doc, at = present(doc, found, self.feature)
            out[first:last] += np.bincount(doc, self.weight[at], last - first)
        return 1 / (1 + np.exp(-out))


def present(doc: np.ndarray, found: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, index in `wanted`): which of the ascending `wanted` features each row has, each once."""
    if not len(wanted) or not len(found):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at = np.searchsorted(wanted, found)
    at[at == len(wanted)] = 0
    known = wanted[at] == found
    both = np.unique(doc[known] * len(wanted) + at[known])
    return both // len(wanted), both % len(wanted)


def label_sample(labels: DataFrame, cfg: Toxicity, folds: int, fold: int) -> DataFrame:
    """(doc_id, y): at most `per_label` rows of each label outside the held-out fold, chosen by a hash of the id."""
    known = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", F.col("toxic").cast("int").alias("y"))
    known = known.filter(~held_out(F.col("doc_id"), folds, fold)).filter("y IN (0, 1)").distinct()
    order = [F.xxhash64(F.lit(29), "doc_id"), "doc_id"]
    return cut(known.filter("y = 1").orderBy(*order).limit(cfg.per_label).unionByName(known.filter("y = 0").orderBy(*order).limit(cfg.per_label)))


def fit(docs: DataFrame, labels: DataFrame, cfg: Toxicity = Toxicity(), folds: int = 3, fold: int = 1) -> Model:
    """The classifier, from a bounded sample of labelled rows."""
    sample = label_sample(labels, cfg, folds, fold)
    counts = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    pos, neg = counts.get(1, 0), counts.get(0, 0)
    base = float(np.log((pos + 1) / (neg + 1)))
    if not pos or not neg:
        return Model(base, np.empty(0, np.uint64), np.empty(0))
    # the sample has at most 2 * per_label rows of two numbers
    texts = cut(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("y", "text"))

    def count(batches):
        for batch in batches:
            y = np.asarray(batch.column(0))
            for first, last, doc, found in features(batch.column(1), cfg):
                order = np.lexsort((doc, found))
                doc, found = doc[order], found[order]
                once = np.ones(len(doc), bool)
                once[1:] = (doc[1:] != doc[:-1]) | (found[1:] != found[:-1])
                doc, found = doc[once], found[once]
                opens = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]])) if len(found) else np.empty(0, np.int64)
                toxic = np.add.reduceat(y[first:last][doc], opens) if len(opens) else opens
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found[opens].view(np.int64)), pa.array(np.diff(opens, append=len(found))), pa.array(toxic.astype(np.int64))],
                    ["feature", "n", "toxic"],
                )

    seen = texts.mapInArrow(count, "feature long, n long, toxic long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))
    share = F.col("toxic") / pos - (F.col("n") - F.col("toxic")) / neg
    spread = F.sqrt((F.col("toxic") + 1) / pos / pos + (F.col("n") - F.col("toxic") + 1) / neg / neg)
    best = seen.filter(F.col("n") >= cfg.least_rows).orderBy(F.desc(F.abs(share / spread)), "feature").limit(cfg.features)
    wanted = np.sort(np.array([r["feature"] for r in best.select("feature").collect()], np.int64).view(np.uint64))

    def pairs(batches):
        """Each labelled text with its features and, per swap, those of the swapped text."""
        for batch in batches:
            y, own = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            changed = [[s for s in (swapped(t, k, cfg) for k in range(cfg.swaps)) if s is not None] for t in own]
            texts = own + [s for c in changed for s in c]
            at = [None] * len(texts)
            for first, last, doc, found in features(pa.array(texts, pa.large_string()), cfg):
                doc, index = present(doc, found, wanted)
                bounds = np.searchsorted(doc, np.arange(last - first + 1))
                at[first:last] = [index[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])]
            swaps, next_ = [], len(own)
            for c in changed:
                swaps.append(at[next_ : next_ + len(c)])
                next_ += len(c)
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(y, pa.int32()), pa.array(at[: len(own)], kind), pa.array(swaps, pa.list_(kind))], ["y", "at", "swaps"])

    rows = texts.mapInArrow(pairs, "y int, at array<long>, swaps array<array<long>>").collect()
    return regress([r["y"] for r in rows], [r["at"] for r in rows], [r["swaps"] for r in rows], wanted, cfg)


def regress(y, at, swaps, wanted: np.ndarray, cfg: Toxicity) -> Model:
    """Logistic regression by accelerated proximal steps; both labels weigh the same.

    The sum of absolute weights is penalised, so among features that occur together
    those that cover most texts carry the weight, and unseen endings of a known stem
    are recognised.
    """
    x = np.zeros((len(y), len(wanted)), np.float32)
    for row, own in zip(x, at):
        row[own] = 1
    changes = []
    for row, others in zip(x, swaps):
        for other in others:
            d = row.copy()
            d[other] -= 1
            changes.append(d)
    d = np.array(changes, np.float32).reshape(len(changes), len(wanted))
    y = np.asarray(y, np.float32)
    each = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1)).astype(np.float32)

    def curve(v):
        """The quadratic bound of the loss, applied to weights and intercept."""
        inner = 0.25 * each * (x @ v[:-1] + v[-1])
        out = np.append(x.T @ inner, inner.sum())
        if len(d):
            out[:-1] += 2 * cfg.penalty * (d.T @ (d @ v[:-1])) / len(d)
        return out

    v = np.ones(len(wanted) + 1, np.float32)
    for _ in range(20):
        v = curve(v / np.linalg.norm(v)).astype(np.float32)
    rate = 1 / (1.1 * float(np.linalg.norm(v)) + 1e-9)
    w = ahead = np.zeros(len(wanted) + 1, np.float32)
    t = 1.0
    for _ in range(cfg.steps):
        logit = np.clip(x @ ahead[:-1] + ahead[-1], -60, 60)
        error = (1 / (1 + np.exp(-logit)) - y) * each
        g = np.append(x.T @ error, error.sum())
        if len(d):
            g[:-1] += 2 * cfg.penalty * (d.T @ (d @ ahead[:-1])) / len(d)
        new = ahead - rate * g
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - rate * cfg.decay, 0)
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead = (new + (t - 1) / after * (new - w)).astype(np.float32)
        w, t = new.astype(np.float32), after
    return Model(float(w[-1]), wanted, w[:-1].astype(np.float64))


def score_toxicity(docs: DataFrame, labels: DataFrame, cfg: Toxicity = Toxicity(), folds: int = 3, fold: int = 1) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Reads `doc_id` and `text` of `docs`, and `doc_id` and `toxic` of `labels`; other
    columns may have any names. Null and empty texts are scored as empty texts, repeated
    rows each get a row, null labels are not learnt from. A document labelled both ways
    is learnt from as both. Without labels of both kinds all scores are the (smoothed)
    rate of label 1. Ties among features are broken by their hash. An empty table gives
    an empty result.
    """
    model = fit(docs, labels, cfg, folds, fold)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(batch.column(1), cfg))], ["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
    return scored.select(
        "doc_id", held_out(F.col("doc_id"), folds, fold).alias("held_out"), "score", (F.col("score") >= cfg.accept).cast("int").alias("predicted")
    )
