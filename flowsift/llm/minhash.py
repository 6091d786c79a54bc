"""Near-duplicate documents: fast similarity sketches, banding, exact verification.

A document's set holds the fingerprints of its distinct five-word shingles. Sketches
follow Dahlgaard, Knudsen and Thorup, "Fast Similarity Sketching" (FOCS 2017): in
round i every element is thrown into one of the coordinates with a value in
[i, i+1) and each coordinate keeps its smallest; after as many rounds as there are
coordinates, round by round all elements go to one fixed coordinate, so all of them
fill, whatever the size of the set. Most documents need two or three rounds.

Bands of the sketch propose pairs, one bit of every coordinate screens them, and the
full sets decide. Equal sets are collapsed first, so copies cost nothing afterwards.
Within a bucket a document is first held against one leader only; each round draws
other leaders. What is left are pairs of one bucket that no link chain joins yet;
all of them are tried, in large buckets block against block without writing a pair.
So the components are those of all linked pairs that share a band.
With the defaults a pair at exactly the threshold shares no band with probability
2e-5, and fails the screen with 3e-6.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..operators.components import connected
from ..session import cut
from .tables import by_ids, fresh
from .words import ODD, chunks, distinct, find_words, giving_back, mix, seeds, shingles

EMPTY_SLOT = np.uint64(0xFFFFFFFFFFFFFFFF)


@dataclass(frozen=True)
class NearDup:
    width: int = 5
    percent: int = 75  # linked when 100 * intersection >= percent * union
    coordinates: int = 256  # a power of two
    rows: int = 5
    bands: int = 40
    deviations: float = 4.5  # of the one-bit screen
    star_rounds: int = 6  # at most; a round that leaves most pairs open is the last
    leaders: tuple = (2, 8)  # orders of the ids in the first round of stars and in later ones
    small: int = 64  # members of a bucket whose open pairs are written out
    block: int = 512  # members of a larger bucket that meet in one task, by two
    pairs_per_doc: float = 2.0  # open pairs a document may have before another round of stars is worth it

    @property
    def most_bits(self) -> int:
        """Differing bits beyond which a pair is taken for less similar than the threshold."""
        j = self.percent / 100
        p = (1 - j) / 2
        t = self.coordinates
        return math.floor(t * p + self.deviations * math.sqrt(t * p * (1 - p)))


def sketch(values: np.ndarray, offsets: np.ndarray, t: int) -> np.ndarray:
    """(rows, t) coordinates of each row's set of distinct fingerprints; empty sets stay all ones."""
    rows = len(offsets) - 1
    out = np.full((rows, t), EMPTY_SLOT, np.uint64)
    flat = out.reshape(-1)
    sizes = np.diff(offsets)
    row = np.repeat(np.arange(rows), sizes)
    round_seeds = seeds(2 * t, 23)
    for i in range(2 * t):
        if not len(row):
            break
        h = mix(values ^ round_seeds[i])
        slot = (h & np.uint64(t - 1)).astype(np.int64) if i < t else np.int64(i - t)
        np.minimum.at(flat, row * t + slot, (np.uint64(i) << np.uint64(48)) | (h >> np.uint64(16)))
        open_rows = (out == EMPTY_SLOT).any(1)
        stay = open_rows[row]
        if not stay.all():
            row, values = row[stay], values[stay]
    return out


def _sets(column, cfg: NearDup):
    for first, last, data, offsets in chunks(column):
        words = find_words(data, offsets)
        doc, found = shingles(words, cfg.width, last - first, short=True)
        yield first, last, *distinct(doc, found, last - first)


def _totals(values, offsets, seed):
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(values ^ np.uint64(seed)), dtype=np.uint64)])
    return (sums[offsets[1:]] - sums[offsets[:-1]]).view(np.int64)


def sketches(docs: DataFrame, cfg: NearDup = NearDup()) -> DataFrame:
    """(doc_id, n, h1, h2, bands, b0..) per row, from one reading of the texts.

    n is the size of the shingle set, h1 and h2 are 128 bits that identify it, `bands`
    the band keys of its sketch (none for an empty set), and the b columns hold one
    bit of every coordinate.
    """
    longs = cfg.coordinates // 64

    def run(batches):
        factors = seeds(cfg.rows * cfg.bands, 31).reshape(cfg.bands, cfg.rows)
        salts = np.arange(cfg.bands, dtype=np.uint64) * np.uint64(ODD)
        for batch in batches:
            for first, last, values, offsets in _sets(batch.column(1), cfg):
                n = np.diff(offsets)
                s = mix(sketch(values, offsets, cfg.coordinates))
                used = s[:, : cfg.bands * cfg.rows].reshape(len(n), cfg.bands, cfg.rows)
                keys = mix((used * factors).sum(2, dtype=np.uint64) + salts)[n > 0]
                bits = np.packbits((s & np.uint64(1)).astype(np.uint8), axis=1).view(np.int64)
                at = np.concatenate([[0], np.cumsum(np.where(n > 0, cfg.bands, 0))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, last - first),
                        pa.array(n),
                        pa.array(_totals(values, offsets, 3)),
                        pa.array(_totals(values, offsets, 5)),
                        pa.ListArray.from_arrays(pa.array(at), pa.array(keys.view(np.int64).reshape(-1))),
                        *(pa.array(np.ascontiguousarray(bits[:, i])) for i in range(longs)),
                    ],
                    ["doc_id", "n", "h1", "h2", "bands", *(f"b{i}" for i in range(longs))],
                )

    schema = "doc_id long, n long, h1 long, h2 long, bands array<long>, " + ", ".join(f"b{i} long" for i in range(longs))
    return docs.select("doc_id", "text").mapInArrow(giving_back(run), schema)


def shingle_sets(docs: DataFrame, cfg: NearDup = NearDup()) -> DataFrame:
    """(doc_id, items): the full set of each document, sorted."""

    def run(batches):
        for batch in batches:
            for first, last, values, offsets in _sets(batch.column(1), cfg):
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, last - first),
                        pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.view(np.int64))),
                    ],
                    ["doc_id", "items"],
                )

    return docs.select("doc_id", "text").mapInArrow(giving_back(run), "doc_id long, items array<long>")


def verified(docs: DataFrame, pairs: DataFrame, cfg: NearDup = NearDup()) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough; only their documents' texts are read again."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    wanted = by_ids(docs.select("doc_id", "text"), ends)
    sets = cut(shingle_sets(wanted, cfg)).hint("merge")
    both = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("items").alias("ia")), "a").join(
        sets.select(F.col("doc_id").alias("b"), F.col("items").alias("ib")), "b"
    )
    common = F.size(F.array_intersect("ia", "ib"))
    union = F.size("ia") + F.size("ib") - common
    return cut(both.filter(100 * common >= cfg.percent * union).select("a", "b").distinct())


def _alike(x: str, y: str, cfg: NearDup):
    """Condition on two joined sketch rows: their sizes allow the similarity, and their bits make it likely."""
    differ = F.lit(0)
    for i in range(cfg.coordinates // 64):
        differ = differ + F.bit_count(F.col(f"{x}.b{i}").bitwiseXOR(F.col(f"{y}.b{i}")))
    sizes = 100 * F.least(f"{x}.n", f"{y}.n") >= cfg.percent * F.greatest(f"{x}.n", f"{y}.n")
    return sizes & (differ <= cfg.most_bits)


def _mask(turn: int, cfg: NearDup):
    """Some orders of the ids per round, dealt to the buckets: an id's place is its bits xor this."""
    masks = seeds(cfg.leaders[min(turn, 1)], 101 + turn).view(np.int64)
    return F.element_at(F.array(*(F.lit(int(m)) for m in masks)), F.pmod("key", F.lit(len(masks))).cast("int") + 1)


def _stars(rows: DataFrame, bits: DataFrame, turn: int, cfg: NearDup) -> DataFrame:
    """(a, b): each member of a bucket with the bucket's leader, if they are of different components."""
    mask = _mask(turn, cfg)
    leaders = rows.groupBy("key").agg(F.min(F.struct(F.col("doc_id").bitwiseXOR(mask).alias("place"), F.col("part").alias("lead_part"))).alias("first"))
    met = rows.join(leaders, "key").select("doc_id", "part", "root", F.col("first.place").bitwiseXOR(mask).alias("lead"), "first.lead_part").distinct()
    roots = rows.select(F.col("doc_id").alias("lead"), F.col("root").alias("lead_root")).distinct()
    met = met.join(roots, "lead").filter("root <> lead_root")
    ends = F.array_sort(F.array(F.struct("doc_id", "part"), F.struct(F.col("lead").alias("doc_id"), F.col("lead_part").alias("part"))))
    met = met.select(ends.alias("ends")).select(
        F.col("ends")[0]["doc_id"].alias("a"), F.col("ends")[0]["part"].alias("pa"), F.col("ends")[1]["doc_id"].alias("b"), F.col("ends")[1]["part"].alias("pb")
    ).distinct()
    x, y = bits.alias("x"), bits.alias("y")
    return (
        met.join(x, (F.col("a") == F.col("x.doc_id")) & (F.col("pa") == F.col("x.part")))
        .join(y, (F.col("b") == F.col("y.doc_id")) & (F.col("pb") == F.col("y.part")))
        .filter(_alike("x", "y", cfg)).select("a", "b").distinct()
    )


def _open_pairs(rows: DataFrame, bits: DataFrame, cfg: NearDup) -> DataFrame:
    """(a, b): all pairs of a bucket that lie in different components and pass the screen."""
    full = rows.join(bits, ["doc_id", "part"])
    x, y = full.alias("x"), full.alias("y")
    unlike = (F.col("x.key") == F.col("y.key")) & (F.col("x.root") < F.col("y.root")) & _alike("x", "y", cfg)
    a, b = F.col("x.doc_id"), F.col("y.doc_id")
    return x.join(y, unlike).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


def _open_rows(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows of buckets that hold more than one component, with their `root`."""
    state = rows.join(roots.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    state = state.withColumn("root", F.coalesce("root", "doc_id"))
    mixed = state.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi")
    return cut(state.join(mixed.select("key"), "key"))


def overlaps(sets: list) -> np.ndarray:
    """How many elements each two of the given sets share, by products of their incidence matrices."""
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    number = np.cumsum(count > 1) - 1
    shared = count[column] > 1
    owner, column = owner[shared], number[column[shared]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        x, y = np.searchsorted(column, [low, low + 4096])
        part = np.zeros((len(sets), 4096), np.float32)
        part[owner[x:y], column[x:y] - low] = 1
        out += part @ part.T
    return out


def spanning(a: np.ndarray, b: np.ndarray) -> list:
    """Those of the edges that join two parts not joined by an earlier one."""
    parent: dict = {}

    def top(x):
        while parent.get(x, x) != x:
            parent[x] = parent.get(parent[x], parent[x])
            x = parent[x]
        return x

    kept = []
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        x, y = top(x), top(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
            kept.append(i)
    return kept


def _crowd_links(docs: DataFrame, rows: DataFrame, cfg: NearDup) -> DataFrame:
    """(a, b): links across components in large buckets, enough of them to join what they join.

    A bucket is dealt into blocks, and every two blocks meet in a task that compares
    full sets by matrix products. Copies of a crowd that have drifted to just below the
    threshold would make a pair for each two of them; here no pair is written.
    """
    ends = rows.select("doc_id").distinct()
    wanted = by_ids(docs.select("doc_id", "text"), ends)
    sets = cut(shingle_sets(wanted, cfg))
    sizes = rows.groupBy("key").agg(F.ceil(F.count("*") / cfg.block).cast("int").alias("blocks"))
    dealt = rows.join(sizes, "key").withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select(
        "key", "doc_id", "root", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi")
    ).join(sets, "doc_id")
    percent = cfg.percent

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        same = overlaps(list(pdf["items"]))
        n = np.array([len(x) for x in pdf["items"]], np.float64)
        root, doc = pdf["root"].to_numpy(), pdf["doc_id"].to_numpy()
        linked = (100 * same >= percent * (n[:, None] + n[None, :] - same)) & (root[:, None] < root[None, :])
        i, j = np.nonzero(linked)
        kept = spanning(root[i], root[j])
        a, b = doc[i[kept]], doc[j[kept]]
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return cut(dealt.groupBy("key", "lo", "hi").applyInPandas(run, "a long, b long"))


def _open_count(rows: DataFrame) -> float:
    """How many pairs across components the buckets hold."""
    sizes = rows.groupBy("key", "root").agg(F.count("*").cast("double").alias("c"))
    pairs = sizes.groupBy("key").agg((F.pow(F.sum("c"), 2) - F.sum(F.pow("c", F.lit(2)))).alias("twice"))
    return (pairs.agg(F.sum("twice")).first()[0] or 0) / 2


def links(docs: DataFrame, made: DataFrame, cfg: NearDup = NearDup()) -> DataFrame:
    """(id, root) for every document of `made` linked with another; root is the smallest id of its component.

    `made` holds the sketches of one document per distinct non-empty set. An id may have
    several; `part` tells which of them a band key is from, so that it is they that are screened.
    """
    words = ["n", *(f"b{i}" for i in range(cfg.coordinates // 64))]
    made = made.withColumn("part", F.pmod(F.xxhash64(*words), F.lit(1 << 15)).cast("short"))
    bits = made.select("doc_id", "part", *words).distinct()
    rows = made.select("doc_id", "part", F.explode("bands").alias("key"))
    shared = rows.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1").select("key")
    rows = cut(rows.join(shared.hint("merge"), "key").distinct())
    state, roots, tried, before = rows.withColumn("root", F.col("doc_id")), None, None, math.inf
    limit = cfg.pairs_per_doc * made.count()
    for turn in range(cfg.star_rounds + 1):
        stars = turn < cfg.star_rounds
        if roots is not None:
            count = _open_count(state)
            stars, before = stars and limit < count < 0.9 * before, count
        if stars:
            pairs = _stars(state, bits, turn, cfg)
        else:
            sizes = state.groupBy("key").agg(F.count("*").alias("m")).filter(F.col("m") > cfg.small).select("key")
            crowds = cut(state.join(sizes, "key", "left_semi"))
            pairs = _open_pairs(state.join(sizes, "key", "left_anti"), bits, cfg)
        pairs = cut(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"))
        good = verified(docs, pairs, cfg)
        if not stars and not crowds.isEmpty():
            good = good.unionByName(_crowd_links(docs, crowds.drop("part").distinct(), cfg))
        if roots is not None:
            good = good.unionByName(roots.filter("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")))
        roots = connected(good, [])
        if not stars:
            break
        state = _open_rows(rows, roots)
        tried = pairs if tried is None else tried.unionByName(pairs)
    return roots


def near_duplicates(docs: DataFrame, cfg: NearDup = NearDup()) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Reads `doc_id` and `text` only, so other columns may have any names. A null or
    empty text, or one without words, has an empty set and links with nothing. A text
    with fewer words than a shingle has its whole word sequence as its one element.
    Rows with the same id and set count once; an id with several texts has a row for
    each and belongs to one component through all of them. A null id links with
    nothing: its component_id is null and it is kept. Ties cannot occur: components are
    named by their smallest id. An empty table gives an empty result.
    """
    made = cut(sketches(docs, cfg))
    prints = made.select("doc_id", "n", "h1", "h2").distinct()
    known = prints.filter("n > 0 AND doc_id IS NOT NULL")
    reps = cut(known.groupBy("h1", "h2").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")))
    first = cut(made.join(reps.drop("copies").hint("merge"), ["h1", "h2", "doc_id"], "left_semi").drop("h1", "h2"))
    roots = links(docs, first, cfg)
    named = (
        reps.join(roots.withColumnRenamed("id", "doc_id"), "doc_id", "left")
        .filter("root IS NOT NULL OR copies > 1")
        .select("h1", "h2", F.coalesce("root", "doc_id").alias("root"))
    )
    out = prints.join(named, ["h1", "h2"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("root")).alias("root")
    )
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id"))
    return out.select(
        "doc_id", "n_shingles", component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def keep_one(docs: DataFrame, cfg: NearDup = NearDup()) -> DataFrame:
    """`docs` with one document of each component, the one with the smallest id, and all its columns.

    Rows with a null id stay. Of several rows with one id, one with the smallest
    hash of its text stays.
    """
    found = cut(near_duplicates(docs, cfg))
    gone = found.filter("NOT kept").select("doc_id").distinct()
    twice = found.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("m")).filter("m > 1").select("doc_id")
    ids = docs.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("m")).filter("m > 1").select("doc_id")
    repeated = cut(twice.unionByName(ids).distinct())
    kept = by_ids(docs, gone, "left_anti")
    if repeated.isEmpty():
        return kept.select(*docs.columns)
    first = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"))
    number = fresh(docs, "number")
    once = kept.join(repeated, "doc_id", "left_semi").withColumn(number, F.row_number().over(first)).filter(F.col(number) == 1)
    return kept.join(repeated, "doc_id", "left_anti").select(*docs.columns).unionByName(once.select(*docs.columns))
