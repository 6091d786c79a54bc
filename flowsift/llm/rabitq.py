"""Near-duplicate embeddings by binary codes of random rotations.

Codes follow Gao and Long, "RaBitQ" (SIGMOD 2024): a unit vector is rotated at random
and replaced by the signs of its coordinates; with the stored inner product of vector
and code, the inner product with any other vector has an unbiased estimate and a
confidence bound. Bands of code bits (from as many rotations as it takes) bring
together pairs that may be close. A pair is looked at once, under the first band it
shares; the estimate's upper bound dismisses most, and only the others are computed
exactly, in double precision.

The bits per band grow with the logarithm of the number of vectors, so chance pairs
stay in proportion to the vectors, and the number of bands follows from the wanted
recall of pairs at exactly the threshold. Equal vectors are one row with a weight.
Large buckets are dealt into blocks that meet two by two; a task writes link counts
and a spanning set of links, never all of them.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..operators.components import connected
from ..session import cut
from .minhash import spanning
from .tables import wide_partitions
from .words import ODD, mix


@dataclass(frozen=True)
class EmbeddingDup:
    cosine: float = 0.95
    miss: float = 1e-4  # chance to overlook a pair at exactly the threshold, by bands
    deviations: float = 4.5  # of the estimate's confidence bound
    spare_bits: int = 4  # per band, beyond the logarithm of the number of vectors
    block: int = 512  # members of a bucket that meet in one task, by two
    seed: int = 5


def bands(n: int, cfg: EmbeddingDup) -> tuple[int, int]:
    """(bits of a band, number of bands) for `n` vectors."""
    bits = min(60, max(6, math.ceil(math.log2(max(n, 2))) + cfg.spare_bits))
    meet = (1 - math.acos(cfg.cosine) / math.pi) ** bits
    return bits, math.ceil(math.log(cfg.miss) / math.log1p(-meet))


def rotation(dims: int, number: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix, the same wherever it is made."""
    q, r = np.linalg.qr(np.random.default_rng([seed, dims, number]).normal(size=(dims, dims)))
    return q * np.sign(np.diag(r))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, dims)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding, h1, h2): the vectors that have a direction."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    some = F.exists("embedding", lambda x: x != 0)
    e = vectors.filter("vec_id IS NOT NULL AND embedding IS NOT NULL").filter(finite & some)
    return e.select("vec_id", "embedding", F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(3), "embedding").alias("h2"))


def codes(reps: DataFrame, bits: int, count: int, cfg: EmbeddingDup) -> DataFrame:
    """(vec_id, weight, embedding, code, factor, keys): sign code, its inner product with the unit vector, band keys."""

    def run(batches):
        powers = np.uint64(1) << np.arange(bits, dtype=np.uint64)
        made: dict = {}
        for whole in batches:
            sizes = np.asarray(whole.column(2).value_lengths())
            for dims in np.unique(sizes).tolist():
                if dims not in made:
                    made[dims] = [rotation(dims, i, cfg.seed) for i in range(-(-bits * count // dims))]
                own = whole.filter(pa.array(sizes == dims))
                for low in range(0, own.num_rows, 2048):
                    batch = own.slice(low, 2048)
                    x = _matrix(batch.column(2), dims)
                    x /= np.linalg.norm(x, axis=1, keepdims=True)
                    turned = np.concatenate([x @ r.T for r in made[dims]], axis=1)
                    signs = turned >= 0
                    groups = signs[:, : bits * count].reshape(len(x), count, bits)
                    keys = (groups * powers).sum(2, dtype=np.uint64) + np.arange(count, dtype=np.uint64) * np.uint64(ODD)
                    keys = mix(keys + np.uint64(dims * ODD % 2**64))
                    factor = np.abs(turned[:, :dims]).sum(1) / math.sqrt(dims)
                    code = [row.tobytes() for row in np.packbits(signs[:, :dims], axis=1)]
                    at = np.arange(0, count * len(x) + 1, count, dtype=np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0), batch.column(1), batch.column(2), pa.array(code, pa.binary()), pa.array(factor),
                            pa.ListArray.from_arrays(pa.array(at), pa.array(keys.view(np.int64).reshape(-1))),
                        ],
                        ["vec_id", "weight", "embedding", "code", "factor", "keys"],
                    )

    schema = "vec_id long, weight long, embedding array<float>, code binary, factor double, keys array<long>"
    return reps.select("vec_id", "weight", "embedding").mapInArrow(run, schema)


def _pairs(sizes: np.ndarray, opens: np.ndarray):
    """(i, j) of all pairs within runs of rows, for many runs of few rows at once."""
    left, right = [], []
    for size in np.unique(sizes[sizes > 1]).tolist():
        a, b = np.triu_indices(size, 1)
        first = opens[sizes == size]
        left.append((first[:, None] + a).reshape(-1))
        right.append((first[:, None] + b).reshape(-1))
    none = np.empty(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


class _Rows:
    """The rows of some buckets of one dimension."""

    def __init__(self, part: pa.Table, dims: int, cfg: EmbeddingDup):
        column = lambda c: part.column(c).combine_chunks()
        self.cfg, self.dims = cfg, dims
        self.id, self.weight, self.own, self.band = (np.asarray(column(c)) for c in ("vec_id", "weight", "own", "band"))
        self.raw = _matrix(column("embedding"), dims)
        self.norm = np.linalg.norm(self.raw, axis=1)
        bits = np.frombuffer(b"".join(column("code").to_pylist()), np.uint8).reshape(len(self.id), -1)
        self.signs = np.unpackbits(bits, axis=1)[:, :dims].astype(np.float32) * 2 - 1
        self.factor = np.asarray(column("factor"))
        self.turned = (self.raw / self.norm[:, None]) @ rotation(dims, 0, cfg.seed).T
        self.keys = np.asarray(column("keys").flatten()).reshape(len(self.id), -1)

    def first_shared(self, i, j, band):
        """Of the pairs that share `band`, those that share none before it."""
        for earlier in range(band):
            keep = self.keys[i, earlier] != self.keys[j, earlier]
            i, j = i[keep], j[keep]
            if not len(i):
                break
        return i, j

    def linked(self, i, j):
        """The pairs whose cosine reaches the threshold: estimated first, computed only where that leaves it open."""
        out_i, out_j = [], []
        for low in range(0, len(i), 65536):
            a, b = i[low : low + 65536], j[low : low + 65536]
            estimate = np.einsum("ij,ij->i", self.turned[a], self.signs[b]) / (math.sqrt(self.dims) * self.factor[b])
            spread = np.sqrt(np.maximum(1 - self.factor[b] ** 2, 0) / (self.factor[b] ** 2 * max(self.dims - 1, 1)))
            open_ = estimate + self.cfg.deviations * spread + 1e-9 >= self.cfg.cosine
            a, b = a[open_], b[open_]
            exact = np.einsum("ij,ij->i", self.raw[a], self.raw[b]) / (self.norm[a] * self.norm[b])
            good = exact >= self.cfg.cosine
            out_i.append(a[good])
            out_j.append(b[good])
        none = np.empty(0, np.int64)
        return (np.concatenate(out_i), np.concatenate(out_j)) if out_i else (none, none)


def _compare(part: pa.Table, cfg: EmbeddingDup):
    """Link counts and spanning links of complete buckets: rows (a, b, n) with either b or n null."""
    sizes = np.asarray(part.column("embedding").combine_chunks().value_lengths())
    for dims in np.unique(sizes).tolist():
        own = part.filter(pa.array(sizes == dims))
        rows = _Rows(own, dims, cfg)
        key, lo, hi = (np.asarray(own.column(c).combine_chunks()) for c in ("key", "lo", "hi"))
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
        opens = np.flatnonzero(new)
        members = np.diff(opens, append=len(key))
        found = []
        small = (members <= 32) & (lo[opens] == hi[opens])
        for band in np.unique(rows.band[opens[small]]).tolist():
            mine = small & (rows.band[opens] == band)
            found.append(rows.linked(*rows.first_shared(*_pairs(members[mine], opens[mine]), band)))
        for first, size in zip(opens[~small].tolist(), members[~small].tolist()):
            at = np.arange(first, first + size)
            left = at[rows.own[at] == lo[first]]
            right = at if lo[first] == hi[first] else at[rows.own[at] == hi[first]]
            apart = np.ones((len(left), len(right)), bool)
            if lo[first] == hi[first]:
                apart = np.triu(apart, 1)
            for earlier in range(rows.band[first]):
                apart &= rows.keys[left, earlier][:, None] != rows.keys[right, earlier][None, :]
                if not apart.any():
                    break
            i, j = np.nonzero(apart)
            found.append(rows.linked(left[i], right[j]))
        i = np.concatenate([f[0] for f in found] or [np.empty(0, np.int64)])
        j = np.concatenate([f[1] for f in found] or [np.empty(0, np.int64)])
        if not len(i):
            continue
        ids, at = np.unique(rows.id, return_inverse=True)
        links = np.bincount(at[i], rows.weight[j], len(ids)) + np.bincount(at[j], rows.weight[i], len(ids))
        some = np.flatnonzero(links)
        a, b = rows.id[i], rows.id[j]
        kept = spanning(a, b)
        n = len(some)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([ids[some], a[kept]])),
                pa.array([None] * n + b[kept].tolist(), pa.int64()),
                pa.array(links[some].astype(np.int64).tolist() + [None] * len(kept), pa.int64()),
            ],
            ["a", "b", "n"],
        )


def compare_buckets(coded: DataFrame, cfg: EmbeddingDup) -> DataFrame:
    """(a, b, n): per bucket, the number n of links of a that are first met there, and links (a, b) that join what it joins."""
    rows = coded.select("vec_id", F.posexplode("keys").alias("band", "key"))
    sizes = rows.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1")
    rows = rows.join(sizes, "key").withColumn("blocks", F.ceil(F.col("m") / cfg.block).cast("int"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("vec_id", "band", "key", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
    bucket = ["key", "lo", "hi"]
    met = rows.join(coded, "vec_id").repartition(wide_partitions(coded.sparkSession), *bucket).sortWithinPartitions(*bucket)

    def run(batches):
        rest = None
        for batch in batches:
            whole = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            whole = whole.combine_chunks()
            keys = [np.asarray(whole.column(c).combine_chunks()) for c in bucket]
            if not whole.num_rows:
                continue
            last = np.logical_and.reduce([k == k[-1] for k in keys])
            begin = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0
            if begin:
                yield from _compare(whole.slice(0, begin), cfg)
            rest = whole.slice(begin)
        if rest is not None and rest.num_rows:
            yield from _compare(rest, cfg)

    return cut(met.mapInArrow(run, "a long, b long, n long"))


def embedding_duplicates(vectors: DataFrame, cfg: EmbeddingDup = EmbeddingDup()) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Reads `vec_id` and `embedding`, so other columns may have any names. Null, empty and
    zero vectors, those with null or non-finite components, and those with a null id
    link with nothing (the component of a null id is null). Vectors of different lengths
    never link. Rows with equal id and vector count once; an id with several vectors has
    a row for each, with that vector's own links, and belongs to one component through all of them. An
    empty table gives an empty result.
    """
    good = cut(usable(vectors).distinct())
    reps = good.groupBy("h1", "h2").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("weight"))
    reps = cut(reps.join(good, ["h1", "h2", "vec_id"]).withColumn("rep", F.monotonically_increasing_id()))
    bits, count = bands(reps.count(), cfg)
    # vectors are compared under numbers of their own: an id may have several
    numbered = reps.drop("vec_id").withColumnRenamed("rep", "vec_id").select(*[c for c in reps.columns if c != "rep"])
    coded = cut(codes(numbered, bits, count, cfg))
    found = compare_buckets(coded, cfg)
    links = found.filter("n IS NOT NULL").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    names = reps.select("rep", "vec_id")
    edges = found.filter("b IS NOT NULL").select("a", "b")
    for end in ("a", "b"):
        edges = edges.join(names.withColumnsRenamed({"rep": end, "vec_id": f"{end}_id"}), end)
    edges = edges.select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))
    several = good.groupBy("vec_id").agg(F.count("*").alias("m")).filter("m > 1").select("vec_id")
    theirs = good.select("h1", "h2", "vec_id").join(several, "vec_id", "left_semi").withColumnRenamed("vec_id", "a")
    edges = edges.unionByName(theirs.join(reps.select("h1", "h2", F.col("vec_id").alias("b")), ["h1", "h2"]).select("a", "b"))
    roots = connected(edges, []).withColumnRenamed("id", "vec_id")
    total = (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links")
    named = reps.join(links, "rep", "left").join(roots, "vec_id", "left")
    named = named.select("h1", "h2", total, F.coalesce("root", "vec_id").alias("root"))
    linked = good.join(named, ["h1", "h2"]).select("vec_id", "n_links", F.col("root").alias("component_id"))
    other = vectors.select("vec_id").join(good.select("vec_id"), "vec_id", "left_anti").distinct()
    other = other.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = linked.unionByName(other)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
