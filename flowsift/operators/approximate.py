"""Nearest neighbours by hashing: an approximate join for groups whose vectors have little structure.

Vectors are projected on random directions and each line is cut into steps, so that near
vectors often share all their steps (p-stable hashing). A table is one draw of directions;
there are as many tables as the wanted recall takes for a pair at the group's usual
distance of neighbours. Buckets are searched exactly, large ones in tiles (`cells.tile`),
so none is capped and every distance reported is exact. A vector travels once per table, and
twice per block of its bucket where that is large. What may be missing is a neighbour that shares no bucket.
"""

from __future__ import annotations

from math import ceil, erf, exp, log, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from ..session import cut
from .cells import BLOCK, Search, extend, fields, grouped, split_large, tile, tile_sides
from .joins import attach

STEP = 4.0  # in distances of neighbours
BUCKET_BLOCKS = 32  # blocks of vectors of one bucket that are searched by one task
SAMPLE = 64  # vectors of a group whose neighbours are looked up exactly


def share_step(step: float = STEP) -> float:
    """Probability that two vectors at distance 1 fall into the same step of a random direction."""
    return erf(step / sqrt(2)) - 2 / (sqrt(2 * pi) * step) * (1 - exp(-(step**2) / 2))


def tables_for(recall: float, directions: int, step: float = STEP) -> int:
    """Tables after which a pair at distance 1 has shared a bucket with probability `recall`."""
    if not 0 < recall < 1:
        raise ValueError("recall must be between 0 and 1")
    return max(1, ceil(log(1 - recall) / log(1 - share_step(step) ** directions)))


def usual_distance(points: DataFrame, keys, k: int, sample: int = SAMPLE) -> DataFrame:
    """(keys, radius): the largest distance to the k-th neighbour among a group's sample.

    At most `sample` vectors of a group, chosen by a hash of their ids, meet all its vectors.
    """
    keys = list(keys)
    picked = W.partitionBy(*keys).orderBy(F.xxhash64("id"), "id")
    asked = points.withColumn("n", F.row_number().over(picked)).filter(F.col("n") <= sample)
    asked = cut(asked.select(*keys, F.col("id").alias("by"), F.col("vec").alias("of")))
    gap = F.zip_with("vec", "of", lambda a, b: (a - b) * (a - b))
    # every vector meets the few of its group; only the k best of a task go on
    met = attach(points, asked, keys, "id").filter(F.col("id") != F.col("by"))
    met = met.select(*keys, "by", "id", F.sqrt(F.aggregate(gap, F.lit(0.0), lambda s, v: s + v)).alias("d"))
    best = W.partitionBy(*keys, "by").orderBy("d", "id")
    near = met.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k)
    return near.groupBy(*keys).agg(F.max("d").alias("radius"))


def bucketed(points: DataFrame, keys, tables: int, directions: int, seed: int = 0) -> DataFrame:
    """`points` (keys, id, vec, weight, radius) once per table, with `table` and `bucket`."""
    names = [*keys, "id", "vec", "weight"]
    schema = extend(fields(points, names), table="int", bucket="long")

    def run(batches):
        drawn: dict = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = batch.column(batch.schema.get_field_index("vec")).value_lengths().to_numpy(zero_copy_only=False)
            for size in np.unique(sizes):
                rows = batch.take(pa.array(np.flatnonzero(sizes == size)))
                if size not in drawn:
                    rng = np.random.default_rng([seed, int(size)])
                    turn = rng.normal(size=(int(size), tables * directions))
                    drawn[size] = turn, rng.random(tables * directions), rng.integers(1, 1 << 62, tables * directions) | 1
                turn, shift, factor = drawn[size]
                vec = rows.column(rows.schema.get_field_index("vec")).flatten().to_numpy(zero_copy_only=False).reshape(-1, int(size))
                radius = rows.column(rows.schema.get_field_index("radius")).to_numpy(zero_copy_only=False)
                width = np.where(radius > 0, STEP * radius, 1.0)[:, None]
                steps = np.floor(vec @ turn / width + shift).astype(np.int64) * factor
                bucket = steps.reshape(len(vec), tables, directions).sum(2)
                kept = [rows.column(rows.schema.get_field_index(n)) for n in names]
                for t in range(tables):
                    number = pa.array(np.full(len(vec), t, np.int32))
                    yield pa.RecordBatch.from_arrays([*kept, number, pa.array(bucket[:, t])], [*names, "table", "bucket"])

    return points.select(*names, "radius").mapInArrow(run, schema)


def approximate_nearest(
    points: DataFrame, keys, k: int = 1, recall: float = 0.95, directions: int = 4, block: int = BLOCK, seed: int = 0
) -> DataFrame:
    """(keys, id, nid, d, approximate): near vectors of the same group, up to k, by exact distances.

    A k-th neighbour no further off than the group's `usual_distance` is found with
    probability `recall` or more. `points` has (keys, id, vec, weight) and should be cheap
    to read again. More `directions` make buckets smaller and tables more. Ties go to the
    smaller id. A vector that shares no bucket has no row. Nothing uses this by default:
    `cells.nearest` is exact at any size.
    """
    keys = list(keys)
    points = points.select(*keys, "id", "vec", "weight")
    tables = tables_for(recall, directions)
    known = attach(points, usual_distance(points, keys, k), keys, "id")
    hashed = cut(bucketed(known, keys, tables, directions, seed))
    near = bucket_nearest(hashed, [*keys, "table", "bucket"], k, block * BUCKET_BLOCKS)
    # at most k per table and vector come together here
    best = near.groupBy(*keys, "id").agg(F.slice(F.sort_array(F.collect_set(F.struct("d", "nid"))), 1, k).alias("best"))
    best = best.select(*keys, "id", F.explode("best").alias("p")).select(*keys, "id", "p.nid", "p.d")
    return best.withColumn("approximate", F.lit(True))


def bucket_nearest(hashed: DataFrame, keys, k: int, rows: int) -> DataFrame:
    """(keys, id, nid, d): the k nearest vectors of the same bucket, exactly; buckets of more than `rows` vectors in tiles."""
    search = Search(hashed, keys, k, False, None)
    small, large, _ = split_large(hashed, keys, rows)
    found = grouped(small, keys).applyInArrow(lambda bucket: search.in_tile(bucket, bucket), search.schema)
    if large is None:
        return found
    met = tile(large, large, cut(tile_sides(large, keys, rows, 1 << 30)), keys, ["id"])
    return found.unionByName(search.merged(met.applyInArrow(lambda visitors, hosts: search.in_tile(visitors, hosts), search.schema)))
