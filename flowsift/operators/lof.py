"""Local outlier factor among the noise entities of a group."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import cut
from .cells import BLOCK, nearest

NEIGHBOURS = 5


def local_outlier_factor(points: DataFrame, keys, k: int = NEIGHBOURS, block: int = BLOCK) -> DataFrame:
    """(keys, id, score): minus the local outlier factor; 0 in groups of at most k points.

    `points` has (keys, id, vec) and is not de-duplicated: copies are neighbours.
    """
    keys = list(keys)
    points = cut(points.select(*keys, "id", "vec", F.lit(1.0).alias("weight")))
    near = cut(nearest(points, keys, k, block))
    reach = near.groupBy(*keys, "id").agg(F.max("d").alias("kdist"), F.count("*").alias("have"))
    reach = reach.filter(F.col("have") == k).select(*keys, F.col("id").alias("nid"), "kdist")
    density = (
        near.join(reach, [*keys, "nid"])
        .groupBy(*keys, "id")
        .agg((1.0 / (F.avg(F.greatest("kdist", "d")) + F.lit(1e-10))).alias("lrd"))
    )
    density = cut(density)
    theirs = density.select(*keys, F.col("id").alias("nid"), F.col("lrd").alias("other"))
    scores = (
        near.join(theirs, [*keys, "nid"])
        .join(density, [*keys, "id"])
        .groupBy(*keys, "id")
        .agg((-F.avg(F.col("other") / F.col("lrd"))).alias("score"))
    )
    return points.select(*keys, "id").join(scores, [*keys, "id"], "left").na.fill(0.0, ["score"])
