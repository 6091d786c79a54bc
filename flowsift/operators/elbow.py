"""Elbow rule on curves, and ranks of sorted values without a global sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.scalars import uniform
from .joins import attach, spread

MARKS = 256
EPS_FALLBACK = 0.3


def chord_distance(x: Column, y: Column, y1: Column, y2: Column, x1: int = 2, x2: int = 30) -> Column:
    """Distance of (x, y) from the line through (x1, y1) and (x2, y2)."""
    dx, dy = F.lit(float(x2 - x1)), y2 - y1
    return F.abs(dy * x - dx * y + F.lit(float(x2)) * y1 - y2 * F.lit(float(x1))) / F.sqrt(dy * dy + dx * dx)


def elbow(curve: DataFrame, keys, x1: int = 2, x2: int = 30, digits: int | None = None) -> DataFrame:
    """(keys, i, y): the point of each curve (keys, i, y) farthest from its chord.

    Points are numbered from 0 and stand at x = i + 2; the chord ends at x2
    whatever the length of the curve. The first of equal distances wins.
    """
    keys = list(keys)
    ends = curve.groupBy(*keys).agg(F.min_by("y", "i").alias("y1"), F.max_by("y", "i").alias("y2"))
    far = chord_distance(F.col("i") + F.lit(2.0), F.col("y"), F.col("y1"), F.col("y2"), x1, x2)
    if digits is not None:
        far = F.round(far, digits)
    return (
        attach(curve, ends, keys, "i")
        .groupBy(*keys)
        .agg(F.max_by(F.struct("i", "y"), F.struct(far.alias("far"), (-F.col("i")).alias("first"))).alias("p"))
        .select(*keys, "p.i", "p.y")
    )


def sorted_ranks(values: DataFrame, keys, y: str, marks: int = MARKS) -> DataFrame:
    """(keys, y, cnt, lo, hi): 0-based first and last rank of each value.

    `values` has (keys, y, cnt). Equal values are combined first. A group is
    then cut at the `marks` values of lowest hash; ranks are counted inside a cut
    and offset by the cuts before it, so no group is ever sorted in one task.
    The picks are limited before they are shuffled.
    """
    keys = list(keys)
    points = values.groupBy(*keys, y).agg(F.sum("cnt").alias("cnt"))
    order = W.partitionBy(*keys).orderBy(uniform(y), y)
    cuts = (
        points.select(*keys, y, F.row_number().over(order).alias("pick"))
        .filter(F.col("pick") <= marks)
        .groupBy(*keys)
        .agg(F.sort_array(F.collect_list(y)).alias("cuts"))
    )
    part = F.size(F.filter("cuts", lambda c: c <= F.col(y)))
    parted = spread(attach(points, cuts, keys, y).withColumn("part", part).drop("cuts"), [*keys, "part"])
    before = (
        parted.groupBy(*keys, "part")
        .agg(F.sum("cnt").alias("held"))
        .withColumn("before", F.sum("held").over(W.partitionBy(*keys).orderBy("part")) - F.col("held"))
        .drop("held")
    )
    inside = F.sum("cnt").over(W.partitionBy(*keys, "part").orderBy(y))
    return (
        parted.withColumn("inside", inside)
        .join(before, [*keys, "part"])
        .select(
            *keys, y, "cnt",
            (F.col("before") + F.col("inside") - F.col("cnt")).alias("lo"),
            (F.col("before") + F.col("inside") - 1).alias("hi"),
        )
    )


def choose_epsilon(nearest: DataFrame, keys, x1: int = 2, x2: int = 30, digits: int | None = None) -> DataFrame:
    """(keys, i, eps): elbow of the sorted nearest-neighbour distances (keys, d, cnt).

    A run of equal distances is a stretch of a horizontal line, on which the
    chord distance peaks at an end, so two points per run are enough.
    """
    ranks = sorted_ranks(nearest, keys, "d")
    curve = ranks.select(
        *keys, F.col("d").alias("y"), F.explode(F.array_distinct(F.array("lo", "hi"))).alias("i")
    )
    eps = F.when(F.col("y") <= 0, F.lit(EPS_FALLBACK)).otherwise(F.col("y"))
    return elbow(curve, keys, x1, x2, digits).select(*keys, "i", eps.alias("eps"))
