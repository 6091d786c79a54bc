"""From profiles to scaled vectors per (day, window, view)."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F

from ..functions.scalars import INTERNAL_PREFIX, view_of
from .features import PORT_SUFFIXES, WINDOW
from .joins import attach

GROUP = [*WINDOW, "view"]
MIN_ENTITIES = 30


def raw_vectors(
    profile: DataFrame, base: list[str], ports: DataFrame | None = None, roles: str = "both", prefix: str = INTERNAL_PREFIX
) -> DataFrame:
    """(group, entity, raw): features in a fixed order, the same for a whole day.

    The order is the base features, then the chosen ports of the day ascending.
    A day has one list of bounded length, so the lists are safe to broadcast.
    """
    fixed = F.array(*[F.col(c).cast("double") for c in base])
    if ports is None:
        return profile.select(*WINDOW, view_of(prefix=prefix).alias("view"), "entity", fixed.alias("raw"))
    suffixes = F.array(*[F.lit(s) for s in PORT_SUFFIXES[roles]])
    names = ports.groupBy("day").agg(F.sort_array(F.collect_set("port")).alias("chosen")).select(
        "day",
        F.flatten(
            F.transform("chosen", lambda p: F.transform(suffixes, lambda s: F.concat(p.cast("string"), s)))
        ).alias("names"),
    )
    seen = F.transform(
        F.coalesce("names", F.array().cast("array<string>")),
        lambda n: F.coalesce(F.try_element_at("ports", n), F.lit(0.0)),
    )
    return profile.join(F.broadcast(names), "day", "left").select(
        *WINDOW, view_of(prefix=prefix).alias("view"), "entity", F.concat(fixed, seen).alias("raw")
    )


def keep_populated(vectors: DataFrame, keys=GROUP, min_entities: int = MIN_ENTITIES) -> DataFrame:
    """Groups with enough entities to cluster."""
    enough = vectors.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") >= min_entities)
    return attach(vectors, enough.select(*keys), keys, "entity", "left_semi")


def min_max(vectors: DataFrame, keys=GROUP) -> DataFrame:
    """Adds `vec`: each coordinate scaled to [0, 1] within its group, constants to 0.

    The extremes are combined before the shuffle, one row per group.
    """
    stats = (
        vectors.groupBy(*keys)
        .agg(Summarizer.metrics("min", "max").summary(array_to_vector("raw")).alias("s"))
        .select(*keys, vector_to_array("s.min").alias("lo"), vector_to_array("s.max").alias("hi"))
    )
    scaled = F.transform(
        F.arrays_zip("raw", "lo", "hi"),
        lambda t: F.when(t["hi"] > t["lo"], (t["raw"] - t["lo"]) / (t["hi"] - t["lo"])).otherwise(F.lit(0.0)),
    )
    return attach(vectors, stats, keys, "entity").withColumn("vec", scaled).drop("lo", "hi")


def distinct_vectors(vectors: DataFrame, keys=GROUP) -> DataFrame:
    """(group, id, vec, weight): equal vectors once, named by the smallest entity."""
    return vectors.groupBy(*keys, "vec").agg(F.min("entity").alias("id"), F.count("*").cast("double").alias("weight"))


def members(vectors: DataFrame, distinct: DataFrame, keys=GROUP) -> DataFrame:
    """(group, entity, id): which distinct vector stands for each entity."""
    return vectors.select(*keys, "entity", "vec").join(
        distinct.select(*keys, "vec", "id"), [*keys, "vec"]
    ).select(*keys, "entity", "id")
