"""Outlier rules, scoring and evaluation against known addresses.

Labels come long: (keys, entity, algorithm, cluster). Everything but the list of
flagged entities is computed from cluster sizes and the few labelled entities,
so the full label table is aggregated once and never sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.scalars import ratio

# Algorithm names, in the order of the score sheets.
ALGORITHMS = ["kmeans", "dbscan", "agglomerative"]
DENSITY = "dbscan"
METRICS = ["tp", "fp", "tn", "fn", "accuracy", "precision", "recall", "f1"]


def is_outlier(cluster: str = "cluster", size: str = "size") -> Column:
    """Noise of any size, or a cluster of one."""
    return (F.col(cluster) < 0) | (F.col(size) <= 1)


def cluster_sizes(labels: DataFrame, keys) -> DataFrame:
    """(keys, algorithm, cluster, size, outlier)."""
    sizes = labels.groupBy(*keys, "algorithm", "cluster").agg(F.count("*").alias("size"))
    return sizes.withColumn("outlier", is_outlier())


def flagged_entities(labels: DataFrame, keys) -> DataFrame:
    """(keys, entity, algorithm, cluster) of all outliers."""
    columns = [*keys, "entity", "algorithm", "cluster"]
    clusters = labels.filter(F.col("cluster") >= 0).groupBy(*keys, "algorithm", "cluster")
    # the smallest entity of a cluster of one is its only one
    alone = clusters.agg(F.count("*").alias("size"), F.min("entity").alias("entity")).filter(is_outlier())
    return labels.filter(F.col("cluster") < 0).select(*columns).unionByName(alone.select(*columns))


def labelled_clusters(labels: DataFrame, truth: DataFrame, keys) -> DataFrame:
    """(keys, role, entity, algorithm, cluster, size, outlier) of known entities in a group.

    `truth` is (day, role, ip); both roles are looked up in both views.
    """
    known = truth.select("day", "role", F.col("ip").alias("entity")).distinct()
    found = labels.join(known, ["day", "entity"])
    return found.join(cluster_sizes(labels, keys), [*keys, "algorithm", "cluster"]).select(
        *keys, "role", "entity", "algorithm", "cluster", "size", "outlier"
    )


def hits_by_cluster(found: DataFrame, keys) -> DataFrame:
    """(keys, role, algorithm, cluster, hits): known entities per cluster they appear in.

    Clusters that are no outliers are listed with 0 hits.
    """
    hits = F.sum(F.col("outlier").cast("long"))
    return found.groupBy(*keys, "role", "algorithm", "cluster").agg(hits.alias("hits"))


def hit_totals(found: DataFrame, keys) -> DataFrame:
    """(keys, role, algorithm, present, hits)."""
    return found.groupBy(*keys, "role", "algorithm").agg(
        F.count("*").alias("present"), F.sum(F.col("outlier").cast("long")).alias("hits")
    )


def evaluate(labels: DataFrame, truth: DataFrame, keys, mode: str = "standard") -> DataFrame:
    """(keys, role, algorithm, tp, fp, tn, fn, accuracy, precision, recall, f1).

    One row per algorithm where a known entity of that role is in the group.
    `standard` counts known entities that were not flagged as fn. `reference`
    reproduces the published score sheets: fn is what the other counts leave of
    all entities (always 0, missed entities count as tn), and the last
    algorithm's f1 stands for all.
    """
    if mode not in ("standard", "reference"):
        raise ValueError(f"unknown mode: {mode}")
    keys = list(keys)
    sizes = cluster_sizes(labels, keys)
    totals = sizes.groupBy(*keys, "algorithm").agg(
        F.sum("size").alias("entities"),
        F.sum(F.when(F.col("outlier"), F.col("size")).otherwise(F.lit(0))).alias("flagged"),
    )
    rows = hit_totals(labelled_clusters(labels, truth, keys), keys).join(totals, [*keys, "algorithm"])
    tp, flagged, entities = F.col("hits"), F.col("flagged"), F.col("entities")
    if mode == "reference":
        tn = entities - flagged
        fn = entities - tp - (flagged - tp) - tn
    else:
        fn = F.col("present") - tp
        tn = entities - flagged - fn
    rows = rows.select(
        *keys, "role", "algorithm", tp.alias("tp"), (flagged - tp).alias("fp"), tn.alias("tn"), fn.alias("fn")
    )
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    rows = (
        rows.withColumn("accuracy", ratio(tp + tn, tp + tn + fn + fp))
        .withColumn("precision", ratio(tp, tp + fp))
        .withColumn("recall", ratio(tp, tp + fn))
        .withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    )
    if mode == "reference":
        rank = F.array_position(F.array(*[F.lit(a) for a in ALGORITHMS]), F.col("algorithm"))
        last = F.max_by("f1", rank).over(W.partitionBy(*keys, "role"))
        rows = rows.withColumn("f1", last)
    return rows.select(*keys, "role", "algorithm", *METRICS)


def most_anomalous(lof: DataFrame, keys) -> DataFrame:
    """(keys, entity, max_score): lowest score in each group; ties go to the smaller id."""
    return (
        lof.groupBy(*keys)
        .agg(F.min(F.struct("score", "id")).alias("m"))
        .select(*keys, F.col("m.id").alias("entity"), F.col("m.score").alias("max_score"))
    )


def labelled_scores(lof: DataFrame, truth: DataFrame, keys) -> DataFrame:
    """(keys, role, entity, score): known entities among the scored noise."""
    known = truth.select("day", "role", F.col("ip").alias("id")).distinct()
    return lof.join(known, ["day", "id"]).select(*keys, "role", F.col("id").alias("entity"), "score")


def with_max_score(scores: DataFrame, lof: DataFrame, keys) -> DataFrame:
    """Adds `max_score`, which belongs to the density rows; 0 elsewhere and without noise."""
    best = most_anomalous(lof, keys).select(*keys, "max_score").withColumn("algorithm", F.lit(DENSITY))
    return scores.join(best, [*keys, "algorithm"], "left").na.fill(0.0, ["max_score"]).select(
        *keys, "role", "algorithm", *METRICS, "max_score"
    )
