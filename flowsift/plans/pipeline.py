"""The whole job: flows → profiles → clusters → outliers → scores."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..functions.scalars import INTERNAL_PREFIX, view_of
from ..operators.cells import BLOCK
from ..operators.clean import internal_flows
from ..operators.density import density_clusters, distance_curve, nearest_distances
from ..operators.elbow import choose_epsilon
from ..operators.features import MIN_FLOWS, PORT_SUFFIXES, SET_A, SET_B, extract, keep_active
from ..operators.kmeans import RESTARTS, choose_k, cluster_profile, kmeans_grid, kmeans_labels
from ..operators.lof import local_outlier_factor
from ..operators.outliers import ALGORITHMS, evaluate, labelled_clusters, labelled_scores, with_max_score
from ..operators.ports import choose_ports
from ..operators.vectors import GROUP, MIN_ENTITIES, distinct_vectors, keep_populated, members, min_max, raw_vectors
from ..operators.ward import ward_clusters
from ..session import cut
from ..sources.flows import FEATURE_KEYS


@dataclass
class Settings:
    """Choices a run can make; the defaults are the usual ones."""

    method: int = 1
    x: int = 100
    minutes: tuple = (30,)
    origin: int | dict = 0  # or a table day -> seconds, see features.with_window
    key: str = "src"
    prefix: str = INTERNAL_PREFIX  # of internal addresses
    min_flows: int = MIN_FLOWS
    min_entities: int = MIN_ENTITIES
    algorithms: tuple = tuple(ALGORITHMS)
    restarts: int = RESTARTS
    seed: int = 0
    block: int = BLOCK
    digits: int | None = None
    mode: str = "standard"
    strict: bool = False  # a neighbour must be nearer than eps
    score_noise: bool = True

    @property
    def base(self):
        return SET_B if self.method == 2 else SET_A

    @property
    def roles(self):
        return self.key if self.method == 2 else "both"

    @property
    def flows_column(self):
        return "flows" if self.method == 2 else "SrcConnMade"


@dataclass
class Features:
    ports: DataFrame
    profiles: DataFrame


@dataclass
class Clusters:
    """Results per (day, window, view); `grid`, `k` and `profile` need k-means, `lof` scored noise."""

    vectors: DataFrame
    distinct: DataFrame
    distances: DataFrame
    eps: DataFrame
    labels: DataFrame
    lof: DataFrame | None = None
    grid: DataFrame | None = None
    k: DataFrame | None = None
    profile: DataFrame | None = None


@dataclass
class Detection:
    features: Features
    clusters: Clusters
    found: DataFrame
    scores: DataFrame
    known_scores: DataFrame


def build_features(flows: DataFrame, s: Settings = Settings(), calendar: DataFrame | None = None) -> Features:
    """Ports are chosen from all flows of a day, profiles from internal flows."""
    ports = cut(choose_ports(flows, s.method, s.x, calendar))
    profiles = cut(extract(internal_flows(flows, s.prefix), ports, s.method, list(s.minutes), s.origin, s.key))
    return Features(ports, keep_active(profiles, s.flows_column, s.min_flows))


def feature_vectors(features: Features, s: Settings = Settings()) -> DataFrame:
    """(group, entity, raw) of the groups large enough to cluster."""
    return keep_populated(raw_vectors(features.profiles, s.base, features.ports, s.roles, s.prefix), GROUP, s.min_entities)


def vectors_from_table(features: DataFrame, day: int, win_sec: int, win_start, s: Settings = Settings()) -> DataFrame:
    """(group, entity, raw) from one wide feature table, such as a feature CSV."""
    names = [c for c in features.columns if c != "entity"]
    rows = features.select(
        F.lit(day).alias("day"),
        F.lit(win_sec).alias("win_sec"),
        F.lit(win_start).cast("timestamp_ntz").alias("win_start"),
        view_of(prefix=s.prefix).alias("view"),
        "entity",
        F.array(*[F.coalesce(F.col(f"`{c}`"), F.lit(0.0)) for c in names]).alias("raw"),
    )
    return keep_populated(rows, GROUP, s.min_entities)


def vectors_from_tables(features: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(group, entity, raw) of all the windows of a table of wide features, as stored by `sinks.write_features`.

    The table has day, win_sec and win_start; all other columns but the entity, its view
    and role, the window's label and the file are features. Columns of ports that other
    days have chosen are 0 throughout a group, so they leave distances as they are.
    """
    keys = {"entity", "day", "win_sec", "window", *FEATURE_KEYS}
    names = [c for c in features.columns if c not in keys]
    rows = features.select(
        F.col("day").cast("int").alias("day"),
        F.col("win_sec").cast("int").alias("win_sec"),
        F.col("win_start").cast("timestamp_ntz").alias("win_start"),
        view_of(prefix=s.prefix).alias("view"),
        "entity",
        F.array(*[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)) for c in names]).alias("raw"),
    )
    return keep_populated(rows, GROUP, s.min_entities)


def cluster(raw: DataFrame, s: Settings = Settings(), keys=GROUP, names: DataFrame | None = None) -> Clusters:
    """Clusters the vectors of every group with the chosen algorithms.

    With `names` (see `feature_names`) the profile names its features; otherwise it has their positions.
    """
    keys = list(keys)
    vectors = cut(min_max(raw, keys))
    unique = cut(distinct_vectors(vectors, keys))
    who = cut(members(vectors, unique, keys))
    distances = cut(nearest_distances(unique, keys, s.block, s.digits))
    eps = cut(choose_epsilon(distance_curve(distances, keys), keys, digits=s.digits))
    by_id = {}
    if "dbscan" in s.algorithms:
        # the next smaller number, so that a distance equal to eps is beyond it
        radius = eps.withColumn("eps", F.col("eps") * (1 - 2.0**-53)) if s.strict else eps
        by_id["dbscan"] = density_clusters(unique, distances, radius, keys, s.block, s.digits)
    grid = chosen = profile = None
    if {"kmeans", "agglomerative"} & set(s.algorithms):
        grid = cut(kmeans_grid(unique, keys, s.restarts, s.seed, s.block))
        chosen = cut(choose_k(grid, keys))
        by_id["kmeans"] = cut(kmeans_labels(unique, grid, chosen, keys, s.block))
        profile = cluster_profile(unique.join(by_id["kmeans"], [*keys, "id"]), keys, names)
    if "agglomerative" in s.algorithms:
        by_id["agglomerative"] = ward_clusters(unique, chosen, keys, s.block)
    long = None
    for name in ALGORITHMS:
        if name in s.algorithms:
            part = by_id[name].withColumn("algorithm", F.lit(name))
            long = part if long is None else long.unionByName(part)
    labels = cut(who.join(long, [*keys, "id"]).select(*keys, "entity", "algorithm", "cluster"))
    lof = None
    if s.score_noise:
        noise = labels.filter((F.col("algorithm") == "dbscan") & (F.col("cluster") < 0)).select(*keys, "entity")
        suspects = vectors.join(noise, [*keys, "entity"], "left_semi").select(
            *keys, F.col("entity").alias("id"), F.col("raw").alias("vec")
        )
        lof = cut(local_outlier_factor(suspects, keys, block=s.block))
    return Clusters(vectors, unique, distances, eps, labels, lof, grid, chosen, profile)


def feature_names(features: Features, s: Settings = Settings()) -> DataFrame:
    """(day, feature, name): what stands at each position of a day's vectors."""
    base = F.array(*[F.lit(n) for n in s.base])
    suffixes = F.array(*[F.lit(x) for x in PORT_SUFFIXES[s.roles]])
    rank = F.transform(
        "chosen", lambda p: F.transform(suffixes, lambda x: F.concat(p.cast("string"), x))
    )
    days = features.ports.groupBy("day").agg(F.sort_array(F.collect_set("port")).alias("chosen"))
    return days.select("day", F.posexplode(F.concat(base, F.flatten(rank))).alias("feature", "name"))


def detect(flows: DataFrame, truth: DataFrame, s: Settings = Settings(), calendar: DataFrame | None = None) -> Detection:
    """Runs everything on typed flows with a `day`; `truth` is (day, role, ip), and `calendar` may give the days."""
    if not s.score_noise:
        raise ValueError("detect needs scored noise")
    features = build_features(flows, s, calendar)
    clusters = cluster(feature_vectors(features, s), s, names=feature_names(features, s))
    scores = evaluate(clusters.labels, truth, GROUP, s.mode)
    return Detection(
        features,
        clusters,
        labelled_clusters(clusters.labels, truth, GROUP),
        with_max_score(scores, clusters.lof, GROUP),
        labelled_scores(clusters.lof, truth, GROUP),
    )
