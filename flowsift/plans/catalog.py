"""Registered queries over the driver tables, with the same results in plain SQL."""

from __future__ import annotations

from dataclasses import replace
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..operators import approximate, cells, clean, density, elbow, features as ft, kmeans, lof, outliers, ports, vectors as vc, ward
from ..session import cut
from ..sources.flows import RATE_COLUMNS, RAW_COLUMNS
from . import pipeline as pl
from .fixture import BULK_SQL, FLOW_SQL, bulk_flows, event_flows, table

DAY_MINUTES = 1440
DAILY = pl.Settings(method=0, minutes=(DAY_MINUTES,), digits=9, algorithms=("dbscan",), score_noise=False)
SCORED = replace(DAILY, score_noise=True)
FULL = pl.Settings(method=1, minutes=(DAY_MINUTES,))
GROUP = vc.GROUP
DIRTY_FORMAT = "dd/MM/yyyy hh:mm:ss a"

TRUTH_SQL = """
SELECT DISTINCT CAST(EXTRACT(day FROM ts) AS INT) AS day, 'victim' AS role,
 '172.31.' || CAST(64 + user_id % 4 AS STRING) || '.' || CAST(user_id % 251 AS STRING) AS ip
FROM events WHERE user_id % 37 = 0
UNION
SELECT DISTINCT CAST(EXTRACT(day FROM ts) AS INT) AS day, 'attacker' AS role,
 '18.221.' || CAST((event_id * 7 + user_id) % 61 AS STRING) || '.4' AS ip
FROM events WHERE ((event_id * 7 + user_id) % 61) % 17 = 0
"""


# ---- inputs -----------------------------------------------------------------


def truth(spark, sf):
    return spark.sql(TRUTH_SQL.replace("FROM events", "FROM {events}"), events=table(spark, sf, "events"))


def dirty_flows(spark, sf) -> DataFrame:
    """The flows as text, with gaps and repeated header lines."""
    number = F.col("event_id")
    lines = F.when(number % 997 == 0, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    flows = event_flows(spark, sf).withColumn("header", F.explode(lines))
    text = {}
    for source, (name, kind) in {**RAW_COLUMNS, **RATE_COLUMNS}.items():
        text[source] = F.date_format(name, DIRTY_FORMAT) if name == "ts" else F.col(name).cast("string")
    text["Src Port"] = F.when(number % 41 != 0, text["Src Port"])
    text["Timestamp"] = F.when(number % 43 != 0, text["Timestamp"])
    return flows.select(*[F.when(F.col("header"), F.lit(n)).otherwise(c).alias(n) for n, c in text.items()])


def kept(spark, sf):
    return clean.internal_flows(event_flows(spark, sf))


def daily_vectors(spark, sf) -> DataFrame:
    """Raw vectors per day and view: feature set A, without port features."""
    profiles = cut(ft.extract(kept(spark, sf), None, 0, DAY_MINUTES))
    active = ft.keep_active(profiles, "SrcConnMade")
    return vc.keep_populated(vc.raw_vectors(active, ft.SET_A))


def daily_clusters(spark, sf, settings=DAILY) -> pl.Clusters:
    return pl.cluster(daily_vectors(spark, sf), settings)


def daily_distinct(spark, sf):
    scaled = cut(vc.min_max(daily_vectors(spark, sf)))
    return scaled, cut(vc.distinct_vectors(scaled))


def embedding_points(spark, sf):
    vec = F.transform("embedding", lambda v: v.cast("double"))
    return table(spark, sf, "embeddings").select(
        F.lit(0).alias("g"), F.col("vec_id").cast("string").alias("id"), vec.alias("vec"), F.lit(1.0).alias("weight")
    )


def rounded(df, digits, *names):
    return df.select(*[F.round(c, digits).alias(c) if c in names else F.col(c) for c in df.columns])


# ---- queries ----------------------------------------------------------------


def q_clean_flows(spark, sf):
    return clean.clean_flows(dirty_flows(spark, sf))


def q_quarantined_flows(spark, sf):
    flows = dirty_flows(spark, sf)
    sent, port, number = F.col("Tot Fwd Pkts"), F.col("Dst Port"), F.col("Dst Port").try_cast("int")
    broken = {
        "Dst Port": F.when(number % 89 == 0, F.concat(port, F.lit("/tcp"))).otherwise(port),
        "Tot Fwd Pkts": F.when((sent == "7") & (number % 2 == 0), "many").otherwise(sent),
        "Timestamp": F.regexp_replace("Timestamp", "^13/", "31/02/"),
    }
    found = clean.quarantine(flows.withColumns(broken))
    return found.select(*flows.columns, F.concat_ws(",", "unreadable").alias("unreadable"))


def q_capture_flows(spark, sf):
    flows = event_flows(spark, sf).withColumn("file", F.concat(F.lit("flows-"), F.col("day").cast("string")))
    rows = [(f"flows-{d}", d, datetime(2024, 1, d, 4), datetime(2024, 1, d + 1, 4)) for d in range(1, 31)]
    calendar = spark.createDataFrame(rows, "file string, day int, start timestamp_ntz, end timestamp_ntz")
    out = clean.within_capture(flows.drop("day"), calendar)
    return out.groupBy("day", "file").agg(
        F.count("*").alias("flows"), F.min("ts").alias("first"), F.max("ts").alias("last")
    )


def q_internal_flows(spark, sf):
    return kept(spark, sf)


def q_active_windows(spark, sf):
    return ft.active_windows(ft.with_window(kept(spark, sf), 1800))


def q_port_usage(spark, sf):
    return ports.port_usage(event_flows(spark, sf))


def q_rare_ports(spark, sf):
    return ports.rare_ports(event_flows(spark, sf))


def q_dynamic_ports(spark, sf):
    return ports.dynamic_ports(event_flows(spark, sf))


def q_static_ports(spark, sf):
    return ports.choose_ports(event_flows(spark, sf), 2)


def q_entity_features(spark, sf):
    profiles = cut(ft.extract(kept(spark, sf), None, 0, 30))
    return ft.keep_active(profiles, "SrcConnMade").drop("ports")


def q_multi_window_features(spark, sf):
    return ft.extract(kept(spark, sf), None, 0, [30, 60, DAY_MINUTES]).drop("ports")


def q_daily_features(spark, sf):
    return ft.extract(kept(spark, sf), None, 0, DAY_MINUTES).drop("ports")


def q_bulk_features(spark, sf):
    flows = clean.internal_flows(bulk_flows(spark, sf))
    return ft.extract(flows, None, 0, DAY_MINUTES).drop("ports")


def q_port_features_long(spark, sf):
    flows = event_flows(spark, sf)
    chosen = ports.dynamic_ports(flows)
    return ft.port_cells(ft.extract(clean.internal_flows(flows), chosen, 1, DAY_MINUTES))


def q_port_features_wide(spark, sf):
    flows = event_flows(spark, sf)
    profiles = ft.extract(clean.internal_flows(flows), ports.choose_ports(flows, 0), 0, DAY_MINUTES)
    return ft.wide(profiles, [], [80, 194, 25, 22])


def _rates(spark, sf, key):
    flows = event_flows(spark, sf)
    profiles = ft.extract(clean.internal_flows(flows), ports.choose_ports(flows, 2), 2, DAY_MINUTES, key=key)
    out = ft.wide(profiles, ft.SET_B, [80, 194, 25, 22, 6667], roles=key)
    return rounded(out, 6, "SrcPktRate", "SrcAvgPktSize", "SrcICMPRate", "SrcSynRate")


def q_rate_features_src(spark, sf):
    return _rates(spark, sf, "src")


def q_rate_features_dst(spark, sf):
    return _rates(spark, sf, "dst")


def q_view_groups(spark, sf):
    return daily_vectors(spark, sf).groupBy(*GROUP).agg(F.count("*").alias("entities"))


def q_minmax_cells(spark, sf):
    scaled = vc.min_max(daily_vectors(spark, sf))
    return rounded(scaled.select(*GROUP, "entity", F.posexplode("vec").alias("feature", "value")), 9, "value")


def q_nn_distance(spark, sf):
    scaled, unique = daily_distinct(spark, sf)
    near = density.nearest_distances(unique, GROUP, digits=9)
    return vc.members(scaled, unique).join(near, [*GROUP, "id"]).select(*GROUP, "entity", "d")


def q_elbow_epsilon(spark, sf):
    _, unique = daily_distinct(spark, sf)
    near = cut(density.nearest_distances(unique, GROUP, digits=9))
    return elbow.choose_epsilon(density.distance_curve(near, GROUP), GROUP, digits=9).select(
        *GROUP, F.col("i").cast("long").alias("i"), "eps"
    )


def q_density_noise(spark, sf):
    _, unique = daily_distinct(spark, sf)
    near = cut(density.nearest_distances(unique, GROUP, digits=9))
    eps = elbow.choose_epsilon(density.distance_curve(near, GROUP), GROUP, digits=9)
    return density.density_noise(near, eps, GROUP).withColumnRenamed("id", "entity")


def q_density_clusters(spark, sf):
    return daily_clusters(spark, sf).labels.select(*GROUP, "entity", "cluster")


def q_lof_scores(spark, sf):
    scores = daily_clusters(spark, sf, SCORED).lof
    return rounded(scores.withColumnRenamed("id", "entity"), 6, "score")


def q_outlier_entities(spark, sf):
    return outliers.flagged_entities(daily_clusters(spark, sf).labels, GROUP)


def q_cluster_sizes(spark, sf):
    return outliers.cluster_sizes(daily_clusters(spark, sf).labels, GROUP)


def q_labelled_clusters(spark, sf):
    return outliers.labelled_clusters(daily_clusters(spark, sf).labels, truth(spark, sf), GROUP)


def q_labelled_hits(spark, sf):
    found = outliers.labelled_clusters(daily_clusters(spark, sf).labels, truth(spark, sf), GROUP)
    return outliers.hits_by_cluster(found, GROUP)


def q_hit_totals(spark, sf):
    found = outliers.labelled_clusters(daily_clusters(spark, sf).labels, truth(spark, sf), GROUP)
    return outliers.hit_totals(found, GROUP)


def _confusion(spark, sf, mode):
    c = daily_clusters(spark, sf, SCORED)
    scores = outliers.evaluate(c.labels, truth(spark, sf), GROUP, mode)
    scores = outliers.with_max_score(scores, c.lof, GROUP)
    return rounded(scores, 6, "accuracy", "precision", "recall", "f1", "max_score")


def q_confusion_standard(spark, sf):
    return _confusion(spark, sf, "standard")


def q_confusion_reference(spark, sf):
    return _confusion(spark, sf, "reference")


def q_labelled_scores(spark, sf):
    return rounded(outliers.labelled_scores(daily_clusters(spark, sf, SCORED).lof, truth(spark, sf), GROUP), 6, "score")


def q_embedding_neighbors(spark, sf):
    near = cells.nearest(cut(embedding_points(spark, sf)), ["g"], k=5)
    return rounded(near, 6, "d").select("id", "d")


def q_embedding_neighbors_approximate(spark, sf):
    near = approximate.approximate_nearest(cut(embedding_points(spark, sf)), ["g"], k=5)
    return rounded(near, 6, "d").select("id", "nid", "d", "approximate")


def q_embedding_lof(spark, sf):
    return rounded(lof.local_outlier_factor(embedding_points(spark, sf), ["g"]).drop("g"), 6, "score")


def _sweep(spark, sf):
    _, unique = daily_distinct(spark, sf)
    return unique, cut(kmeans.kmeans_grid(unique, GROUP))


def q_kmeans_grid(spark, sf):
    return kmeans.inertia_curve(_sweep(spark, sf)[1], GROUP)


def q_kmeans_clusters(spark, sf):
    unique, grid = _sweep(spark, sf)
    return kmeans.kmeans_labels(unique, grid, kmeans.choose_k(grid, GROUP), GROUP)


def q_cluster_profile(spark, sf):
    unique, grid = _sweep(spark, sf)
    labels = kmeans.kmeans_labels(unique, grid, kmeans.choose_k(grid, GROUP), GROUP)
    return kmeans.cluster_profile(unique.join(labels, [*GROUP, "id"]), GROUP)


def q_ward_clusters(spark, sf):
    unique, grid = _sweep(spark, sf)
    return ward.ward_clusters(unique, cut(kmeans.choose_k(grid, GROUP)), GROUP)


def q_nn_distance_blocks(spark, sf):
    """As nn_distance, with groups of more than 32 vectors cut into cells."""
    scaled, unique = daily_distinct(spark, sf)
    near = density.nearest_distances(unique, GROUP, 32, digits=9)
    return vc.members(scaled, unique).join(near, [*GROUP, "id"]).select(*GROUP, "entity", "d")


def q_density_clusters_blocks(spark, sf):
    """As density_clusters, with groups of more than 32 vectors cut into cells."""
    return daily_clusters(spark, sf, replace(DAILY, block=32)).labels.select(*GROUP, "entity", "cluster")


GIVEN_K = (3, 6)


def _given(spark, sf, block=cells.BLOCK):
    """K-means that starts from the first vectors of each group by id."""
    unique = daily_distinct(spark, sf)[1]
    order = F.row_number().over(W.partitionBy(*GROUP).orderBy("id")) - 1
    first = unique.select(*GROUP, F.col("vec").alias("centre"), order.alias("c")).filter(F.col("c") < max(GIVEN_K))
    ks = F.explode(F.array(*[F.lit(k) for k in GIVEN_K])).alias("k")
    starts = cut(first.select(*GROUP, ks, "c", "centre").filter("c < k"))
    return unique, cut(kmeans.kmeans_grid(unique, GROUP, block=block, starts=starts))


def q_kmeans_given_inertia(spark, sf):
    return rounded(kmeans.inertia_curve(_given(spark, sf)[1], GROUP), 6, "inertia")


def q_kmeans_given_inertia_blocks(spark, sf):
    """The same, with groups of more than 32 vectors spread over blocks."""
    return rounded(kmeans.inertia_curve(_given(spark, sf, 32)[1], GROUP), 6, "inertia")


def _given_labels(spark, sf):
    unique, grid = _given(spark, sf)
    chosen = unique.select(*GROUP).distinct().withColumn("k", F.lit(max(GIVEN_K)))
    return unique, kmeans.kmeans_labels(unique, grid, chosen, GROUP)


def q_kmeans_given_labels(spark, sf):
    return _given_labels(spark, sf)[1]


def q_kmeans_given_profile(spark, sf):
    unique, labels = _given_labels(spark, sf)
    return rounded(kmeans.cluster_profile(unique.join(labels, [*GROUP, "id"]), GROUP), 6, "mean")


PORTED = pl.Settings(method=0, minutes=(DAY_MINUTES // 2, DAY_MINUTES), digits=9, algorithms=("dbscan",))


def q_pipeline_density_scores(spark, sf):
    """The whole job over two window lengths, with port features, by density alone."""
    return rounded(pl.detect(event_flows(spark, sf), truth(spark, sf), PORTED).scores, 6, "accuracy", "precision", "recall", "f1", "max_score")


def q_pipeline_scores(spark, sf):
    return pl.detect(event_flows(spark, sf), truth(spark, sf), FULL).scores


# ---- the same in SQL --------------------------------------------------------


def _with(*ctes: tuple[str, str], final: str) -> str:
    body = ",\n".join(f"{name} AS ({text})" for name, text in ctes)
    return f"WITH RECURSIVE {body}\n{final}"


INTERNAL = "src_ip LIKE '172.31.%' OR dst_ip LIKE '172.31.%'"
FLOWS = ("flows", FLOW_SQL)
KEPT = ("kept", f"SELECT * FROM flows WHERE {INTERNAL}")
K4 = "day, win_sec, win_start, view"
K3 = "day, win_sec, win_start"


def windowed(seconds: int) -> str:
    return (
        f"SELECT *, {seconds} AS win_sec, "
        f"time_bucket(INTERVAL '{seconds} seconds', ts) AS win_start FROM kept"
    )


def set_a_sql(source: str) -> list[tuple[str, str]]:
    return [
        ("src_side", f"""SELECT {K3}, src_ip AS entity, COUNT(DISTINCT dst_ip) AS SrcIPContacted,
          COUNT(DISTINCT src_port) AS SrcPortUsed, COUNT(DISTINCT dst_port) AS SrcPortContacted,
          SUM(bwd_bytes) AS SrcTotLenRcv, SUM(fwd_bytes) AS SrcTotLenSent, COUNT(*) AS SrcConnMade
          FROM {source} GROUP BY ALL"""),
        ("dst_side", f"""SELECT {K3}, dst_ip AS entity, COUNT(DISTINCT src_ip) AS DstIPContacted,
          COUNT(DISTINCT dst_port) AS DstPortUsed, COUNT(DISTINCT src_port) AS DstPortContacted,
          SUM(fwd_bytes) AS DstTotLenRcv, SUM(bwd_bytes) AS DstTotLenSent, COUNT(*) AS DstTotConn
          FROM {source} GROUP BY ALL"""),
        ("profile", f"""SELECT {K3}, entity, {", ".join(f"COALESCE({c}, 0) AS {c}" for c in ft.SET_A)}
          FROM src_side FULL JOIN dst_side USING ({K3}, entity)"""),
    ]


FEATURES = f"SELECT {K3}, entity, {', '.join(ft.SET_A)} FROM profile"
DAILY_CTES = [FLOWS, KEPT, ("w", windowed(86400)), *set_a_sql("w")]
VECTOR_CTES = [
    *DAILY_CTES,
    ("active", f"SELECT {K3} FROM w GROUP BY ALL HAVING COUNT(*) >= 10"),
    ("viewed", f"""SELECT p.*, CASE WHEN entity LIKE '172.31.%' THEN 'internal' ELSE 'external' END AS view
       FROM profile p SEMI JOIN active USING ({K3})"""),
    ("populated", f"SELECT {K4}, COUNT(*) AS entities FROM viewed GROUP BY ALL HAVING COUNT(*) >= 30"),
    ("raw_vec", f"""SELECT {K4}, entity, [{", ".join(f"CAST({c} AS DOUBLE)" for c in ft.SET_A)}] AS raw
       FROM viewed SEMI JOIN populated USING ({K4})"""),
    ("cell", f"SELECT {K4}, entity, unnest(range({len(ft.SET_A)})) AS feature, unnest(raw) AS v FROM raw_vec"),
    ("bound", f"SELECT {K4}, feature, MIN(v) AS lo, MAX(v) AS hi FROM cell GROUP BY ALL"),
    ("scaled", f"""SELECT {K4}, entity, feature, CASE WHEN hi > lo THEN (v - lo) / (hi - lo) ELSE 0.0 END AS value
       FROM cell JOIN bound USING ({K4}, feature)"""),
]
NEAR_CTES = [
    *VECTOR_CTES,
    ("vec", f"SELECT {K4}, entity, list(value ORDER BY feature) AS vec FROM scaled GROUP BY ALL"),
    ("pair", f"""SELECT {", ".join(f"a.{c}" for c in K4.split(", "))}, a.entity AS a, b.entity AS b,
       ROUND(list_distance(a.vec, b.vec), 9) AS d
       FROM vec a JOIN vec b USING ({K4}) WHERE a.entity <> b.entity"""),
    ("near", f"SELECT {K4}, a AS entity, MIN(d) AS d FROM pair GROUP BY ALL"),
    ("ordered", f"""SELECT {K4}, d AS y, ROW_NUMBER() OVER (PARTITION BY {K4} ORDER BY d) - 1 AS i,
       MIN(d) OVER (PARTITION BY {K4}) AS y1, MAX(d) OVER (PARTITION BY {K4}) AS y2 FROM near"""),
    ("elbow", f"""SELECT {K4}, i, y FROM ordered QUALIFY ROW_NUMBER() OVER (PARTITION BY {K4} ORDER BY
       ROUND(ABS((y2 - y1) * (i + 2) - 28 * y + 30 * y1 - y2 * 2) / SQRT((y2 - y1) * (y2 - y1) + 28 * 28), 9) DESC, i) = 1"""),
    ("epsilon", f"SELECT {K4}, i, CASE WHEN y <= 0 THEN 0.3 ELSE y END AS eps FROM elbow"),
    ("noise", f"SELECT {K4}, entity FROM near JOIN epsilon USING ({K4}) WHERE d > eps"),
]
LABEL_CTES = [
    *NEAR_CTES,
    ("edge", f"SELECT {K4}, a, b FROM pair JOIN epsilon USING ({K4}) WHERE d <= eps"),
    # smallest entity within reach, one step further per round
    ("spread", f"""SELECT 0 AS step, {K4}, entity, entity AS low FROM vec SEMI JOIN edge
        ON vec.day = edge.day AND vec.win_sec = edge.win_sec AND vec.win_start = edge.win_start
        AND vec.view = edge.view AND vec.entity = edge.a
      UNION ALL
      SELECT step + 1, {K4}, entity, MIN(low) FROM (
        SELECT step, {K4}, entity, low FROM spread
        UNION ALL
        SELECT s.step, {", ".join(f"s.{c}" for c in K4.split(", "))}, e.a, s.low FROM spread s JOIN edge e
          ON s.day = e.day AND s.win_sec = e.win_sec AND s.win_start = e.win_start AND s.view = e.view AND s.entity = e.b
      ) WHERE step < 40 GROUP BY ALL"""),
    ("root", f"SELECT {K4}, entity, low FROM spread WHERE step = 40"),
    ("label", f"""SELECT {K4}, entity, 'dbscan' AS algorithm,
        CAST(DENSE_RANK() OVER (PARTITION BY {K4} ORDER BY low) - 1 AS INT) AS cluster FROM root
      UNION ALL SELECT {K4}, entity, 'dbscan', CAST(-1 AS INT) FROM noise"""),
    ("size", f"SELECT {K4}, algorithm, cluster, COUNT(*) AS size FROM label GROUP BY ALL"),
    ("sized", f"SELECT *, cluster < 0 OR size <= 1 AS outlier FROM size"),
    ("truth", TRUTH_SQL),
    ("found", f"""SELECT {", ".join(f"l.{c}" for c in K4.split(", "))}, role, entity, l.algorithm, l.cluster, size, outlier
       FROM label l JOIN truth ON l.day = truth.day AND entity = ip
       JOIN sized s ON {" AND ".join(f"s.{c} = l.{c}" for c in [*K4.split(", "), "algorithm", "cluster"])}"""),
]


def lof_sql(points: str, keys: str) -> list[tuple[str, str]]:
    """CTEs up to `lof` for points (keys, id, vec)."""
    each = keys.split(", ")
    return [
        ("lp", points),
        ("crowd", f"SELECT {keys}, COUNT(*) AS n FROM lp GROUP BY ALL"),
        ("knn", f"""SELECT {", ".join(f"a.{c}" for c in each)}, a.id AS id, b.id AS nid, list_distance(a.vec, b.vec) AS d
           FROM lp a JOIN lp b USING ({keys}) JOIN crowd USING ({keys}) WHERE a.id <> b.id AND n > 5
           QUALIFY ROW_NUMBER() OVER (PARTITION BY {", ".join(f"a.{c}" for c in each)}, a.id ORDER BY d, b.id) <= 5"""),
        ("kdist", f"SELECT {keys}, id AS nid, MAX(d) AS kd FROM knn GROUP BY ALL"),
        ("lrd", f"""SELECT {keys}, id, 1.0 / (AVG(GREATEST(kd, d)) + 1e-10) AS lrd
           FROM knn JOIN kdist USING ({keys}, nid) GROUP BY ALL"""),
        ("factor", f"""SELECT {", ".join(f"k.{c}" for c in each)}, k.id, -AVG(o.lrd / p.lrd) AS score FROM knn k
           JOIN lrd o ON {" AND ".join(f"o.{c} = k.{c}" for c in each)} AND o.id = k.nid
           JOIN lrd p ON {" AND ".join(f"p.{c} = k.{c}" for c in each)} AND p.id = k.id GROUP BY ALL"""),
        ("lof", f"""SELECT {keys}, id, COALESCE(score, 0.0) AS score FROM lp LEFT JOIN factor USING ({keys}, id)"""),
    ]


LOF_CTES = [
    *LABEL_CTES,
    *lof_sql(f"SELECT {K4}, entity AS id, raw AS vec FROM raw_vec SEMI JOIN noise USING ({K4}, entity)", K4),
]
G4 = K4.split(", ")


def same_group(*names: str) -> str:
    """That rows of the named tables are of one group."""
    return " AND ".join(f"{names[0]}.{c} = {n}.{c}" for n in names[1:] for c in G4)


GIVEN_CTES = [
    *VECTOR_CTES,
    ("vec", f"SELECT {K4}, entity, list(value ORDER BY feature) AS vec FROM scaled GROUP BY ALL"),
    ("uniq", f"SELECT {K4}, vec, MIN(entity) AS id, CAST(COUNT(*) AS DOUBLE) AS weight FROM vec GROUP BY ALL"),
    ("most", f"SELECT {K4}, 1e-4 * AVG(v) AS most FROM (SELECT {K4}, feature, VAR_POP(value) AS v FROM scaled GROUP BY ALL) GROUP BY ALL"),
    ("ordered", f"SELECT *, ROW_NUMBER() OVER (PARTITION BY {K4} ORDER BY id) - 1 AS c FROM uniq"),
    ("lloyd", f"""SELECT 0 AS step, {K4}, k, c, vec AS centre, true AS moves
        FROM ordered JOIN (VALUES {", ".join(f"({k})" for k in GIVEN_K)}) t(k) ON c < k
      UNION ALL
      SELECT step + 1, {K4}, k, c, new, SUM(list_distance(centre, new) * list_distance(centre, new)) OVER (PARTITION BY {K4}, k) > most
      FROM (SELECT l.*, COALESCE(m.new, l.centre) AS new FROM lloyd l LEFT JOIN (
          SELECT {K4}, k, c, list(mean ORDER BY feature) AS new FROM (
            SELECT {K4}, k, c, feature, SUM(weight * value) / SUM(weight) AS mean FROM (
              SELECT {", ".join(f"n.{c}" for c in G4)}, k, place.c AS c, weight, unnest(vec) AS value, unnest(range(len(vec))) AS feature FROM (
                SELECT {", ".join(f"u.{c}" for c in G4)}, k, u.vec, u.weight, MIN({{'d': ROUND(list_distance(u.vec, z.centre), 12), 'c': z.c}}) AS place
                FROM lloyd z JOIN uniq u ON {same_group("z", "u")} WHERE z.moves GROUP BY ALL) n)
            GROUP BY ALL) GROUP BY ALL) m
          ON {same_group("l", "m")} AND l.k = m.k AND l.c = m.c WHERE l.moves) JOIN most USING ({K4})"""),
    ("settled", f"SELECT * FROM lloyd WHERE NOT moves"),
    ("placed", f"""SELECT {", ".join(f"u.{c}" for c in G4)}, k, id, u.vec, weight,
       MIN({{'d': ROUND(list_distance(u.vec, z.centre), 12), 'c': z.c}}) AS place, MIN(list_distance(u.vec, z.centre)) AS d
       FROM settled z JOIN uniq u ON {same_group("z", "u")} GROUP BY ALL"""),
    ("profile_cell", f"""SELECT {K4}, CAST(place.c AS INT) AS cluster, weight, unnest(vec) AS value, CAST(unnest(range(len(vec))) AS INT) AS feature
       FROM placed WHERE k = {max(GIVEN_K)}"""),
    ("cluster_mean", f"SELECT {K4}, cluster, feature, SUM(weight * value) / SUM(weight) AS mean FROM profile_cell GROUP BY ALL"),
]
GIVEN_INERTIA = _with(*GIVEN_CTES, final=f"SELECT {K4}, CAST(k AS INT) AS k, ROUND(SUM(weight * d * d), 6) AS inertia FROM placed GROUP BY ALL")
EMBEDDING_POINTS = (
    "SELECT 0 AS g, CAST(vec_id AS VARCHAR) AS id, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings"
)


def confusion_sql(mode: str, ctes=None) -> str:
    fn = "0" if mode == "reference" else "present - hits"
    return _with(
        *(ctes or LOF_CTES),
        ("total", f"""SELECT {K4}, algorithm, CAST(SUM(size) AS BIGINT) AS entities,
           CAST(SUM(CASE WHEN outlier THEN size ELSE 0 END) AS BIGINT) AS flagged FROM sized GROUP BY ALL"""),
        ("hit", f"""SELECT {K4}, role, algorithm, COUNT(*) AS present,
           CAST(SUM(CASE WHEN outlier THEN 1 ELSE 0 END) AS BIGINT) AS hits FROM found GROUP BY ALL"""),
        ("conf", f"""SELECT {K4}, role, algorithm, hits AS tp, flagged - hits AS fp,
           entities - flagged - CAST({fn} AS BIGINT) AS tn, CAST({fn} AS BIGINT) AS fn
           FROM hit JOIN total USING ({K4}, algorithm)"""),
        ("rates", """SELECT *, COALESCE((tp + tn) / NULLIF(tp + tn + fn + fp, 0), 0.0) AS accuracy,
           COALESCE(tp / NULLIF(tp + fp, 0), 0.0) AS precision, COALESCE(tp / NULLIF(tp + fn, 0), 0.0) AS recall FROM conf"""),
        ("worst", f"SELECT {K4}, MIN(score) AS max_score FROM lof GROUP BY ALL"),
        final=f"""SELECT {K4}, role, algorithm, tp, fp, tn, fn, ROUND(accuracy, 6) AS accuracy,
           ROUND(precision, 6) AS precision, ROUND(recall, 6) AS recall,
           ROUND(COALESCE(2 * precision * recall / NULLIF(precision + recall, 0), 0.0), 6) AS f1,
           ROUND(COALESCE(max_score, 0.0), 6) AS max_score
           FROM rates LEFT JOIN worst USING ({K4})""",
    )


def rates_sql(key: str) -> str:
    peer = "dst_ip" if key == "src" else "src_ip"
    mine, other = ("src_port", "dst_port") if key == "src" else ("dst_port", "src_port")
    to, frm = ("SrcTo", "SrcFrom") if key == "src" else ("DstTo", "DstFrom")
    sent, received = ("fwd_pkts + 1", "bwd_pkts - 1") if key == "src" else ("bwd_pkts - 1", "fwd_pkts + 1")
    cells = ",\n".join(
        f"""CAST(COALESCE(SUM({v}) FILTER ({c} = {p}), 0) AS DOUBLE) AS "{p}{s}\""""
        for p in (80, 194, 25, 22, 6667)
        for s, c, v in ((to, mine, sent), (frm, other, received))
    )
    pkts = "SUM(fwd_pkts + bwd_pkts)"
    return _with(
        FLOWS, KEPT, ("w", windowed(86400)),
        final=f"""SELECT {K3}, {key}_ip AS entity, COUNT(DISTINCT {peer}) AS SrcIPContacted,
          CAST({pkts} AS BIGINT) AS SrcTotalNumPkts, SUM(fwd_bytes + bwd_bytes) AS SrcTotalNumBytes,
          ROUND({pkts} / CASE WHEN SUM(flow_duration) = 0 THEN 0.1 ELSE SUM(flow_duration) END, 6) AS SrcPktRate,
          ROUND(COALESCE(SUM(fwd_bytes + bwd_bytes) / NULLIF({pkts}, 0), 0), 6) AS SrcAvgPktSize,
          ROUND(COALESCE(CAST(SUM(CASE WHEN protocol = 1 THEN fwd_pkts + bwd_pkts ELSE 0 END) AS DOUBLE) / NULLIF({pkts}, 0), 0), 6) AS SrcICMPRate,
          ROUND(COALESCE(SUM(syn_cnt) / NULLIF({pkts}, 0), 0), 6) AS SrcSynRate,
          COUNT(DISTINCT dst_port) AS NumDport, COUNT(DISTINCT src_port) AS NumSport,
          {cells} FROM w GROUP BY {K3}, {key}_ip""",
    )


PORT_CTES = [
    FLOWS,
    ("usage", """SELECT day, 'dst' AS side, dst_port AS port, COUNT(*) AS cnt FROM flows WHERE dst_port < 49151 GROUP BY ALL
       UNION ALL SELECT day, 'src', src_port, COUNT(*) FROM flows WHERE src_port < 49151 GROUP BY ALL"""),
    ("rare", """SELECT day, dst_port AS port, COUNT(DISTINCT src_ip) AS sources FROM flows WHERE dst_port < 49151
       GROUP BY ALL HAVING COUNT(DISTINCT src_ip) < 10"""),
    ("chosen", """SELECT day, port FROM usage QUALIFY ROW_NUMBER() OVER (PARTITION BY day ORDER BY cnt DESC, port, side) <= 33
       UNION SELECT day, port FROM usage SEMI JOIN rare USING (day, port)
         QUALIFY ROW_NUMBER() OVER (PARTITION BY day ORDER BY cnt DESC, port, side) <= 33
       UNION SELECT day, port FROM usage WHERE port < 1024
         QUALIFY ROW_NUMBER() OVER (PARTITION BY day ORDER BY cnt, port DESC, side DESC) <= 33"""),
]


def port_cell_sql(entity: str, port: str, suffix: str, value: str) -> str:
    return f"""SELECT {K3}, {entity} AS entity, CAST({port} AS VARCHAR) || '{suffix}' AS feature,
      CAST(SUM({value}) AS DOUBLE) AS value
      FROM w SEMI JOIN chosen ON w.day = chosen.day AND w.{port} = chosen.port GROUP BY ALL"""


PORT_BLOCKS = [
    ("src_ip", "src_port", "SrcTo", "fwd_pkts + 1"),
    ("src_ip", "dst_port", "SrcFrom", "bwd_pkts - 1"),
    ("dst_ip", "dst_port", "DstTo", "bwd_pkts - 1"),
    ("dst_ip", "src_port", "DstFrom", "fwd_pkts + 1"),
]
PORT_LONG = " UNION ALL ".join(port_cell_sql(*b) for b in PORT_BLOCKS)
DIRTY_SQL = f"""
SELECT CASE WHEN event_id % 43 <> 0 THEN strftime(ts, '%d/%m/%Y %I:%M:%S %p') END AS "Timestamp",
 src_ip AS "Src IP", dst_ip AS "Dst IP",
 CASE WHEN event_id % 41 <> 0 THEN CAST(src_port AS VARCHAR) END AS "Src Port", CAST(dst_port AS VARCHAR) AS "Dst Port",
 CAST(fwd_pkts AS VARCHAR) AS "Tot Fwd Pkts", CAST(bwd_pkts AS VARCHAR) AS "Tot Bwd Pkts",
 CAST(fwd_bytes AS VARCHAR) AS "TotLen Fwd Pkts", CAST(bwd_bytes AS VARCHAR) AS "TotLen Bwd Pkts",
 CAST(syn_cnt AS VARCHAR) AS "SYN Flag Cnt", CAST(flow_duration AS VARCHAR) AS "Flow Duration",
 CAST(protocol AS VARCHAR) AS "Protocol"
FROM flows
UNION ALL SELECT {", ".join(f"'{c}'" for c in [*RAW_COLUMNS, *RATE_COLUMNS])} FROM flows WHERE event_id % 997 = 0
"""
WIDE_CELLS = ", ".join(
    f"""COALESCE(SUM(value) FILTER (feature = '{p}{s}'), 0) AS "{p}{s}\""""
    for p in (80, 194, 25, 22)
    for _, _, s, _ in PORT_BLOCKS
)
SIZES = [1800, 3600, 86400]


def ported_ctes() -> list[tuple[str, str]]:
    """LOF_CTES over two window lengths, with the port features behind the others."""
    ports = [22, 25, 80, 194]
    wide = ", ".join(
        f"COALESCE(SUM(value) FILTER (feature = '{p}{s}'), 0.0) AS f{p}{s}" for p in ports for _, _, s, _ in PORT_BLOCKS
    )
    columns = [*(f"CAST({c} AS DOUBLE)" for c in ft.SET_A), *(f"COALESCE(f{p}{s}, 0.0)" for p in ports for _, _, s, _ in PORT_BLOCKS)]
    changed = {
        "w": " UNION ALL ".join(windowed(60 * m) for m in PORTED.minutes),
        "raw_vec": f"""SELECT {K4}, entity, [{", ".join(columns)}] AS raw
           FROM viewed SEMI JOIN populated USING ({K4}) LEFT JOIN wide_ports USING ({K3}, entity)""",
        "cell": f"SELECT {K4}, entity, unnest(range({len(columns)})) AS feature, unnest(raw) AS v FROM raw_vec",
    }
    before = {
        "raw_vec": [
            ("chosen", "SELECT day, unnest([80, 194, 25, 22]) AS port FROM (SELECT DISTINCT day FROM flows)"),
            ("port_cells", PORT_LONG),
            ("wide_ports", f"SELECT {K3}, entity, {wide} FROM port_cells GROUP BY {K3}, entity"),
        ],
    }
    return [x for name, text in LOF_CTES for x in [*before.get(name, []), (name, changed.get(name, text))]]


ORACLES = {
    "clean_flows": _with(
        FLOWS, ("dirty", DIRTY_SQL),
        ("filled", """SELECT COALESCE(COLUMNS(*), '0') FROM dirty"""),
        final="""SELECT strptime("Timestamp", '%d/%m/%Y %I:%M:%S %p') AS ts, "Src IP" AS src_ip, "Dst IP" AS dst_ip,
          CAST("Src Port" AS INT) AS src_port, CAST("Dst Port" AS INT) AS dst_port,
          CAST("Tot Fwd Pkts" AS BIGINT) AS fwd_pkts, CAST("Tot Bwd Pkts" AS BIGINT) AS bwd_pkts,
          CAST("TotLen Fwd Pkts" AS DOUBLE) AS fwd_bytes, CAST("TotLen Bwd Pkts" AS DOUBLE) AS bwd_bytes,
          CAST("SYN Flag Cnt" AS DOUBLE) AS syn_cnt, CAST("Flow Duration" AS DOUBLE) AS flow_duration,
          CAST("Protocol" AS INT) AS protocol
          FROM filled WHERE "Src Port" <> 'Src Port' AND "Timestamp" <> '0'""",
    ),
    "quarantined_flows": _with(
        FLOWS, ("dirty", DIRTY_SQL),
        ("broken", """SELECT * REPLACE (
          CASE WHEN TRY_CAST("Dst Port" AS INT) % 89 = 0 THEN "Dst Port" || '/tcp' ELSE "Dst Port" END AS "Dst Port",
          CASE WHEN "Tot Fwd Pkts" = '7' AND TRY_CAST("Dst Port" AS INT) % 2 = 0 THEN 'many' ELSE "Tot Fwd Pkts" END AS "Tot Fwd Pkts",
          regexp_replace("Timestamp", '^13/', '31/02/') AS "Timestamp") FROM dirty"""),
        ("filled", """SELECT COALESCE(COLUMNS(*), '0') FROM broken"""),
        ("judged", f"""SELECT *, concat_ws(',',
          CASE WHEN try_strptime("Timestamp", '%d/%m/%Y %I:%M:%S %p') IS NULL THEN 'Timestamp' END,
          {", ".join(f"""CASE WHEN TRY_CAST("{c}" AS {kind}) IS NULL THEN '{c}' END""" for c, (_, kind) in {**RAW_COLUMNS, **RATE_COLUMNS}.items() if kind not in ("string", "timestamp_ntz"))}
          ) AS unreadable FROM filled WHERE "Src Port" <> 'Src Port' AND "Timestamp" <> '0'"""),
        final="SELECT * FROM judged WHERE unreadable <> ''",
    ),
    "capture_flows": _with(
        FLOWS,
        final="""SELECT day, 'flows-' || CAST(day AS VARCHAR) AS file, COUNT(*) AS flows, MIN(ts) AS first, MAX(ts) AS last
          FROM flows WHERE ts BETWEEN date_trunc('day', ts) + INTERVAL 4 HOURS AND date_trunc('day', ts) + INTERVAL 28 HOURS
          GROUP BY ALL""",
    ),
    "internal_flows": _with(FLOWS, KEPT, final="SELECT * FROM kept"),
    "active_windows": _with(
        FLOWS, KEPT, ("w", windowed(1800)),
        final=f"SELECT {K3}, COUNT(*) AS flows FROM w GROUP BY ALL HAVING COUNT(*) >= 10",
    ),
    "port_usage": _with(*PORT_CTES, final="SELECT day, side, port, cnt FROM usage"),
    "rare_ports": _with(*PORT_CTES, final="SELECT day, port, sources FROM rare"),
    "dynamic_ports": _with(*PORT_CTES, final="SELECT day, port FROM chosen"),
    "static_ports": _with(FLOWS, final="SELECT day, unnest([80, 194, 25, 22, 6667]) AS port FROM (SELECT DISTINCT day FROM flows)"),
    "entity_features": _with(
        FLOWS, KEPT, ("every", windowed(1800)),
        ("w", f"SELECT * FROM every QUALIFY COUNT(*) OVER (PARTITION BY {K3}) >= 10"),
        *set_a_sql("w"), final=FEATURES,
    ),
    "multi_window_features": _with(
        FLOWS, KEPT, ("w", " UNION ALL ".join(windowed(s) for s in SIZES)), *set_a_sql("w"), final=FEATURES
    ),
    "daily_features": _with(*DAILY_CTES, final=FEATURES),
    "bulk_features": _with(
        ("flows", BULK_SQL), KEPT, ("w", windowed(86400)), *set_a_sql("w"), final=FEATURES
    ),
    "port_features_long": _with(*PORT_CTES, KEPT, ("w", windowed(86400)), final=PORT_LONG),
    "port_features_wide": _with(
        FLOWS, KEPT, ("w", windowed(86400)),
        ("chosen", "SELECT day, unnest([80, 194, 25, 22]) AS port FROM (SELECT DISTINCT day FROM flows)"),
        ("cells", PORT_LONG),
        ("everyone", f"SELECT {K3}, src_ip AS entity FROM w UNION SELECT {K3}, dst_ip FROM w"),
        final=f"""SELECT {K3}, entity, {WIDE_CELLS} FROM everyone LEFT JOIN cells USING ({K3}, entity) GROUP BY {K3}, entity""",
    ),
    "rate_features_src": rates_sql("src"),
    "rate_features_dst": rates_sql("dst"),
    "view_groups": _with(*VECTOR_CTES, final=f"SELECT {K4}, entities FROM populated"),
    "minmax_cells": _with(
        *VECTOR_CTES, final=f"SELECT {K4}, entity, CAST(feature AS INT) AS feature, ROUND(value, 9) AS value FROM scaled"
    ),
    "nn_distance": _with(*NEAR_CTES, final=f"SELECT {K4}, entity, d FROM near"),
    "elbow_epsilon": _with(*NEAR_CTES, final=f"SELECT {K4}, i, eps FROM epsilon"),
    "density_noise": _with(*NEAR_CTES, final=f"SELECT {K4}, entity FROM noise"),
    "density_clusters": _with(*LABEL_CTES, final=f"SELECT {K4}, entity, cluster FROM label"),
    "lof_scores": _with(*LOF_CTES, final=f"SELECT {K4}, id AS entity, ROUND(score, 6) AS score FROM lof"),
    "outlier_entities": _with(
        *LABEL_CTES,
        final=f"""SELECT {K4}, entity, algorithm, cluster FROM label JOIN sized USING ({K4}, algorithm, cluster) WHERE outlier""",
    ),
    "cluster_sizes": _with(*LABEL_CTES, final=f"SELECT {K4}, algorithm, cluster, size, outlier FROM sized"),
    "labelled_clusters": _with(*LABEL_CTES, final="SELECT * FROM found"),
    "labelled_hits": _with(
        *LABEL_CTES,
        final=f"""SELECT {K4}, role, algorithm, cluster, CAST(SUM(CASE WHEN outlier THEN 1 ELSE 0 END) AS BIGINT) AS hits
          FROM found GROUP BY ALL""",
    ),
    "hit_totals": _with(
        *LABEL_CTES,
        final=f"""SELECT {K4}, role, algorithm, COUNT(*) AS present,
          CAST(SUM(CASE WHEN outlier THEN 1 ELSE 0 END) AS BIGINT) AS hits FROM found GROUP BY ALL""",
    ),
    "confusion_standard": confusion_sql("standard"),
    "confusion_reference": confusion_sql("reference"),
    "labelled_scores": _with(
        *LOF_CTES,
        final=f"""SELECT {", ".join(f"lof.{c}" for c in K4.split(", "))}, role, id AS entity, ROUND(score, 6) AS score
          FROM lof JOIN truth ON lof.day = truth.day AND id = ip""",
    ),
    "nn_distance_blocks": _with(*NEAR_CTES, final=f"SELECT {K4}, entity, d FROM near"),
    "density_clusters_blocks": _with(*LABEL_CTES, final=f"SELECT {K4}, entity, cluster FROM label"),
    "kmeans_given_inertia": GIVEN_INERTIA,
    "kmeans_given_inertia_blocks": GIVEN_INERTIA,
    "kmeans_given_labels": _with(
        *GIVEN_CTES, final=f"SELECT {K4}, id, CAST(place.c AS INT) AS cluster FROM placed WHERE k = {max(GIVEN_K)}"
    ),
    "kmeans_given_profile": _with(
        *GIVEN_CTES,
        final=f"""SELECT {K4}, cluster, feature, ROUND(mean, 6) AS mean FROM cluster_mean
          SEMI JOIN (SELECT {K4}, feature FROM cluster_mean WHERE mean > 0.2) USING ({K4}, feature)""",
    ),
    "pipeline_density_scores": confusion_sql("standard", ported_ctes()),
    "embedding_neighbors": _with(
        ("p", EMBEDDING_POINTS),
        final="""SELECT a.id AS id, ROUND(list_distance(a.vec, b.vec), 6) AS d FROM p a JOIN p b ON a.g = b.g AND a.id <> b.id
          QUALIFY ROW_NUMBER() OVER (PARTITION BY a.id ORDER BY list_distance(a.vec, b.vec), b.id) <= 5""",
    ),
    "embedding_lof": _with(*lof_sql(EMBEDDING_POINTS, "g"), final="SELECT id, ROUND(score, 6) AS score FROM lof"),
}

QUERIES = {name[2:]: fn for name, fn in list(globals().items()) if name.startswith("q_")}
