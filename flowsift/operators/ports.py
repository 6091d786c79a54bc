"""Choosing the ports worth featuring."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..sources.dimensions import STATIC_PORTS

PORT_LIMIT = 49151
WELL_KNOWN = 1024
RARE_BELOW = 10


def port_stats(flows: DataFrame) -> DataFrame:
    """(day, side, port, cnt, sources): use of each port on either side of a flow.

    One scan serves the usage ranking and the rare ports. `sources` counts the
    distinct source addresses seen on the destination side. Both counts are
    combined before the shuffle, and the distinct addresses are spread by
    address, so a port that carries most of the traffic stays spread out.
    """
    sides = F.explode(
        F.array(
            F.struct(F.lit("dst").alias("side"), F.col("dst_port").alias("port"), F.col("src_ip").alias("ip")),
            F.struct(F.lit("src").alias("side"), F.col("src_port").alias("port"), F.lit(None).cast("string").alias("ip")),
        )
    )
    return (
        flows.select("day", sides.alias("s"))
        .select("day", "s.*")
        .filter(F.col("port") < PORT_LIMIT)
        .groupBy("day", "side", "port")
        .agg(F.count("*").alias("cnt"), F.count_distinct("ip").alias("sources"))
    )


def port_usage(flows: DataFrame) -> DataFrame:
    """(day, side, port, cnt)."""
    return port_stats(flows).select("day", "side", "port", "cnt")


def rare_ports(flows: DataFrame, below: int = RARE_BELOW) -> DataFrame:
    """(day, port, sources): destination ports reached by few source addresses."""
    return (
        flows.filter(F.col("dst_port") < PORT_LIMIT)
        .groupBy("day", F.col("dst_port").alias("port"))
        .agg(F.count_distinct("src_ip").alias("sources"))
        .filter(F.col("sources") < below)
    )


def dynamic_ports(flows: DataFrame, x: int = 100, below: int = RARE_BELOW) -> DataFrame:
    """(day, port): most used, most used among the rare, least used well-known.

    Each third holds int(x / 3) entries of the usage ranking, in which a port
    has one entry per side. The ranking has at most two entries per port number
    below the limit, so a day's window partition is bounded whatever the data.
    """
    third = int(x / 3)
    stats = port_stats(flows)
    on_dst = F.when((F.col("side") == "dst") & (F.col("sources") < below), 1).otherwise(0)
    ranked = stats.select(
        "day", "side", "port", "cnt",
        (F.max(on_dst).over(W.partitionBy("day", "port")) == 1).alias("rare"),
        (F.col("port") < WELL_KNOWN).alias("low"),
    )
    order = [F.col("cnt").desc(), F.col("port").asc(), F.col("side").asc()]
    reverse = [F.col("cnt").asc(), F.col("port").desc(), F.col("side").desc()]
    ranked = ranked.select(
        "day", "port", "rare", "low",
        F.row_number().over(W.partitionBy("day").orderBy(*order)).alias("top"),
        F.row_number().over(W.partitionBy("day", "rare").orderBy(*order)).alias("top_rare"),
        F.row_number().over(W.partitionBy("day", "low").orderBy(*reverse)).alias("bottom_low"),
    )
    return (
        ranked.filter(
            (F.col("top") <= third)
            | (F.col("rare") & (F.col("top_rare") <= third))
            | (F.col("low") & (F.col("bottom_low") <= third))
        )
        .select("day", "port")
        .distinct()
    )


def choose_ports(flows: DataFrame, method: int = 1, x: int = 100, calendar: DataFrame | None = None) -> DataFrame:
    """(day, port) for feature method 0, 1 or 2.

    The fixed lists of methods 0 and 2 go to the days of `calendar`; without one the
    days are looked up in the flows, which reads that column of all of them.
    """
    if method == 1:
        return dynamic_ports(flows, x)
    listed = F.array(*[F.lit(p) for p in STATIC_PORTS[method]])
    days = flows if calendar is None else calendar
    return days.select("day").distinct().select("day", F.explode(listed).alias("port"))
