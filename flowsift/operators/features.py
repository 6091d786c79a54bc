"""One behaviour profile per (day, window, address).

Every flow is unfolded into what each of its two ends touched: the port it
used, the port it talked to, and the address it talked to. These *items* are
aggregated once per (window, address, role, item). All features follow from
that one table: distinct counts are row counts, totals are sums over one kind
of item, and the port features are the items whose port was chosen. A scan of
the flows therefore feeds two shuffles and no join between feature blocks.

The first shuffle hashes on the item too, after map-side combining, so neither
an address nor a window that holds a third of all flows ends up in one task.
The second one moves map-side partial sums only. Two addresses that talked to each other are one row
in the first shuffle, whichever of them the item belongs to, and totals travel with the items they are read from only.
"""

from __future__ import annotations

from functools import reduce
from math import gcd

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.scalars import EPOCH, floor_time, ratio
from .joins import attach

WINDOW = ["day", "win_sec", "win_start"]
PROFILE = [*WINDOW, "entity"]
MIN_FLOWS = 10

OWN_PORT, PEER_PORT, PEER_IP = 0, 1, 2
KINDS = (OWN_PORT, PEER_PORT, PEER_IP)
PAIR = "pair"  # the role of a row that is an item of either end
ROLES = ("src", "dst", PAIR)

SET_A = [
    "SrcIPContacted", "SrcPortUsed", "SrcPortContacted", "SrcTotLenRcv", "SrcTotLenSent", "SrcConnMade",
    "DstIPContacted", "DstPortUsed", "DstPortContacted", "DstTotLenRcv", "DstTotLenSent", "DstTotConn",
]
SET_B = [
    "SrcIPContacted", "SrcTotalNumPkts", "SrcTotalNumBytes", "SrcPktRate", "SrcAvgPktSize",
    "SrcICMPRate", "SrcSynRate", "NumDport", "NumSport",
]
PORT_SUFFIXES = {"both": ["SrcTo", "SrcFrom", "DstTo", "DstFrom"], "src": ["SrcTo", "SrcFrom"], "dst": ["DstTo", "DstFrom"]}


def window_seconds(minutes) -> list[int]:
    """Window lengths in whole seconds, from one or more lengths in minutes."""
    sizes = [minutes] if isinstance(minutes, (int, float)) else list(minutes)
    return sorted({int(m * 60) for m in sizes})


def _offset(origin: int | dict[int, int]):
    """The start of a row's grid, from one origin for all rows or one per `day`."""
    if not isinstance(origin, dict):
        return F.lit(origin)
    entries = [F.lit(v).cast("long" if i % 2 else "int") for i, v in enumerate(v for pair in sorted(origin.items()) for v in pair)]
    own = F.try_element_at(F.create_map(*entries), F.col("day").cast("int")) if entries else F.lit(None).cast("long")
    return F.coalesce(own, F.lit(0))


def with_window(flows: DataFrame, seconds: int, origin: int | dict[int, int] = 0) -> DataFrame:
    """Adds `win_sec` and `win_start` (tumbling, left-closed).

    `origin` shifts the grid, in seconds after midnight 1970-01-01; it matters
    only for lengths that do not divide a day. It may be a table day -> seconds,
    such as `dimensions.capture_origins()`; days it does not hold count from 0.
    """
    if isinstance(origin, dict):
        start = floor_time(F.col("ts"), F.lit(seconds), _offset(origin))
    else:
        start = F.window("ts", f"{seconds} seconds", startTime=f"{origin % seconds} seconds")["start"]
    return flows.withColumn("win_start", start).withColumn("win_sec", F.lit(seconds))


def active_windows(flows: DataFrame, min_flows: int = MIN_FLOWS) -> DataFrame:
    """(day, win_sec, win_start, flows) of windows with enough flows.

    `flows` are windowed flows that already touch an internal address.
    """
    return flows.groupBy(*WINDOW).agg(F.count("*").alias("flows")).filter(F.col("flows") >= min_flows)


def flow_items(flows: DataFrame, minutes=30, origin: int | dict[int, int] = 0, rates: bool = False) -> DataFrame:
    """The item table for one or more window lengths.

    Several lengths share one pass: items are built on the longest window that
    divides them all, then summed into each requested length. Packets are those of
    ports, all other totals those of an end's own ports; elsewhere they are null.
    """
    sizes = window_seconds(minutes)
    base = reduce(gcd, sizes)
    windowed = with_window(flows, base, origin)
    clock = windowed.schema["win_start"].dataType
    totals = ["fwd_pkts", "bwd_pkts", "fwd_bytes", "bwd_bytes"]
    if rates:
        windowed = windowed.withColumn("icmp_pkts", F.when(F.col("protocol") == 1, F.col("fwd_pkts") + F.col("bwd_pkts")).otherwise(0))
        totals += ["flow_duration", "syn_cnt", "icmp_pkts"]

    def item(role, entity, kind, port=None, ip=None):
        return F.struct(
            F.lit(ROLES.index(role) * len(KINDS) + kind).cast("tinyint").alias("what"),
            F.col(entity).alias("entity"),
            (F.col(port) if port else F.lit(None)).cast("int").alias("port"),
            (F.col(ip) if ip else F.lit(None)).cast("string").alias("ip"),
        )

    touched = F.array(
        item("src", "src_ip", OWN_PORT, port="src_port"),
        item("src", "src_ip", PEER_PORT, port="dst_port"),
        item("dst", "dst_ip", OWN_PORT, port="dst_port"),
        item("dst", "dst_ip", PEER_PORT, port="src_port"),
        item(PAIR, "src_ip", PEER_IP, ip="dst_ip"),
    )
    kind = F.pmod(F.col("what"), F.lit(len(KINDS)))
    read = {c: kind != PEER_IP if c in ("fwd_pkts", "bwd_pkts") else kind == OWN_PORT for c in totals}
    # short keys: the start as a number, role and kind as one; a constant length need not travel
    items = (
        windowed.select("day", _seconds(F.col("win_start"), clock).alias("start"), *totals, F.explode(touched).alias("item"))
        .select("day", "start", "item.*", *totals)
        .groupBy("day", "start", "entity", "what", "port", "ip")
        .agg(F.count("*").alias("n"), *[F.sum(F.when(used, F.col(c))).alias(c) for c, used in read.items()])
    )
    role = F.element_at(F.array(*[F.lit(r) for r in ROLES]), F.floor(F.col("what") / len(KINDS)).cast("int") + 1)
    items = items.select(
        "day", F.lit(base).alias("win_sec"), _from_seconds(F.col("start"), clock).alias("win_start"),
        "entity", role.alias("role"), kind.cast("tinyint").alias("kind"), "port", "ip", "n", *totals,
    )
    keys = [*PROFILE, "role", "kind", "port", "ip"]
    if sizes == [base]:
        return _of_both_ends(items)
    return _of_both_ends(
        items.withColumn("win_sec", F.explode(F.array(*[F.lit(s) for s in sizes])))
        .withColumn("win_start", floor_time(F.col("win_start"), F.col("win_sec"), _offset(origin)))
        .groupBy(*keys)
        .agg(*[F.sum(c).alias(c) for c in ["n", *totals]])
    )


def _seconds(start: Column, kind: T.DataType) -> Column:
    """A window's start, which is a whole second, as the seconds since 1970; for wall-clock times on their own clock."""
    if isinstance(kind, T.TimestampNTZType):
        return F.timestamp_diff("SECOND", F.expr(EPOCH), start)
    return F.unix_seconds(start)


def _from_seconds(seconds: Column, kind: T.DataType) -> Column:
    """What `_seconds` was made from."""
    if not isinstance(kind, T.TimestampNTZType):
        return F.timestamp_seconds(seconds)
    days = F.floor(seconds / 86400).cast("int")
    return F.timestamp_add("SECOND", F.pmod(seconds, F.lit(86400)).cast("int"), F.timestamp_add("DAY", days, F.expr(EPOCH)))


def _of_both_ends(items: DataFrame) -> DataFrame:
    """`items` with every pair of addresses as an item of its source and one of its destination."""
    own, other, pair = F.col("entity"), F.col("ip"), F.col("role") == PAIR

    def end(role, entity, ip):
        return F.struct(role.alias("role"), entity.alias("entity"), ip.alias("ip"))

    ends = F.when(pair, F.array(end(F.lit("src"), own, other), end(F.lit("dst"), other, own))).otherwise(
        F.array(end(F.col("role"), own, other))
    )
    names = [F.col(f"end.{c}").alias(c) if c in ("role", "entity", "ip") else F.col(c) for c in items.columns]
    return items.withColumn("end", F.explode(ends)).select(*names)


def _port_cell(ports: DataFrame | None, items: DataFrame, roles):
    """Items with `cell` = (feature name, value) where the port was chosen.

    Packet counts are corrected per flow: one more forward, one less backward.
    The port list has at most x entries per capture day, so it is small enough
    to broadcast at any volume of flows.
    """
    if ports is None:
        return items.withColumn("cell", F.lit(None).cast("struct<name:string,value:double>"))
    chosen = F.broadcast(ports.withColumn("chosen", F.lit(True)))
    src, own = F.col("role") == "src", F.col("kind") == OWN_PORT
    to_port = (src & own) | (~src & ~own)
    suffix = (
        F.when(src & own, "SrcTo").when(src, "SrcFrom").when(own, "DstTo").otherwise("DstFrom")
    )
    value = F.when(to_port, F.col("fwd_pkts") + F.col("n")).otherwise(F.col("bwd_pkts") - F.col("n"))
    wanted = F.col("chosen") & F.col("role").isin(roles)
    cell = F.when(
        wanted,
        F.struct(F.concat(F.col("port").cast("string"), suffix).alias("name"), value.cast("double").alias("value")),
    )
    return items.join(chosen, ["day", "port"], "left").withColumn("cell", cell).drop("chosen")


def _port_map():
    """Chosen port cells of a profile as a map; its size is bounded by the port list."""
    return F.map_from_entries(F.collect_list("cell")).alias("ports")


def profile_a(items: DataFrame, ports: DataFrame | None = None) -> DataFrame:
    """Feature set A: twelve totals per address in both roles, plus port cells."""
    src, dst = F.col("role") == "src", F.col("role") == "dst"
    kind = F.col("kind")

    def distinct(role, k):
        return F.count(F.when(role & (kind == k), 1))

    def total(role, column):
        return F.coalesce(F.sum(F.when(role & (kind == OWN_PORT), F.col(column))), F.lit(0.0))

    def flows(role):
        return F.coalesce(F.sum(F.when(role & (kind == OWN_PORT), F.col("n"))), F.lit(0))

    values = [
        distinct(src, PEER_IP), distinct(src, OWN_PORT), distinct(src, PEER_PORT),
        total(src, "bwd_bytes"), total(src, "fwd_bytes"), flows(src),
        distinct(dst, PEER_IP), distinct(dst, OWN_PORT), distinct(dst, PEER_PORT),
        total(dst, "fwd_bytes"), total(dst, "bwd_bytes"), flows(dst),
    ]
    return (
        _port_cell(ports, items, ["src", "dst"])
        .groupBy(*PROFILE)
        .agg(*[v.alias(name) for v, name in zip(values, SET_A)], _port_map())
    )


def profile_b(items: DataFrame, ports: DataFrame | None = None, key: str = "src") -> DataFrame:
    """Feature set B: rates per address in one role, plus that role's port cells.

    A quotient with denominator 0 is 0; a total duration of 0 counts as 0.1.
    `items` must have been built with `rates`.
    """
    kind = F.col("kind")

    def total(column):
        return F.sum(F.when(kind == OWN_PORT, column))

    pkts = F.col("fwd_pkts") + F.col("bwd_pkts")
    dport, sport = (PEER_PORT, OWN_PORT) if key == "src" else (OWN_PORT, PEER_PORT)
    sums = (
        _port_cell(ports, items.filter(F.col("role") == key), [key])
        .groupBy(*PROFILE)
        .agg(
            F.count(F.when(kind == PEER_IP, 1)).alias("SrcIPContacted"),
            total(pkts).alias("SrcTotalNumPkts"),
            total(F.col("fwd_bytes") + F.col("bwd_bytes")).alias("SrcTotalNumBytes"),
            total(F.col("flow_duration")).alias("duration"),
            total(F.col("icmp_pkts")).alias("icmp"),
            total(F.col("syn_cnt")).alias("syn"),
            F.count(F.when(kind == dport, 1)).alias("NumDport"),
            F.count(F.when(kind == sport, 1)).alias("NumSport"),
            F.sum(F.when(kind == OWN_PORT, F.col("n"))).alias("flows"),
            _port_map(),
        )
    )
    spent = F.when(F.col("duration") == 0, F.lit(0.1)).otherwise(F.col("duration"))
    return (
        sums.withColumn("SrcPktRate", ratio(F.col("SrcTotalNumPkts"), spent))
        .withColumn("SrcAvgPktSize", ratio(F.col("SrcTotalNumBytes"), F.col("SrcTotalNumPkts")))
        .withColumn("SrcICMPRate", ratio(F.col("icmp"), F.col("SrcTotalNumPkts")))
        .withColumn("SrcSynRate", ratio(F.col("syn"), F.col("SrcTotalNumPkts")))
        .select(*PROFILE, *SET_B, "flows", "ports")
    )


def keep_active(profile: DataFrame, flows_column: str, min_flows: int = MIN_FLOWS) -> DataFrame:
    """Profiles of windows with enough flows.

    Each flow counts once among the sources (or once among the destinations),
    so summing one such column per window gives its flows. Both sides read
    `profile`: store it first (see `session.cut`) to scan the flows only once.
    """
    active = (
        profile.groupBy(*WINDOW)
        .agg(F.sum(flows_column).alias("total"))
        .filter(F.col("total") >= min_flows)
        .select(*WINDOW)
    )
    return attach(profile, active, WINDOW, "entity", "left_semi")


def port_cells(profile: DataFrame) -> DataFrame:
    """(…, entity, feature, value): the port features in long form."""
    return profile.select(*PROFILE, F.explode("ports").alias("feature", "value"))


def wide(profile: DataFrame, base: list[str], ports: list[int], roles: str = "both") -> DataFrame:
    """One column per feature, for export. A port not seen is 0.

    The port map of each profile is read by name, so no shuffle is needed.
    """
    names = [f"{p}{s}" for p in ports for s in PORT_SUFFIXES[roles]]
    return profile.select(
        *PROFILE,
        *base,
        *[F.coalesce(F.try_element_at("ports", F.lit(n)), F.lit(0.0)).alias(n) for n in names],
    )


def extract(flows: DataFrame, ports: DataFrame | None, method: int = 1, minutes=30, origin: int | dict[int, int] = 0, key: str = "src") -> DataFrame:
    """Profiles of all windows of internal flows, before the activity guard."""
    items = flow_items(flows, minutes, origin, rates=method == 2)
    return profile_b(items, ports, key) if method == 2 else profile_a(items, ports)
