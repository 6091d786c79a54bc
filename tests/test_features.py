from datetime import datetime

import pytest
from pyspark.sql import functions as F

from flowsift.operators import clean, features as ft, ports as pt, vectors as vc
from flowsift.functions.scalars import label_time
from flowsift.sources.dimensions import capture_calendar, capture_origins, ground_truth

T0 = datetime(2018, 2, 14, 10, 0)
SCHEMA = (
    "day int, ts timestamp_ntz, src_ip string, dst_ip string, src_port int, dst_port int, fwd_pkts long, bwd_pkts long, "
    "fwd_bytes double, bwd_bytes double, syn_cnt double, flow_duration double, protocol int"
)
IN, OUT = "172.31.1.1", "8.8.8.8"


def flow(src=IN, dst=OUT, sport=5000, dport=80, fwd=3, bwd=2, fb=10.0, bb=20.0, syn=1.0, dur=4.0, proto=6, ts=T0, day=1):
    return (day, ts, src, dst, sport, dport, fwd, bwd, fb, bb, syn, dur, proto)


def flows(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def one(df, **where):
    for c, v in where.items():
        df = df.filter(F.col(c) == v)
    (row,) = df.collect()
    return row.asDict()


def test_set_a_by_hand(spark):
    f = flows(
        spark,
        flow(sport=5000, dport=80),
        flow(sport=5001, dport=80, fb=1.0, bb=2.0),
        flow(src=OUT, dst=IN, sport=443, dport=22, fb=100.0, bb=200.0, bwd=0),
    )
    ports = spark.createDataFrame([(1, 80), (1, 22), (1, 443)], "day int, port int")
    p = ft.extract(f, ports, 1, 30)
    row = one(p, entity=IN)
    assert {k: row[k] for k in ft.SET_A} == dict(
        SrcIPContacted=1, SrcPortUsed=2, SrcPortContacted=1, SrcTotLenRcv=22.0, SrcTotLenSent=11.0, SrcConnMade=2,
        DstIPContacted=1, DstPortUsed=1, DstPortContacted=1, DstTotLenRcv=100.0, DstTotLenSent=200.0, DstTotConn=1,
    )
    # forward counts gain one per flow, backward counts lose one and may go below 0
    assert row["ports"] == {"80SrcFrom": 2.0, "22DstTo": -1.0, "443DstFrom": 4.0}
    assert one(p, entity=OUT)["ports"] == {"443SrcTo": 4.0, "22SrcFrom": -1.0, "80DstTo": 2.0}
    wide = one(ft.wide(p, ft.SET_A, [22, 80]), entity=OUT)
    assert wide["80DstTo"] == 2.0 and wide["80SrcTo"] == 0.0 and wide["22SrcFrom"] == -1.0


def test_rates_by_hand(spark):
    f = flows(
        spark,
        flow(proto=1, dur=0.0, syn=0.0),
        flow(fwd=5, bwd=0, dur=0.0, sport=6000, dst="9.9.9.9"),
        flow(src="172.31.1.2", fwd=0, bwd=0, fb=0.0, bb=0.0, syn=0.0),
    )
    p = ft.extract(f, None, 2, 30)
    row = one(p, entity=IN)
    assert row["SrcTotalNumPkts"] == 10 and row["SrcTotalNumBytes"] == 60.0
    assert row["SrcPktRate"] == pytest.approx(100.0) and row["SrcAvgPktSize"] == 6.0
    assert row["SrcICMPRate"] == 0.5 and row["SrcSynRate"] == 0.1
    assert (row["NumDport"], row["NumSport"], row["SrcIPContacted"]) == (1, 2, 2)
    idle = one(p, entity="172.31.1.2")
    assert (idle["SrcAvgPktSize"], idle["SrcICMPRate"], idle["SrcSynRate"]) == (0.0, 0.0, 0.0)
    assert {r.entity for r in p.collect()} == {IN, "172.31.1.2"}
    d = one(ft.extract(f, None, 2, 30, key="dst"), entity=OUT)
    assert (d["NumDport"], d["NumSport"], d["SrcIPContacted"]) == (1, 1, 2)


def test_activity_guard_counts_internal_flows(spark):
    later = datetime(2018, 2, 14, 10, 30)
    f = flows(
        spark,
        *[flow(sport=i) for i in range(10)],
        *[flow(sport=i, ts=later) for i in range(9)],
        *[flow(src="1.1.1.1", ts=later) for _ in range(5)],
    )
    p = ft.keep_active(ft.extract(clean.internal_flows(f), None, 0, 30), "SrcConnMade")
    assert {r.win_start for r in p.collect()} == {T0}
    w = ft.active_windows(ft.with_window(clean.internal_flows(f), 1800)).collect()
    assert [(r.win_start, r.flows) for r in w] == [(T0, 10)]


def test_windows_are_left_closed_and_roll_up(spark):
    times = [datetime(2018, 2, 14, 10, 29, 59), datetime(2018, 2, 14, 10, 30), datetime(2018, 2, 14, 11, 0)]
    f = flows(spark, *[flow(ts=t, sport=i) for i, t in enumerate(times)])
    several = ft.extract(f, None, 0, [10, 30, 60])
    assert {(r.win_sec, r.win_start) for r in several.filter(F.col("entity") == IN).collect()} == {
        (600, datetime(2018, 2, 14, 10, 20)), (600, datetime(2018, 2, 14, 10, 30)), (600, datetime(2018, 2, 14, 11, 0)),
        (1800, T0), (1800, datetime(2018, 2, 14, 10, 30)), (1800, datetime(2018, 2, 14, 11, 0)),
        (3600, T0), (3600, datetime(2018, 2, 14, 11, 0)),
    }
    for minutes in (10, 30, 60):
        alone = ft.extract(f, None, 0, minutes)
        same = several.filter(F.col("win_sec") == minutes * 60)
        assert alone.drop("ports").exceptAll(same.drop("ports")).isEmpty()
    assert one(several.filter(F.col("win_sec") == 3600), entity=IN, win_start=T0)["SrcPortUsed"] == 2
    shown = several.select(label_time(F.col("win_start")).alias("t")).agg(F.min("t")).first()[0]
    assert shown == datetime(2018, 2, 14, 6, 0)


def test_windows_begin_at_midnight_of_each_capture_day(spark):
    assert capture_origins()[2] - capture_origins()[1] == 86400
    late = datetime(2018, 2, 15, 0, 5)
    f = flows(spark, flow(ts=late), flow(ts=late, day=2), flow(ts=late, day=99))
    origins = capture_origins()
    starts = {r.day: r.win_start for r in ft.with_window(f, 3000, origins).collect()}
    # the 29th window of 50 minutes begins at 23:20; the second day's grid begins anew, and an unknown day counts from 1970
    assert starts[1] == datetime(2018, 2, 14, 23, 20) and starts[2] == datetime(2018, 2, 15)
    unknown = {r.win_start for r in ft.with_window(f.filter("day = 99"), 3000).collect()}
    assert {starts[99]} == unknown
    several = ft.extract(f, None, 0, [10, 50], origins).filter(F.col("entity") == IN)
    assert {(r.day, r.win_start) for r in several.filter("win_sec = 3000").collect()} == set(starts.items())
    assert {r.win_start for r in several.filter("win_sec = 600").collect()} == {datetime(2018, 2, 15)}


def test_half_minute_windows(spark):
    assert ft.window_seconds([0.5, 0.9, 30]) == [30, 54, 1800]


def test_dynamic_ports_limits_and_ties(spark):
    rows = []
    for port, times, sources in ((80, 30, 12), (443, 20, 12), (7, 3, 1), (1023, 2, 1), (1024, 2, 1), (49150, 9, 2), (49151, 40, 2)):
        rows += [flow(src=f"172.31.0.{i % sources}", sport=60000, dport=port) for i in range(times)]
    f = flows(spark, *rows)
    usage = {(r.side, r.port): r.cnt for r in pt.port_usage(f).collect()}
    assert usage == {("dst", 80): 30, ("dst", 443): 20, ("dst", 7): 3, ("dst", 1023): 2, ("dst", 1024): 2, ("dst", 49150): 9}
    assert {r.port for r in pt.rare_ports(f).collect()} == {7, 1023, 1024, 49150}
    # one of each kind: most used, most used among the rare, least used below 1024
    assert {r.port for r in pt.dynamic_ports(f, x=3).collect()} == {80, 49150, 1023}
    assert {r.port for r in pt.dynamic_ports(f, x=2).collect()} == set()
    both = flows(spark, *[flow(sport=22, dport=22) for _ in range(3)], flow(sport=60000, dport=25))
    # a port used on both sides takes two places of the ranking
    assert {r.port for r in pt.dynamic_ports(both, x=6, below=0).collect()} == {22, 25}


def test_static_methods(spark):
    f = flows(spark, flow(), flow(day=2))
    assert {(r.day, r.port) for r in pt.choose_ports(f, 0).collect()} == {(d, p) for d in (1, 2) for p in (80, 194, 25, 22)}
    assert pt.choose_ports(f, 2).count() == 10


def raw(spark, *rows):
    names = ["Timestamp", "Src IP", "Dst IP", "Src Port", "Dst Port", "Tot Fwd Pkts", "Tot Bwd Pkts", "TotLen Fwd Pkts", "TotLen Bwd Pkts"]
    return spark.createDataFrame(list(rows), ", ".join(f"`{n}` string" for n in names)), names


def test_cleaning(spark):
    good = ("14/02/2018 01:05:09 PM", IN, OUT, "5000", "80", "1", "2", "3", "4.5")
    df, names = raw(spark, good, ("4/2/2018 1:05:09 AM", IN, OUT, None, "80", "1", None, "3", "4"), (None, *good[1:]))
    df = df.union(df.filter("`Src Port` = '5000'").select(*[F.concat(F.substring(F.col(f"`{n}`"), 1, 0), F.lit(n)) for n in names]))
    got = sorted(clean.clean_flows(df).collect(), key=lambda r: r.ts)
    assert [r.ts for r in got] == [datetime(2018, 2, 4, 1, 5, 9), datetime(2018, 2, 14, 13, 5, 9)]
    assert (got[0].src_port, got[0].bwd_pkts, got[1].bwd_bytes) == (0, 0, 4.5)
    bad, _ = raw(spark, good, (good[0], IN, OUT, "x", *good[4:]), ("yesterday", *good[1:]))
    lenient = clean.clean_flows(bad, strict=False)
    assert clean.malformed(lenient).count() == 2 and clean.well_formed(lenient).count() == 1
    with pytest.raises(Exception):
        clean.clean_flows(bad).collect()
    held = {tuple(r.unreadable): r for r in clean.quarantine(bad).collect()}
    assert set(held) == {("Src Port",), ("Timestamp",)} and held["Src Port",]["Src Port"] == "x" and held["Timestamp",]["Timestamp"] == "yesterday"


def test_capture_bounds_are_inclusive(spark):
    start, end = datetime(2018, 2, 14, 4), datetime(2018, 2, 15, 4)
    times = [datetime(2018, 2, 14, 3, 59, 59), start, end, datetime(2018, 2, 15, 4, 0, 1)]
    df = spark.createDataFrame([("new_wednesday-14-02-18.csv", t) for t in times], "file string, ts timestamp_ntz")
    got = clean.within_capture(df, capture_calendar(spark)).collect()
    assert sorted(r.ts for r in got) == [start, end] and {r.day for r in got} == {1}


def test_a_file_outside_the_calendar_stops_the_job(spark):
    df = spark.createDataFrame([("other.csv", datetime(2018, 2, 14, 5))], "file string, ts timestamp_ntz")
    with pytest.raises(Exception, match="other.csv"):
        clean.within_capture(df, capture_calendar(spark)).collect()


def test_dimension_sizes(spark):
    truth = ground_truth(spark)
    assert truth.filter("role = 'victim'").count() == 38 and truth.filter("role = 'attacker'").count() == 31
    assert capture_calendar(spark).count() == 11


def test_min_max_and_guard(spark):
    rows = [(1, 60, T0, "internal", f"e{i}", [float(i), 7.0]) for i in range(30)]
    rows += [(1, 60, T0, "external", f"x{i}", [float(i), 7.0]) for i in range(29)]
    v = spark.createDataFrame(rows, "day int, win_sec int, win_start timestamp_ntz, view string, entity string, raw array<double>")
    got = {r.entity: r.vec for r in vc.min_max(vc.keep_populated(v)).collect()}
    assert len(got) == 30 and got["e0"] == [0.0, 0.0] and got["e29"] == [1.0, 0.0]


def test_raw_vectors_follow_the_ports_of_the_day(spark):
    f = flows(spark, flow(), flow(day=2, dport=443))
    ports = spark.createDataFrame([(1, 80), (2, 25), (2, 443)], "day int, port int")
    got = {(r.day, r.entity): r.raw for r in vc.raw_vectors(ft.extract(f, ports, 1, 30), ft.SET_A, ports).collect()}
    assert got[1, IN][12:] == [0.0, 1.0, 0.0, 0.0]
    assert got[2, OUT][12:] == [0.0] * 6 + [1.0, 0.0]


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_items_travel_with_short_keys_and_what_is_read_of_them(spark, kind):
    columns = ["day", "ts", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "flow_duration", "fwd_pkts", "bwd_pkts", "fwd_bytes", "bwd_bytes", "syn_cnt"]
    rows = [
        (1, "1969-12-31 23:59:59", "172.31.0.1", "1.1.1.1", 5, 80, 6, 1.0, 2, 3, 10.0, 20.0, 0.0),
        (1, "2024-03-31 02:30:00", "172.31.0.1", None, 5, 80, 1, 1.0, 4, 5, 30.0, 40.0, 1.0),
        (1, "2024-03-31 02:31:00", "2.2.2.2", "172.31.0.1", 5, 5, 6, 1.0, 6, 7, 50.0, 60.0, 1.0),
    ]
    flows = spark.createDataFrame(rows, columns).withColumn("ts", F.col("ts").cast(kind))
    items = ft.flow_items(flows, 30)
    assert dict(items.dtypes)["win_start"] == kind and {r.win_sec for r in items.collect()} == {1800}
    starts = sorted({str(r.w) for r in items.select(F.col("win_start").cast("string").alias("w")).collect()})
    assert starts == ["1969-12-31 23:30:00", "2024-03-31 02:30:00"]
    peers = {(r.role, r.entity, r.ip) for r in items.filter(F.col("kind") == ft.PEER_IP).collect()}
    assert peers == {
        ("src", "172.31.0.1", "1.1.1.1"), ("dst", "1.1.1.1", "172.31.0.1"), ("src", "172.31.0.1", None), ("dst", None, "172.31.0.1"),
        ("src", "2.2.2.2", "172.31.0.1"), ("dst", "172.31.0.1", "2.2.2.2"),
    }
    assert items.count() == 3 * 6
    assert items.filter((F.col("kind") != ft.OWN_PORT) & F.col("fwd_bytes").isNotNull()).isEmpty()
    assert items.filter((F.col("kind") == ft.PEER_IP) & F.col("fwd_pkts").isNotNull()).isEmpty()
    plan = items._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert moved and not any("win_sec" in line or "role" in line for line in moved)
