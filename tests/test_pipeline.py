"""Sources, sinks and the whole job on the smallest tables."""

import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from flowsift.plans import catalog, pipeline as pl
from flowsift.plans.fixture import event_flows
from flowsift.operators import clean, features as ft
from flowsift.sources import flows, sinks
from flowsift.sources.flows import read_feature_csv, read_flow_csv

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


def test_flow_csv_round_trip(spark, tmp_path):
    dirty = catalog.dirty_flows(spark, SF)
    dirty.coalesce(2).write.option("header", True).csv(str(tmp_path / "raw"))
    raw = read_flow_csv(spark, str(tmp_path / "raw"))
    assert raw.select("file").distinct().count() >= 1
    back = clean.clean_flows(raw).drop("file")
    assert back.exceptAll(clean.clean_flows(dirty)).isEmpty() and back.count() == clean.clean_flows(dirty).count()


def test_flow_files_of_other_column_orders(spark, tmp_path):
    cells = {
        "Timestamp": "14/02/2018 10:00:00 AM", "Src IP": "172.31.0.1", "Dst IP": "8.8.8.8", "Src Port": "5", "Dst Port": "80",
        "Tot Fwd Pkts": "1", "Tot Bwd Pkts": "2", "TotLen Fwd Pkts": "3.5", "TotLen Bwd Pkts": "4.5",
    }
    other = {"Flow ID": "x", **dict(reversed(cells.items())), "Protocol": "6", "Src Port": "7"}
    for name, rows in (("a b.csv", cells), ("c[1].csv", other)):
        (tmp_path / name).write_text(",".join(rows) + "\n" + ",".join(rows.values()) + "\n")
    (tmp_path / "empty.csv").write_text("")
    assert sorted(map(len, flows.header_catalogue(spark, str(tmp_path)))) == [9, 11]
    got = {r.src_port: r for r in clean.clean_flows(read_flow_csv(spark, str(tmp_path))).collect()}
    assert {(p, r.src_ip, r.dst_port, r.bwd_bytes, r.protocol) for p, r in got.items()} == {
        (5, "172.31.0.1", 80, 4.5, 0), (7, "172.31.0.1", 80, 4.5, 6),
    }
    (tmp_path / "d.csv").write_text("Timestamp,Src IP\n1,2\n")
    with pytest.raises(ValueError, match="Dst IP"):
        read_flow_csv(spark, str(tmp_path))


def test_lines_that_are_no_flows_are_kept_as_text(spark, tmp_path):
    names = [*flows.RAW_COLUMNS, "Note"]
    good = "14/02/2018 10:00:00 AM,172.31.0.1,8.8.8.8,5,80,1,2,3.5,4.5,fine"
    short, wide, wrong = "14/02/2018 10:00:01 AM,172.31.0.1,8.8.8.8,6", good + ",one,more", good.replace(",80,", ",http,")
    other = [names[-1], *names[:-1]]
    (tmp_path / "a.csv").write_text("\n".join([",".join(names), good, short, wide, ",".join(names), wrong]) + "\n")
    (tmp_path / "b.csv").write_text("\n".join([",".join(other), "fine," + good[:-5]]) + "\n")
    raw = read_flow_csv(spark, str(tmp_path), keep_lines=True)
    held = {(r.file, *r.unreadable): r for r in clean.quarantine(raw).collect()}
    assert set(held) == {("a.csv", flows.BAD_LINE), ("a.csv", "Dst Port")} and held["a.csv", "Dst Port"].bad_line is None
    assert sorted(r.bad_line for r in clean.quarantine(raw).filter("bad_line IS NOT NULL").collect()) == sorted([short, wide])
    typed = clean.clean_flows(raw, strict=False)
    assert sorted(r.file for r in clean.well_formed(typed).collect()) == ["a.csv", "b.csv"] and clean.malformed(typed).count() == 3
    sinks.write_quarantine(clean.quarantine(raw), str(tmp_path / "held"))
    back = spark.read.parquet(str(tmp_path / "held"))
    assert back.count() == 3 and {(r.file, r.unreadable) for r in back.collect()} == {("a.csv", "Dst Port"), ("a.csv", flows.BAD_LINE)}
    # without the lines, cells that lack are 0 and those beyond the header are left out
    plain = read_flow_csv(spark, str(tmp_path / "*.csv"))
    assert plain.columns == [*flows.RAW_COLUMNS, "file"] and clean.quarantine(plain).count() == 1


def test_stored_flows_are_pruned_by_day(spark, tmp_path):
    typed = event_flows(spark, SF)
    sinks.write_flows(typed, str(tmp_path / "flows"))
    days = sorted(r.day for r in typed.select("day").distinct().collect())
    calendar = spark.createDataFrame([(day, f"{day}.csv") for day in days], "day int, file string").filter(F.col("file") == f"{days[0]}.csv")
    back = flows.read_flow_parquet(spark, str(tmp_path / "flows"), calendar)
    assert "dynamicpruningexpression" in back._jdf.queryExecution().toString()
    mine = typed.filter(F.col("day") == days[0])
    assert back.count() == mine.count() > 0
    assert back.select(*typed.columns).exceptAll(mine).isEmpty()
    assert flows.read_flow_parquet(spark, str(tmp_path / "flows")).count() == typed.count()


def test_fixed_ports_need_no_flows(spark):
    none = spark.createDataFrame([], "day int")
    calendar = spark.createDataFrame([(3, "x"), (3, "y")], "day int, file string")
    got = pl.choose_ports(none, 0, calendar=calendar).collect()
    assert sorted((r.day, r.port) for r in got) == [(3, p) for p in (22, 25, 80, 194)]


def test_windows_of_stored_features_give_the_same_vectors(spark, tmp_path):
    s = pl.Settings(method=1, x=9, minutes=(1440,), min_entities=12)
    typed = event_flows(spark, SF)
    features = pl.build_features(typed, s)
    direct = pl.feature_vectors(features, s)
    listed = sorted({r.port for r in features.ports.collect()})
    sinks.write_features(ft.wide(features.profiles, list(s.base), listed, s.roles), str(tmp_path / "f"), "csv")
    stored = pl.vectors_from_tables(read_feature_csv(spark, str(tmp_path / "f")), s)

    def total(vectors):
        return {(r.day, r.win_sec, r.win_start, r.view, r.entity): r.t for r in vectors.select(
            "day", "win_sec", "win_start", "view", "entity", F.aggregate("raw", F.lit(0.0), lambda a, v: a + v).alias("t")).collect()}

    mine, theirs = total(direct), total(stored)
    assert mine and mine.keys() == theirs.keys() and all(abs(mine[k] - theirs[k]) <= 1e-9 * abs(mine[k]) for k in mine)


def test_feature_csv_is_read_by_name(spark, tmp_path):
    (tmp_path / "f.csv").write_text(",SrcConnMade,T443SrcTo,Total\n172.31.0.1,3,4.5,1\n8.8.8.8,1,0,2\n")
    df = read_feature_csv(spark, str(tmp_path / "f.csv"))
    assert df.columns == ["entity", "SrcConnMade", "443SrcTo", "Total"]
    assert df.filter("entity = '172.31.0.1'").first()["443SrcTo"] == 4.5


def test_feature_files_are_read_by_their_own_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text(",SrcConnMade,T443SrcTo\n172.31.0.1,3,4.5\n")
    (tmp_path / "b.csv").write_text("entity,T443SrcTo,T80SrcTo,SrcConnMade\n8.8.8.8,7,1,2\n")
    got = {r.entity: r.asDict() for r in read_feature_csv(spark, str(tmp_path)).collect()}
    assert got["8.8.8.8"] == {"entity": "8.8.8.8", "SrcConnMade": 2.0, "443SrcTo": 7.0, "80SrcTo": 1.0}
    assert got["172.31.0.1"] == {"entity": "172.31.0.1", "SrcConnMade": 3.0, "443SrcTo": 4.5, "80SrcTo": 0.0}


def test_features_written_as_csv_come_back_and_other_days_stay(spark, tmp_path):
    columns = "win_start timestamp_ntz, entity string, SrcConnMade double, day int, win_sec int"
    at = datetime(2018, 2, 14, 10)
    for day, value in ((1, 3.0), (2, 5.0), (2, 6.0)):
        sinks.write_features(spark.createDataFrame([(at, f"10.0.0.{day}", value, day, 600)], columns), str(tmp_path / "out"), "csv")
    back = read_feature_csv(spark, str(tmp_path / "out"))
    assert {(r.entity, r.SrcConnMade, r.day, r.win_sec) for r in back.collect()} == {("10.0.0.1", 3.0, 1, 600), ("10.0.0.2", 6.0, 2, 600)}


@pytest.fixture(scope="module")
def detection(spark):
    s = pl.Settings(method=1, x=9, minutes=(1440,), min_entities=12, restarts=2)
    return s, pl.detect(event_flows(spark, SF), catalog.truth(spark, SF), s)


def test_every_entity_has_three_labels(spark, detection):
    s, d = detection
    vectors = pl.feature_vectors(d.features, s)
    per = d.clusters.labels.groupBy("day", "view", "entity").agg(F.countDistinct("algorithm").alias("n"), F.count("*").alias("m"))
    assert per.filter("n <> 3 or m <> 3").isEmpty() and per.count() == vectors.count() > 0
    assert not d.clusters.profile.isEmpty()


def test_counts_add_up(spark, detection):
    _, d = detection
    sizes = d.clusters.labels.groupBy(*catalog.GROUP, "algorithm").count()
    off = d.scores.join(sizes, [*catalog.GROUP, "algorithm"]).filter("tp + fp + tn + fn <> count")
    assert off.isEmpty() and not d.scores.isEmpty()


def test_feature_names_match_vector_length(spark, detection):
    s, d = detection
    names = pl.feature_names(d.features, s).groupBy("day").agg(F.count("*").alias("n"))
    lengths = pl.feature_vectors(d.features, s).select("day", F.size("raw").alias("n")).distinct()
    assert lengths.exceptAll(names).isEmpty()


def test_other_networks_can_be_internal(spark):
    s = pl.Settings(method=0, minutes=(1440,), min_flows=1, min_entities=1, prefix="18.221.")
    typed = event_flows(spark, SF)
    vectors = pl.feature_vectors(pl.build_features(typed, s), s)
    touched = typed.filter("src_ip LIKE '18.221.%' OR dst_ip LIKE '18.221.%'")
    want = {a for r in touched.select("src_ip", "dst_ip").collect() for a in r}
    got = {r.entity: r.view for r in vectors.select("entity", "view").collect()}
    assert set(got) == want and all((v == "internal") == a.startswith("18.221.") for a, v in got.items())


def test_method_two_runs(spark):
    s = pl.Settings(method=2, minutes=(1440,), min_entities=8, algorithms=("dbscan",))
    d = pl.detect(event_flows(spark, SF), catalog.truth(spark, SF), s)
    assert d.clusters.vectors.select(F.size("raw")).distinct().first()[0] == 9 + 10


def test_sinks(spark, detection, tmp_path):
    s, d = detection
    wide = ft.wide(d.features.profiles, ft.SET_A, [443])
    sinks.write_features(wide, str(tmp_path / "features"), "csv")
    back = spark.read.option("header", True).csv(str(tmp_path / "features"))
    assert back.count() == wide.count() and {"day", "win_sec", "window"} <= set(back.columns)
    assert "2023-12-31_20_00_00" in {r.window for r in back.select("window").distinct().collect()}
    sinks.write_features(d.features.profiles, str(tmp_path / "profiles"))
    sinks.write_labels(d.clusters.labels, str(tmp_path / "labels"))
    sinks.write_labelled(d.found, str(tmp_path / "known"))
    assert {r.feature for r in d.clusters.profile.select("feature").distinct().collect()} <= {
        r.name for r in pl.feature_names(d.features, s).select("name").collect()}
    sinks.write_profiles(d.clusters.profile, str(tmp_path / "heat"))
    sinks.write_scores(d.scores, str(tmp_path / "scores"))
    assert spark.read.parquet(str(tmp_path / "labels")).count() == d.clusters.labels.count()
    assert {r.role for r in spark.read.parquet(str(tmp_path / "scores")).select("role").distinct().collect()} <= {"victim", "attacker"}


def test_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns[:4] == ["day", "win_sec", "win_start", "entity"] and df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_executors_need_no_copy_of_the_package(spark):
    from pyspark import cloudpickle

    from flowsift.functions.kernels import nearest_in_block

    assert b"sq_distances" in cloudpickle.dumps(nearest_in_block)
