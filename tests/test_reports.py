"""Baselines, thinning, roll-ups, detections and the alert store."""

from __future__ import annotations

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from packetloom.operators import anomaly, detect, limits, rollup
from packetloom.sources import alert_store
from packetloom.plans import fixtures
from tests.test_match_lookup import packets


def test_unusual_port_counts_both_sides_and_this_packet(spark):
    # Packet 0 uses port 80 as source and destination: its destination is sighting 2.
    pk = packets(spark, [{"sport": 80, "dport": 80}] + [{"sport": None, "dport": 80}] * 4 + [{"sport": None, "dport": None}])
    got = anomaly.unusual_ports(pk).orderBy("packet_id").collect()
    assert [(r["packet_id"], r["sightings"]) for r in got] == [(0, 2), (1, 3), (2, 4)]
    assert got[0]["description"] == "Unusual port 80 usage detected" and got[0]["severity"] == "medium"


def test_large_transfer_is_strict(spark):
    pk = packets(spark, [{"size": 1_000_000}, {"size": 1_000_001}])
    got = anomaly.large_transfers(pk).collect()
    assert [(r["packet_id"], r["severity"]) for r in got] == [(1, "high")]
    assert got[0]["description"] == "Large data transfer detected: 1000001 bytes"


def test_baselines(spark):
    pk = packets(spark, [{"proto": "TCP"}, {"proto": "udp", "sport": None}, {"proto": "icmp", "sport": None, "dport": None}])
    assert {r[0]: r[1] for r in anomaly.protocol_frequency(pk).collect()} == {"tcp": 1, "udp": 1}
    assert {r[0]: r[1] for r in anomaly.port_frequency(pk).collect()} == {1000: 1, 80: 2}
    assert tuple(anomaly.traffic_volume(pk).first()) == (3, 300)
    assert tuple(anomaly.traffic_volume(pk.limit(0)).first()) == (0, 0)


def test_rate_limit_windows(spark):
    pk = packets(spark, [{"at": s} for s in (0, 1, 59, 60, 61, 125)])
    got = limits.rate_limit(pk, ["proto"], seconds=60, count=2)
    assert sorted(r["packet_id"] for r in got.collect()) == [0, 1, 3, 4, 5]


def test_threshold_fires_once(spark):
    pk = packets(spark, [{"proto": "icmp", "src": s} for s in ("1.1.1.1",) * 25 + ("2.2.2.2",) * 9])
    got = limits.at_threshold(pk, ["src_ip"], F.col("proto") == "icmp", threshold=10).collect()
    assert [(r["src_ip"], r["packet_id"]) for r in got] == [("1.1.1.1", 9)]


def test_once_per_key(spark):
    pk = packets(spark, [{"src": "b", "at": 5}, {"src": "a", "at": 9}, {"src": "a", "at": 2}])
    assert sorted(r["packet_id"] for r in limits.once_per(pk, ["src_ip"]).collect()) == [0, 2]


def scores(spark, values):
    return spark.createDataFrame([(v,) for v in values], "threat_score int")


def test_rollup_bands_and_null(spark):
    got = rollup.severity_rollup(scores(spark, [20, 21, 50, 51, 100, 101, None])).first()
    assert tuple(got) == (7, 1, 2, 2, 1, 57)
    assert tuple(rollup.severity_rollup(scores(spark, [])).first()) == (0, 0, 0, 0, 0, 0)
    assert rollup.mean_score(scores(spark, [1, 2, 2])).first()[0] == 1


def test_newest(spark):
    pk = packets(spark, [{"at": s} for s in (5, 1, 9, 9)])
    top = rollup.newest(pk, 2).collect()
    assert [r["packet_id"] for r in top] == [3, 2]
    assert [r["packet_id"] for r in rollup.newest(pk, 3, oldest_first=True).collect()] == [0, 2, 3]
    with pytest.raises(ValueError):
        rollup.newest(pk, 0)
    plan = rollup.newest(pk, 2)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_last_signatures_by_first_seen(spark):
    base = datetime(2024, 1, 1)
    rows = [("old", 0, 1), ("mid", 1, 1), ("old", 9, 7), ("new", 2, 1)]
    df = spark.createDataFrame(
        [(s, base + timedelta(seconds=t), v) for s, t, v in rows], "sid string, ts timestamp, threat_score int"
    )
    got = rollup.last_signatures(df, 2).collect()
    assert [(r["sid"], r["latest"]) for r in got] == [("new", "00:00:02"), ("mid", "00:00:01")]


def test_topology(spark):
    pk = packets(spark, [{"src": "1.1.1.1", "dst": "2.2.2.2", "size": s} for s in (5, 10)]
                 + [{"src": "1.1.1.1", "dst": "3.3.3.3", "size": 50}, {"src": "3.3.3.3", "dst": "1.1.1.1", "size": 1}])
    edges = {(r["src_ip"], r["dst_ip"]): (r["packets"], r["bytes"], r["traffic"]) for r in rollup.topology_edges(pk).collect()}
    assert edges == {
        ("3.3.3.3", "1.1.1.1"): (1, 1, "low"), ("1.1.1.1", "2.2.2.2"): (2, 15, "medium"),
        ("1.1.1.1", "3.3.3.3"): (1, 50, "high"),
    }
    scored = pk.withColumn("intel_score", F.when(F.col("dst_ip") == "3.3.3.3", 200).otherwise(0))
    nodes = {r["ip"]: (r["degree"], r["threat_level"]) for r in rollup.topology_nodes(scored).collect()}
    assert nodes == {"1.1.1.1": (2, "critical"), "2.2.2.2": (1, "low"), "3.3.3.3": (1, "critical")}


def test_traffic_and_connections(spark):
    pk = packets(spark, [{"at": 0, "size": 1000}, {"at": 9, "size": 500}, {"at": 10, "sport": None, "dport": None}, {"at": 11, "sport": None, "dport": None}])
    got = sorted((r["packets"], r["bytes"], r["packets_per_s"], r["mbit_per_s"]) for r in rollup.traffic_rate(pk, 10).collect())
    assert got == [(2, 200, 0.2, 0.00016), (2, 1500, 0.2, 0.0012)]
    assert sorted(r["connections"] for r in rollup.active_connections(pk, 10).collect()) == [1, 1]
    assert sorted(r["connections"] for r in rollup.active_connections(pk, 10, approximate=True).collect()) == [1, 1]


def test_service_mix_keeps_unlisted_and_missing_ports(spark):
    pk = packets(spark, [{"dport": 80}, {"dport": 443}, {"dport": 9999}, {"dport": None}])
    got = {r["service"]: r["packets"] for r in rollup.service_mix(pk, fixtures.services(spark)).collect()}
    assert got == {"HTTP": 1, "HTTPS": 1, "OTHER": 2}


def test_beacons(spark):
    steady = [{"src": "a", "at": 60 * i} for i in range(12)]
    wild = [{"src": "b", "at": i * i * 7} for i in range(12)]
    still = [{"src": "c", "at": 3} for _ in range(12)]
    got = detect.beacons(packets(spark, steady + wild + still), ["src_ip"], slot_seconds=100, piece_rows=2).collect()
    assert [(r["src_ip"], r["gaps"], r["mean_gap"], r["variation"]) for r in got] == [("a", 11, 60.0, 0.0)]


def test_pattern_and_signature_scans(spark):
    texts = spark.createDataFrame([(1, "the end and"), (2, "theme"), (3, None), (4, "x@y.z a@b.c")], "id long, text string")
    sigs = spark.createDataFrame(
        [("two", ["the", "and"], 2), ("one", ["the", "no"], 1), ("regex", [], None)], "name string, strings array<string>, k int"
    )
    got = {(r["id"], r["name"], r["found"]) for r in detect.scan_signatures(texts, sigs, key="id").collect()}
    assert got == {(1, "two", 2), (1, "one", 1), (2, "one", 1)}
    named = detect.scan_patterns(texts, {"mail": r"\w@\w", "the": "^the"}, key="id").collect()
    assert {tuple(r) for r in named} == {(1, "the"), (2, "the"), (4, "mail")}
    hits = detect.sensitive_records(texts, [r"\w@\w", "x"], key="id", min_hits=3).collect()
    assert [tuple(r) for r in hits] == [(4, 3)]


RECORD = "packet_id long, sid string, msg string, src string, sport int, dport int, threat_score int"


def test_table_rows_tell_missing_from_null(spark):
    df = spark.createDataFrame([(1, "9", "m", "1.1.1.1", None, 80, 5)], RECORD)
    row = alert_store.table_rows(df, keep=("packet_id",)).first()
    assert (row["src_port"], row["dst_port"], row["dst_ip"], row["escalated"], row["packet_size"]) == (None, 80, "", False, 0)
    raw = json.loads(row["raw_data"])
    assert raw["sport"] is None and "dst" not in raw and raw["threat_score"] == 5


def test_table_round_trip(spark, tmp_path):
    path = str(tmp_path / "alerts")
    df = spark.createDataFrame(
        [(1, "9", "m", "1.1.1.1", None, 80, 5), (2, "8", "n", "2.2.2.2", 7, 80, 6)], RECORD
    ).withColumn("ts", F.timestamp_micros(F.col("packet_id") * 86_400_000_000))
    rows = alert_store.table_rows(df, keep=("packet_id", "ts"))
    alert_store.append_table(alert_store.with_row_defaults(rows, "packet_id", "sid"), path, "ts")
    alert_store.append_table(alert_store.with_row_defaults(rows, "packet_id", "sid"), path, "ts")
    back = spark.read.parquet(path)
    assert back.count() == 4 and back.select("alert_id").distinct().count() == 2
    assert back.filter("ingested_at is null").isEmpty()
    found = rollup.alert_by_id(back, back.filter("sid = '8'").first()["alert_id"])
    assert {r["msg"] for r in found.collect()} == {"n"}
    assert rollup.alert_by_id(back, "none").isEmpty()


def test_read_back_of_empty_text(spark):
    df = spark.createDataFrame([("",), (None,), ('{"sid":"1","dport":null,"escalated":true}',)], "raw_data string")
    got = [r["record"] for r in alert_store.read_back(df).collect()]
    assert [(g["sid"], g["escalated"]) for g in got] == [(None, None), (None, None), ("1", True)]


def test_log_round_trip(spark, tmp_path):
    path = str(tmp_path / "log")
    df = spark.createDataFrame([("9", 'quote " and {brace}', None, 80)], "sid string, msg string, sport int, dport int").withColumn(
        "ts", F.timestamp_micros(F.lit(1_704_067_200_123_456))
    )
    alert_store.write_log(alert_store.log_lines(df, ["sid", "msg", "sport", "dport"], "ts"), path)
    lines = spark.read.text(path).collect()
    assert lines[0][0].startswith("2024-01-01 00:00:00,123 INFO {")
    noise = spark.createDataFrame([("noise",), ("2024-01-01 00:00:00,123 INFO not json",)], "value string")
    back = alert_store.replay(spark.read.text(path).unionByName(noise)).collect()
    assert [(r["sid"], r["msg"], r["sport"], r["dport"], r["level"]) for r in back] == [("9", 'quote " and {brace}', None, 80, "INFO")]
