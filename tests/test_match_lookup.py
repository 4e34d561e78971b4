"""Rule matching, rule heads, directions and indicator lookups."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from packetloom.operators import lookup, match
from packetloom.plans import detection, fixtures
from packetloom.sources import packets as packet_source

PACKET = (
    "packet_id long, ts timestamp, src_ip string, dst_ip string, proto string, sport int, dport int,"
    " packet_size int, payload string"
)


def packets(spark, rows):
    from datetime import datetime, timedelta

    start = datetime(2024, 1, 1)
    full = [
        (i, start + timedelta(seconds=r.get("at", i)), r.get("src", "10.0.0.1"), r.get("dst", "10.0.0.2"),
         r.get("proto", "tcp"), r.get("sport", 1000), r.get("dport", 80), r.get("size", 100), r.get("payload"))
        for i, r in enumerate(rows)
    ]
    return spark.createDataFrame(full, PACKET)


def rule_rows(spark, rows):
    full = [
        (i, r.get("proto", "ip"), r.get("sid", str(i)), "m", "c", r.get("content"), r.get("op"), r.get("n"))
        for i, r in enumerate(rows)
    ]
    return spark.createDataFrame(
        full,
        "rule_key long, rule_proto string, sid string, msg string, rule_class string, content string,"
        " dsize_op string, dsize_n long",
    )


def test_hash_form_equals_theta_form(spark):
    rng = random.Random(7)
    texts = ["the cat", "The", "", None, "a thread", "http"]
    pk = packets(
        spark,
        [
            {"proto": rng.choice(["tcp", "TCP", "udp", "icmp"]), "size": rng.randrange(1000),
             "payload": rng.choice(texts)}
            for _ in range(200)
        ],
    )
    rl = rule_rows(
        spark,
        [
            {"proto": rng.choice(["tcp", "UDP", "http", "ip"]), "content": rng.choice([None, None, "the", "T"]),
             "op": rng.choice([None, ">", "<"]), "n": rng.randrange(1000)}
            for _ in range(30)
        ],
    )
    got = match.match_packets(pk, rl, spread=3).select("packet_id", "rule_key").collect()
    want = set()
    rules = rl.collect()
    for p in pk.collect():
        for r in rules:
            proto = r["rule_proto"].lower()
            if proto in ("tcp", "udp") and proto != p["proto"].lower():
                continue
            if r["content"] is not None and r["content"] not in (p["payload"] or ""):
                continue
            if r["dsize_op"] == ">" and p["packet_size"] <= r["dsize_n"]:
                continue
            if r["dsize_op"] == "<" and p["packet_size"] >= r["dsize_n"]:
                continue
            want.add((p["packet_id"], r["rule_key"]))
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_matching_without_broadcast_is_equal(spark):
    pk = packets(spark, [{"proto": p, "size": 50 * i} for i, p in enumerate(["tcp", "udp", "icmp"] * 20)])
    rl = rule_rows(spark, [{"proto": "tcp"}, {"proto": "udp", "op": ">", "n": 500}, {"proto": "x"}])
    small = sorted(map(tuple, match.match_packets(pk, rl).select("packet_id", "rule_key").collect()))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        shuffled = match.match_packets(pk, rl).select("packet_id", "rule_key")
        assert sorted(map(tuple, shuffled.collect())) == small
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_known_sums_of_the_flagship(spark):
    """Expected values of the first 200 documents as payload, one-hour window."""
    folder = "/root/testdata/sf0.01"
    pk = packet_source.with_payload(
        packet_source.packet_heads(spark, folder), packet_source.table(spark, folder, "documents").filter("doc_id < 200")
    )
    alerts = detection.detect(pk, fixtures.rules(spark), fixtures.intel(spark), window_seconds=3600)
    got = {
        (r["severity"], r["sid"]): (r["alerts"], r["escalated"], r["score"])
        for r in detection.severity_by_signature(alerts).collect()
    }
    assert len(got) == 15
    assert got[("critical", "9000001")] == (144, 144, 21700)
    assert got[("medium", "9000001")] == (5618, 5618, 280900)
    assert got[("medium", "9000003")] == (5, 5, 250)
    assert got[("medium", "9000004")] == (3418, 3418, 170900)
    assert got[("low", "9000005")] == (21, 0, 0)


def test_staging_does_not_change_alerts(spark, data):
    def run(staged):
        alerts = detection.detect(
            packet_source.packets(spark, data), fixtures.rules(spark), fixtures.intel(spark),
            window_seconds=86_400, staged=staged,
        )
        return sorted(map(tuple, alerts.select("packet_id", "rule_key", "escalated", "threat_score").collect()))

    assert run(True) == run(False)


def test_ipv6_rows_are_left_out(spark):
    pk = packets(spark, [{}, {"src": "fe80::1"}, {"dst": None}, {"src": "300.1.1.1"}])
    assert [r["packet_id"] for r in packet_source.ipv4_only(pk).collect()] == [0]


ADDRESS = [
    ("any", {"10.0.0.1", "9.9.9.9"}),
    ("10.0.0.1", {"10.0.0.1"}),
    ("10.0.0.0/8", {"10.0.0.1", "10.9.9.9"}),
    ("!10.0.0.0/16", {"10.9.9.9", "9.9.9.9"}),
    ("[10.0.0.1, 9.9.9.9]", {"10.0.0.1", "9.9.9.9"}),
    ("![10.0.0.1,9.9.9.9]", {"10.9.9.9"}),
    ("[10.0.0.0/8,!10.9.9.9]", {"10.0.0.1"}),
    ("[10.0.0.0/8,![10.9.9.9,1.1.1.1]]", {"10.0.0.1"}),
    ("[any,!9.9.9.9]", {"10.0.0.1", "10.9.9.9"}),
    ("$HOME", {"10.0.0.1"}),
    ("!$HOME", {"10.9.9.9", "9.9.9.9"}),
]


@pytest.mark.parametrize("spec,expected", ADDRESS)
def test_address_specs(spark, spec, expected):
    from packetloom.functions.net import ip_number

    df = spark.createDataFrame([(x,) for x in ("10.0.0.1", "10.9.9.9", "9.9.9.9")], "ip string")
    df = df.withColumn("spec", match.fill_variables(F.lit(spec), {"HOME": "[10.0.0.0/24]"}))
    df = df.withColumns({"no": ip_number(F.col("ip")), "ranges": match.address_ranges("spec")})
    got = {r["ip"] for r in df.filter(match.in_ranges("no", "ranges")).collect()}
    assert got == expected if spec != "any" else len(got) == 3


PORTS = [
    ("any", {21, 80, 1024, 65535, None}),
    ("80", {80}),
    ("!80", {21, 1024, 65535}),
    ("1024:", {1024, 65535}),
    (":80", {21, 80}),
    ("80:1024", {80, 1024}),
    ("[21,80]", {21, 80}),
    ("![21,80]", {1024, 65535}),
    ("[$WEB,65535]", {80, 65535}),
    ("[20:90,!80]", {21}),
    ("0:65535", {21, 80, 1024, 65535, None}),
]


@pytest.mark.parametrize("spec,expected", PORTS)
def test_port_specs(spark, spec, expected):
    df = spark.createDataFrame([(x,) for x in (21, 80, 1024, 65535, None)], "p long")
    df = df.withColumn("spec", match.fill_variables(F.lit(spec), {"WEB": "80"}))
    df = df.withColumn("ranges", match.port_ranges("spec"))
    assert {r["p"] for r in df.filter(match.in_ranges("p", "ranges")).collect()} == expected


def test_two_way_rule_heads(spark):
    rules = fixtures.head_rules(spark).filter("sid = '9200001'")
    rules = match.with_head_ranges(rules, {"HOME_NET": "10.0.0.1", "WEB_PORTS": "80"})
    pk = match.with_address_numbers(
        packets(spark, [{"src": "10.0.0.1", "dst": "1.1.1.1"},
                        {"src": "1.1.1.1", "dst": "10.0.0.1", "sport": 80, "dport": 999}])
    )

    def run(two_way):
        hits = match.match_packets(pk, rules, residual=[match.head_matches(two_way)])
        return sorted(r["packet_id"] for r in hits.collect())

    assert run(False) == [0] and run(True) == [0, 1]


def test_event_rules_by_option(spark):
    lines = [
        'alert http any any -> any any (msg:"a"; app-layer-event:http.bad; sid:1;)',
        'alert pkthdr any any -> any any (msg:"b"; decode-event:ipv4.short; sid:2;)',
        'alert tcp any any -> any any (msg:"c"; stream-event:late; sid:3;)',
        'alert ip any any -> any any (msg:"d"; ipv4-csum:invalid; sid:4;)',
        'alert ip any any -> any any (msg:"e"; sid:5;)',
    ]
    from packetloom.sources import rules

    parsed = rules.parse_rules(spark.createDataFrame([("f", x) for x in lines], "rule_file string, line string"))
    events = spark.createDataFrame([(1, "http.bad"), (2, "ipv4-csum"), (3, "late"), (4, "none")], "n int, event_name string")
    got = match.match_events(events, match.event_rules(parsed))
    assert {(r["n"], r["sid"]) for r in got.collect()} == {(1, "1"), (2, "4"), (3, "3")}


def test_direction_and_established(spark):
    rows = [("f", 1, "a"), ("f", 2, "a"), ("f", 3, "b"), ("f", 4, "a"), (None, 1, "c"), (None, 2, "d"), ("g", 1, "x")]
    df = spark.createDataFrame(rows, "flow string, n int, who string")
    got = {
        (r["flow"], r["n"]): (r["direction"], r["established"])
        for r in match.with_direction(df, ["flow"], "who", ["n"]).collect()
    }
    assert got == {
        ("f", 1): ("to_server", False), ("f", 2): ("to_server", False), ("f", 3): ("to_client", False),
        ("f", 4): ("to_server", True), (None, 1): ("to_server", False), (None, 2): ("to_client", False),
        ("g", 1): ("to_server", False),
    }


def test_flow_key_is_the_same_both_ways(spark):
    pk = packets(spark, [{"src": "1.1.1.1", "dst": "2.2.2.2", "sport": 5, "dport": 6},
                         {"src": "2.2.2.2", "dst": "1.1.1.1", "sport": 6, "dport": 5},
                         {"src": "2.2.2.2", "dst": "1.1.1.1", "sport": 5, "dport": 6}])
    assert pk.select(*match.flow_key()).distinct().count() == 2


def test_indicator_scores(spark):
    pk = packets(spark, [{"src": "1.1.1.1", "dst": "2.2.2.2"}, {"src": "1.1.1.1", "dst": "3.3.3.3"},
                         {"src": "5.5.5.5", "dst": "4.4.4.4"}])
    # The list repeats an indicator; the range line is only text here.
    intel = spark.createDataFrame(
        [("1.1.1.1", "ip"), ("1.1.1.1", "ip"), ("2.2.2.2", "ip"), ("4.4.4.0/24", "ip"), ("3.3.3.3", "domain")],
        "indicator string, kind string",
    )
    got = {r["packet_id"]: r["intel_score"] for r in lookup.score_indicators(pk, intel).collect()}
    assert got == {0: 200, 1: 100, 2: 0}


def test_cidr_edges(spark):
    ranges = ["45.146.164.0/24", "10.0.0.0/20", "7.0.0.0/7", "8.8.8.8", "9.0.0.128/25", "bad/24", "1.1.1.1/99"]
    ips = ["45.146.163.255", "45.146.164.0", "45.146.164.255", "45.146.165.0", "10.0.15.255", "10.0.16.0",
           "6.0.0.0", "7.255.255.255", "8.0.0.0", "8.8.8.8", "9.0.0.127", "9.0.0.128", "x", None]
    df = spark.createDataFrame([(i,) for i in ips], "ip string")
    rng = spark.createDataFrame([(r,) for r in ranges], "indicator string")
    got = {r["ip"] for r in lookup.in_ranges(df, "ip", rng).filter("in_range").collect()}
    assert got == {"45.146.164.0", "45.146.164.255", "10.0.15.255", "6.0.0.0", "7.255.255.255", "8.8.8.8", "9.0.0.128"}
    assert lookup.in_ranges(df, "ip", rng).count() == len(ips)


def test_countries_across_buckets(spark):
    blocks = spark.createDataFrame([(16777216, 33554431, "A"), (33554432, 33554432, "B")], "lo long, hi long, country string")
    df = spark.createDataFrame([("1.0.0.0",), ("1.255.255.255",), ("2.0.0.0",), ("2.0.0.1",), (None,)], "ip string")
    got = [(r["ip"], r["country"]) for r in lookup.with_country(df, "ip", blocks).collect()]
    assert set(got) == {("1.0.0.0", "A"), ("1.255.255.255", "A"), ("2.0.0.0", "B"), ("2.0.0.1", "UNKNOWN"), (None, "UNKNOWN")}


def test_allow_list_wins(spark):
    df = spark.createDataFrame([("a",), ("b",), ("c",)], "ip string")
    names = lambda *n: spark.createDataFrame([(x,) for x in n], "indicator string")
    got = lookup.blocked_unless_allowed(df, "ip", names("a", "b"), names("b"))
    assert [r["ip"] for r in got.collect()] == ["a"]


def test_packets_from_json_and_bytes(spark):
    line = '{"packet_id":7,"ts":"2024-01-01T00:00:00Z","src_ip":"1.1.1.1","dport":80,"payload":"the"}'
    got = packet_source.packets_from_json(spark.createDataFrame([(line,)], "value string")).first()
    assert (got["packet_id"], got["sport"], got["dport"], got["payload"]) == (7, None, 80, "the")
    raw = packets(spark, [{"payload": "x"}]).withColumn("payload", F.lit(b"\xffthe\xfe"))
    assert packet_source.with_text_payload(raw).first()["payload"] == "the"
    hits = detection.detect(
        raw, rule_rows(spark, [{"content": "the"}, {"content": "The"}]), fixtures.intel(spark)
    )
    assert [r["rule_key"] for r in hits.collect()] == [0]
