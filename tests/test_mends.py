"""Shared folder, hot keys beyond Spark's bound, listings, overlapping blocks, rule options."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from packetloom import session
from packetloom.operators import correlate, lookup, match, ordered, rollup, rule_options
from packetloom.plans import fixtures, option_queries
from packetloom.sources.packets import packet_heads


class Stub:
    def __init__(self, master, **conf):
        self.sparkContext = type("C", (), {"master": master})
        self.conf = type("F", (), {"get": lambda _, k, d=None: conf.get(k.replace(".", "_"), d), "set": lambda *_: None})()


def test_no_local_folder_on_a_cluster():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_root(Stub("spark://host:7077"))
    with pytest.raises(ValueError):
        session.shared_root(Stub("local-cluster[2,1,1024]"))
    assert session.shared_root(Stub("yarn", spark_checkpoint_dir="hdfs://x/y")) == "hdfs://x/y"


def test_clear_scratch(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "shared_root", lambda _: str(tmp_path))
    session.written(spark.range(3), "t")
    assert list(tmp_path.rglob("*.parquet"))
    assert session.clear_scratch(spark) and not list(tmp_path.rglob("*.parquet"))
    assert not session.clear_scratch(spark)


def test_first_rows_beyond_the_group_limit(spark):
    df = spark.range(9000).select((F.col("id") % 2).alias("k"), F.col("id").alias("at"))
    got = ordered.first_rows(df, ["k"], [F.asc("at")], 1500)
    assert got.count() == 3000
    assert got.agg(F.max("at")).first()[0] == 2999
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window ") >= 2


def test_rules_are_listed_once_per_class(spark):
    rules = fixtures.rules(spark)
    assert match.rule_listing(rules).count() == 4 + 4 * 2 - 2  # three for tcp, one for udp, two for any
    assert match.rule_listing(rules, 3).count() == 3 * match.rule_listing(rules).count()


def test_content_rules_need_a_payload(spark, data):
    alerts = match.match_packets(packet_heads(spark, data), fixtures.rules(spark))
    assert alerts.where("sid in ('9000004', '9000006')").isEmpty() and not alerts.isEmpty()


def test_overlapping_blocks_do_not_multiply(spark):
    blocks = spark.createDataFrame(
        [(0x0A000000, 0x0A00FFFF, "wide"), (0x0A000100, 0x0A0001FF, "narrow"), (0x0A000100, 0x0A0001FF, "twin")],
        "lo long, hi long, country string",
    )
    df = spark.createDataFrame([("10.0.1.7",), ("10.0.2.7",), ("11.0.0.1",), (None,)], "ip string")
    got = {r.ip: r.country for r in lookup.with_country(df, "ip", blocks).collect()}
    assert got == {"10.0.1.7": "narrow", "10.0.2.7": "wide", "11.0.0.1": "UNKNOWN", None: "UNKNOWN"}


def test_small_pieces_give_the_same(spark, data):
    heads = packet_heads(spark, data)
    a = rollup.topology_edges(heads).select("src_ip", "dst_ip", "traffic")
    b = rollup.topology_edges(heads, piece_rows=50).select("src_ip", "dst_ip", "traffic")
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    same = heads.withColumns({"packet_size": F.lit(64), "src_ip": F.lit("10.0.0.1")})
    edges = spark.range(2000).select(F.concat(F.lit("10.1."), F.col("id").cast("int") % 200, F.lit("."), F.floor(F.col("id") / 200)).alias("dst_ip"))
    one = edges.select("dst_ip", F.lit("10.0.0.1").alias("src_ip"), F.lit(64).alias("packet_size"), F.lit(None).cast("timestamp").alias("ts"))
    tiers = rollup.topology_edges(one, piece_rows=100).groupBy("traffic").count().collect()
    assert sorted(r["count"] for r in tiers) == [666, 667, 667]
    for f in (correlate.mark_escalated, correlate.sliding_count):
        x, y = (f(same, "src_ip", tie=["packet_id"], window_seconds=3600, piece_rows=n) for n in (40, 10**6))
        assert sorted(x.select("packet_id", x.columns[-1]).collect()) == sorted(y.select("packet_id", y.columns[-1]).collect())


def test_behaviour_columns(spark):
    rules = {r.sid: r for r in option_queries.option_rules(spark, option_queries.FLOW_LINES + option_queries.LIMIT_LINES + option_queries.COUNT_LINES).collect()}
    assert (rules["9300004"].flow_side, rules["9300004"].flow_established) == ("to_client", True)
    assert (rules["9300005"].flow_side, rules["9300005"].flow_established) == ("to_server", False)
    assert rules["9300001"].flow_side is None and rules["9300001"].limit_kind is None
    r = rules["9300012"]
    assert (r.limit_kind, r.limit_track, r.limit_count, r.limit_seconds, r.limit_factor) == ("backoff", "by_dst", 1, 60, 10)
    assert [tuple(o) for o in rules["9300022"].state_options] == [("flowint", "tcp.big.count,+,2")]
    assert [tuple(o) for o in rules["9300024"].state_options][::2] == [("flowbits", "isnotset,tcp.told"), ("flowbits", "set,tcp.told")]
    assert rules["9300021"].noalert


def test_small_pieces_of_options(spark, data):
    rules = option_queries.option_rules(spark, option_queries.LIMIT_LINES)
    alerts = match.match_packets(packet_heads(spark, data), rules)
    a, b = (rule_options.limited(alerts, rules, piece_rows=n).select("packet_id", "sid") for n in (30, 10**6))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_scratch_goes_with_its_block(spark, data):
    heads = packet_heads(spark, data)
    kept = session.written(heads.select("packet_id"), "kept")
    with session.scratch(spark):
        outer = session.written(heads.select("packet_id"), "outer")
        with session.scratch(spark):
            inner = session.written(outer, "inner")
            assert inner.count() == outer.count() == heads.count()
            folder = os.path.dirname(inner.inputFiles()[0].removeprefix("file:"))
        assert not os.path.exists(folder) and outer.count() == heads.count()
    assert kept.count() == heads.count()
    assert not os.path.exists(os.path.dirname(os.path.dirname(folder)))
