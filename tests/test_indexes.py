"""Catalogs of thousands of rules and strings: indexes give what plain matching gives."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from packetloom.operators import detect, head_index, match, string_index
from packetloom.sources.packets import packet_heads

HEAD = "rule_key long, rule_proto string, sid string, msg string, rule_class string, content string, dsize_op string, dsize_n long, rule_src string, rule_sport string, rule_dst string, rule_dport string"


def address(rng):
    base = rng.choice(["10.0.0", "10.0.1", "192.168.1", "45.146.164"])
    one = f"{base}.{rng.randrange(256)}" + rng.choice(["", "", "/24", "/28", "/16", "/9"])
    return rng.choice([one, one, "any", f"!{one}", f"[{one},10.0.0.{rng.randrange(256)}]", f"[{base}.0/24,!{base}.{rng.randrange(256)}]", f"![{one},1.2.3.4]", "x.y"])


def port(rng):
    p = rng.choice([21, 22, 80, 443, rng.randrange(65536)])
    return rng.choice([str(p), "any", "any", f"!{p}", f"{p}:", f":{p}", f"{p}:{p + 40}", f"[{p},8000:8100]", f"[{p}:,!{p + 1}]", f"{p + 9}:{p}"])


def head_rules(spark, n, seed=1):
    rng = random.Random(seed)
    rows = [
        (i, rng.choice(["tcp", "udp", "ip", "TCP"]), str(i), "m", "c", None, rng.choice([None, None, ">"]), 2000, address(rng), port(rng), address(rng), port(rng))
        for i in range(n)
    ]
    return match.with_head_ranges(spark.createDataFrame(rows, HEAD))


def hits(df):
    return sorted(map(tuple, df.select("packet_id", "rule_key").collect()))


@pytest.mark.parametrize("two_way", [False, True])
def test_heads_equal_plain_matching(spark, data, two_way):
    heads = match.with_address_numbers(packet_heads(spark, data)).limit(400)
    swap = {"src_ip": "dst_ip", "dst_ip": "src_ip", "src_no": "dst_no", "dst_no": "src_no", "sport": "dport", "dport": "sport"}
    turned = heads.where("packet_id % 5 = 0").select(*[F.col(swap.get(c, c)).alias(c) for c in heads.columns])
    heads = heads.unionByName(turned.withColumn("packet_id", F.col("packet_id") + 1_000_000))
    rules = head_rules(spark, 300)
    want = hits(match.match_packets(heads, rules, residual=[match.head_matches(two_way)]))
    assert hits(head_index.match_heads(heads, rules, two_way=two_way)) == want and len(want) > 100
    assert head_index.match_heads(heads, rules.limit(0), two_way=two_way).collect() == []


def test_each_rule_has_one_width(spark):
    listed = head_index.head_listing(head_rules(spark, 400)).withColumn("width", F.shiftright(F.expr("_at div 3"), 34))
    assert listed.groupBy("rule_key").agg(F.count_distinct("width").alias("n")).where("n > 1").isEmpty()
    assert listed.groupBy("rule_key").count().agg(F.max("count")).first()[0] <= 3 * max(256, head_index.MOST_BLOCKS)


def test_five_thousand_heads_take_little_longer_than_four(spark):
    heads = match.with_address_numbers(packet_heads(spark, "/root/testdata/sf0.1"))
    rows = [(i, "tcp", str(i), "m", "c", None, None, None, "any", "any", f"172.{16 + i // 65536}.{i // 256 % 256}.{i % 256}", "any") for i in range(5000)]
    four = [(9000 + i, "tcp", str(i), "m", "c", None, None, None, "any", "any", f"192.168.1.{i + 10}", "any") for i in range(4)]

    def seconds(rules):
        found = head_index.match_heads(heads, match.with_head_ranges(spark.createDataFrame(rules, HEAD)).cache())
        best = 1e9
        for _ in range(3):
            start = time.perf_counter()
            n = found.count()
            best = min(best, time.perf_counter() - start)
        return n, best

    small, large = seconds(four), seconds(rows + four)
    assert small[0] == large[0] > 0
    assert large[1] < 3 * small[1] + 0.5


WORDS = [f"{a}{b}{c}{d}" for a in "aehtxz" for b in "aeiou" for c in "dnrst" for d in ["", "a", "ed", "ing", "q", "zz"]]


def many_strings(n):
    rng = random.Random(3)
    out = {"", "a", "th", "the", "é", "\\E", "and ", "\n"}
    while len(out) < n:
        out.add(" ".join(rng.choices(WORDS, k=rng.randint(1, 3))) + rng.choice(["", "", str(rng.randrange(1000))]))
    return sorted(out)


@pytest.mark.parametrize("n, carried", [(20_000, 100_000), (20_000, 10), (30, 100_000), (30, 3)])
def test_strings_in_texts(spark, data, monkeypatch, n, carried):
    monkeypatch.setattr(string_index, "CARRIED", carried)
    texts = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", F.left("text", F.lit(1500)).alias("text")).limit(120)
    texts = texts.unionByName(spark.createDataFrame([(-1, None), (-2, ""), (-3, "é\\E\nthe"), (-4, "xanzz zedq")], texts.schema))
    strings = many_strings(n) if n > 100 else many_strings(8) + WORDS[:22]
    df = spark.createDataFrame([(s, i) for i, s in enumerate(strings)] + [(None, -1)], "s string, nth int")
    got = {(r.doc_id, r.s) for r in string_index.occurring(texts, df, text="text", string="s", keys=["doc_id"]).collect()}
    want = {(r.doc_id, s) for r in texts.collect() for s in strings if r.text is not None and s in r.text}
    assert got == want
    keys = string_index.listed_by_gram(df, "s").groupBy("_gram").count().agg(F.max("count")).first()[0]
    assert keys < n / 10 + 5
    assert string_index.occurring(texts, df.where("s is null"), text="text", string="s").collect() == []


@pytest.mark.parametrize("broadcast", [True, False])
def test_contents_and_signatures(spark, data, broadcast):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", F.left("text", F.lit(900)).alias("text")).limit(60)
    strings = many_strings(3000)
    rows = [(i, ["tcp", "udp", "ip"][i % 3], str(i), "m", "c", s if i % 50 else None, [None, ">", "<"][i % 3], 400) for i, s in enumerate(strings)]
    rules = spark.createDataFrame(rows, HEAD.split(", rule_src")[0])
    heads = packet_heads(spark, data).where("packet_id < 60").join(docs.withColumnRenamed("doc_id", "packet_id").withColumnRenamed("text", "payload"), "packet_id", "left")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old if broadcast else "-1")
    try:
        assert hits(match.match_contents(heads, rules)) == hits(match.match_packets(heads, rules, spread=1)) == hits(match.match_packets(heads, rules, spread=8))
        signatures = [(f"s{i}", strings[i::40], 2 + i % 3) for i in range(40)] + [("none", None, 1), ("null k", ["the"], None), ("twice", ["the", "the", None], 2)]
        df = spark.createDataFrame(signatures, "name string, strings array<string>, k int")
        got = {tuple(r) for r in detect.scan_signatures(docs, df, key="doc_id").collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    want = set()
    for d in docs.collect():
        for name, some, k in signatures:
            found = sum(s is not None and s in (d.text or "") for s in some or []) if d.text is not None else 0
            if k is not None and found >= k:
                want.add((d.doc_id, name, found))
    assert got == want and len(want) > 20


def test_a_shuffled_catalog_is_spread(spark):
    assert match.spread_of(spark.range(100)) == 1 and match.spread_of(spark.range(20_000)) == 20
