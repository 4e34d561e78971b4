"""Ranges as aligned blocks, sketches that merge, and update tables over many batches."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from packetloom.operators import lookup, rollup
from packetloom.sources.packets import packet_heads
from packetloom.streaming import updates


def number(ip):
    a, b, c, d = map(int, ip.split("."))
    return ((a * 256 + b) * 256 + c) * 256 + d


def address(n):
    return ".".join(str(n >> s & 255) for s in (24, 16, 8, 0))


def test_blocks_cover_ranges_exactly(spark):
    rng = random.Random(2)
    spans = [(0, 2**32 - 1), (5, 5), (0, 0), (2**32 - 1, 2**32 - 1), (1, 2**32 - 2), (255, 256)]
    for _ in range(200):
        a = rng.randrange(2**32)
        spans.append((a, min(a + rng.choice([0, 1, 7, 255, 256, 65_537, 2**28]), 2**32 - 1)))
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(spans)], "i int, lo long, hi long")
    found = {}
    for r in lookup.range_blocks(df).collect():
        found.setdefault(r.i, []).append((r.block << r.width, ((r.block + 1) << r.width) - 1))
    for i, (a, b) in enumerate(spans):
        parts = sorted(found[i])
        assert parts[0][0] == a and parts[-1][1] == b and len(parts) <= 64
        assert all(x[1] + 1 == y[0] for x, y in zip(parts, parts[1:]))
    assert lookup.range_blocks(spark.createDataFrame([(9, 3)], "lo long, hi long")).collect() == []


def test_owners_equal_brute_force(spark):
    rng = random.Random(3)
    spans = [(a, a + rng.choice([0, 3, 40, 300, 5000]), f"c{i % 9}") for i, a in enumerate(rng.randrange(number("10.1.0.0"), number("10.3.0.0")) for _ in range(150))]
    spans += [(spans[0][0], spans[0][1], "z"), (number("10.0.0.0"), number("10.255.255.255"), "wide")]
    ips = [address(rng.randrange(number("10.0.200.0"), number("10.3.9.0"))) for _ in range(300)] + ["11.0.0.1", None, "not an ip"]
    blocks = spark.createDataFrame(spans, "lo long, hi long, country string")
    got = {r.ip: r.country for r in lookup.with_country(spark.createDataFrame([(x,) for x in ips], "ip string"), "ip", blocks).collect()}
    for ip in ips[:-2]:
        n = number(ip)
        inside = [(b - a, a, c) for a, b, c in spans if a <= n <= b]
        assert got[ip] == (min(inside)[2] if inside else "UNKNOWN")
    assert got[None] == got["not an ip"] == "UNKNOWN"


def test_many_host_ranges_in_one_network(spark):
    """200,000 ranges of one address in one /16: an address meets one owner a width."""
    base = number("10.1.0.0")
    blocks = spark.range(200_000).select((F.lit(base) + F.col("id") % 65_536).alias("lo"), (F.lit(base) + F.col("id") % 65_536).alias("hi"), F.concat(F.lit("c"), F.col("id") % 7).alias("country"))
    ips = spark.range(65_536).select(F.concat(F.lit("10.1."), F.expr("id div 256"), F.lit("."), F.col("id") % 256).alias("ip"))
    got = lookup.with_country(ips, "ip", blocks)
    assert got.count() == 65_536 and got.where("country = 'UNKNOWN'").isEmpty()
    want = blocks.groupBy("lo").agg(F.min("country").alias("c"))
    assert got.join(want, lookup.ip_number(F.col("ip")) == F.col("lo")).where("country <> c").isEmpty()


def test_sketches_merge_to_the_same(spark, data):
    heads = packet_heads(spark, data)
    whole = rollup.distinct_sketches(heads, ["src_ip", "dport"], 86_400, size=20)
    parts = [rollup.distinct_sketches(heads.where(f"packet_id % 3 = {i}"), ["src_ip", "dport"], 86_400, size=20) for i in range(3)]
    merged = rollup.merged_sketches(parts[2].unionByName(parts[0]).unionByName(parts[1]).unionByName(parts[0]), ["window_start"], size=20)
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, whole.collect()))


@pytest.mark.parametrize("n, error", [(999, 0), (1000, 0.1), (50_000, 0.1)])
def test_sketch_error(spark, n, error):
    rows = spark.range(3 * n).select((F.col("id") % n).alias("x"), F.timestamp_micros(F.lit(0)).alias("ts"))
    got = rollup.distinct_sketches(rows, ["x"], 60).select(rollup.sketch_estimate().alias("e")).first().e
    assert abs(got - n) <= error * n


def folders_in(path):
    return sorted(p.name for p in path.iterdir() if "=" in p.name)


@pytest.mark.parametrize("keys", [["k"], []])
def test_thirty_batches_and_a_repeat(spark, tmp_path, monkeypatch, keys):
    monkeypatch.setattr(updates, "RUN", 3)
    monkeypatch.setattr(updates, "BASE", 3)
    rng, state, out = random.Random(1), {}, tmp_path / "out"
    table = updates.UpdateTable(spark, str(out), keys)
    assert not table.exists()
    for n in range(30):
        changed = {rng.randrange(12): rng.randrange(1000) for _ in range(3)}
        if not keys:
            state = {}
        state |= changed
        rows = spark.createDataFrame(list(changed.items()), "k int, v int").coalesce(1)
        for _ in range(2 if n % 4 == 2 or n == 26 else 1):  # some batches run again
            table.write(rows, n)
        base, runs, batches = table.folders()
        assert (base is not None) + len(runs) + len(batches) <= 1 + 2 + 2
        if n % 5 == 4 or n in (8, 26, 29):
            assert {r.k: r.v for r in table.read().collect()} == state
    assert len(folders_in(out)) <= 6 and len(folders_in(out / "_merged")) <= 2 + 6
