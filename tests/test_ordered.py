"""Order-dependent operators with many tiny pieces against plain windows and brute force."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from packetloom.operators import correlate, detect, limits, ordered, rollup

US = 1_000_000


def hits(seed: int, n: int = 400, keys=("a", "a", "a", "b", None), span: int = 900, ties: int = 5):
    """Random (key, second, id): bursts, equal times and NULL keys."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        second = rng.choice([rng.randrange(span), rng.randrange(0, span, max(span // ties, 1))])
        rows.append((rng.choice(keys), second, i))
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    df = spark.createDataFrame(rows, "sid string, second long, packet_id long")
    return df.withColumn("ts", F.timestamp_micros(F.col("second") * US)).withColumn(
        "rule_key", F.lit(1).cast("bigint")
    ).repartition(3)


@pytest.mark.parametrize("seed,piece_rows", [(0, 1), (1, 3), (2, 1000)])
def test_occurrence_number(spark, seed, piece_rows):
    df = frame(spark, hits(seed)).withColumn("_us", F.unix_micros("ts"))
    plain = F.row_number().over(Window.partitionBy("sid").orderBy("_us", "packet_id"))
    got = ordered.occurrence_number(
        df, ["sid"], "_us", "packet_id", slot_seconds=300, piece_rows=piece_rows
    )
    assert got.withColumn("p", plain).filter(~F.col("occurrence").eqNullSafe(F.col("p"))).isEmpty()
    assert got.count() == df.count()


@pytest.mark.parametrize("seed,piece_rows", [(1, 2), (2, 7), (3, 1000)])
def test_lagged_position_and_running_max(spark, seed, piece_rows):
    df = frame(spark, hits(seed)).withColumn("_us", F.unix_micros("ts"))
    order = ["_us", "packet_id"]
    pieces = ordered.time_pieces(
        df, ["sid"], "_us", "packet_id", slot_seconds=200, piece_rows=piece_rows
    )
    got = ordered.previous_position(pieces, "_us", order, "before")
    got = ordered.lagged_position(got, "_us", order, 4, "before4")
    got = ordered.running_max(got, order, F.col("packet_id"), "top")
    w = Window.partitionBy("sid").orderBy(*order)
    got = got.withColumn("b4", F.lag("_us", 4).over(w))
    check = got.withColumn("b", F.lag("_us").over(w)).withColumn(
        "t", F.max("packet_id").over(w.rowsBetween(Window.unboundedPreceding, 0))
    )
    wrong = check.filter(
        ~F.col("before").eqNullSafe(F.col("b"))
        | ~F.col("before4").eqNullSafe(F.col("b4"))
        | ~F.col("top").eqNullSafe(F.col("t"))
    )
    assert wrong.isEmpty() and check.count() == len(hits(seed))


def test_pieces_keep_the_order_and_stay_small(spark):
    # One key, one slot, and most rows at one instant.
    rows = [("a", 5, i) for i in range(1000)] + [("a", 6, i) for i in range(1000, 1100)]
    df = frame(spark, rows).withColumn("_us", F.unix_micros("ts"))
    pieces = ordered.time_pieces(
        df, ["sid"], "_us", "packet_id", slot_seconds=1, piece_rows=100
    )
    sizes = [r["count"] for r in pieces.groupBy(*ordered.PIECE).count().collect()]
    assert max(sizes) <= 101 and sum(sizes) == 1100


def test_a_burst_inside_a_day_is_divided_again(spark):
    # Half of the rows within one second of a day that the others fill evenly.
    rows = [("a", 43_200_000 + i, i) for i in range(1000)]
    rows += [("a", 86_400 * i, 1000 + i) for i in range(1000)]
    df = spark.createDataFrame(rows, "sid string, ms long, packet_id long")
    df = df.withColumn("_us", F.col("ms") * 1000)
    pieces = ordered.time_pieces(df, ["sid"], "_us", "packet_id", piece_rows=50)
    sizes = [r["count"] for r in pieces.groupBy(*ordered.PIECE).count().collect()]
    assert max(sizes) <= 110 and sum(sizes) == 2000
    got = ordered.occurrence_number(df, ["sid"], "_us", "packet_id", piece_rows=50)
    plain = F.row_number().over(Window.partitionBy("sid").orderBy("_us", "packet_id"))
    assert got.withColumn("p", plain).filter("p <> occurrence").isEmpty()


def brute_counts(rows, window):
    by_key = defaultdict(list)
    for key, second, i in rows:
        by_key[key].append((second, i))
    counts = {}
    for key, items in by_key.items():
        items.sort()
        for at, (second, i) in enumerate(items):
            counts[i] = sum(1 for s, _ in items[: at + 1] if second - s < window)
    return counts


@pytest.mark.parametrize("seed,piece_rows", [(0, 2), (1, 7), (2, 1000)])
def test_sliding_count(spark, seed, piece_rows):
    rows = hits(seed)
    got = correlate.sliding_count(
        frame(spark, rows), window_seconds=60, slot_seconds=120, piece_rows=piece_rows
    )
    assert {r["packet_id"]: r["in_window"] for r in got.collect()} == brute_counts(rows, 60)


@pytest.mark.parametrize("piece_rows", [2, 1000])
@pytest.mark.parametrize("seed,window,need", [(0, 60, 5), (1, 7, 2), (2, 60, 1), (3, 120, 9)])
def test_escalation_is_count_reached(spark, seed, window, need, piece_rows):
    rows = hits(seed)
    got = correlate.mark_escalated(
        frame(spark, rows),
        window_seconds=window,
        hits=need,
        slot_seconds=100,
        piece_rows=piece_rows,
    )
    want = {i: c >= need for i, c in brute_counts(rows, window).items()}
    assert {r["packet_id"]: r["escalated"] for r in got.collect()} == want


def test_escalation_without_written_pieces(spark):
    rows = hits(5)
    got = correlate.mark_escalated(frame(spark, rows), piece_rows=9, staged=False)
    want = {i: c >= 5 for i, c in brute_counts(rows, 60).items()}
    assert {r["packet_id"]: r["escalated"] for r in got.collect()} == want


@pytest.mark.parametrize("last,expected", [(59_999_999, True), (60_000_000, False)])
def test_the_window_is_strict(spark, last, expected):
    at = [0, 10, 20, 30, last]
    df = spark.createDataFrame(
        [("a", i, 1, us) for i, us in enumerate(at)],
        "sid string, packet_id long, rule_key long, us long",
    ).withColumn("ts", F.timestamp_micros("us"))
    got = {r["packet_id"]: r["escalated"] for r in correlate.mark_escalated(df).collect()}
    assert got == {0: False, 1: False, 2: False, 3: False, 4: expected}


def test_escalated_message_and_score(spark):
    df = spark.createDataFrame(
        [("m", 100, True), ("n", 0, False)], "msg string, threat_score int, escalated boolean"
    )
    got = correlate.apply_escalation(df).orderBy("msg").collect()
    assert [(r["msg"], r["threat_score"]) for r in got] == [("[ESCALATED] m", 150), ("n", 0)]


@pytest.mark.parametrize("piece_rows", [2, 1000])
def test_running_ip_score(spark, piece_rows):
    rng = random.Random(3)
    ips = ["1.1.1.1", "1.1.1.1", "2.2.2.2", "3.3.3.3"]
    rows = [
        (i, rng.randrange(50), rng.choice(ips), rng.choice(ips), rng.choice([0, 100, 200]))
        for i in range(200)
    ]
    df = spark.createDataFrame(
        rows, "packet_id long, second long, src_ip string, dst_ip string, intel_score int"
    ).withColumn("ts", F.timestamp_micros(F.col("second") * US)).withColumn("rule_key", F.lit(1))
    got = correlate.running_ip_score(df, slot_seconds=10, piece_rows=piece_rows)
    totals, want = defaultdict(int), {}
    for i, second, src, dst, score in sorted(rows, key=lambda r: (r[1], r[0])):
        for side, ip in enumerate((src, dst)):
            totals[ip] += score
            want[(i, side)] = totals[ip]
    assert {(r["packet_id"], r["side"]): r["running_score"] for r in got.collect()} == want
    final = {r["ip"]: r["score"] for r in correlate.ip_scores(df).collect()}
    assert final == dict(totals)


@pytest.mark.parametrize("piece_rows", [2, 1000])
def test_backoff(spark, piece_rows):
    df = frame(spark, hits(9, n=300, keys=("a", "a", "b")))
    got = limits.backoff(df, ["sid"], count=1, multiplier=2, slot_seconds=60, piece_rows=piece_rows)
    numbers = {s: sorted(r["occurrence"] for r in got.collect() if r["sid"] == s) for s in "ab"}
    totals = {r["sid"]: r["count"] for r in df.groupBy("sid").count().collect()}
    for s in "ab":
        assert numbers[s] == [2**i for i in range(20) if 2**i <= totals[s]]


def test_backoff_steps():
    assert limits.backoff_steps(3, 10)[:3] == [3, 30, 300]
    assert limits.backoff_steps(2, 1) == [2]
    assert limits.backoff_steps(1, 2)[-1] == 2**62


@pytest.mark.parametrize("piece_rows", [2, 1000])
def test_sessions(spark, piece_rows):
    rows = hits(4, n=200, span=9000, ties=20)
    df = frame(spark, rows).withColumn("packet_size", F.lit(10))
    got = detect.sessions(df, ["sid"], idle_seconds=60, slot_seconds=500, piece_rows=piece_rows)
    want = []
    for key in {r[0] for r in rows}:
        run = []
        for second in sorted(s for k, s, _ in rows if k == key):
            if run and second - run[-1] >= 60:
                want.append((str(key), run[0] * US, run[-1] * US, len(run)))
                run = []
            run.append(second)
        want.append((str(key), run[0] * US, run[-1] * US, len(run)))
    have = [(str(r["sid"]), r["start_us"], r["last_us"], r["packets"]) for r in got.collect()]
    assert sorted(have) == sorted(want)


@pytest.mark.parametrize("n,tiles,piece_rows", [(1, 3, 2), (2, 3, 9), (10, 3, 2), (11, 3, 9), (97, 4, 5)])
def test_tiles_equal_ntile(spark, n, tiles, piece_rows):
    df = spark.range(n).withColumn("v", F.pmod(F.col("id") * 7, F.lit(5)))
    got = rollup.tiled(df, tiles, "v", ["id"], "tile", piece_rows)
    plain = F.ntile(tiles).over(Window.orderBy("v", "id"))
    assert got.withColumn("p", plain).filter("tile <> p").isEmpty() and got.count() == n


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_hot_keys_are_cut_before_the_shuffle(spark):
    df = frame(spark, hits(1))
    first = ordered.first_rows(df, ["sid"], [F.asc("ts")], 3)
    assert plan_of(first).count("WindowGroupLimit") == 2


def test_escalation_shuffles_the_alerts_once(spark):
    df = correlate.mark_escalated(frame(spark, hits(1)))
    df.collect()
    final = plan_of(df).split("== Initial Plan ==")[0]
    assert "ReusedExchange" in final and "Join" not in final
