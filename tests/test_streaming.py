"""Streams over several files and micro-batches against the batch operators."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from packetloom.operators import anomaly, correlate, lookup, rollup
from packetloom.plans import fixtures
from packetloom.sources import alert_store
from packetloom.sources.packets import packet_heads, stream_packets
from packetloom.streaming import jobs

ONE_FILE = {"maxFilesPerTrigger": "1"}


def split(df, folder, parts, order="packet_id"):
    """Write ``df`` as ``parts`` files whose modification order follows ``order``."""
    ranked = df.orderBy(order).collect()
    size = -(-len(ranked) // parts)
    for i in range(parts):
        piece = df.sparkSession.createDataFrame(ranked[i * size : (i + 1) * size], df.schema)
        piece.coalesce(1).write.mode("append").parquet(str(folder))


@pytest.fixture(scope="module")
def heads(spark, data):
    return packet_heads(spark, data).withColumn("payload", F.lit(None).cast("string"))


@pytest.fixture(scope="module")
def folder(heads, tmp_path_factory):
    path = tmp_path_factory.mktemp("packets")
    split(heads, path, 4)
    return str(path)


def places(tmp_path):
    return {"work": str(tmp_path / "work"), "out": str(tmp_path / "out")}


def head_rules(spark):
    return fixtures.rules(spark).filter(F.col("content").isNull())


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


def test_matching_and_escalation_equal_batch(spark, heads, folder, tmp_path):
    at = places(tmp_path)
    alerts = jobs.matched_stream(stream_packets(spark, folder, **ONE_FILE), head_rules(spark))
    query = jobs.start_escalation(alerts, window_seconds=86_400, trigger=jobs.NOW, **at)
    jobs.finish(query)
    assert query.lastProgress["batchId"] == 3
    got = spark.read.parquet(at["out"])
    batch = jobs.matched_stream(heads, head_rules(spark))
    want = correlate.mark_escalated(batch, window_seconds=86_400)
    columns = ("packet_id", "sid", "escalated")
    assert rows(got, *columns) == rows(want, *columns)
    assert want.filter("escalated").count() > 0


def test_held_back_stream_is_exact_when_files_come_out_of_order(spark, heads, tmp_path):
    """Files are in an order unrelated to time inside the hold; nothing is late."""
    path = tmp_path / "in"
    day = 86_400
    jittered = heads.withColumn(
        "arrival", F.unix_micros("ts") + F.pmod(F.xxhash64("packet_id"), F.lit(3 * day * 1_000_000))
    )
    split(jittered, path, 5, "arrival")
    at = places(tmp_path)
    stream = spark.readStream.schema(heads.schema).option("maxFilesPerTrigger", "1").parquet(str(path))
    alerts = jobs.matched_stream(stream, head_rules(spark))
    jobs.finish(
        jobs.start_escalation(alerts, window_seconds=day, hold_seconds=4 * day, trigger=jobs.NOW, **at)
    )
    got = spark.read.parquet(at["out"])
    batch = jobs.matched_stream(heads, head_rules(spark))
    mark = heads.agg(F.max("ts")).first()[0].timestamp() - 4 * day
    want = correlate.mark_escalated(batch, window_seconds=day).filter(F.col("ts").cast("double") <= mark)
    columns = ("packet_id", "sid", "escalated")
    assert rows(got, *columns) == rows(want, *columns)


def test_late_rows_are_counted_and_left_out(spark, heads, tmp_path):
    path = tmp_path / "in"
    newest_first = heads.withColumn("back", -F.unix_micros("ts"))
    split(newest_first, path, 2, "back")
    at = places(tmp_path)
    stream = spark.readStream.schema(heads.schema).option("maxFilesPerTrigger", "1").parquet(str(path))
    alerts = jobs.matched_stream(stream, head_rules(spark))
    jobs.finish(jobs.start_escalation(alerts, hold_seconds=60, trigger=jobs.NOW, **at))
    clock = spark.read.parquet(f"{at['work']}/carry/clock/place=1").first()
    half = heads.orderBy("ts").limit(heads.count() - -(-heads.count() // 2))
    assert clock["late"] == jobs.matched_stream(half, head_rules(spark)).count()


def test_unusual_ports_equal_batch(spark, heads, folder, tmp_path):
    at = places(tmp_path)
    jobs.finish(jobs.start_unusual_ports(stream_packets(spark, folder, **ONE_FILE), trigger=jobs.NOW, **at))
    columns = ("packet_id", "port", "sightings")
    assert rows(spark.read.parquet(at["out"]), *columns) == rows(anomaly.unusual_ports(heads), *columns)


def test_restart_goes_on_from_the_carry(spark, heads, tmp_path):
    path = tmp_path / "in"
    at = places(tmp_path)
    first, second = heads.filter("packet_id < 400"), heads.filter("packet_id >= 400")
    for piece in (first, second):
        piece.coalesce(1).write.mode("append").parquet(str(path))
        jobs.finish(jobs.start_unusual_ports(stream_packets(spark, str(path)), trigger=jobs.NOW, **at))
    columns = ("packet_id", "port", "sightings")
    assert rows(spark.read.parquet(at["out"]), *columns) == rows(anomaly.unusual_ports(heads), *columns)


def scored(spark, df):
    alerts = jobs.matched_stream(df, head_rules(spark))
    return lookup.score_indicators(alerts, fixtures.intel(spark)).withColumn("threat_score", F.col("intel_score"))


def test_scores_stats_and_snapshots(spark, heads, folder, tmp_path):
    batch = scored(spark, heads)
    at = places(tmp_path / "scores")
    jobs.finish(jobs.start_ip_scores(scored(spark, stream_packets(spark, folder, **ONE_FILE)), trigger=jobs.NOW, **at))
    got = jobs.latest(spark.read.parquet(at["out"]), ["ip"])
    assert rows(got, "ip", "score", "alerts") == rows(correlate.ip_scores(batch), "ip", "score", "alerts")

    at = places(tmp_path / "stats")
    jobs.finish(jobs.start_stats(scored(spark, stream_packets(spark, folder, **ONE_FILE)), trigger=jobs.NOW, **at))
    want = rollup.severity_rollup(batch)
    assert rows(jobs.latest(spark.read.parquet(at["out"]), []), *want.columns) == rows(want, *want.columns)

    at = places(tmp_path / "snapshots")
    jobs.finish(jobs.start_snapshots(scored(spark, stream_packets(spark, folder, **ONE_FILE)), trigger=jobs.NOW, **at))
    snapshots = spark.read.parquet(at["out"])
    assert snapshots.select("batch_id").distinct().count() == 4
    last = jobs.latest(snapshots, [])
    stats = last.filter("kind = 'stats'").select(F.from_json("body", want.schema).alias("s")).select("s.*")
    assert rows(stats, *want.columns) == rows(want, *want.columns)
    feed = last.filter("kind = 'alert'").select(F.get_json_object("body", "$.packet_id").cast("long").alias("p"))
    top = rollup.newest(batch, 10, ["ts", "packet_id", "rule_key"])
    assert rows(feed, "p") == rows(top, "packet_id")


def test_append_log_and_table(spark, heads, folder, tmp_path):
    at = places(tmp_path / "log")
    lines = alert_store.log_lines(stream_packets(spark, folder).withColumnRenamed("src_ip", "src"), ["src", "sport"], "ts")
    jobs.finish(jobs.append_log(lines, trigger=jobs.NOW, **at))
    back = alert_store.read_log(spark, at["out"])
    assert rows(back, "src", "sport") == rows(heads, "src_ip", "sport")
    at = places(tmp_path / "table")
    jobs.finish(jobs.append_table(stream_packets(spark, folder).select("packet_id"), trigger=jobs.NOW, **at))
    assert spark.read.parquet(at["out"]).count() == heads.count()


def test_rates_close_with_the_watermark(spark, heads, folder, tmp_path):
    at = places(tmp_path)
    rates = jobs.rates(stream_packets(spark, folder, **ONE_FILE), seconds=3600)
    jobs.finish(jobs.append_table(rates, trigger=jobs.NOW, **at))
    mark = heads.agg(F.max(F.unix_micros("ts"))).first()[0] - 600 * 1_000_000
    want = rollup.traffic_rate(heads, 3600).filter(F.col("window_start") + 3600 * 1_000_000 <= mark)
    columns = ("window_start", "packets", "bytes")
    assert rows(spark.read.parquet(at["out"]), *columns) == rows(want, *columns)


def test_watermark_drops_and_reports_late_rows(spark, heads, tmp_path):
    path = tmp_path / "in"
    newest_first = heads.withColumn("back", -F.unix_micros("ts"))
    split(newest_first, path, 4, "back")
    at = places(tmp_path)
    stream = spark.readStream.schema(heads.schema).option("maxFilesPerTrigger", "1").parquet(str(path))
    query = jobs.append_table(jobs.rates(stream, seconds=3600), trigger=jobs.NOW, **at)
    jobs.finish(query)
    dropped = sum(
        op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"]
    )
    assert dropped > 0


@pytest.mark.parametrize("local_merge", ["false", "true"])
def test_sessions(spark, heads, folder, tmp_path, local_merge):
    from packetloom.operators import detect

    at = places(tmp_path)
    old = spark.conf.get(jobs.LOCAL_MERGE)
    spark.conf.set(jobs.LOCAL_MERGE, local_merge)
    try:
        found = jobs.flow_sessions(stream_packets(spark, folder, **ONE_FILE), idle="3600 seconds")
        jobs.finish(jobs.append_table(found, trigger=jobs.NOW, **at))
    finally:
        spark.conf.set(jobs.LOCAL_MERGE, old)
    mark = heads.agg(F.max(F.unix_micros("ts"))).first()[0] - 600 * 1_000_000
    want = detect.sessions(heads, ["src_ip"], idle_seconds=3600).filter(F.col("last_us") + 3600 * 1_000_000 <= mark)
    got = spark.read.parquet(at["out"]).withColumn("start_us", F.unix_micros("started"))
    columns = ("src_ip", "start_us", "packets", "bytes")
    assert rows(got, *columns) == rows(want, *columns)


def test_once_per_flow(spark, heads, folder, tmp_path):
    at = places(tmp_path)
    alerts = scored(spark, stream_packets(spark, folder, **ONE_FILE))
    once = jobs.once_per_flow(alerts, ["src_ip", "sid"], delay="3650 days")
    jobs.finish(jobs.append_table(once.select("src_ip", "sid"), trigger=jobs.NOW, **at))
    want = scored(spark, heads).select("src_ip", "sid").distinct()
    assert rows(spark.read.parquet(at["out"]), "src_ip", "sid") == rows(want, "src_ip", "sid")


def test_unusual_ports_in_event_order(spark, heads, tmp_path):
    """Shuffled files over five micro-batches, held back and flushed, equal the batch operator."""
    path = tmp_path / "in"
    split(heads.withColumn("any", F.xxhash64("packet_id")), path, 5, "any")
    at = places(tmp_path)
    span = heads.agg((F.max(F.unix_micros("ts")) - F.min(F.unix_micros("ts"))) / 1e6).first()[0] + 1
    stream = spark.readStream.schema(heads.schema).option("maxFilesPerTrigger", "1").parquet(str(path))
    jobs.finish(jobs.start_unusual_ports(stream, hold_seconds=span, trigger=jobs.NOW, **at))
    columns = ("packet_id", "port", "sightings")
    want = rows(anomaly.unusual_ports(heads), *columns)
    assert rows(spark.read.parquet(at["out"]), *columns) != want
    first = jobs.flush_unusual_ports(stream, hold_seconds=span, **at)
    assert rows(spark.read.parquet(at["out"]), *columns) == want
    # a flush may be run again, and the job may go on after it: its next batch replaces the flushed rows
    assert jobs.flush_unusual_ports(stream, hold_seconds=span, **at) == first
    assert rows(spark.read.parquet(at["out"]), *columns) == want
    more = heads.limit(1).withColumn("ts", F.timestamp_micros(F.unix_micros("ts") + int(3 * span * 1e6))).withColumn("packet_id", F.lit(10**9))
    more.coalesce(1).write.mode("append").parquet(str(path))
    jobs.finish(jobs.start_unusual_ports(stream, hold_seconds=span, trigger=jobs.NOW, **at))
    assert rows(spark.read.parquet(at["out"]), *columns) == want  # the new packet itself is held


def test_flush_of_a_job_without_batches(spark, heads, tmp_path):
    assert jobs.flush_unusual_ports(heads, hold_seconds=1, **places(tmp_path)) is None


def test_flushed_escalation_equals_batch(spark, heads, tmp_path):
    path = tmp_path / "in"
    split(heads.withColumn("any", F.xxhash64("packet_id")), path, 3, "any")
    at = places(tmp_path)
    stream = spark.readStream.schema(heads.schema).option("maxFilesPerTrigger", "1").parquet(str(path))
    alerts = jobs.matched_stream(stream, head_rules(spark))
    how = {"window_seconds": 86_400, "hold_seconds": 400 * 86_400}
    jobs.finish(jobs.start_escalation(alerts, trigger=jobs.NOW, **how, **at))
    jobs.flush_escalation(alerts, **how, **at)
    columns = ("packet_id", "sid", "escalated")
    want = correlate.mark_escalated(jobs.matched_stream(heads, head_rules(spark)), window_seconds=86_400)
    assert rows(spark.read.parquet(at["out"]), *columns) == rows(want, *columns)


def test_once_per_session_lets_state_go(spark, heads, folder, tmp_path):
    at = places(tmp_path)
    alerts = jobs.matched_stream(stream_packets(spark, folder, **ONE_FILE), head_rules(spark)).select("src_ip", "sid", "ts", "packet_id")
    query = jobs.append_table(jobs.once_per_session(alerts, ["src_ip", "sid"], idle="3600 seconds"), trigger=jobs.NOW, **at)
    jobs.finish(query)
    removed = sum(op["numRowsRemoved"] for p in query.recentProgress for op in p["stateOperators"])
    assert removed > 0
    got = spark.read.parquet(at["out"])
    assert got.groupBy("src_ip", "sid", "packet_id").count().where("count > 1").isEmpty() and got.count() > 0


def test_a_streamed_sketch_equals_the_batch_sketch(spark, heads, folder, tmp_path):
    at = places(tmp_path)
    jobs.finish(jobs.start_sketches(stream_packets(spark, folder, **ONE_FILE), ["src_ip", "dport"], seconds=86_400, trigger=jobs.NOW, **at))
    want = rollup.distinct_sketches(heads, ["src_ip", "dport"], 86_400)
    assert rows(jobs.current(spark, at["out"], ["window_start"]), "window_start", "sketch") == rows(want, "window_start", "sketch")


def test_current_reads_few_folders(spark, heads, folder, tmp_path):
    at = places(tmp_path)
    jobs.finish(jobs.start_ip_scores(scored(spark, stream_packets(spark, folder, **ONE_FILE)), trigger=jobs.NOW, **at))
    batch = scored(spark, heads)
    assert rows(jobs.current(spark, at["out"], ["ip"]), "ip", "score", "alerts") == rows(correlate.ip_scores(batch), "ip", "score", "alerts")
