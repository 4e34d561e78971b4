"""Streaming queries over the event files, run to their end and read back.

Each writes below the cluster's shared folder and returns the written table.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom import schema
from packetloom.functions.timing import epoch_us, from_epoch_us, ntz_epoch_us
from packetloom.operators import lookup, rollup
from packetloom.plans import fixtures as fx
from packetloom.plans.registry import query
from packetloom.plans.sql_parts import (
    HEADS,
    PACKETS,
    RULES,
    full_alerts,
    matched,
    slot,
)
from packetloom.session import scratch_path
from packetloom.sources import alert_store
from packetloom.sources.packets import packets_from_events, table, with_payload
from packetloom.streaming import jobs

HOUR = 3600


def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    # A pattern, for a file source takes a plain path only if it is a directory.
    return spark.readStream.schema(schema.TABLES["events"]).parquet(f"{folder}/events.parque[t]")


def head_stream(spark: SparkSession, folder: str) -> DataFrame:
    return packets_from_events(event_stream(spark, folder))


def places(spark: SparkSession, label: str) -> dict[str, str]:
    base = scratch_path(spark, label)
    return {"work": f"{base}/work", "out": f"{base}/out"}


def scored_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Alerts of all rules with their un-escalated score."""
    packets = with_payload(head_stream(spark, folder), table(spark, folder, "documents"))
    alerts = jobs.matched_stream(packets, fx.rules(spark))
    return lookup.score_indicators(alerts, fx.intel(spark)).withColumn(
        "threat_score", F.col("intel_score")
    )


BATCHES = 5
LATE = 2 * 86_400


def arrivals(spark: SparkSession, folder: str, late_seconds: int = 0) -> Iterator[DataFrame]:
    """A stream of events after each of ``BATCHES`` arrivals, in equal spans of time.

    Each event arrives up to ``late_seconds`` after its time, by its number.
    """
    path = scratch_path(spark, "arrivals")
    events = table(spark, folder, "events")
    us = ntz_epoch_us("ts") + F.pmod(F.xxhash64("event_id"), F.lit(late_seconds * 1_000_000 + 1))
    low, high = (x or 0 for x in events.agg(F.min(us), F.max(us)).first())
    span = F.floor((us - F.lit(low)) / F.lit((high - low) // BATCHES + 1))
    for i in range(BATCHES):
        events.where(span == i).write.mode("append").parquet(path)
        yield spark.readStream.schema(schema.TABLES["events"]).parquet(path)


def detected(spark: SparkSession, folder: str, label: str) -> dict[str, str]:
    """Live detection over arriving events, a micro-batch each.

    After every arrival the job is started again from its checkpoint.
    """
    at = places(spark, label)
    at["log"] = f"{at['work']}/log"
    for arrived in arrivals(spark, folder):
        stream = with_payload(packets_from_events(arrived), table(spark, folder, "documents"))
        jobs.finish(
            jobs.start_detection(
                stream, fx.rules(spark), fx.intel(spark), window_seconds=HOUR, trigger=jobs.NOW, **at
            )
        )
    return at


@query(
    "stream_rule_match",
    f"with {PACKETS}, {RULES}, {matched('packets')}"
    + " select packet_id, sid, protocol, rule_class, packet_size from matched",
)
def stream_rule_match(spark, folder):
    at = places(spark, "match")
    packets = with_payload(head_stream(spark, folder), table(spark, folder, "documents"))
    alerts = jobs.matched_stream(packets, fx.rules(spark))
    jobs.finish(jobs.append_table(alerts, trigger=jobs.NOW, **at))
    return spark.read.parquet(at["out"]).select(
        "packet_id", "sid", "protocol", "rule_class", "packet_size"
    )


@query(
    "stream_escalation",
    """
select event_id, event_type, coalesce(epoch_us(ts) - lag(epoch_us(ts), 4) over
  (partition by event_type order by ts, event_id) < 3600000000, false) as escalated
from events""",
)
def stream_escalation(spark, folder):
    """Events arrive up to two days late in five micro-batches and are marked in order of time."""
    at = places(spark, "escalation")
    how = {"key": "event_type", "tie": ["event_id"], "window_seconds": HOUR, "hold_seconds": LATE}
    for arrived in arrivals(spark, folder, LATE):
        events = arrived.select("event_id", "event_type", from_epoch_us(ntz_epoch_us("ts")).alias("ts"))
        jobs.finish(jobs.start_escalation(events, trigger=jobs.NOW, **how, **at))
    jobs.flush_escalation(events, **how, **at)
    return spark.read.parquet(at["out"]).select("event_id", "event_type", "escalated")


@query(
    "stream_unusual_ports",
    f"with {HEADS}"
    + """,
ports as (select packet_id, us, 0 as slot, sport as port from heads where sport is not null
  union all select packet_id, us, 1, dport from heads where dport is not null),
seen as (select *, count(*) over (partition by port order by us, packet_id, slot
  rows unbounded preceding) as sightings from ports)
select packet_id, port, sightings from seen where slot = 1 and sightings < 5""",
)
def stream_unusual_ports(spark, folder):
    """Packets arrive up to two days late in five micro-batches and are counted in order of time."""
    at = places(spark, "ports")
    for arrived in arrivals(spark, folder, LATE):
        heads = packets_from_events(arrived)
        jobs.finish(jobs.start_unusual_ports(heads, hold_seconds=LATE, trigger=jobs.NOW, **at))
    jobs.flush_unusual_ports(heads, hold_seconds=LATE, **at)
    return spark.read.parquet(at["out"]).select("packet_id", "port", "sightings")


@query(
    "stream_ip_scores",
    full_alerts(HOUR)
    + """
select ip, sum(intel_score)::bigint as score, count(*) as alerts
from (select src_ip as ip, intel_score from alerts union all select dst_ip, intel_score from alerts)
group by ip""",
)
def stream_ip_scores(spark, folder):
    at = places(spark, "scores")
    jobs.finish(jobs.start_ip_scores(scored_stream(spark, folder), trigger=jobs.NOW, **at))
    return jobs.current(spark, at["out"], ["ip"])


STATS_COLUMNS = """
count(*) as total_alerts, count(*) filter (intel_score > 100) as critical_alerts,
  count(*) filter (intel_score > 50 and intel_score <= 100) as high_alerts,
  count(*) filter (intel_score > 20 and intel_score <= 50) as medium_alerts,
  count(*) filter (intel_score <= 20) as low_alerts,
  cast(coalesce(trunc(avg(intel_score)), 0) as int) as threat_score"""


@query("stream_stats", full_alerts(HOUR) + f" select {STATS_COLUMNS} from alerts")
def stream_stats(spark, folder):
    at = places(spark, "stats")
    jobs.finish(jobs.start_stats(scored_stream(spark, folder), trigger=jobs.NOW, **at))
    return jobs.current(spark, at["out"], [])


@query(
    "stream_snapshots",
    full_alerts(HOUR)
    + f""",
stats as (select {STATS_COLUMNS} from alerts),
feed as (select us, packet_id, rule_key, sid, intel_score as threat_score from alerts
  order by us desc, packet_id desc, rule_key desc limit 10)
select 'stats' as kind, cast(to_json(stats) as varchar) as body from stats
union all select 'alert', cast(to_json(feed) as varchar) from feed""",
)
def stream_snapshots(spark, folder):
    at = places(spark, "snapshots")
    jobs.finish(jobs.start_snapshots(scored_stream(spark, folder), trigger=jobs.NOW, **at))
    return jobs.current(spark, at["out"], [])


@query(
    "stream_alert_log",
    full_alerts(HOUR)
    + """
select strftime(ts, '%Y-%m-%d %H:%M:%S,%g') as logged_at, sid, msg, src_ip as src, dst_ip as dst, dport,
  threat_score, escalated, packet_size
from alerts""",
)
def stream_alert_log(spark, folder):
    """The log that live detection writes, read back."""
    at = detected(spark, folder, "log")
    return alert_store.read_log(spark, at["log"]).select(
        "logged_at", "sid", "msg", "src", "dst", "dport", "threat_score", "escalated", "packet_size"
    )


@query(
    "stream_detect",
    full_alerts(HOUR)
    + " select packet_id, rule_key, sid, msg, escalated, intel_score, threat_score from alerts",
)
def stream_detect(spark, folder):
    """Live detection over several micro-batches equals the batch plan."""
    at = detected(spark, folder, "detect")
    return spark.read.parquet(at["out"]).select(
        "packet_id", "rule_key", "sid", "msg", "escalated", "intel_score", "threat_score"
    )


@query(
    "stream_rate",
    f"with {HEADS}"
    + f"""
select {slot("us", HOUR)} as window_start, count(*) as packets, sum(packet_size)::bigint as bytes
from heads group by 1""",
)
def stream_rate(spark, folder):
    at = places(spark, "rate")
    rates = jobs.rates(head_stream(spark, folder), seconds=HOUR)
    jobs.finish(jobs.start_updates(rates, keys=["window_start"], trigger=jobs.NOW, **at))
    return jobs.current(spark, at["out"], ["window_start"]).select(
        "window_start", "packets", "bytes"
    )


@contextmanager
def merged_locally(spark: SparkSession) -> Iterator[None]:
    """Sessions of a hot key are merged in each task, and their state is on disk, while a query starts and runs."""
    old = {name: spark.conf.get(name) for name in (jobs.LOCAL_MERGE, jobs.STATE_STORE)}
    jobs.merge_sessions_locally(spark)
    jobs.keep_state_on_disk(spark)
    try:
        yield
    finally:
        for name, value in old.items():
            spark.conf.set(name, value)


@query(
    "stream_sessions",
    f"with {HEADS}"
    + """,
flagged as (select *, case when us - lag(us) over (partition by src_ip order by us, packet_id)
    < 3600000000 then 0 else 1 end as fresh from heads),
numbered as (select *, sum(fresh) over (partition by src_ip order by us, packet_id
    rows unbounded preceding) as session from flagged),
found as (select src_ip, min(us) as start_us, max(us) as last_us, count(*) as packets,
  sum(packet_size)::bigint as bytes from numbered group by src_ip, session)
select * from found
where last_us + 3600000000 <= (select (max(us) - 600000000) // 1000 * 1000 from heads)""",
)
def stream_sessions(spark, folder):
    """Closed sessions: those that end before the watermark (append mode)."""
    at = places(spark, "sessions")
    found = jobs.flow_sessions(head_stream(spark, folder), idle=f"{HOUR} seconds")
    with merged_locally(spark):
        jobs.finish(jobs.append_table(found, trigger=jobs.NOW, **at))
    return spark.read.parquet(at["out"]).select(
        "src_ip",
        epoch_us(F.col("started")).alias("start_us"),
        epoch_us(F.col("last_seen")).alias("last_us"),
        "packets",
        "bytes",
    )


@query("stream_once_per_flow", full_alerts(HOUR) + " select distinct src_ip, sid from alerts")
def stream_once_per_flow(spark, folder):
    """The delay spans the whole table, so each flow and signature comes out once."""
    at = places(spark, "once")
    alerts = jobs.once_per_flow(
        scored_stream(spark, folder), ["src_ip", "sid"], delay="3650 days"
    )
    jobs.finish(jobs.append_table(alerts.select("src_ip", "sid"), trigger=jobs.NOW, **at))
    return spark.read.parquet(at["out"])


@query(
    "stream_once_per_session",
    full_alerts(HOUR)
    + """,
flagged as (select *, case when us - lag(us) over (partition by src_ip, sid order by us, packet_id)
    < 3600000000 then 0 else 1 end as fresh from alerts),
numbered as (select *, sum(fresh) over (partition by src_ip, sid order by us, packet_id
    rows unbounded preceding) as session from flagged)
select src_ip, sid, arg_min(packet_id, (us, packet_id)) as packet_id, count(*) as alerts from numbered
group by src_ip, sid, session
having max(us) + 3600000000 <= (select (max(us) - 600000000) // 1000 * 1000 from alerts)""",
)
def stream_once_per_session(spark, folder):
    """The first alert of each source and signature until an idle hour; state goes with the watermark."""
    at = places(spark, "once-per-session")
    with merged_locally(spark):
        for arrived in arrivals(spark, folder):
            packets = with_payload(packets_from_events(arrived), table(spark, folder, "documents"))
            alerts = jobs.matched_stream(packets, fx.rules(spark)).select("src_ip", "sid", "ts", "packet_id")
            once = jobs.once_per_session(alerts, ["src_ip", "sid"], idle=f"{HOUR} seconds")
            jobs.finish(jobs.append_table(once.select("src_ip", "sid", "packet_id", "alerts"), trigger=jobs.NOW, **at))
    return spark.read.parquet(at["out"])


@query(
    "stream_connection_sketches",
    f"with {HEADS}"
    + f"""
select {slot("us", 24 * HOUR)} as window_start, count(distinct (src_ip, dport)) as services
from heads where dport is not null group by 1""",
)
def stream_connection_sketches(spark, folder):
    """Different (source, port) pairs a day from hourly sketches that a stream has stored."""
    at = places(spark, "sketches")
    for arrived in arrivals(spark, folder, LATE):
        heads = packets_from_events(arrived).where("dport is not null")
        jobs.finish(jobs.start_sketches(heads, ["src_ip", "dport"], seconds=HOUR, trigger=jobs.NOW, **at))
    day = (F.col("window_start") - F.pmod("window_start", F.lit(24 * HOUR * 1_000_000))).alias("window_start")
    daily = rollup.merged_sketches(jobs.current(spark, at["out"], ["window_start"]), [day])
    return daily.select("window_start", rollup.sketch_estimate().alias("services"))
