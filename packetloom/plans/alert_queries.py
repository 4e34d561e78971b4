"""Queries over alerts: matching, correlation, roll-ups, records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.functions.score import display_colour
from packetloom.functions.timing import epoch_us, from_epoch_us, ntz_epoch_us
from packetloom.operators import correlate, limits, lookup, match, rollup
from packetloom.operators.ordered import first_rows
from packetloom.plans import fixtures as fx
from packetloom.plans.detection import detect, severity_by_signature
from packetloom.plans.registry import query
from packetloom.plans.sql_parts import (
    BAND,
    EVENT_RULES,
    HEADS,
    PACKETS,
    RULES,
    full_alerts,
    matched,
)
from packetloom.session import scratch_path, written
from packetloom.sources import alert_store
from packetloom.sources.alert_store import alert_records
from packetloom.sources.packets import packet_heads, packets, table

HOUR = 3600


def scored_matches(spark: SparkSession, folder: str) -> DataFrame:
    """Alerts of all rules with their un-escalated score."""
    alerts = match.match_packets(packets(spark, folder), fx.rules(spark))
    return lookup.score_indicators(alerts, fx.intel(spark))


def detections(spark: SparkSession, folder: str) -> DataFrame:
    """The same alerts, written once and correlated."""
    alerts = written(scored_matches(spark, folder), "alerts")
    marked = correlate.mark_escalated(alerts, window_seconds=HOUR)
    return correlate.apply_escalation(marked.withColumn("threat_score", F.col("intel_score")))


def event_rows(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").withColumn("ts", from_epoch_us(ntz_epoch_us("ts")))


@query(
    "flagship_severity_by_sid",
    full_alerts(HOUR)
    + f"""
select {BAND.format("threat_score")} as severity, sid, count(*) as alerts,
  count(*) filter (escalated) as escalated, sum(threat_score)::bigint as score
from alerts group by all""",
)
def flagship_severity_by_sid(spark, folder):
    alerts = detect(packets(spark, folder), fx.rules(spark), fx.intel(spark), window_seconds=HOUR)
    return severity_by_signature(alerts)


@query(
    "rule_match",
    f"with {PACKETS}, {RULES}, {matched('packets')}"
    + """
select packet_id, sid, msg, protocol, rule_class, packet_size, src_ip, dst_ip from matched""",
)
def rule_match(spark, folder):
    return match.match_packets(packets(spark, folder), fx.rules(spark)).select(
        "packet_id", "sid", "msg", "protocol", "rule_class", "packet_size", "src_ip", "dst_ip"
    )


@query(
    "escalation",
    """
select event_id, event_type, coalesce(epoch_us(ts) - lag(epoch_us(ts), 4) over
  (partition by event_type order by ts, event_id) < 3600000000, false) as escalated
from events""",
)
def escalation(spark, folder):
    marked = correlate.mark_escalated(
        event_rows(spark, folder), "event_type", tie=["event_id"], window_seconds=HOUR
    )
    return marked.select("event_id", "event_type", "escalated")


@query(
    "sliding_count",
    """
select event_id, count(*) over (partition by event_type order by ts
    range between interval '3599.999999 seconds' preceding and current row)
  - count(*) over (partition by event_type, ts)
  + row_number() over (partition by event_type, ts order by event_id) as in_window
from events""",
)
def sliding_count(spark, folder):
    counted = correlate.sliding_count(
        event_rows(spark, folder),
        "event_type",
        tie=["event_id"],
        window_seconds=HOUR,
        slot_seconds=86_400,
    )
    return counted.select("event_id", "in_window")


ROLLUP_SQL = """
select count(*) as total_alerts, count(*) filter (threat_score > 100) as critical_alerts,
  count(*) filter (threat_score > 50 and threat_score <= 100) as high_alerts,
  count(*) filter (threat_score > 20 and threat_score <= 50) as medium_alerts,
  count(*) filter (threat_score <= 20) as low_alerts,
  cast(coalesce(trunc(avg(threat_score)), 0) as int) as threat_score
from alerts"""


@query("alert_severity", full_alerts(HOUR) + ROLLUP_SQL)
def alert_severity(spark, folder):
    return rollup.severity_rollup(detections(spark, folder))


@query(
    "avg_score",
    full_alerts(HOUR)
    + " select cast(coalesce(trunc(avg(threat_score)), 0) as int) as threat_score from alerts",
)
def avg_score(spark, folder):
    return rollup.mean_score(detections(spark, folder), "threat_score")


@query(
    "dashboard_stats",
    full_alerts(HOUR)
    + f""", stats as ({ROLLUP_SQL}),
volume as (select count(*) as packets_analyzed, sum(packet_size)::bigint as bytes_analyzed from heads),
loaded as (select count(*) as rules_loaded from rules)
select * from stats, volume, loaded""",
)
def dashboard_stats(spark, folder):
    """The stats record: alert roll-up with packet, byte and rule counts (three one-row sums)."""
    stats = rollup.severity_rollup(detections(spark, folder))
    heads = packet_heads(spark, folder)
    rules = fx.rules(spark)
    return stats.select(
        "*",
        heads.agg(F.count(F.lit(1))).scalar().alias("packets_analyzed"),
        heads.agg(F.sum("packet_size").cast("bigint")).scalar().alias("bytes_analyzed"),
        rules.agg(F.count(F.lit(1))).scalar().alias("rules_loaded"),
    )


@query(
    "last_n_alerts",
    full_alerts(HOUR)
    + """
select packet_id, rule_key, us, sid, msg, threat_score from alerts
order by us desc, packet_id desc, rule_key desc limit 100""",
)
def last_n_alerts(spark, folder):
    top = rollup.newest(
        detections(spark, folder), 100, ["ts", "packet_id", "rule_key"], oldest_first=True
    )
    return top.select(
        "packet_id", "rule_key", epoch_us(F.col("ts")).alias("us"), "sid", "msg", "threat_score"
    )


@query(
    "latest_intel",
    f"with {HEADS}"
    + """
select packet_id as id, us as timestamp_us, src_ip as ip_address, cast(null as varchar) as domain,
  proto as threat_type, packet_size % 101 as confidence, 'events' as source
from heads order by us desc, packet_id desc limit 100""",
)
def latest_intel(spark, folder):
    """The newest 100 rows of a threat-intel table filled from packet sources."""
    records = packet_heads(spark, folder).select(
        F.col("packet_id").alias("id"),
        F.col("ts").alias("timestamp"),
        F.col("src_ip").alias("ip_address"),
        F.lit(None).cast("string").alias("domain"),
        F.col("proto").alias("threat_type"),
        F.pmod("packet_size", F.lit(101)).alias("confidence"),
        F.lit("events").alias("source"),
    )
    newest = rollup.newest(records, 100, ["timestamp", "id"])
    return newest.withColumn("timestamp_us", epoch_us(F.col("timestamp"))).drop("timestamp")


@query(
    "bounded_history",
    full_alerts(HOUR)
    + """
select sid, packet_id, rule_key from alerts
qualify row_number() over (partition by sid order by us desc, packet_id desc, rule_key desc) <= 100""",
)
def bounded_history(spark, folder):
    order = [F.desc("ts"), F.desc("packet_id"), F.desc("rule_key")]
    return first_rows(detections(spark, folder), ["sid"], order, 100).select(
        "sid", "packet_id", "rule_key"
    )


@query(
    "alert_lookup",
    full_alerts(HOUR)
    + """
select packet_id, rule_key, sid, msg, threat_score, escalated
from alerts where packet_id = 38 and rule_key = 1""",
)
def alert_lookup(spark, folder):
    """One alert of the stored table by its key, which Spark pushes to the files."""
    path = scratch_path(spark, "alert-table")
    rows = alert_store.table_rows(
        alert_records(detections(spark, folder)), keep=("packet_id", "rule_key", "ts")
    )
    alert_store.append_table(rows, path, "ts")
    return rollup.alert_by_key(spark.read.parquet(path), packet_id=38, rule_key=1).select(
        "packet_id", "rule_key", "sid", "msg", "threat_score", "escalated"
    )


@query(
    "ip_score",
    full_alerts(HOUR)
    + """
select ip, sum(intel_score)::bigint as score, count(*) as alerts
from (select src_ip as ip, intel_score from alerts union all select dst_ip, intel_score from alerts)
group by ip""",
)
def ip_score(spark, folder):
    return correlate.ip_scores(scored_matches(spark, folder))


@query(
    "ip_running_score",
    full_alerts(HOUR)
    + """
select ip, packet_id, rule_key, side, sum(intel_score) over (partition by ip
    order by us, packet_id, rule_key, side rows unbounded preceding)::bigint as running_score
from (select src_ip as ip, 0 as side, us, packet_id, rule_key, intel_score from alerts
      union all select dst_ip, 1, us, packet_id, rule_key, intel_score from alerts)""",
)
def ip_running_score(spark, folder):
    alerts = written(scored_matches(spark, folder), "alerts")
    scored = correlate.running_ip_score(alerts, slot_seconds=86_400)
    return scored.select("ip", "packet_id", "rule_key", "side", "running_score")


@query(
    "top_offenders",
    full_alerts(HOUR)
    + """
select ip, sum(intel_score)::bigint as score, count(*) as alerts
from (select src_ip as ip, intel_score from alerts union all select dst_ip, intel_score from alerts)
group by ip order by score desc, ip limit 10""",
)
def top_offenders(spark, folder):
    return rollup.top_offenders(correlate.ip_scores(scored_matches(spark, folder)), 10)


@query(
    "active_signatures",
    full_alerts(HOUR) + " select count(distinct sid) as active_alerts from alerts",
)
def active_signatures(spark, folder):
    return rollup.active_signatures(scored_matches(spark, folder))


@query(
    "last_signatures",
    full_alerts(HOUR)
    + """
select sid, min(us) as first_us, strftime(max(ts), '%H:%M:%S') as latest,
  max(threat_score) as top_score, count(*) as alerts
from alerts group by sid order by first_us desc, sid desc limit 10""",
)
def last_signatures(spark, folder):
    return rollup.last_signatures(detections(spark, folder)).select(
        "sid", epoch_us(F.col("first_seen")).alias("first_us"), "latest", "top_score", "alerts"
    )


@query(
    "display_colour",
    full_alerts(HOUR)
    + """
select case when threat_score > 100 then 'red' when threat_score > 50 then 'yellow' else 'green' end
  as colour, count(*) as alerts from alerts group by colour""",
)
def colours(spark, folder):
    return (
        detections(spark, folder)
        .groupBy(display_colour(F.col("threat_score")).alias("colour"))
        .agg(F.count(F.lit(1)).alias("alerts"))
    )


RAW_JSON = """to_json({'sid': sid, 'msg': msg, 'src': src_ip, 'dst': dst_ip, 'sport': sport,
  'dport': dport, 'proto': protocol, 'threat_score': threat_score, 'escalated': escalated,
  'packet_size': packet_size, 'rule_class': rule_class})"""


@query(
    "alert_records",
    full_alerts(HOUR)
    + f"""
select packet_id, rule_key, sid, msg, src_ip, dst_ip, sport as src_port, dport as dst_port, protocol,
  threat_score, escalated, packet_size, rule_class, cast({RAW_JSON} as varchar) as raw_data
from alerts""",
)
def stored_alerts(spark, folder):
    records = alert_records(detections(spark, folder))
    return alert_store.table_rows(records, keep=("packet_id", "rule_key"))


@query(
    "alert_record_defaults",
    f"with {HEADS}"
    + """
select packet_id, '' as sid, '' as msg, src_ip, '' as dst_ip, sport as src_port, 0 as dst_port,
  '' as protocol, 0 as threat_score, false as escalated, packet_size, '' as rule_class,
  cast(to_json({'src': src_ip, 'sport': sport, 'packet_size': packet_size}) as varchar) as raw_data
from heads""",
)
def alert_record_defaults(spark, folder):
    """Records that lack most fields: missing ones take defaults, NULL ports stay NULL."""
    sparse = packet_heads(spark, folder).select(
        "packet_id", F.col("src_ip").alias("src"), "sport", "packet_size"
    )
    return alert_store.table_rows(sparse, keep=("packet_id",))


@query(
    "alert_ids",
    full_alerts(HOUR) + " select count(*) as alerts, count(*) as ids from alerts",
)
def alert_ids(spark, folder):
    """Every stored alert has an id of its own."""
    rows = alert_store.with_row_defaults(stored_alerts(spark, folder), "packet_id", "rule_key")
    return rows.agg(
        F.count("ingested_at").alias("alerts"), F.count_distinct("alert_id").alias("ids")
    )


@query(
    "alert_json_readback",
    full_alerts(HOUR)
    + """
select packet_id, rule_key, sid, src_ip as src, dport, threat_score, escalated from alerts""",
)
def alert_json_readback(spark, folder):
    rows = stored_alerts(spark, folder)
    return alert_store.read_back(rows).select(
        "packet_id",
        "rule_key",
        "record.sid",
        "record.src",
        "record.dport",
        "record.threat_score",
        "record.escalated",
    )


@query(
    "log_replay",
    full_alerts(HOUR)
    + """
select packet_id, rule_key, strftime(ts, '%Y-%m-%d %H:%M:%S,%g') as logged_at, 'INFO' as level,
  sid, msg, src_ip as src, dst_ip as dst, sport, dport, protocol as proto, threat_score, escalated,
  packet_size, rule_class
from alerts""",
)
def log_replay(spark, folder):
    records = alert_records(detections(spark, folder))
    fields = [f for f, *_ in alert_store.TABLE_COLUMNS]
    keep = ("packet_id", "rule_key")
    return alert_store.replay(alert_store.log_lines(records, fields, "ts", keep=keep), keep=keep)


@query(
    "event_rule_join",
    f"with {EVENT_RULES}"
    + """
select event_id, sid, msg from events e join event_rules r on e.event_type = r.event_name""",
)
def event_rule_join(spark, folder):
    events = table(spark, folder, "events").withColumnRenamed("event_type", "event_name")
    return match.match_events(events, fx.event_rules(spark)).select("event_id", "sid", "msg")


@query(
    "rate_limit",
    f"with {HEADS}"
    + """
select proto, packet_id from heads
qualify row_number() over (partition by proto, us // 3600000000 order by us, packet_id) <= 1""",
)
def rate_limit(spark, folder):
    heads = packet_heads(spark, folder)
    return limits.rate_limit(heads, ["proto"], seconds=HOUR, count=1).select("proto", "packet_id")


@query(
    "backoff",
    f"with {HEADS}"
    + """
select * from (select src_ip, packet_id,
    row_number() over (partition by src_ip order by us, packet_id) as occurrence from heads)
where occurrence in (1, 10, 100, 1000, 10000, 100000)""",
)
def backoff(spark, folder):
    heads = packet_heads(spark, folder)
    return limits.backoff(heads, ["src_ip"], count=1, multiplier=10).select(
        "src_ip", "packet_id", "occurrence"
    )


@query(
    "counter_threshold",
    f"with {HEADS}"
    + """
select src_ip, packet_id from heads where proto = 'icmp'
qualify row_number() over (partition by src_ip order by us, packet_id) = 10""",
)
def counter_threshold(spark, folder):
    heads = packet_heads(spark, folder)
    return limits.at_threshold(heads, ["src_ip"], F.col("proto") == "icmp", threshold=10).select(
        "src_ip", "packet_id"
    )


@query(
    "once_per_flow",
    full_alerts(HOUR)
    + """
select src_ip, sid, packet_id from alerts
qualify row_number() over (partition by src_ip, sid order by us, packet_id, rule_key) = 1""",
)
def once_per_flow(spark, folder):
    alerts = scored_matches(spark, folder)
    return limits.once_per(alerts, ["src_ip", "sid"], tie=("packet_id", "rule_key")).select(
        "src_ip", "sid", "packet_id"
    )


@query(
    "flow_counters",
    f"with {HEADS}"
    + """
select src_ip, proto || '.anomaly.count' as counter, count(*) as n
from heads where packet_size > 4000 group by all""",
)
def flow_counters(spark, folder):
    big = packet_heads(spark, folder).filter(F.col("packet_size") > 4000)
    counter = F.concat("proto", F.lit(".anomaly.count"))
    return limits.flow_counters(big, ["src_ip"], counter)
