"""Queries through the file sources: Spark writes derived files, the loaders read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from packetloom.plans import text_queries as texts
from packetloom.plans.registry import query
from packetloom.plans.sql_parts import HEADS, PACKETS
from packetloom.session import scratch_path
from packetloom.sources import intel as intel_source
from packetloom.sources import rules as rule_source
from packetloom.sources.packets import packet_heads, packets, read_packets, stream_packets, table
from packetloom.sources.signatures import signature_files, signatures
from packetloom.streaming import jobs


@query(
    "rule_files",
    f"with {texts.RULE_SQL}"
    + """
select coalesce(sid, '0') as sid, coalesce(classtype, 'unknown') as rule_class, rule_proto, content,
  count(*) as rules
from parsed group by all""",
)
def rule_files(spark, folder):
    """Rule text files, loaded as a catalog."""
    path = scratch_path(spark, "rule-files")
    lines = texts.part_rule_lines(spark, folder).select(F.col("line").alias("value"))
    lines.where("value is not null").write.text(path)
    loaded = rule_source.load_rules(spark, path, pattern="*.txt")
    return loaded.groupBy("sid", "rule_class", "rule_proto", "content").agg(F.count(F.lit(1)).alias("rules"))


@query(
    "intel_files",
    f"with {HEADS}"
    + f""",
ips as (select distinct src_ip as i from heads),
nets as (select distinct regexp_replace(src_ip, '[.][0-9]+$', '') as i from heads),
hosts as (select distinct {texts.HOST} as i from pages)
select 'ip' as kind, (select count(*) from ips) as indicators
union all select 'cidr', (select count(*) from nets)
union all select 'domain', (select count(*) from hosts where i <> '')""",
)
def intel_files(spark, folder):
    """Indicator files of addresses and domains, cleaned on loading."""
    path = scratch_path(spark, "intel-files")
    lines = texts.indicator_text(spark, folder)
    for kind in ("ip", "domain"):
        lines.where(F.col("kind") == kind).select(F.col("line").alias("value")).write.text(f"{path}/{kind}")
    return intel_source.indicator_counts(
        intel_source.load_indicators(spark, f"{path}/ip", f"{path}/domain")
    )


@query(
    "signature_texts",
    """
select 'part_' || p_partkey as name, p_size::varchar as size,
  case p_partkey % 3 when 0 then 2 when 1 then 3 else 1 end as k, 3 as strings
from part""",
)
def signature_texts(spark, folder):
    """Signature files read whole and parsed."""
    path = scratch_path(spark, "signature-files")
    table(spark, folder, "part").select(F.expr(texts.SIGNATURE_TEXT).alias("value")).write.text(path)
    found = signatures(signature_files(spark, path, pattern="*.txt"))
    return found.select("name", F.col("meta")["size"].alias("size"), "k", F.size("strings").alias("strings"))


@query(
    "stored_intel",
    f"with {HEADS}"
    + """
select packet_id as id, us as timestamp_us, src_ip as ip_address, proto as threat_type,
  packet_size % 101 as confidence, 'events' as source
from heads where packet_size % 101 >= 90""",
)
def stored_intel(spark, folder):
    """The stored threat-intel table, filtered at the scan."""
    path = scratch_path(spark, "intel-table")
    packet_heads(spark, folder).select(
        F.col("packet_id").alias("id"),
        F.col("ts").alias("timestamp"),
        F.col("src_ip").alias("ip_address"),
        F.lit(None).cast("string").alias("domain"),
        F.col("proto").alias("threat_type"),
        F.pmod("packet_size", F.lit(101)).cast("int").alias("confidence"),
        F.lit("events").alias("source"),
    ).write.parquet(path)
    stored = intel_source.threat_intel_table(spark, path).where("confidence >= 90")
    return stored.select(
        "id", F.unix_micros("timestamp").alias("timestamp_us"), "ip_address", "threat_type", "confidence", "source"
    )


PACKET_FILE_SQL = f"""with {PACKETS}
select proto, count(*) as packets, sum(packet_size)::bigint as bytes, count(payload) as with_payload,
  sum(length(payload))::bigint as chars
from packets group by proto"""


def _packet_files(spark, folder: str) -> str:
    path = scratch_path(spark, "packet-files")
    packets(spark, folder).withColumn("payload", F.encode("payload", "UTF-8")).write.parquet(path)
    return path


def _summed(found):
    return found.groupBy("proto").agg(
        F.count(F.lit(1)).alias("packets"),
        F.sum("packet_size").cast("bigint").alias("bytes"),
        F.count("payload").alias("with_payload"),
        F.sum(F.length("payload")).cast("bigint").alias("chars"),
    )


@query("packet_files", PACKET_FILE_SQL)
def packet_files(spark, folder):
    """Packet files with binary payloads, read as records with text payloads."""
    return _summed(read_packets(spark, _packet_files(spark, folder)))


@query("packet_file_stream", PACKET_FILE_SQL)
def packet_file_stream(spark, folder):
    base = scratch_path(spark, "packet-stream")
    arrived = stream_packets(spark, _packet_files(spark, folder), maxFilesPerTrigger="2")
    jobs.finish(jobs.append_table(arrived, work=f"{base}/work", out=f"{base}/out", trigger=jobs.NOW))
    return _summed(spark.read.parquet(f"{base}/out"))
