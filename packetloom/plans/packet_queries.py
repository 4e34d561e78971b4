"""Queries over packets: baselines, indicators, topology, traffic, detections."""

from __future__ import annotations

from pyspark.sql import functions as F

from packetloom.functions.net import ip_number, is_ipv4
from packetloom.functions.timing import epoch_us
from packetloom.operators import anomaly, correlate, detect, head_index, lookup, match, rollup
from packetloom.plans import fixtures as fx
from packetloom.plans.registry import query
from packetloom.plans.sql_parts import (
    BAND,
    HEADS,
    INTEL,
    IP_NUMBER,
    PACKETS,
    SERVICES,
    slot,
)
from packetloom.sources.packets import ipv4_only, packet_heads, packets, table

HOUR, DAY = 3600, 86_400


@query(
    "ipv4_gate",
    """
select n, count(*) as packets from (select c_nationkey as n from customer where c_nationkey <> 0)
group by n""",
)
def ipv4_gate(spark, folder):
    """Customers as endpoints; those of nation 0 have IPv6 addresses and are left out."""
    ends = table(spark, folder, "customer").select(
        F.col("c_nationkey").alias("n"),
        F.when(F.col("c_nationkey") == 0, F.concat(F.lit("fe80::"), F.col("c_custkey").cast("string")))
        .otherwise(F.concat(F.lit("10.1.0."), F.pmod("c_custkey", F.lit(256)).cast("string")))
        .alias("src_ip"),
    )
    gated = ipv4_only(ends.withColumn("dst_ip", F.lit("10.0.0.1")))
    return gated.groupBy("n").agg(F.count(F.lit(1)).alias("packets"))


@query(
    "port_frequency",
    f"with {HEADS}"
    + """
select port, count(*) as sightings
from (select sport as port from heads union all select dport from heads)
where port is not null group by port""",
)
def port_frequency(spark, folder):
    return anomaly.port_frequency(packet_heads(spark, folder))


@query(
    "protocol_counts",
    f"with {HEADS} select proto, count(*) as packets from heads where proto in ('tcp', 'udp') group by proto",
)
def protocol_counts(spark, folder):
    return anomaly.protocol_frequency(packet_heads(spark, folder))


@query(
    "traffic_volume",
    f"with {HEADS} select count(*) as packets, sum(packet_size)::bigint as bytes from heads",
)
def traffic_volume(spark, folder):
    return anomaly.traffic_volume(packet_heads(spark, folder))


UNUSUAL = """
ports as (select packet_id, us, 0 as slot, sport as port from heads where sport is not null
  union all select packet_id, us, 1, dport from heads where dport is not null),
seen as (select *, count(*) over (partition by port order by us, packet_id, slot
  rows unbounded preceding) as sightings from ports)"""


@query(
    "unusual_port",
    f"with {HEADS}, {UNUSUAL}"
    + """
select packet_id, port, sightings, 'Unusual port ' || port || ' usage detected' as description
from seen where slot = 1 and sightings < 5""",
)
def unusual_port(spark, folder):
    return anomaly.unusual_ports(packet_heads(spark, folder)).select(
        "packet_id", "port", "sightings", "description"
    )


@query(
    "large_transfer",
    """
select l_orderkey, l_linenumber, 'large_transfer' as type, 'high' as severity,
  'Large data transfer detected: ' || cast(floor(l_extendedprice * 20) as bigint) || ' bytes'
    as description
from lineitem where floor(l_extendedprice * 20) > 1000000""",
)
def large_transfer(spark, folder):
    """Order lines as transfers of 20 bytes per unit of price, default limit."""
    lines = table(spark, folder, "lineitem").withColumn(
        "bytes", F.floor(F.col("l_extendedprice") * 20).cast("bigint")
    )
    return anomaly.large_transfers(lines, size="bytes", keep=("l_orderkey", "l_linenumber"))


@query(
    "anomalies",
    f"with {HEADS}, {UNUSUAL}"
    + """
select packet_id, 'unusual_port' as type, 'medium' as severity,
  'Unusual port ' || port || ' usage detected' as description
from seen where slot = 1 and sightings < 5
union all
select packet_id, 'large_transfer', 'high',
  'Large data transfer detected: ' || packet_size || ' bytes'
from heads where packet_size > 8000""",
)
def anomalies(spark, folder):
    return anomaly.anomalies(packet_heads(spark, folder), limit_bytes=8000).drop("ts")


IN_INTEL = "case when {0} in (select indicator from intel where kind = 'ip') then 100 else 0 end"


@query(
    "ip_intel",
    f"with {HEADS}, {INTEL}"
    + f"""
select packet_id, {IN_INTEL.format("src_ip")} + {IN_INTEL.format("dst_ip")} as intel_score from heads""",
)
def ip_intel(spark, folder):
    return lookup.score_indicators(packet_heads(spark, folder), fx.intel(spark)).select(
        "packet_id", "intel_score"
    )


@query(
    "cidr_intel",
    f"with {HEADS}, {INTEL}"
    + f"""
select dst_ip as ip, count(*) as packets from heads
where {IP_NUMBER.format("dst_ip")} between {IP_NUMBER.format("'45.146.164.0'")}
  and {IP_NUMBER.format("'45.146.164.255'")} group by dst_ip""",
)
def cidr_intel(spark, folder):
    ranges = fx.intel(spark).filter(F.col("kind") == "cidr")
    heads = packet_heads(spark, folder)
    counts = heads.groupBy(F.col("dst_ip").alias("ip")).agg(F.count(F.lit(1)).alias("packets"))
    return lookup.in_ranges(counts, "ip", ranges).filter("in_range").drop("in_range")


@query(
    "hash_intel",
    f"with {PACKETS}"
    + """
select md5(payload) as digest, count(*) as packets from packets
where md5(payload) in (select md5(text) from documents join labels using (doc_id) where toxic = 1)
group by digest""",
)
def hash_intel(spark, folder):
    """Packets that carry the text of a document labelled toxic, by content digest."""
    bad = table(spark, folder, "labels").filter("toxic = 1").select("doc_id")
    hashes = (
        table(spark, folder, "documents")
        .join(bad, "doc_id", "left_semi")
        .select(F.md5(F.col("text").cast("binary")).alias("indicator"))
    )
    digest = F.md5(F.col("payload").cast("binary"))
    return (
        lookup.hash_hits(packets(spark, folder), digest, hashes)
        .groupBy("digest")
        .agg(F.count(F.lit(1)).alias("packets"))
    )


@query(
    "allow_block",
    f"with {HEADS}"
    + """
select packet_id, dst_ip from heads
where dst_ip in (select dst_ip from heads where packet_size > 6000)
  and dst_ip not in (select dst_ip from heads group by dst_ip having avg(packet_size) < 1050)""",
)
def allow_block(spark, folder):
    """Block hosts that get big packets, unless their packets are small on average."""
    heads = packet_heads(spark, folder)
    block = heads.filter("packet_size > 6000").select(F.col("dst_ip").alias("indicator")).distinct()
    allow = (
        heads.groupBy(F.col("dst_ip").alias("indicator"))
        .agg(F.avg("packet_size").alias("mean"))
        .filter("mean < 1050")
    )
    return lookup.blocked_unless_allowed(heads, "dst_ip", block, allow).select("packet_id", "dst_ip")


@query(
    "geo_threats",
    f"with {HEADS}"
    + f""",
located as (select coalesce(n_name, 'UNKNOWN') as country from heads left join nation
  on ({IP_NUMBER.format("src_ip")} - 167772160) // 16 = n_nationkey)
select country, count(*) as alerts from located group by country""",
)
def geo_threats(spark, folder):
    low = F.lit(167772160) + F.col("n_nationkey").cast("bigint") * 16
    blocks = table(spark, folder, "nation").select(
        low.alias("lo"), (low + 15).alias("hi"), F.col("n_name").alias("country")
    )
    counts = packet_heads(spark, folder).groupBy("src_ip").agg(F.count(F.lit(1)).alias("alerts"))
    return rollup.by_country(lookup.with_country(counts, "src_ip", blocks), "alerts")


@query(
    "exposure",
    f"with {HEADS}, {SERVICES}"
    + """
select distinct dst_ip as host, port, service, risk from heads join services on dport = port""",
)
def exposure(spark, folder):
    return lookup.exposure_report(packet_heads(spark, folder), fx.services(spark))


@query(
    "service_mix",
    f"with {HEADS}, {SERVICES}"
    + """
select coalesce(service, 'OTHER') as service, count(*) as packets
from heads left join services on dport = port group by 1""",
)
def service_mix(spark, folder):
    return rollup.service_mix(packet_heads(spark, folder), fx.services(spark))


@query(
    "topology_edges",
    f"with {HEADS}"
    + f""",
edges as (select src_ip, dst_ip, count(*) as packets, sum(packet_size)::bigint as bytes,
  max(us) as last_us from heads group by all)
select src_ip, dst_ip, packets, bytes, last_us,
  case ntile(3) over (order by bytes, {IP_NUMBER.format("src_ip")}, {IP_NUMBER.format("dst_ip")})
    when 3 then 'high' when 2 then 'medium' else 'low' end as traffic
from edges""",
)
def topology_edges(spark, folder):
    edges = rollup.topology_edges(packet_heads(spark, folder))
    return edges.withColumn("last_us", epoch_us(F.col("last_seen"))).drop("last_seen")


@query(
    "topology_nodes",
    f"with {HEADS}, {INTEL}"
    + f""",
scored as (select src_ip, dst_ip, {IN_INTEL.format("src_ip")} + {IN_INTEL.format("dst_ip")} as s from heads),
ends as (select src_ip as ip, dst_ip as peer, s from scored union all select dst_ip, src_ip, s from scored)
select ip, count(distinct peer) as degree, max(s) as top_score, {BAND.format("max(s)")} as threat_level
from ends group by ip""",
)
def topology_nodes(spark, folder):
    return rollup.topology_nodes(
        lookup.score_indicators(packet_heads(spark, folder), fx.intel(spark))
    )


@query(
    "peer_sets",
    f"with {HEADS} select src_ip, dst_ip as peer, count(*) as packets from heads group by all",
)
def peer_sets(spark, folder):
    return rollup.peers(packet_heads(spark, folder))


@query(
    "rate_per_window",
    f"with {HEADS}"
    + f"""
select {slot("us", HOUR)} as window_start, count(*) as packets, sum(packet_size)::bigint as bytes,
  round(count(*)::double / 3600.0::double, 9) as packets_per_s,
  round(sum(packet_size)::double * 8 / 3600.0::double / 1e6, 9) as mbit_per_s
from heads group by 1""",
)
def rate_per_window(spark, folder):
    rates = rollup.traffic_rate(packet_heads(spark, folder), HOUR)
    return rates.withColumn("packets_per_s", F.round("packets_per_s", 9)).withColumn(
        "mbit_per_s", F.round("mbit_per_s", 9)
    )


@query(
    "active_connections",
    f"with {HEADS}"
    + f"""
select {slot("us", HOUR)} as window_start, count(*) as connections
from (select distinct {slot("us", HOUR)} as us, src_ip, dst_ip, sport, dport, proto from heads)
group by 1""",
)
def active_connections(spark, folder):
    return rollup.active_connections(packet_heads(spark, folder), HOUR)


@query(
    "port_scan",
    f"with {HEADS}"
    + f"""
select src_ip, {slot("us", DAY)} as window_start, count(distinct dport) as ports
from heads where dport is not null group by all having count(distinct dport) >= 3""",
)
def port_scan(spark, folder):
    return detect.port_scans(packet_heads(spark, folder), seconds=DAY, min_ports=3)


@query(
    "brute_force",
    f"with {HEADS}"
    + f"""
select src_ip, dport, {slot("us", DAY)} as window_start, count(*) as attempts
from heads where dport in (21, 22, 23, 25) group by all having count(*) >= 3""",
)
def brute_force(spark, folder):
    return detect.brute_force(packet_heads(spark, folder), seconds=DAY, min_attempts=3)


@query(
    "exfiltration",
    f"with {HEADS}"
    + f"""
select src_ip, {slot("us", DAY)} as window_start, sum(packet_size)::bigint as bytes
from heads group by all having sum(packet_size) > 8000""",
)
def exfiltration(spark, folder):
    return detect.exfiltration(packet_heads(spark, folder), seconds=DAY, limit_bytes=8000)


@query(
    "beaconing",
    f"with {HEADS}"
    + """,
gaps as (select src_ip, (us - lag(us) over (partition by src_ip order by us, packet_id))::double / 1e6 as gap
  from heads)
select src_ip, count(gap) as gaps, round(stddev_pop(gap) / avg(gap), 4) as variation
from gaps group by src_ip having count(gap) >= 10 and stddev_pop(gap) / avg(gap) <= 0.95""",
)
def beaconing(spark, folder):
    found = detect.beacons(
        packet_heads(spark, folder), ["src_ip"], min_gaps=10, max_variation=0.95
    )
    return found.select("src_ip", "gaps", F.round("variation", 4).alias("variation"))


@query(
    "volume_zscore",
    f"with {HEADS}"
    + f""",
days as (select proto, {slot("us", DAY)} as window_start, sum(packet_size)::bigint as bytes
  from heads group by all)
select proto, window_start, bytes, round((bytes - avg(bytes) over p) / stddev_pop(bytes) over p, 6) as z
from days window p as (partition by proto)
qualify abs((bytes - avg(bytes) over p) / stddev_pop(bytes) over p) >= 1.5""",
)
def volume_zscore(spark, folder):
    found = detect.volume_outliers(packet_heads(spark, folder), ["proto"], seconds=DAY, min_z=1.5)
    return found.withColumn("z", F.round("z", 6))


@query(
    "flow_sessions",
    f"with {HEADS}"
    + """,
flagged as (select *, case when us - lag(us) over (partition by src_ip order by us, packet_id)
    < 3600000000 then 0 else 1 end as fresh from heads),
numbered as (select *, sum(fresh) over (partition by src_ip order by us, packet_id
    rows unbounded preceding) as session from flagged)
select src_ip, min(us) as start_us, max(us) as last_us, count(*) as packets,
  sum(packet_size)::bigint as bytes
from numbered group by src_ip, session""",
)
def flow_sessions(spark, folder):
    return detect.sessions(packet_heads(spark, folder), ["src_ip"], idle_seconds=HOUR)


@query(
    "activity_feed",
    f"with {HEADS}, {INTEL}"
    + f"""
select packet_id, src_ip, dst_ip, proto, packet_size,
  {IN_INTEL.format("src_ip")} + {IN_INTEL.format("dst_ip")} as intel_score
from heads where us >= (select max({slot("us", HOUR)}) from heads)""",
)
def activity_feed(spark, folder):
    scored = lookup.score_indicators(packet_heads(spark, folder), fx.intel(spark))
    return detect.activity_feed(scored, seconds=HOUR).select(
        "packet_id", "src_ip", "dst_ip", "proto", "packet_size", "intel_score"
    )


_SRC, _DST = IP_NUMBER.format("src_ip"), IP_NUMBER.format("dst_ip")


@query(
    "header_match",
    f"with {HEADS}"
    + f""",
numbered as (select *, {_SRC} - 167772160 as s, {_DST} as d,
  {_DST} between {IP_NUMBER.format("'45.146.164.0'")} and {IP_NUMBER.format("'45.146.164.255'")} as bad
  from heads)
select packet_id, '9200001' as sid from numbered
where proto = 'tcp' and (s between 0 and 31 or s between 64 and 95)
  and (dport in (80, 443) or dport between 8000 and 8009)
union all
select packet_id, '9200002' from numbered
where s not between 0 and 63 and sport between 1024 and 20000 and bad
union all
select packet_id, '9200003' from numbered
where proto = 'udp' and dst_ip <> '192.168.1.100'
  and d between {IP_NUMBER.format("'192.168.1.0'")} and {IP_NUMBER.format("'192.168.1.127'")}
  and dport not in (80, 443)
union all
select packet_id, '9200004' from numbered
where proto = 'tcp' and s in (1, 2) and sport >= 60000 and not bad and dport <= 1023""",
)
def header_match(spark, folder):
    rules = match.with_head_ranges(fx.head_rules(spark), fx.VARIABLES)
    heads = match.with_address_numbers(packet_heads(spark, folder))
    hits = head_index.match_heads(heads, rules)
    return hits.select("packet_id", "sid")


@query(
    "flow_direction",
    """
with first as (select conv_id, arg_min(role, turn) as client from conversations
  where role <> 'system' group by conv_id),
sides as (select conv_id, role, min(turn) as t from conversations where role <> 'system' group by all),
both_from as (select conv_id, max(t) as t, count(*) as n from sides group by conv_id)
select c.conv_id, c.turn, c.role, case when c.role = f.client then 'to_server' else 'to_client' end
  as direction, b.n >= 2 and c.turn > b.t as established
from conversations c join first f using (conv_id) join both_from b using (conv_id)
where c.role <> 'system'""",
)
def flow_direction(spark, folder):
    """Conversations as flows: the first role that is not ``system`` is the client."""
    talk = table(spark, folder, "conversations").filter("role <> 'system'")
    return match.with_direction(talk, ["conv_id"], "role", ["turn"]).select(
        "conv_id", "turn", "role", "direction", "established"
    )


@query(
    "endpoint_union",
    f"with {HEADS}"
    + """
select ip, count(*) as packets from
  (select src_ip as ip from heads union all select dst_ip from heads) group by ip""",
)
def endpoint_union(spark, folder):
    ends = packet_heads(spark, folder).select("src_ip", "dst_ip")
    return (
        correlate.endpoints(ends, ["src_ip", "dst_ip"], "ip")
        .groupBy("ip")
        .agg(F.count(F.lit(1)).alias("packets"))
    )


@query(
    "address_numbers",
    f"with {HEADS} select distinct src_ip as ip, {IP_NUMBER.format('src_ip')} as number from heads",
)
def address_numbers(spark, folder):
    ips = packet_heads(spark, folder).select(F.col("src_ip").alias("ip")).distinct()
    return ips.filter(is_ipv4(F.col("ip"))).withColumn("number", ip_number(F.col("ip")))
