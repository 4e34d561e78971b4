"""Queries over rule options: flow, threshold, flowint, flowbits, noalert.

The rule lines are small fixed text; the packets they are applied to are the given tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.operators import flow_state, flows, match, rule_options
from packetloom.plans.registry import query
from packetloom.plans.sql_parts import HEADS
from packetloom.sources import rules as rule_source
from packetloom.sources.packets import packet_heads, table

# Rule lines of these queries.
FLOW_LINES = (
    'alert tcp any any -> any any (msg:"any side"; dsize:>60; sid:9300001;)',
    'alert tcp any any -> any any (msg:"to server"; flow:to_server; sid:9300002;)',
    'alert tcp any any -> any any (msg:"settled"; flow:established; dsize:>200; sid:9300003;)',
    'alert tcp any any -> any any (msg:"settled to client"; flow:established,to_client; sid:9300004;)',
    'alert tcp any any -> any any (msg:"opening"; flow:not_established,from_client; sid:9300005;)',
)
LIMIT_LINES = (
    'alert tcp any any -> any any (msg:"first two"; threshold:type limit, track by_src, count 2, seconds 3600; sid:9300011;)',
    'alert tcp any any -> any any (msg:"ever rarer"; threshold:type backoff, track by_dst, count 1, multiplier 10; sid:9300012;)',
    'alert udp any any -> any any (msg:"each fifth"; threshold:type threshold, track by_rule, count 5, seconds 86400; sid:9300013;)',
    'alert ip any any -> any any (msg:"third only"; dsize:>5000; threshold:type both, track by_src, count 3, seconds 86400; sid:9300014;)',
    'alert udp any any -> any any (msg:"all"; dsize:>6000; sid:9300015;)',
)
COUNT_LINES = (
    'alert tcp any any -> any any (msg:"big"; dsize:>6000; flowint:tcp.big.count,+,1; noalert; sid:9300021;)',
    'alert tcp any any -> any any (msg:"small"; dsize:<300; flowint:tcp.big.count,+,2; noalert; sid:9300022;)',
    'alert udp any any -> any any (msg:"told"; dsize:>4000; sid:9300023;)',
    'alert tcp any any -> any any (msg:"many"; dsize:>2000; flowbits:isnotset,tcp.told; flowint:tcp.big.count,>=,9; flowbits:set,tcp.told; sid:9300024;)',
)
BIT_LINES = (
    'alert tcp any any -> any any (msg:"long turn"; dsize:>900; flowbits:set,long.seen; noalert; sid:9300031;)',
    'alert tcp any any -> any any (msg:"short after long"; dsize:<150; flowbits:isset,long.seen; sid:9300032;)',
    'alert tcp any any -> any any (msg:"middle before long"; dsize:>250; flowbits:isnotset,long.seen; sid:9300033;)',
    'alert tcp any any -> any any (msg:"short ends it"; dsize:<100; flowbits:isset,long.seen; flowbits:unset,long.seen; sid:9300034;)',
    'alert tcp any any -> any any (msg:"turn"; flowint:turns,+,1; noalert; sid:9300035;)',
    'alert tcp any any -> any any (msg:"third turn"; dsize:>200; flowbits:isnotset,told; flowint:turns,>=,3; flowbits:set,told; sid:9300036;)',
    'alert tcp any any -> any any (msg:"untested"; dsize:>1500; flowint:unread,+,1; sid:9300037;)',
)
BACKOFF_LINES = (
    'alert tcp any any -> any any (msg:"rarer"; threshold:type backoff, track by_flow, count 1, multiplier 2; sid:9300041;)',
    'alert tcp any any -> any any (msg:"second"; dsize:>100; threshold:type backoff, track by_flow, count 2, multiplier 10; sid:9300042;)',
)


def option_rules(spark: SparkSession, lines: tuple[str, ...]) -> DataFrame:
    text = spark.createDataFrame([(x, "own.rules") for x in lines], "line string, rule_file string")
    return rule_options.with_behaviour(rule_source.rule_table(rule_source.parse_rules(text)))


@query(
    "rule_flow_match",
    """
with talk as (select * from conversations where role <> 'system'),
first as (select conv_id, arg_min(role, turn) as client from talk group by conv_id),
sides as (select conv_id, role, min(turn) as t from talk group by all),
both_from as (select conv_id, max(t) as t, count(*) as n from sides group by conv_id),
known as (select c.conv_id, c.turn, length(c.text) as size, c.role = f.client as to_server,
    b.n >= 2 and c.turn > b.t as settled
  from talk c join first f using (conv_id) join both_from b using (conv_id))
select conv_id, turn, '9300001' as sid from known where size > 60
union all select conv_id, turn, '9300002' from known where to_server
union all select conv_id, turn, '9300003' from known where settled and size > 200
union all select conv_id, turn, '9300004' from known where settled and not to_server
union all select conv_id, turn, '9300005' from known where not settled and to_server""",
)
def rule_flow_match(spark, folder):
    """Turns of conversations as packets of a flow, against rules with ``flow`` options."""
    talk = table(spark, folder, "conversations").where("role <> 'system'")
    sent = match.with_direction(talk, ["conv_id"], "role", ["turn"]).select(
        F.struct("conv_id", "turn").alias("packet_id"),
        F.lit(None).cast("timestamp").alias("ts"),
        F.col("role").alias("src_ip"),
        *[F.lit(None).cast(t).alias(c) for c, t in (("dst_ip", "string"), ("sport", "int"), ("dport", "int"))],
        F.lit("tcp").alias("proto"),
        F.length("text").alias("packet_size"),
        "direction",
        "established",
    )
    rules = option_rules(spark, FLOW_LINES)
    found = match.match_packets(sent, rules, residual=[rule_options.flow_matches()])
    return found.select("packet_id.*", "sid")


@query(
    "rule_threshold",
    f"with {HEADS}"
    + """
select packet_id, '9300011' as sid from heads where proto = 'tcp'
qualify row_number() over (partition by src_ip, us // 3600000000 order by us, packet_id) <= 2
union all select packet_id, sid from (select packet_id, '9300012' as sid,
    row_number() over (partition by dst_ip order by us, packet_id) as n from heads where proto = 'tcp')
  where n in (1, 10, 100, 1000, 10000, 100000)
union all select packet_id, sid from (select packet_id, '9300013' as sid,
    row_number() over (partition by us // 86400000000 order by us, packet_id) as n from heads where proto = 'udp')
  where n % 5 = 0
union all select packet_id, sid from (select packet_id, '9300014' as sid,
    row_number() over (partition by src_ip, us // 86400000000 order by us, packet_id) as n
    from heads where packet_size > 5000) where n = 3
union all select packet_id, '9300015' from heads where proto = 'udp' and packet_size > 6000""",
)
def rule_threshold(spark, folder):
    rules = option_rules(spark, LIMIT_LINES)
    alerts = match.match_packets(packet_heads(spark, folder), rules)
    return rule_options.limited(alerts, rules).select("packet_id", "sid")


COUNTED = """
, sums as (
  select packet_id, us, src_ip, packet_size,
    sum(case when packet_size > 6000 then 1 when packet_size < 300 then 2 else 0 end)
      over (partition by src_ip order by us, packet_id rows unbounded preceding) as total
  from heads where proto = 'tcp')"""


@query(
    "rule_flowint",
    f"with {HEADS} {COUNTED}"
    + """
select src_ip, '9300024' as sid, arg_min(packet_id, (us, packet_id)) as packet_id
from sums where total >= 9 and packet_size > 2000 group by src_ip""",
)
def rule_flowint(spark, folder):
    """The first packet of a source that its own rule matches once the counter has reached 9."""
    rules = option_rules(spark, COUNT_LINES)
    alerts = match.match_packets(packet_heads(spark, folder), rules)
    found = rule_options.noalert_removed(flow_state.evaluated(alerts, rules, ["src_ip"]), rules)
    return found.where("sid = '9300024'").select("src_ip", "sid", "packet_id")


# Turns of conversations as packets both ways. Two conversations share their ends, two hours
# apart, and each has a pause of 450 seconds before its fifth turn.
TALK = """
talk as (
  select conv_id * 1000 + turn as packet_id, role = 'user' as asks, conv_id // 2 as pair, length(text) as packet_size,
    (1700000000 + conv_id * 7200 + turn * 50 + (turn // 4) * 400) * 1000000::bigint as us
  from conversations where role <> 'system'),
gaps as (select *, us - lag(us) over (partition by pair order by us, packet_id) as gap from talk),
flows as (
  select *, max(case when gap is null or gap >= 180000000 then us end)
    over (partition by pair order by us, packet_id rows unbounded preceding) as start_us from gaps)"""


def talk_packets(spark: SparkSession, folder: str) -> DataFrame:
    talk = table(spark, folder, "conversations").where("role <> 'system'").selectExpr(
        "conv_id * 1000 + turn as packet_id",
        "timestamp_micros((1700000000 + conv_id * 7200 + turn * 50 + (turn div 4) * 400) * 1000000) as ts",
        "role = 'user' as asks",
        "concat('10.1.', conv_id div 512, '.', conv_id div 2 % 256) as client",
        "length(text) as packet_size",
    )
    own, other = F.struct(F.col("client").alias("ip"), F.lit(40000).alias("port")), F.struct(F.lit("192.0.2.7").alias("ip"), F.lit(443).alias("port"))
    sender, receiver = F.when(F.col("asks"), own).otherwise(other), F.when(F.col("asks"), other).otherwise(own)
    return talk.select(
        "packet_id", "ts", sender["ip"].alias("src_ip"), receiver["ip"].alias("dst_ip"), F.lit("tcp").alias("proto"),
        sender["port"].alias("sport"), receiver["port"].alias("dport"), "packet_size",
    )


@query(
    "flow_table",
    f"with {TALK}, opened as (select pair, start_us, arg_min(asks, (us, packet_id)) as first from flows group by all)"
    + """
select '10.1.' || (pair // 256) || '.' || (pair % 256) as client_ip, start_us, first as by_client, max(us) as last_us,
  count(*) filter (asks = first) as packets_to_server, count(*) filter (asks <> first) as packets_to_client,
  coalesce(sum(packet_size) filter (asks = first), 0)::bigint as bytes_to_server,
  coalesce(sum(packet_size) filter (asks <> first), 0)::bigint as bytes_to_client
from flows join opened using (pair, start_us) group by pair, start_us, first""",
)
def flow_table(spark, folder):
    """Flows of both directions, ended by 180 idle seconds."""
    found = flows.flow_table(flows.with_flow(talk_packets(spark, folder)))
    low = F.col("flow.end_a.ip")
    return found.select(
        low.alias("client_ip"), "flow.start_us", (F.col("client.ip") == low).alias("by_client"),
        F.unix_micros("last_ts").alias("last_us"), "packets_to_server", "packets_to_client", "bytes_to_server", "bytes_to_client",
    )


@query(
    "rule_flow_backoff",
    f"with {TALK}, "
    + """
numbered as (
  select packet_id, packet_size, row_number() over (partition by pair, start_us order by us, packet_id) as n,
    sum((packet_size > 100)::int) over (partition by pair, start_us order by us, packet_id rows unbounded preceding) as big
  from flows)
select packet_id, '9300041' as sid from numbered where n in (1, 2, 4, 8, 16)
union all select packet_id, '9300042' from numbered where packet_size > 100 and big in (2, 20)""",
)
def rule_flow_backoff(spark, folder):
    """Back-off per flow: packets of both directions count together, and anew after a pause."""
    rules = option_rules(spark, BACKOFF_LINES)
    alerts = match.match_packets(flows.with_flow(talk_packets(spark, folder)), rules, keep=["flow"])
    return rule_options.limited(alerts, rules).select("packet_id", "sid")


@query(
    "rule_flowbits",
    f"with recursive {TALK}, "
    + """
turns as (
  select packet_id, pair, start_us, packet_size as size,
    row_number() over (partition by pair, start_us order by us, packet_id) as n from flows),
run as (
  select pair, start_us, 0::bigint as n, null::bigint as packet_id, false as seen, 0 as turns, false as told,
    false as a2, false as a3, false as a4, false as a6, 0 as size
  from turns where n = 1
  union all
  select t.pair, t.start_us, t.n, t.packet_id,
    (r.seen or t.size > 900) and not (t.size < 100), r.turns + 1,
    r.told or (t.size > 200 and r.turns + 1 >= 3),
    t.size < 150 and (r.seen or t.size > 900), t.size > 250 and not (r.seen or t.size > 900),
    t.size < 100 and (r.seen or t.size > 900), t.size > 200 and not r.told and r.turns + 1 >= 3, t.size
  from run r join turns t on t.pair = r.pair and t.start_us = r.start_us and t.n = r.n + 1)
select packet_id, '9300032' as sid from run where a2
union all select packet_id, '9300033' from run where a3
union all select packet_id, '9300034' from run where a4
union all select packet_id, '9300036' from run where a6
union all select packet_id, '9300037' from run where size > 1500""",
)
def rule_flowbits(spark, folder):
    """Rules that set, unset and test bits and counters of a flow, in the order of its packets."""
    rules = option_rules(spark, BIT_LINES)
    alerts = match.match_packets(flows.with_flow(talk_packets(spark, folder)), rules, keep=["flow"])
    return rule_options.noalert_removed(flow_state.evaluated(alerts, rules), rules).select("packet_id", "sid")


@query(
    "noalert_alerts",
    f"with {HEADS} select packet_id, '9300023' as sid from heads where proto = 'udp' and packet_size > 4000",
)
def noalert_alerts(spark, folder):
    rules = option_rules(spark, COUNT_LINES[:3])
    alerts = match.match_packets(packet_heads(spark, folder), rules)
    return rule_options.noalert_removed(alerts, rules).select("packet_id", "sid")


# Rules that name upstream events by option.
EVENT_LINES = (
    'alert http any any -> any any (msg:"error reported"; app-layer-event:error; sid:9300051;)',
    'alert pkthdr any any -> any any (msg:"sign-up decoded"; decode-event:signup; sid:9300052;)',
    'alert tcp any any -> any any (msg:"purchase in stream"; stream-event:purchase; sid:9300053;)',
    'alert ip any any -> any any (msg:"bad sum"; ipv4-csum:invalid; sid:9300054;)',
    'alert ip any any -> any any (msg:"good sum"; ipv4-csum:valid; sid:9300055;)',
    'alert tcp any any -> any any (msg:"two names"; app-layer-event:error; stream-event:signup; sid:9300056;)',
    'alert tcp any any -> any any (msg:"no event"; dsize:>10; sid:9300057;)',
)


@query(
    "event_rules",
    """
with named as (select event_id, case when event_id % 50 = 0 then 'ipv4-csum' else event_type end as event_name from events)
select event_id, sid, msg from named join (values ('9300051', 'error reported', 'error'), ('9300052', 'sign-up decoded', 'signup'),
  ('9300053', 'purchase in stream', 'purchase'), ('9300054', 'bad sum', 'ipv4-csum'),
  ('9300056', 'two names', 'error'), ('9300056', 'two names', 'signup')) t(sid, msg, event_name) using (event_name)""",
)
def event_rules(spark, folder):
    """Upstream events, every fiftieth a failed checksum, against rules that name them by option."""
    events = table(spark, folder, "events")
    name = F.when(F.col("event_id") % 50 == 0, F.lit("ipv4-csum")).otherwise(F.col("event_type"))
    rules = match.event_rules(option_rules(spark, EVENT_LINES)).select("sid", "msg", "event_name")
    return match.match_events(events.select("event_id", name.alias("event_name")), rules).select("event_id", "sid", "msg")
