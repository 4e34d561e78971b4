"""Common table expressions of the reference SQL (DuckDB dialect)."""

from __future__ import annotations

from packetloom.plans.fixtures import (
    EVENT_RULE_VALUES,
    INTEL_VALUES,
    RULE_VALUES,
    SERVICE_VALUES,
)

# Packet heads from events; `us` is the time in microseconds.
HEADS = """
heads as (
  select event_id as packet_id, us, ts, event_type,
    '10.0.' || cast(user_id // 256 as varchar) || '.' || cast(user_id % 256 as varchar) as src_ip,
    case when k = 0 then '192.168.1.100' when k = 1 then '185.220.101.1'
         when k < 10 then '45.146.164.' || cast(k as varchar)
         else '192.168.1.' || cast(k as varchar) end as dst_ip,
    case event_type when 'error' then 'icmp' when 'signup' then 'udp' else 'tcp' end as proto,
    case when event_type <> 'error' then cast(1024 + (event_id * 7919) % 64512 as int) end as sport,
    case when event_type <> 'error' then cast(case event_id % 8 when 0 then 80 when 1 then 443
      when 2 then 22 when 3 then 21 when 4 then 23 when 5 then 53 when 6 then 25
      else 8000 + user_id end as int) end as dport,
    cast(64 + floor(value * 20) as int) as packet_size
  from (select *, epoch_us(ts) as us, cast(json_extract_string(props, '$.k') as int) as k
        from events))"""

PACKETS = (
    HEADS
    + """,
packets as (
  select h.*, d.text as payload from heads h
  left join documents d on d.doc_id = h.packet_id % (select count(*) from documents))"""
)

RULES = f"""
rules as (
  select rule_key, rule_proto, sid, msg, coalesce(classtype, 'unknown') as rule_class,
         content, dsize_op, dsize_n
  from (values {RULE_VALUES.replace("cast(null as bigint)", "null").replace("cast(null as string)", "null")})
    t(rule_key, rule_proto, sid, msg, classtype, content, dsize_op, dsize_n))"""

INTEL = f"intel as (select * from (values {INTEL_VALUES}) t(indicator, kind))"
SERVICES = f"services as (select * from (values {SERVICE_VALUES}) t(port, service, risk))"
EVENT_RULES = f"event_rules as (select * from (values {EVENT_RULE_VALUES}) t(sid, msg, event_name))"


def matched(source: str) -> str:
    return f"""
matched as (
  select p.packet_id, p.us, p.ts, p.src_ip, p.dst_ip, p.sport, p.dport, p.packet_size,
         r.rule_proto as protocol, cast(r.rule_key as bigint) as rule_key, r.sid, r.msg, r.rule_class
  from {source} p join rules r
    on (lower(r.rule_proto) not in ('tcp', 'udp') or lower(r.rule_proto) = p.proto)
   and (r.dsize_op is null or (r.dsize_op = '>' and p.packet_size > r.dsize_n)
        or (r.dsize_op = '<' and p.packet_size < r.dsize_n))
   and (r.content is null or coalesce(contains(p.payload, r.content), false)))"""


def correlated(seconds: int) -> str:
    return f"""
marked as (
  select *, coalesce(us - lag(us, 4) over (partition by sid order by us, packet_id, rule_key)
                     < {seconds} * 1000000::bigint, false) as escalated,
    case when src_ip in (select indicator from intel where kind = 'ip') then 100 else 0 end
    + case when dst_ip in (select indicator from intel where kind = 'ip') then 100 else 0 end
      as intel_score
  from matched),
alerts as (
  select packet_id, us, ts, src_ip, dst_ip, sport, dport, packet_size, protocol, rule_key, sid,
         rule_class, escalated, intel_score,
         case when escalated then '[ESCALATED] ' || msg else msg end as msg,
         intel_score + case when escalated then 50 else 0 end as threat_score
  from marked)"""


BAND = """case when {0} > 100 then 'critical' when {0} > 50 then 'high'
  when {0} > 20 then 'medium' when {0} <= 20 then 'low' end"""

IP_NUMBER = """(split_part({0}, '.', 1)::bigint * 16777216 + split_part({0}, '.', 2)::bigint * 65536
  + split_part({0}, '.', 3)::bigint * 256 + split_part({0}, '.', 4)::bigint)"""


def full_alerts(seconds: int) -> str:
    return f"with {PACKETS}, {RULES}, {INTEL}, {matched('packets')}, {correlated(seconds)}"


def slot(us: str, seconds: int) -> str:
    """Start of the epoch-aligned window, in microseconds."""
    return f"({us} - {us} % ({seconds} * 1000000::bigint))"
