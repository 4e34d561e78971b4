"""Packet x rule matching as an equi-join with a residual.

A rule for ``tcp`` or ``udp`` needs that protocol; any other rule protocol
accepts every packet. Each rule is therefore listed once per packet class it
accepts, and packets join on their class, with content and size as residual
conditions. Spark broadcasts a small catalog. For a large one each class is spread over
several keys, at as many listings of a rule; rules with contents are better found
by ``match_contents``, rules with narrow heads by ``head_index``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.functions.net import IPV4_PATTERN, ip_number
from packetloom.operators.ordered import attach
from packetloom.operators.string_index import occurring
from packetloom.sources.rules import resolve_variables

CLASSES = ("tcp", "udp", "other")
#: Rules up to which a catalog counts as small, and the most keys a class is dealt over.
BROADCAST_RULES, MOST_SPREAD = 5000, 256


def packet_class(proto: Column) -> Column:
    p = F.lower(proto)
    return F.when(p == "tcp", 0).when(p == "udp", 1).otherwise(2)


def rule_classes(proto: Column) -> Column:
    p = F.lower(proto)
    return (
        F.when(p == "tcp", F.array(F.lit(0)))
        .when(p == "udp", F.array(F.lit(1)))
        .otherwise(F.array(F.lit(0), F.lit(1), F.lit(2)))
    )


def content_matches(payload: Column, content: Column) -> Column:
    """Case-sensitive substring; rules without content pass, packets without payload fail."""
    return content.isNull() | F.coalesce(F.contains(payload, content), F.lit(False))


def size_matches(size: Column, op: Column, n: Column) -> Column:
    return op.isNull() | ((op == ">") & (size > n)) | ((op == "<") & (size < n))


def rule_listing(rules: DataFrame, spread: int = 1) -> DataFrame:
    """One row per rule and class it accepts, times the spread number."""
    meets = rule_classes(F.col("rule_proto"))
    if spread > 1:
        meets = F.flatten(
            F.transform(meets, lambda c: F.sequence(c * spread, c * spread + (spread - 1)))
        )
    return rules.select("*", F.explode(meets).alias("_rule_meet"))


def match_packets(
    packets: DataFrame,
    rules: DataFrame,
    *,
    residual: Sequence[Column] = (),
    spread: int | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """One alert per packet and matching rule.

    ``rules`` has the columns of ``sources.rules.rule_table``. Alerts are narrow:
    packet head, rule key, sid, msg, class and the packet columns to ``keep``, such as
    its flow; the payload is left behind. Packets
    without a payload column match no rule with content. Extra ``residual`` conditions
    may use any column of both sides. ``spread`` is over how many keys each class is dealt;
    by default that follows from the number of rules.
    """
    spread = spread_of(rules) if spread is None else spread
    listed = rule_listing(rules, spread)
    meet = packet_class(F.col("proto"))
    if spread > 1:
        meet = meet * spread + F.pmod(F.xxhash64("packet_id"), F.lit(spread)).cast("int")
    keyed = packets.withColumn("_meet", meet)
    on = (F.col("_meet") == F.col("_rule_meet")) & size_matches(
        F.col("packet_size"), F.col("dsize_op"), F.col("dsize_n")
    )
    for condition in residual:
        on = on & condition
    payload = F.col("payload") if "payload" in packets.columns else F.lit(None).cast("string")
    on = on & content_matches(payload, F.col("content"))
    return keyed.join(listed, on).select(*alert_columns(keep))


def alert_columns(keep: Sequence[str] = ()) -> list[Column]:
    """Columns of an alert: the packet's head, the rule's key, sid, msg and class."""
    head = ("packet_id", "ts", "src_ip", "dst_ip", "sport", "dport")
    rule = ("packet_size", "rule_key", "sid", "msg", "rule_class")
    return [F.col(c) for c in head] + [F.col("rule_proto").alias("protocol")] + [F.col(c) for c in (*rule, *keep)]


def spread_of(rules: DataFrame) -> int:
    """Keys per class: one for a catalog that is broadcast anyway, else one per 1,000 rules."""
    count = rules.count()
    return 1 if count <= BROADCAST_RULES else min(-(-count // 1000), MOST_SPREAD)


def match_contents(
    packets: DataFrame, rules: DataFrame, *, residual: Sequence[Column] = (), keep: Sequence[str] = ()
) -> DataFrame:
    """:func:`match_packets` for catalogs with very many contents.

    Rules without content are matched as there. The others meet only packets whose payload has
    their content's rarest run of characters. ``packet_id`` must tell packets apart.
    """
    plain = match_packets(packets, rules.where("content is null"), residual=residual, keep=keep)
    if "payload" not in packets.columns:
        return plain
    proto = F.lower(F.col("rule_proto"))
    on = [
        ~proto.isin("tcp", "udp") | (proto == F.lower("proto")),
        size_matches(F.col("packet_size"), F.col("dsize_op"), F.col("dsize_n")),
        *residual,
    ]
    wanted = rules.where("content is not null")
    hits = occurring(packets, wanted, text="payload", string="content", on=on, keys=["packet_id"])
    return plain.unionByName(hits.select(*alert_columns(keep)))


# --- rule heads: addresses and ports -----------------------------------------------


def fill_variables(spec: Column, variables: Mapping[str, str]) -> Column:
    """Replace ``$NAME`` by the values of a variable table."""
    resolved = resolve_variables(variables)
    for name in sorted(resolved, key=len, reverse=True):
        spec = F.replace(spec, F.lit(f"${name}"), F.lit(resolved[name]))
    return spec


def _terms(spec: str) -> str:
    """SQL: terms of a spec column as array of (text, negated), lists flattened.

    ``![a,b]`` negates each listed term. The text is cut at every ``![``; in a
    later piece the terms up to its ``]`` are the negated ones.
    """

    def listed(text: str, negated: str) -> str:
        return f"""transform(
          filter(split(translate({text}, '[]', ''), ','), w -> w <> ''),
          w -> named_struct('text', ltrim('!', w), 'negated', startswith(w, '!') <> {negated}))"""

    pieces = rf"split(regexp_replace({spec}, r'\s+', ''), r'!\[')"
    rest = "if(instr(p, ']') > 0, substr(p, instr(p, ']') + 1), '')"
    return f"""flatten(transform({pieces}, (p, i) -> if(i = 0,
        {listed("p", "false")},
        concat({listed("substring_index(p, ']', 1)", "true")}, {listed(rest, "false")}))))"""


def address_ranges(spec: str) -> Column:
    """Address spec column → array of (lo, hi, negated); unreadable terms get NULL limits."""
    read = f"""transform({_terms(spec)}, t -> named_struct(
        'negated', t.negated, 'whole', lower(t.text) = 'any',
        'base', if(substring_index(t.text, '/', 1) rlike r'{IPV4_PATTERN}',
          aggregate(split(substring_index(t.text, '/', 1), r'\\.'), 0L,
                    (n, o) -> n * 256 + cast(o as bigint)), null),
        'bits', if(instr(t.text, '/') > 0, try_cast(substring_index(t.text, '/', -1) as int), 32)))"""
    size = "cast(pow(2.0, 32 - r.bits) as bigint)"
    return F.expr(f"""transform({read}, r -> named_struct(
        'lo', if(r.whole, 0L, r.base - r.base % {size}),
        'hi', if(r.whole, 4294967295L, r.base - r.base % {size} + {size} - 1),
        'negated', r.negated))""")


def port_ranges(spec: str) -> Column:
    """Port spec column (``any``, ``n``, ``lo:hi``, ``lo:``, ``:hi``) → array of
    (lo, hi, negated)."""
    open_low = "lower(t.text) = 'any' or startswith(t.text, ':')"
    open_high = "lower(t.text) = 'any' or endswith(t.text, ':')"
    return F.expr(f"""transform({_terms(spec)}, t -> named_struct(
        'lo', if({open_low}, 0L, try_cast(substring_index(t.text, ':', 1) as bigint)),
        'hi', if({open_high}, 65535L, try_cast(substring_index(t.text, ':', -1) as bigint)),
        'negated', t.negated))""")


def in_ranges(value: str, ranges: str) -> str:
    """SQL: in one of the plain ranges (or there are none) and in no negated one.

    A NULL value, such as a missing port, meets only a spec of bare ``any``.
    """
    inside = f"{value} between r.lo and r.hi"
    return f"""if({value} is null,
        exists({ranges}, r -> not r.negated and r.lo = 0 and r.hi >= 65535)
          and not exists({ranges}, r -> r.negated),
        coalesce((exists({ranges}, r -> not r.negated and {inside})
                  or not exists({ranges}, r -> not r.negated))
                 and not exists({ranges}, r -> r.negated and {inside}), false))"""


HEAD_SPECS = ("src", "sport", "dst", "dport")


def with_head_ranges(rules: DataFrame, variables: Mapping[str, str] | None = None) -> DataFrame:
    """Rules with their four head specs as range arrays."""
    filled = rules.withColumns(
        {f"_{h}": fill_variables(F.col(f"rule_{h}"), variables or {}) for h in HEAD_SPECS}
    )
    return filled.withColumns(
        {
            f"{h}_ranges": port_ranges(f"_{h}") if h.endswith("port") else address_ranges(f"_{h}")
            for h in HEAD_SPECS
        }
    ).drop(*[f"_{h}" for h in HEAD_SPECS])


def head_condition(turned: bool = False) -> Column:
    """Whether a packet, or with ``turned`` the packet the other way round, fits a rule's head."""
    ends = ("dst_no", "dport", "src_no", "sport") if turned else ("src_no", "sport", "dst_no", "dport")
    src, sport, dst, dport = ends
    pairs = ((sport, "sport"), (dport, "dport"), (src, "src"), (dst, "dst"))
    return F.expr(" and ".join(f"({in_ranges(v, f'{h}_ranges')})" for v, h in pairs))


def head_matches(two_way: bool = False) -> Column:
    """Residual for ``match_packets`` on rules from ``with_head_ranges``."""
    return head_condition() | head_condition(turned=True) if two_way else head_condition()


def with_address_numbers(packets: DataFrame) -> DataFrame:
    return packets.withColumns(
        {"src_no": ip_number(F.col("src_ip")), "dst_no": ip_number(F.col("dst_ip"))}
    )


# --- rules that react to named upstream events -------------------------------------

# Rule options that name an upstream event or checksum.
EVENT_OPTIONS = ("app-layer-event", "decode-event", "stream-event")
CHECKSUM_OPTIONS = ("ipv4-csum", "tcpv4-csum", "tcpv6-csum", "udpv4-csum", "udpv6-csum", "icmpv4-csum", "icmpv6-csum")


def event_rules(rules: DataFrame) -> DataFrame:
    """Rules by the event they name, one row per rule and event option."""
    named = [F.col("options")[o] for o in EVENT_OPTIONS]
    sums = [F.when(F.col("options")[o] == "invalid", F.lit(o)) for o in CHECKSUM_OPTIONS]
    return rules.withColumn("event_name", F.explode(F.array_compact(F.array(*named, *sums))))


def match_events(events: DataFrame, rules: DataFrame, name: str = "event_name") -> DataFrame:
    """Equi-join of upstream events with the rules that name them."""
    return events.join(rules, name)


# --- directions --------------------------------------------------------------------


def first_senders(
    df: DataFrame, flow: Sequence[str], sender: str, order: Sequence[str]
) -> DataFrame:
    """Per flow: who sent first, and when each side first spoke (combined before the shuffle)."""
    position = F.struct(*order)
    return (
        df.groupBy(*flow, sender)
        .agg(F.min(position).alias("_first"))
        .groupBy(*flow)
        .agg(
            F.min_by(sender, "_first").alias("client"),
            F.max("_first").alias("both_from"),
            F.count(F.lit(1)).alias("sides"),
        )
    )


def with_direction(
    df: DataFrame, flow: Sequence[str], sender: str, order: Sequence[str]
) -> DataFrame:
    """Add ``direction`` and ``established`` (both sides were heard before this row)."""
    known = first_senders(df, flow, sender, order)
    return (
        attach(df, known, list(flow))
        .withColumn(
            "direction",
            F.when(F.col(sender).eqNullSafe(F.col("client")), "to_server").otherwise("to_client"),
        )
        .withColumn(
            "established", (F.col("sides") >= 2) & (F.struct(*order) > F.col("both_from"))
        )
        .drop("client", "both_from", "sides")
    )


def flow_key(src: str = "src_ip", dst: str = "dst_ip", sport: str = "sport", dport: str = "dport") -> list[Column]:
    """Both ends and ports in an order that is the same for the two directions."""
    a = F.struct(F.col(src).alias("ip"), F.coalesce(sport, F.lit(-1)).alias("port"))
    b = F.struct(F.col(dst).alias("ip"), F.coalesce(dport, F.lit(-1)).alias("port"))
    return [F.least(a, b).alias("end_a"), F.greatest(a, b).alias("end_b")]
