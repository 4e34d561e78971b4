"""Rule options that decide after a match: flow, threshold, noalert.

Parsed rules keep their options, alerts keep the rule's key only; what an option asks for is
joined back by that key. Occurrence numbers are running values over pieces, so a hot source or
flow is not one task. Variables of flows (``flowbits``, ``flowint``) are in ``flow_state``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.functions.timing import epoch_us
from packetloom.operators.match import flow_key
from packetloom.operators.ordered import DAY, PIECE_ROWS, first_rows, occurrence_number


def _words(text: Column) -> Column:
    return F.transform(F.split(text, ","), lambda w: F.trim(w))


def _number(text: Column, name: str) -> Column:
    """The whole number after a word, null without one."""
    return F.nullif(F.regexp_extract(text, rf"\b{name}\s+(\d{{1,18}})", 1), F.lit("")).cast("bigint")


def with_behaviour(rules: DataFrame, options: str = "options") -> DataFrame:
    """Adds ``flow_side`` (to_server, to_client or null), ``flow_established`` (true, false or
    null), ``limit_kind``, ``limit_track``, ``limit_count``, ``limit_seconds`` and ``limit_factor``.

    Absent options give nulls. A limit without a count counts 1, without seconds 60, without a
    multiplier 1; it is tracked by source unless it says otherwise.
    """
    flow = _words(F.col(options)["flow"])
    side = F.when(
        F.array_contains(flow, "to_server") | F.array_contains(flow, "from_client"), "to_server"
    ).when(F.array_contains(flow, "to_client") | F.array_contains(flow, "from_server"), "to_client")
    settled = F.when(F.array_contains(flow, "established"), True).when(
        F.array_contains(flow, "not_established"), False
    )
    limit = F.col(options)["threshold"]

    def named(name: str) -> Column:
        return F.nullif(F.regexp_extract(limit, rf"\b{name}\s+(\w+)", 1), F.lit(""))

    present = limit.isNotNull()
    return rules.withColumns(
        {
            "flow_side": side,
            "flow_established": settled,
            "limit_kind": named("type"),
            "limit_track": F.when(present, F.coalesce(named("track"), F.lit("by_src"))),
            "limit_count": F.when(present, F.coalesce(_number(limit, "count"), F.lit(1))),
            "limit_seconds": F.when(present, F.coalesce(_number(limit, "seconds"), F.lit(60))),
            "limit_factor": F.when(present, F.coalesce(_number(limit, "multiplier"), F.lit(1))),
        }
    )


def flow_matches() -> Column:
    """Residual of ``match_packets``: packets with ``direction`` and ``established`` against rules
    with :func:`with_behaviour`."""
    side = F.col("flow_side").isNull() | (F.col("direction") == F.col("flow_side"))
    settled = F.col("flow_established").isNull() | (F.col("established") == F.col("flow_established"))
    return side & settled


def with_rule(alerts: DataFrame, rules: DataFrame, *columns: str) -> DataFrame:
    """Alerts with columns of their rules, joined back by the rule's key."""
    return alerts.join(rules.select("rule_key", *columns), "rule_key")


def noalert_removed(alerts: DataFrame, rules: DataFrame) -> DataFrame:
    """Alerts of rules that alert; rules with ``noalert`` are only counted."""
    silent = rules.where("noalert").select("rule_key")
    return alerts.join(silent, "rule_key", "left_anti")


TRACKED = {
    "by_src": ("src_ip",),
    "by_dst": ("dst_ip",),
    "by_both": ("src_ip", "dst_ip"),
    "by_rule": (),
}


def _tracked(alerts: DataFrame) -> Column:
    """What a rule's limit tracks, as text.

    By flow that is the alert's ``flow`` (``flows.with_flow``). Alerts without that column are
    told apart by both ends, whichever is the source, and their flows never end.
    """
    flow = F.to_json("flow") if "flow" in alerts.columns else F.to_json(F.struct(*flow_key()))
    track = F.when(F.col("limit_track") == "by_flow", flow)
    for name, columns in TRACKED.items():
        key = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in columns])
        track = track.when(F.col("limit_track") == name, key)
    return track.otherwise("")


def limited(
    alerts: DataFrame,
    rules: DataFrame,
    *,
    ts: str = "ts",
    tie: str = "packet_id",
    slot_seconds: float = DAY,
    piece_rows: int = PIECE_ROWS,
) -> DataFrame:
    """Alerts that their rules' ``threshold`` options let through; rules without one pass all.

    Within a rule, what it tracks and, but for ``backoff``, its epoch-aligned window of seconds:
    ``limit`` passes the first ``count``, ``threshold`` every ``count``-th, ``both`` the ``count``-th
    only, and ``backoff`` numbers ``count``, ``count * multiplier``, ... of all.
    """
    names = ["limit_kind", "limit_track", "limit_count", "limit_seconds", "limit_factor"]
    known = with_rule(alerts, rules, *names)
    us = epoch_us(F.col(ts))
    width = F.col("limit_seconds") * 1_000_000
    windowed = F.when(F.col("limit_kind") != "backoff", us - F.pmod(us, width)).otherwise(F.lit(0))
    keyed = known.where("limit_kind is not null").withColumns(
        {"_us": us, "_w": windowed, "_track": _tracked(alerts)}
    )
    keys, early = ["rule_key", "_track", "_w"], F.col("limit_kind").isin("limit", "both")
    most, later = rules.agg(
        F.max(F.when(early, F.col("limit_count"))), F.coalesce(F.bool_or(~early), F.lit(False))
    ).first()  # one row
    parts = []
    if most is not None:  # only the first rows of a key can pass
        order = [F.asc("_us"), F.asc(tie)]
        parts.append(first_rows(keyed.where(early), keys, order, int(most), "occurrence"))
    if later:
        parts.append(
            occurrence_number(keyed.where(~early), keys, "_us", tie, slot_seconds=slot_seconds, piece_rows=piece_rows)
        )
    if not parts:
        return alerts
    numbered = parts[0].unionByName(parts[1].select(*parts[0].columns)) if len(parts) == 2 else parts[0]
    n, count, factor = F.col("occurrence"), F.col("limit_count"), F.col("limit_factor")
    turns = F.round(F.log(n / count) / F.log(factor.cast("double")))
    power = F.when(factor > 1, count * F.pow(factor, turns) == n).otherwise(n == count)
    fires = (
        F.when(F.col("limit_kind") == "limit", n <= count)
        .when(F.col("limit_kind") == "threshold", n % count == 0)
        .when(F.col("limit_kind") == "both", n == count)
        .otherwise((n >= count) & power)
    )
    passed = numbered.where(fires).select(*alerts.columns)
    return passed.unionByName(known.where("limit_kind is null").select(*alerts.columns))
