"""Alert correlation: sliding counts, escalation, running scores.

Fixed values: a signature escalates at 5 hits in less than 60 seconds, each
known bad address adds 100 and escalation adds 50.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from packetloom.functions.timing import epoch_us, slot_of
from packetloom.operators.ordered import (
    DAY,
    KEY,
    PIECE_ROWS,
    cut_pieces,
    drop_pieces,
    lagged_position,
    over_full_keys,
    running_sum,
    time_pieces,
)

WINDOW_SECONDS = 60
HITS = 5
ESCALATION_BONUS = 50
PREFIX = "[ESCALATED] "


def sliding_count(
    df: DataFrame,
    key: str = "sid",
    ts: str = "ts",
    tie: Sequence[str] = ("packet_id", "rule_key"),
    *,
    window_seconds: float = WINDOW_SECONDS,
    slot_seconds: float = DAY,
    piece_rows: int = PIECE_ROWS,
    out: str = "in_window",
) -> DataFrame:
    """Rows of the same key, this one included, younger than the window.

    A key is cut into slots of time no shorter than the window. Each slot also gets, as context,
    the rows of the slot before that are younger than the window when it begins; a row's
    count is its number in the slot less the number of rows as old as the window or older. So
    rows are shuffled once. Keys with an over-full slot are counted over arrivals and expiries
    instead, whose pieces can be as small as needed.
    """
    width = int(round(window_seconds * 1_000_000))
    slot_us = max(int(round(slot_seconds * 1_000_000)), width)
    timed = df.withColumn("_us", epoch_us(F.col(ts)))
    of = lambda us: slot_of(us, slot_us / 1_000_000)
    hot = over_full_keys(timed, [key], "_us", slot=of(F.col("_us")), piece_rows=piece_rows)
    if hot is None:
        return _counted_in_slots(timed, key, tie, width, of, out)
    named = timed.withColumn(KEY, F.struct(key))
    cold = named.join(hot, KEY, "left_anti").drop(KEY)
    full = named.join(hot, KEY, "left_semi").drop(KEY, "_us")
    return _counted_in_slots(cold, key, tie, width, of, out).unionByName(
        _counted_by_expiry(full, key, ts, tie, width, slot_seconds, piece_rows, out)
    )


def _counted_in_slots(timed: DataFrame, key: str, tie: Sequence[str], width: int, of, out: str) -> DataFrame:
    own, next_ = of(F.col("_us")), of(F.col("_us") + width)
    # a row without a time is in no slot, and counts in none
    slots = F.when(next_ == own, F.array(own)).otherwise(F.array(own, next_))
    dealt = timed.withColumn("_own", own).select("*", F.explode_outer(slots).alias("_in"))
    rows = Window.partitionBy(key, "_in").orderBy("_us", *tie)
    older = Window.partitionBy(key, "_in").orderBy("_us").rangeBetween(Window.unboundedPreceding, -width)
    counted = dealt.withColumn(out, F.row_number().over(rows) - F.count(F.lit(1)).over(older))
    return counted.filter(F.col("_own").eqNullSafe(F.col("_in"))).drop("_own", "_in", "_us")


def _counted_by_expiry(
    df: DataFrame, key: str, ts: str, tie: Sequence[str], width: int, slot_seconds: float, piece_rows: int, out: str
) -> DataFrame:
    """A row counts +1 when it arrives and -1 once it is exactly as old as the window, so the
    count is a running sum over both. At one instant expiries go first (the limit is strict)
    and arrivals follow in ``tie`` order.
    """
    arrival = df.withColumn("_us", epoch_us(F.col(ts))).withColumn("_delta", F.lit(1))
    expiry = arrival.select(
        key, *tie, (F.col("_us") + width).alias("_us"), F.lit(-1).alias("_delta")
    )
    # One number orders both kinds: twice the time, arrivals on the odd values.
    both = arrival.unionByName(expiry, allowMissingColumns=True).withColumn(
        "_at", F.col("_us") * 2 + (F.col("_delta") > 0).cast("bigint")
    )
    pieces = cut_pieces(
        both, [key], "_at", tie[0], slot=slot_of(F.col("_us"), slot_seconds), piece_rows=piece_rows
    )
    counted = running_sum(pieces, ["_at", *tie], F.col("_delta"), out)
    return drop_pieces(counted.filter(F.col("_delta") == 1)).drop("_us", "_at", "_delta")


def mark_escalated(
    df: DataFrame,
    key: str = "sid",
    ts: str = "ts",
    tie: Sequence[str] = ("packet_id", "rule_key"),
    *,
    window_seconds: float = WINDOW_SECONDS,
    hits: int = HITS,
    slot_seconds: float = DAY,
    piece_rows: int = PIECE_ROWS,
    staged: bool = True,
    out: str = "escalated",
) -> DataFrame:
    """Add ``out``: true when this row is at least the ``hits``-th in the window.

    That is so when the row ``hits - 1`` places before it is younger than the window.
    """
    if hits <= 1:
        return df.withColumn(out, F.lit(True))
    width = int(round(window_seconds * 1_000_000))
    timed = df.withColumn("_us", epoch_us(F.col(ts)))
    pieces = time_pieces(
        timed,
        [key],
        "_us",
        tie[0],
        slot_seconds=slot_seconds,
        piece_rows=piece_rows,
        staged=staged,
    )
    lagged = lagged_position(pieces, "_us", ["_us", *tie], hits - 1, "_back")
    reached = F.coalesce(F.col("_us") - F.col("_back") < width, F.lit(False))
    return drop_pieces(lagged.withColumn(out, reached)).drop("_us", "_back")


def apply_escalation(
    df: DataFrame, *, score: str = "threat_score", msg: str = "msg", escalated: str = "escalated"
) -> DataFrame:
    """Prefix the message and raise the score of escalated alerts."""
    return df.withColumn(
        msg, F.when(F.col(escalated), F.concat(F.lit(PREFIX), msg)).otherwise(F.col(msg))
    ).withColumn(
        score,
        F.col(score) + F.when(F.col(escalated), F.lit(ESCALATION_BONUS)).otherwise(F.lit(0)),
    )


def endpoints(df: DataFrame, columns: Sequence[str], out: str, position: str | None = None) -> DataFrame:
    """Bag union of several columns into one (both ends of a packet, both ports)."""
    values = F.array(*[F.col(c) for c in columns])
    rest = [c for c in df.columns if c not in columns]
    if position is None:
        return df.select(*rest, F.explode(values).alias(out))
    return df.select(*rest, F.posexplode(values).alias(position, out))


def ip_scores(alerts: DataFrame, score: str = "intel_score") -> DataFrame:
    """Cumulative score per address: each alert adds its un-escalated score to both ends."""
    narrow = alerts.select("src_ip", "dst_ip", score)
    return (
        endpoints(narrow, ["src_ip", "dst_ip"], "ip")
        .groupBy("ip")
        .agg(F.sum(score).cast("bigint").alias("score"), F.count(F.lit(1)).alias("alerts"))
    )


def running_ip_score(
    alerts: DataFrame,
    *,
    score: str = "intel_score",
    tie: Sequence[str] = ("packet_id", "rule_key"),
    slot_seconds: float = DAY,
    piece_rows: int = PIECE_ROWS,
) -> DataFrame:
    """Score of each address after each alert that names it."""
    narrow = alerts.select("src_ip", "dst_ip", *tie, score, epoch_us(F.col("ts")).alias("_us"))
    ends = endpoints(narrow, ["src_ip", "dst_ip"], "ip", "side")
    pieces = time_pieces(
        ends, ["ip"], "_us", tie[0], slot_seconds=slot_seconds, piece_rows=piece_rows
    )
    order = ["_us", *tie, "side"]
    return drop_pieces(running_sum(pieces, order, F.col(score), "running_score")).drop(
        "_us"
    )
