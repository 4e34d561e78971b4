"""Alert thinning: rate limits, back-off, counter thresholds, once per flow."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.functions.timing import epoch_us, slot_of
from packetloom.operators.ordered import PIECE_ROWS, first_rows, occurrence_number


def rate_limit(
    df: DataFrame,
    keys: Sequence[str],
    *,
    seconds: float = 60.0,
    count: int = 1,
    ts: str = "ts",
    tie: str = "packet_id",
) -> DataFrame:
    """At most ``count`` rows per key in each epoch-aligned window, the earliest ones."""
    windowed = df.withColumn("_w", slot_of(epoch_us(F.col(ts)), seconds))
    return first_rows(windowed, [*keys, "_w"], [F.asc(ts), F.asc(tie)], count, "_rn").drop(
        "_w", "_rn"
    )


def backoff_steps(count: int, multiplier: int) -> list[int]:
    """Occurrence numbers that fire: count, count*m, count*m^2, ... within a LONG."""
    steps, n = [], count
    while n < 2**63:
        steps.append(n)
        if multiplier <= 1:
            break
        n *= multiplier
    return steps


def backoff(
    df: DataFrame,
    keys: Sequence[str],
    *,
    count: int = 1,
    multiplier: int = 2,
    ts: str = "ts",
    tie: str = "packet_id",
    slot_seconds: float = 86_400.0,
    piece_rows: int = PIECE_ROWS,
) -> DataFrame:
    """Rows whose occurrence number within the key is a back-off step."""
    timed = df.withColumn("_us", epoch_us(F.col(ts)))
    numbered = occurrence_number(
        timed, keys, "_us", tie, slot_seconds=slot_seconds, piece_rows=piece_rows
    )
    steps = backoff_steps(count, multiplier)
    return numbered.filter(F.col("occurrence").isin(steps)).drop("_us")


def at_threshold(
    df: DataFrame,
    keys: Sequence[str],
    counted: Column,
    *,
    threshold: int = 10,
    ts: str = "ts",
    tie: str = "packet_id",
) -> DataFrame:
    """The row with which a key's counter reaches ``threshold``: fires once per key."""
    early = first_rows(df.filter(counted), keys, [F.asc(ts), F.asc(tie)], threshold, "_rn")
    return early.filter(F.col("_rn") == threshold).drop("_rn")


def once_per(
    df: DataFrame, keys: Sequence[str], *, ts: str = "ts", tie: Sequence[str] = ("packet_id",)
) -> DataFrame:
    """The earliest row of each key."""
    order = [F.asc(ts), *[F.asc(t) for t in tie]]
    return first_rows(df, keys, order, 1, "_rn").drop("_rn")


def flow_counters(df: DataFrame, flow: Sequence[str], counter: Column) -> DataFrame:
    """How often each named counter of a flow was raised."""
    return df.groupBy(*flow, counter.alias("counter")).agg(F.count(F.lit(1)).alias("n"))


def emitted(alerts: DataFrame, noalert: str = "noalert") -> DataFrame:
    """Alerts of rules that alert; counting rules are only counted."""
    return alerts.filter(~F.col(noalert))
