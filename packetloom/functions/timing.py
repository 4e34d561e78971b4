"""Event-time expressions on whole microseconds, free of session-zone effects."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def epoch_us(ts: Column) -> Column:
    """TIMESTAMP → microseconds since 1970 UTC."""
    return F.unix_micros(ts)


def from_epoch_us(us: Column) -> Column:
    return F.timestamp_micros(us)


def ntz_epoch_us(name: str) -> Column:
    """TIMESTAMP_NTZ column read as UTC → microseconds, whatever the session zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{name}`)")


def slot_of(us: Column, seconds: float) -> Column:
    """Number of the epoch-aligned time slot of the given width (exact on longs)."""
    width = F.lit(int(round(seconds * 1_000_000))).cast("bigint")
    return ((us - F.pmod(us, width)) / width).cast("bigint")


def utc_text(ts: Column, pattern: str) -> Column:
    """A timestamp as UTC text, whatever the session zone."""
    return F.date_format(F.to_utc_timestamp(ts, F.current_timezone()), pattern)
