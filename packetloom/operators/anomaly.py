"""Behavioural baseline and anomalies.

Fixed values: a destination port is unusual while it has been seen fewer than 5
times (as either port, this packet included); a transfer is large above
1,000,000 bytes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.operators.correlate import endpoints
from packetloom.operators.ordered import first_rows

USUAL_AFTER = 5
LARGE_BYTES = 1_000_000


def port_sightings(packets: DataFrame) -> DataFrame:
    """One row per packet and present port; slot 0 is the source port, 1 the destination."""
    narrow = packets.select("packet_id", "ts", "sport", "dport")
    return endpoints(narrow, ["sport", "dport"], "port", "slot").filter(
        F.col("port").isNotNull()
    )


def unusual_ports(packets: DataFrame, usual_after: int = USUAL_AFTER) -> DataFrame:
    """Destination ports whose running count is still below ``usual_after``.

    Only the first ``usual_after - 1`` sightings of a port can qualify, so each
    port is cut to those before the shuffle and nothing is joined back.
    """
    early = first_rows(
        port_sightings(packets),
        ["port"],
        [F.asc("ts"), F.asc("packet_id"), F.asc("slot")],
        usual_after - 1,
        "sightings",
    )
    return early.filter(F.col("slot") == 1).select(
        "packet_id",
        "ts",
        F.lit("unusual_port").alias("type"),
        F.lit("medium").alias("severity"),
        F.format_string("Unusual port %d usage detected", "port").alias("description"),
        "port",
        "sightings",
    )


def large_transfers(
    df: DataFrame,
    limit_bytes: int = LARGE_BYTES,
    *,
    size: str = "packet_size",
    keep: Sequence[str] = ("packet_id", "ts"),
) -> DataFrame:
    return df.filter(F.col(size) > limit_bytes).select(
        *keep,
        F.lit("large_transfer").alias("type"),
        F.lit("high").alias("severity"),
        F.format_string("Large data transfer detected: %d bytes", F.col(size)).alias("description"),
    )


def anomalies(
    packets: DataFrame, usual_after: int = USUAL_AFTER, limit_bytes: int = LARGE_BYTES
) -> DataFrame:
    """All anomalies as rows; alerts themselves carry none."""
    return (
        unusual_ports(packets, usual_after)
        .drop("port", "sightings")
        .unionByName(large_transfers(packets, limit_bytes))
    )


def port_frequency(packets: DataFrame) -> DataFrame:
    return port_sightings(packets).groupBy("port").agg(F.count(F.lit(1)).alias("sightings"))


def protocol_frequency(packets: DataFrame) -> DataFrame:
    """TCP and UDP only; other packets are in no protocol counter."""
    return (
        packets.filter(F.lower("proto").isin("tcp", "udp"))
        .groupBy(F.lower("proto").alias("proto"))
        .agg(F.count(F.lit(1)).alias("packets"))
    )


def traffic_volume(packets: DataFrame) -> DataFrame:
    """Packet count and bytes, as two separate figures."""
    return packets.agg(
        F.count(F.lit(1)).alias("packets"),
        F.coalesce(F.sum("packet_size"), F.lit(0)).cast("bigint").alias("bytes"),
    )
