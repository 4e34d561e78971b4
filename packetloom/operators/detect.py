"""Detections composed from windows, distinct counts, gaps and text scans."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from packetloom.functions.net import host_of, parent_domain
from packetloom.functions.timing import epoch_us
from packetloom.operators.anomaly import LARGE_BYTES
from packetloom.operators.ordered import (
    DAY,
    KEY,
    PIECE,
    PIECE_ROWS,
    SLOT,
    STEP,
    drop_pieces,
    previous_position,
    time_pieces,
)
from packetloom.operators.rollup import window_start_us
from packetloom.operators.string_index import occurring

# Ports of services with a log-in, and the personal-data count
# above which a record is reported.
AUTH_PORTS = (21, 22, 23, 25)
SENSITIVE_HITS = 25


def port_scans(packets: DataFrame, *, seconds: int = 60, min_ports: int = 20) -> DataFrame:
    """Sources that touch at least ``min_ports`` different ports in a window."""
    return (
        packets.filter(F.col("dport").isNotNull())
        .select("src_ip", window_start_us("ts", seconds).alias("window_start"), "dport")
        .distinct()
        .groupBy("src_ip", "window_start")
        .agg(F.count(F.lit(1)).alias("ports"))
        .filter(F.col("ports") >= min_ports)
    )


def brute_force(
    packets: DataFrame,
    *,
    seconds: int = 60,
    min_attempts: int = 10,
    ports: Sequence[int] = AUTH_PORTS,
) -> DataFrame:
    return (
        packets.filter(F.col("dport").isin(list(ports)))
        .groupBy("src_ip", "dport", window_start_us("ts", seconds).alias("window_start"))
        .agg(F.count(F.lit(1)).alias("attempts"))
        .filter(F.col("attempts") >= min_attempts)
    )


def exfiltration(
    packets: DataFrame, *, seconds: int = 60, limit_bytes: int = LARGE_BYTES
) -> DataFrame:
    return (
        packets.groupBy("src_ip", window_start_us("ts", seconds).alias("window_start"))
        .agg(F.sum("packet_size").cast("bigint").alias("bytes"))
        .filter(F.col("bytes") > limit_bytes)
    )


def beacons(
    packets: DataFrame,
    keys: Sequence[str] = ("src_ip", "dst_ip"),
    *,
    min_gaps: int = 10,
    max_variation: float = 0.1,
    tie: str = "packet_id",
    slot_seconds: float = DAY,
    piece_rows: int = PIECE_ROWS,
) -> DataFrame:
    """Keys whose gaps vary little: population stddev over mean of the gaps."""
    timed = packets.select(*keys, tie, epoch_us(F.col("ts")).alias("_us"))
    pieces = time_pieces(
        timed, keys, "_us", tie, slot_seconds=slot_seconds, piece_rows=piece_rows
    )
    before = previous_position(pieces, "_us", ["_us", tie], "_before")
    gap = (F.col("_us") - F.col("_before")).cast("double") / F.lit(1e6)
    return (
        before.withColumn("_gap", gap)
        .groupBy(*keys)
        .agg(
            F.count("_gap").alias("gaps"),
            F.avg("_gap").alias("mean_gap"),
            (F.stddev_pop("_gap") / F.nullif(F.avg("_gap"), F.lit(0.0))).alias("variation"),
        )
        .filter((F.col("gaps") >= min_gaps) & (F.col("variation") <= max_variation))
    )


def dns_tunnels(
    names: DataFrame, host: str = "host", *, min_hosts: int = 50, min_label: int = 0
) -> DataFrame:
    """Parent domains with many different hosts (and a long label, if asked)."""
    labels = F.transform(F.split(host, r"\."), lambda x: F.length(x))
    return (
        names.select(host)
        .distinct()
        .groupBy(parent_domain(F.col(host)).alias("parent"))
        .agg(
            F.count(F.lit(1)).alias("hosts"),
            F.max(F.array_max(labels)).alias("longest_label"),
        )
        .filter((F.col("hosts") >= min_hosts) & (F.col("longest_label") >= min_label))
    )


def url_hosts(pages: DataFrame, url: str = "url") -> DataFrame:
    return pages.withColumn("host", host_of(F.col(url))).filter(F.col("host").isNotNull())


def volume_outliers(
    packets: DataFrame,
    keys: Sequence[str] = ("src_ip",),
    *,
    seconds: int = 3600,
    min_z: float = 3.0,
) -> DataFrame:
    """Windows whose bytes are far from the key's own mean (windows are aggregated first)."""
    volumes = packets.groupBy(*keys, window_start_us("ts", seconds).alias("window_start")).agg(
        F.sum("packet_size").cast("bigint").alias("bytes")
    )
    mine = Window.partitionBy(*keys)
    spread = F.nullif(F.stddev_pop("bytes").over(mine), F.lit(0.0))
    z = (F.col("bytes") - F.avg("bytes").over(mine)) / spread
    return volumes.withColumn("z", z).filter(F.abs("z") >= min_z)


def scan_signatures(
    texts: DataFrame, signatures: DataFrame, *, key: str, text: str = "text"
) -> DataFrame:
    """Texts that hold at least ``k`` of a signature's strings, and how many they hold.

    A text meets only strings whose rarest run of characters it has, whatever the number of
    signatures. Equal rows of ``texts`` count once; null strings are in no text, and a
    ``k`` below 1 counts as 1.
    """
    strings = signatures.filter(F.col("k").isNotNull()).select(
        "name", F.greatest("k", F.lit(1)).alias("k"), F.posexplode("strings").alias("_nth", "_wanted")
    )
    named = texts.select(F.col(key), F.col(text).alias("_text"))
    distinct = strings.select("_wanted").distinct()
    hits = occurring(named, distinct, text="_text", string="_wanted", keys=[key])
    hits = hits.select(key, F.xxhash64("_text").alias("_row"), "_wanted")
    return (
        hits.join(strings, "_wanted")
        .groupBy(key, "_row", "name", "k")
        .agg(F.count_distinct("_nth").cast("int").alias("found"))
        .filter("found >= k")
        .select(key, "name", "found")
    )


def scan_patterns(
    texts: DataFrame, patterns: Mapping[str, str], *, key: str, text: str = "text"
) -> DataFrame:
    """One row per text and named regular expression that is found in it."""
    found = F.array_compact(
        F.array(*[F.when(F.col(text).rlike(p), F.lit(name)) for name, p in patterns.items()])
    )
    return texts.select(key, F.explode(found).alias("name"))


def sensitive_records(
    texts: DataFrame,
    patterns: Sequence[str],
    *,
    key: str,
    text: str = "text",
    min_hits: int = SENSITIVE_HITS,
) -> DataFrame:
    """Texts with at least ``min_hits`` finds of personal-data patterns."""
    hits = sum((F.regexp_count(F.col(text), F.lit(p)) for p in patterns), F.lit(0))
    # Exploding a one-element array keeps the filter above the count, done once per text.
    return texts.select(key, F.explode(F.array(hits)).alias("hits")).filter(
        F.col("hits") >= min_hits
    )


def sessions(
    packets: DataFrame,
    keys: Sequence[str] = ("src_ip",),
    *,
    idle_seconds: float = 180.0,
    tie: str = "packet_id",
    slot_seconds: float = DAY,
    piece_rows: int = PIECE_ROWS,
) -> DataFrame:
    """Flow sessions: a gap of ``idle_seconds`` or more starts a new one.

    The rows of each piece become sessions there. Only a piece's first and last session can go
    on in its neighbours; these are brought together per key and merged by first and last
    time, so packets are shuffled once.
    """
    timed = packets.select(*keys, tie, "packet_size", epoch_us(F.col("ts")).alias("_us"))
    pieces = time_pieces(
        timed, keys, "_us", tie, slot_seconds=slot_seconds, piece_rows=piece_rows
    )
    idle = int(round(idle_seconds * 1_000_000))

    def begun(us: str, before: Column, order: WindowSpec) -> Column:
        """The latest time at which a session began, up to a row."""
        fresh = F.when(before.isNull() | (F.col(us) - before >= idle), F.col(us))
        return F.max(fresh).over(order.rowsBetween(Window.unboundedPreceding, 0))

    def summed(rows: DataFrame, by: Sequence[str]) -> DataFrame:
        return rows.groupBy(*by, "start_us").agg(
            F.min("first_us").alias("first_us"),
            F.max("last_us").alias("last_us"),
            F.sum("packets").alias("packets"),
            F.sum("bytes").alias("bytes"),
        )

    inside = Window.partitionBy(*PIECE).orderBy("_us", tie)
    rows = pieces.withColumn("_before", F.lag("_us").over(inside))
    rows = rows.withColumn("start_us", begun("_us", F.col("_before"), inside)).select(
        *PIECE, "start_us", F.col("_us").alias("first_us"), F.col("_us").alias("last_us"),
        F.lit(1).cast("bigint").alias("packets"), F.col("packet_size").cast("bigint").alias("bytes"),
    )
    local = summed(rows, PIECE)
    whole = Window.partitionBy(*PIECE)
    marked = local.withColumn(
        "_edge", (F.col("first_us") == F.min("first_us").over(whole)) | (F.col("last_us") == F.max("last_us").over(whole))
    )
    across = Window.partitionBy(KEY).orderBy(SLOT, STEP, "first_us")
    edges = marked.filter(F.coalesce("_edge", F.lit(True))).withColumn("_before", F.lag("last_us").over(across))
    merged = summed(edges.withColumn("start_us", begun("first_us", F.col("_before"), across)), [KEY])
    found = marked.filter(~F.coalesce("_edge", F.lit(True))).select(*merged.columns).unionByName(merged)
    return found.select(f"{KEY}.*", "start_us", "last_us", "packets", "bytes")


def activity_feed(scored: DataFrame, *, seconds: int = 60, score: str = "intel_score") -> DataFrame:
    """Packets of the newest time window of the table, with their score."""
    start = scored.agg(F.max(window_start_us("ts", seconds)).alias("m")).scalar()
    return scored.filter(epoch_us(F.col("ts")) >= start)
