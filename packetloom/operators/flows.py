"""Flows: packets between the same two ends in either direction, until they fall idle.

A flow is named by its protocol, its two ends in an order that is the same both ways, and its
first packet's time. Counters, limits and directions per flow use that name as a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetloom.functions.timing import epoch_us, from_epoch_us
from packetloom.operators.match import flow_key
from packetloom.operators.ordered import KEY, PIECE, PIECE_ROWS, SLOT, STEP, key_pieces

IDLE_SECONDS = 180.0


def two_way_key(proto: str = "proto", **ends: str) -> Column:
    """Protocol and both ends, the same for the two directions."""
    return F.struct(F.lower(proto).alias("proto"), *flow_key(**ends))


def with_flow(
    packets: DataFrame,
    *,
    idle_seconds: float = IDLE_SECONDS,
    out: str = "flow",
    ts: str = "ts",
    tie: str = "packet_id",
    piece_rows: int = PIECE_ROWS,
    **ends: str,
) -> DataFrame:
    """Packets with the struct ``out``: proto, end_a, end_b and ``start_us``, the flow's first time.

    A gap of ``idle_seconds`` or more between two packets of the same ends, whichever way they
    go, ends a flow. All columns are shuffled by ends, so leave payloads out and give heads.
    A pair of ends with very many packets is cut into pieces; one row per piece tells how
    the flow that is open at a piece's end began.
    """
    timed = packets.withColumns({"_ends": two_way_key(**ends), "_us": epoch_us(F.col(ts))})
    placed, cut = key_pieces(timed, ["_ends"], "_us", tie, piece_rows=piece_rows)
    idle = int(round(idle_seconds * 1_000_000))
    inside = Window.partitionBy(*PIECE).orderBy("_us", tie)
    begun = _begun(F.col("_us"), F.lag("_us").over(inside), idle)
    started = placed.withColumn("_new", begun).withColumn(
        "_start", F.max("_new").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    )
    if cut is not None:
        opened = _open_flows(started.join(cut, KEY, "left_semi"), idle)
        limits = opened.withColumnsRenamed({c: f"_open{c}" for c in PIECE})
        started = started.join(limits, [F.col(c) == F.col(f"_open{c}") for c in PIECE], "left")
        goes_on = (F.col("_start") == F.col("_first")) & F.col("_carried").isNotNull()
        started = started.withColumn("_start", F.when(goes_on, F.col("_carried")).otherwise(F.col("_start")))
    name = F.struct("_ends.*", F.col("_start").alias("start_us"))
    return started.withColumn(out, name).select(*packets.columns, out)


def _begun(us: Column, before: Column, idle: int) -> Column:
    """The time of a row that begins a flow, else null."""
    return F.when(before.isNull() | (us - before >= idle), us)


def _open_flows(rows: DataFrame, idle: int) -> DataFrame:
    """For each piece of the divided keys its first time and the start of the flow it goes on with."""
    pieces = rows.groupBy(*PIECE).agg(
        F.min("_us").alias("_first"), F.max("_us").alias("_last"), F.max("_start").alias("_latest")
    )
    along = Window.partitionBy(KEY).orderBy(SLOT, STEP)
    pieces = pieces.withColumn("_joins", F.col("_first") - F.lag("_last").over(along) < idle)
    # a piece that only goes on leaves the flow open that was open before it
    only = F.coalesce("_joins", F.lit(False)) & (F.col("_latest") == F.col("_first"))
    opened = F.max(F.when(~only, F.col("_latest"))).over(along.rowsBetween(Window.unboundedPreceding, -1))
    return pieces.select(*PIECE, "_first", F.when(F.col("_joins"), opened).alias("_carried"))


def flow_table(packets: DataFrame, flow: str = "flow", *, ts: str = "ts", tie: str = "packet_id") -> DataFrame:
    """One row per flow of :func:`with_flow`: who opened it, and packets and bytes each way.

    ``client`` is the sender (ip, port) of the first packet. Combined per task before the
    shuffle, so a flow with very many packets is no more work than others.
    """
    sender = F.struct(F.col("src_ip").alias("ip"), F.coalesce("sport", F.lit(-1)).alias("port"))
    sides = packets.groupBy(flow, sender.alias("_from")).agg(
        F.count(F.lit(1)).alias("_packets"),
        F.sum(F.col("packet_size").cast("bigint")).alias("_bytes"),
        F.min(F.struct(ts, tie)).alias("_first"),
        F.max(ts).alias("_last"),
    )
    client = F.min_by("_from", "_first")
    whole = sides.groupBy(flow).agg(
        client.alias("client"),
        F.collect_list(F.struct("_from", "_packets", "_bytes")).alias("_sides"),  # two at most
        F.max("_last").alias("last_ts"),
    )

    def side(to_server: bool, value: str) -> Column:
        same = lambda x: x["_from"] == F.col("client")
        mine = F.filter("_sides", lambda x: same(x) if to_server else ~same(x))
        return F.aggregate(mine, F.lit(0).cast("bigint"), lambda n, x: n + F.coalesce(x[value], F.lit(0)))

    return whole.select(
        flow,
        "client",
        from_epoch_us(F.col(f"{flow}.start_us")).alias("first_ts"),
        "last_ts",
        side(True, "_packets").alias("packets_to_server"),
        side(False, "_packets").alias("packets_to_client"),
        side(True, "_bytes").alias("bytes_to_server"),
        side(False, "_bytes").alias("bytes_to_client"),
    )
