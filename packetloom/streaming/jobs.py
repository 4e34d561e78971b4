"""The streaming counterparts of the detection operators.

Watermarks default to 10 minutes. Rows later than that are dropped by the
watermarked aggregates and counted in the query progress.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from packetloom.operators.anomaly import USUAL_AFTER, port_sightings
from packetloom.operators.correlate import (
    HITS,
    WINDOW_SECONDS,
    apply_escalation,
    ip_scores,
    mark_escalated,
)
from packetloom.operators.lookup import score_indicators
from packetloom.operators.match import match_packets
from packetloom.operators.ordered import first_rows
from packetloom.operators.rollup import (
    distinct_sketches,
    merged_sketches,
    severity_rollup,
    traffic_rate,
)
from packetloom.session import written
from packetloom.sources import alert_store
from packetloom.sources.packets import ipv4_only, with_text_payload
from packetloom.streaming.carry import (
    Step,
    flush,
    held_back,
    held_schemas,
    start_carried,
    start_updates,
)
from packetloom.streaming.updates import UpdateTable, latest  # noqa: F401

DELAY = "10 minutes"
LATE_SECONDS = 600


def matched_stream(packets: DataFrame, rules: DataFrame) -> DataFrame:
    """Continuous rule matching: stream against the static catalog."""
    return match_packets(packets, rules)


def append_log(lines: DataFrame, *, work: str, out: str, trigger: dict | None = None) -> StreamingQuery:
    """Append alert log lines as text files."""
    return (
        lines.select("value")
        .writeStream.format("text")
        .option("path", out)
        .option("checkpointLocation", f"{work}/checkpoint")
        .outputMode("append")
        .trigger(**(trigger or {"processingTime": "3 seconds"}))
        .start()
    )


def append_table(rows: DataFrame, *, work: str, out: str, trigger: dict | None = None) -> StreamingQuery:
    """Append rows to a Parquet table."""
    return (
        rows.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", f"{work}/checkpoint")
        .outputMode("append")
        .trigger(**(trigger or {"processingTime": "3 seconds"}))
        .start()
    )


def start_escalation(
    alerts: DataFrame,
    *,
    work: str,
    out: str,
    key: str = "sid",
    tie: Sequence[str] = ("packet_id", "rule_key"),
    window_seconds: float = WINDOW_SECONDS,
    hits: int = HITS,
    hold_seconds: float | None = None,
    trigger: dict | None = None,
    then: Callable[[DataFrame], DataFrame] | None = None,
    also: Callable[[DataFrame, int], None] | None = None,
) -> StreamingQuery:
    """Escalation over a stream; the carry is the last ``hits - 1`` rows per key.

    Carried rows go once they are older than the window and ``LATE_SECONDS`` before the
    newest row. ``then`` is applied to the marked rows of a batch before they are written,
    ``also`` as in ``start_carried``. Rows are ordered inside a micro-batch and after the carried rows. Where rows
    may arrive out of order across batches, ``hold_seconds`` keeps rows back
    until none that is at most this late can come before them; later rows are
    left out, and counted in the ``clock`` table.
    """
    step, schemas = escalation_step(
        alerts, key=key, tie=tie, window_seconds=window_seconds, hits=hits, hold_seconds=hold_seconds, then=then
    )
    return start_carried(
        alerts, step, work=work, out=out, schemas=schemas, trigger=trigger, also=also
    )


def escalation_step(
    alerts: DataFrame,
    *,
    key: str = "sid",
    tie: Sequence[str] = ("packet_id", "rule_key"),
    window_seconds: float = WINDOW_SECONDS,
    hits: int = HITS,
    hold_seconds: float | None = None,
    then: Callable[[DataFrame], DataFrame] | None = None,
    last: bool = False,
) -> tuple[Step, dict[str, str]]:
    """The step of :func:`start_escalation` and its state tables, for a table like ``alerts``."""
    kinds = dict(alerts.dtypes)
    schemas = {"recent": ", ".join(f"`{c}` {kinds[c]}" for c in [key, "ts", *tie])}

    def mark(batch: DataFrame, states: dict[str, DataFrame]) -> tuple[DataFrame, dict[str, DataFrame]]:
        both = batch.withColumn("_own", F.lit(True)).unionByName(
            states["recent"].withColumn("_own", F.lit(False)), allowMissingColumns=True
        )
        marked = mark_escalated(
            both, key, tie=tie, window_seconds=window_seconds, hits=hits, staged=False
        )
        newest = [F.desc("ts"), *[F.desc(t) for t in tie]]
        latest_rows = first_rows(both.select(key, "ts", *tie), [key], newest, max(hits - 1, 1), "_n")
        us = F.unix_micros("ts")
        oldest = both.agg(F.max(us)).scalar() - F.lit(int((window_seconds + LATE_SECONDS) * 1_000_000))
        rows = marked.filter("_own").drop("_own")
        return then(rows) if then else rows, {"recent": latest_rows.drop("_n").filter(us >= oldest)}

    if hold_seconds is None:
        return mark, schemas
    return held_back(mark, alerts.columns, hold_seconds, last=last), schemas | held_schemas(alerts.dtypes)


def flush_escalation(alerts: DataFrame, *, work: str, out: str, **how) -> int | None:
    """Mark and write the rows that a stopped job still holds; ``how`` as it was started."""
    step, schemas = escalation_step(alerts, **how, last=True)
    spark = alerts.sparkSession
    return flush(spark, step, spark.createDataFrame([], alerts.schema), work=work, out=out, schemas=schemas)


def start_detection(
    packets: DataFrame,
    rules: DataFrame,
    intel: DataFrame,
    *,
    work: str,
    out: str,
    log: str | None = None,
    window_seconds: float = WINDOW_SECONDS,
    hits: int = HITS,
    hold_seconds: float | None = None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """The detection plan on a stream: gate, decode, match, escalate, score, store, log.

    Each micro-batch appends its correlated alerts, as ``plans.detection.detect`` gives them,
    to the table ``out``, and their log lines to the text folder ``log``.
    """
    gated = ipv4_only(with_text_payload(packets))

    def score(rows: DataFrame) -> DataFrame:
        scored = score_indicators(rows, intel)
        return apply_escalation(scored.withColumn("threat_score", F.col("intel_score")))

    def write_log(rows: DataFrame, batch_id: int) -> None:
        records = alert_store.alert_records(rows)
        fields = [f for f, *_ in alert_store.TABLE_COLUMNS]
        lines = alert_store.log_lines(records, fields, "ts").select("value")
        lines.write.mode("overwrite").text(f"{log}/batch_id={batch_id}")

    return start_escalation(
        matched_stream(gated, rules),
        work=work,
        out=out,
        window_seconds=window_seconds,
        hits=hits,
        hold_seconds=hold_seconds,
        trigger=trigger,
        then=score,
        also=write_log if log else None,
    )


def start_unusual_ports(
    packets: DataFrame,
    *,
    work: str,
    out: str,
    usual_after: int = USUAL_AFTER,
    hold_seconds: float | None = None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Unusual destination ports; the carry is a capped count per port seen.

    Sightings are counted in order of time inside a micro-batch and after those of earlier ones.
    Where packets may arrive out of order across batches, ``hold_seconds`` keeps them back until
    none that is at most this late can come before them; :func:`flush_unusual_ports` lets
    out the last.
    """
    step, schemas = unusual_ports_step(packets, usual_after=usual_after, hold_seconds=hold_seconds)
    return start_carried(packets, step, work=work, out=out, schemas=schemas, trigger=trigger)


def unusual_ports_step(
    packets: DataFrame, *, usual_after: int = USUAL_AFTER, hold_seconds: float | None = None, last: bool = False
) -> tuple[Step, dict[str, str]]:
    cap = usual_after - 1
    schemas = {"ports": "port int, seen int"}

    def count(batch: DataFrame, states: dict[str, DataFrame]) -> tuple[DataFrame, dict[str, DataFrame]]:
        order = [F.asc("ts"), F.asc("packet_id"), F.asc("slot")]
        early = first_rows(port_sightings(batch), ["port"], order, cap, "_n")
        known = states["ports"].withColumnRenamed("port", "_port")
        counted = early.join(known, F.col("port") == F.col("_port"), "left").withColumn(
            "sightings", F.col("_n") + F.coalesce("seen", F.lit(0))
        )
        rows = counted.filter((F.col("slot") == 1) & (F.col("sightings") < usual_after)).select(
            "packet_id", "ts", "port", "sightings"
        )
        seen = (
            early.select("port", F.lit(1).alias("seen"))
            .unionByName(states["ports"])
            .groupBy("port")
            .agg(F.least(F.sum("seen"), F.lit(cap)).cast("int").alias("seen"))
        )
        return rows, {"ports": seen}

    if hold_seconds is None:
        return count, schemas
    kept = ["packet_id", "ts", "sport", "dport"]
    kinds = dict(packets.dtypes)
    return held_back(count, kept, hold_seconds, last=last), schemas | held_schemas([(c, kinds[c]) for c in kept])


def flush_unusual_ports(packets: DataFrame, *, work: str, out: str, **how) -> int | None:
    """Count and write the packets that a stopped job still holds; ``how`` as it was started."""
    step, schemas = unusual_ports_step(packets, **how, last=True)
    spark = packets.sparkSession
    return flush(spark, step, spark.createDataFrame([], packets.schema), work=work, out=out, schemas=schemas)


def start_ip_scores(alerts: DataFrame, *, work: str, out: str, trigger: dict | None = None) -> StreamingQuery:
    """Running score per address; each batch writes the addresses it changed."""
    return start_updates(ip_scores(alerts), work=work, out=out, keys=["ip"], mode="update", trigger=trigger)


def start_stats(alerts: DataFrame, *, work: str, out: str, trigger: dict | None = None) -> StreamingQuery:
    """The severity roll-up, refreshed every three seconds unless told otherwise."""
    return start_updates(
        severity_rollup(alerts), work=work, out=out, mode="complete", trigger=trigger
    )


def start_snapshots(
    alerts: DataFrame,
    *,
    work: str,
    out: str,
    last: int = 10,
    tie: Sequence[str] = ("packet_id", "rule_key"),
    trigger: dict | None = None,
) -> StreamingQuery:
    """Per batch: the totals so far and the newest alerts, as JSON rows by kind.

    Totals and newest alerts are carried, so no batch reads the history again.
    """
    totals = ("n", "critical", "high", "medium", "low", "score", "scored")
    kinds = dict(alerts.dtypes)
    shown = ["ts", *tie, "sid", "msg", "src_ip", "dst_ip", "threat_score"]
    schemas = {
        "totals": ", ".join(f"{t} bigint" for t in totals),
        "last": ", ".join(f"`{c}` {kinds[c]}" for c in shown),
    }

    def step(batch: DataFrame, states: dict[str, DataFrame]):
        s = F.col("threat_score")
        now = batch.agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(s > 100).alias("critical"),
            F.count_if((s > 50) & (s <= 100)).alias("high"),
            F.count_if((s > 20) & (s <= 50)).alias("medium"),
            F.count_if(s <= 20).alias("low"),
            F.sum(s).cast("bigint").alias("score"),
            F.count(s).alias("scored"),
        )
        summed = (
            now.unionByName(states["totals"])
            .agg(*[F.sum(t).cast("bigint").alias(t) for t in totals])
        )
        newest = (
            batch.select(*shown)
            .unionByName(states["last"])
            .orderBy(F.desc("ts"), *[F.desc(t) for t in tie])
            .limit(last)
        )
        stats = summed.select(
            F.lit("stats").alias("kind"),
            F.to_json(
                F.struct(
                    F.col("n").alias("total_alerts"),
                    F.col("critical").alias("critical_alerts"),
                    F.col("high").alias("high_alerts"),
                    F.col("medium").alias("medium_alerts"),
                    F.col("low").alias("low_alerts"),
                    F.coalesce(
                        (F.col("score") / F.nullif("scored", F.lit(0))).cast("int"), F.lit(0)
                    ).alias("threat_score"),
                )
            ).alias("body"),
        )
        feed = newest.select(
            F.lit("alert").alias("kind"),
            F.to_json(
                F.struct(F.unix_micros("ts").alias("us"), *tie, "sid", "threat_score"),
                {"ignoreNullFields": "false"},
            ).alias("body"),
        )
        return stats.unionByName(feed), {"totals": summed, "last": newest}

    return start_carried(
        alerts, step, work=work, out=out, schemas=schemas, trigger=trigger, replaces=True
    )


def start_sketches(
    packets: DataFrame, of: Sequence[str], *, work: str, out: str, seconds: int = 60, trigger: dict | None = None
) -> StreamingQuery:
    """Distinct counts per window as stored sketches that days and batches can be merged from.

    A batch merges its own sketches with the stored ones of the windows it has; merging the same
    rows again changes nothing.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        stored = UpdateTable(spark, out, ["window_start"])
        new = written(distinct_sketches(batch, of, seconds), "sketches")
        if stored.exists():
            old = stored.read().join(new.select("window_start"), "window_start", "left_semi")
            new = written(merged_sketches(new.unionByName(old), ["window_start"]), "sketches")
        stored.write(new, batch_id)

    return (
        packets.writeStream.foreachBatch(run)
        .option("checkpointLocation", f"{work}/checkpoint")
        .trigger(**(trigger or {"processingTime": "3 seconds"}))
        .start()
    )


def rates(packets: DataFrame, *, seconds: int = 60, delay: str = DELAY) -> DataFrame:
    """Tumbling traffic rates; in append mode a window comes out once it is closed."""
    return traffic_rate(packets.withWatermark("ts", delay), seconds)


def flow_sessions(
    packets: DataFrame,
    keys: Sequence[str] = ("src_ip",),
    *,
    idle: str = "180 seconds",
    delay: str = DELAY,
) -> DataFrame:
    """Flow sessions in append mode.

    With the setting of ``merge_sessions_locally`` the rows of a hot key become
    sessions in each task before the shuffle.
    """
    return (
        packets.withWatermark("ts", delay)
        .groupBy(*keys, F.session_window("ts", idle).alias("_s"))
        .agg(
            F.min("ts").alias("started"),
            F.max("ts").alias("last_seen"),
            F.count(F.lit(1)).alias("packets"),
            F.sum("packet_size").cast("bigint").alias("bytes"),
        )
        .drop("_s")
    )


STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ON_DISK = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keep_state_on_disk(spark: SparkSession) -> None:
    """State of sessions, windows and de-duplication in RocksDB, for queries started from now on:
    memory then holds a part of it, and it is stored in changes with each checkpoint."""
    spark.conf.set(STATE_STORE, ON_DISK)


LOCAL_MERGE = "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition"


def merge_sessions_locally(spark: SparkSession) -> None:
    spark.conf.set(LOCAL_MERGE, "true")


def once_per_flow(
    alerts: DataFrame, keys: Sequence[str] = ("src_ip", "dst_ip", "sid"), *, delay: str = DELAY
) -> DataFrame:
    """At most one alert per flow and signature within the watermark delay."""
    return alerts.withWatermark("ts", delay).dropDuplicatesWithinWatermark(list(keys))


def once_per_session(
    alerts: DataFrame,
    keys: Sequence[str] = ("src_ip", "dst_ip", "sid"),
    *,
    idle: str = "180 seconds",
    delay: str = DELAY,
    order: Sequence[str] = ("ts", "packet_id"),
) -> DataFrame:
    """The first alert of each flow and signature until it falls idle, in append mode.

    State rows go when the watermark passes the end of a session. With the setting of
    ``merge_sessions_locally`` rows are combined in each task before the shuffle, so a hot flow
    sends one row per task and session.
    """
    rest = [c for c in alerts.columns if c not in keys]
    return (
        alerts.withWatermark("ts", delay)
        .groupBy(*keys, F.session_window("ts", idle).alias("_s"))
        .agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_first"), F.count(F.lit(1)).alias("alerts"))
        .select(*keys, "_first.*", "alerts")
    )


def current(spark: SparkSession, out: str, keys: Sequence[str]) -> DataFrame:
    """The newest row of each key of an update table; without keys the last batch's rows."""
    return UpdateTable(spark, out, keys).read()


def finish(query: StreamingQuery) -> StreamingQuery:
    """Wait for an ``availableNow`` query; raises what it raised."""
    query.awaitTermination()
    return query


NOW = {"availableNow": True}
