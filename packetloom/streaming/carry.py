"""State carried from one micro-batch to the next as a small written table.

Spark's keyed state puts all rows of a key in one task. The order-dependent jobs
here run the batch operators, which split hot keys, on each micro-batch together
with a few carried rows per key. State and output of a batch are overwritten at
paths that depend on the batch number only, so a batch that is run again after a
failure gives the same tables.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from packetloom.streaming.updates import UpdateTable

Step = Callable[[DataFrame, dict[str, DataFrame]], tuple[DataFrame, dict[str, DataFrame]]]


@dataclass(frozen=True)
class Carry:
    """Named state tables below one folder.

    Batch numbers are consecutive, so two places per table are enough: batch n
    reads what n-1 wrote and writes to the other place.
    """

    folder: str
    schemas: dict[str, str]

    def _path(self, name: str, batch: int) -> str:
        return f"{self.folder}/{name}/place={batch % 2}"

    def read(self, spark: SparkSession, batch: int) -> dict[str, DataFrame]:
        if batch == 0:
            return {n: spark.createDataFrame([], s) for n, s in self.schemas.items()}
        return {
            n: spark.read.schema(s).parquet(self._path(n, batch - 1))
            for n, s in self.schemas.items()
        }

    def write(self, states: dict[str, DataFrame], batch: int) -> None:
        for name, state in states.items():
            state.write.mode("overwrite").parquet(self._path(name, batch))


def start_carried(
    stream: DataFrame,
    step: Step,
    *,
    work: str,
    out: str,
    schemas: dict[str, str],
    trigger: dict | None = None,
    also: Callable[[DataFrame, int], None] | None = None,
    replaces: bool = False,
) -> StreamingQuery:
    """Run ``step(batch, states) -> (rows, new states)`` on every micro-batch.

    Rows of batch n are written to ``out/batch_id=n``. ``also`` gets the written rows and
    the batch number, for a further sink that may overwrite what it wrote for that number.
    With ``replaces`` each batch's rows replace those before, and older ones are removed
    as in ``updates``.
    """
    carry = Carry(f"{work}/carry", schemas)

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        try:
            rows, states = step(batch, carry.read(spark, batch_id))
            path = f"{out}/batch_id={batch_id}"
            if replaces:
                UpdateTable(spark, out, []).write(rows, batch_id)
            else:
                rows.write.mode("overwrite").parquet(path)
            if also is not None:
                also(spark.read.schema(rows.schema).parquet(path), batch_id)
            carry.write(states, batch_id)
        finally:
            batch.unpersist()

    return (
        stream.writeStream.foreachBatch(run)
        .option("checkpointLocation", f"{work}/checkpoint")
        .trigger(**(trigger or {"processingTime": "3 seconds"}))
        .start()
    )


def start_updates(
    result: DataFrame, *, work: str, out: str, keys: Sequence[str] = (), mode: str = "update", trigger: dict | None = None
) -> StreamingQuery:
    """Write each micro-batch of an updating aggregate to an update table with these keys."""

    def run(batch: DataFrame, batch_id: int) -> None:
        UpdateTable(batch.sparkSession, out, keys).write(batch, batch_id)

    return (
        result.writeStream.foreachBatch(run)
        .outputMode(mode)
        .option("checkpointLocation", f"{work}/checkpoint")
        .trigger(**(trigger or {"processingTime": "3 seconds"}))
        .start()
    )


# --- rows held back until none can come before them ----------------------------------


CLOCK = "mark_us bigint, late bigint, batch bigint"


def held_schemas(columns: Sequence[tuple[str, str]]) -> dict[str, str]:
    """State tables of :func:`held_back`, for a stream with these columns."""
    return {"held": ", ".join(f"`{c}` {t}" for c, t in columns), "clock": CLOCK}


def held_back(step: Step, columns: Sequence[str], hold_seconds: float, *, ts: str = "ts", last: bool = False) -> Step:
    """A step that gives ``step`` only rows that nothing at most ``hold_seconds`` late can precede.

    The mark is the newest time seen less the hold; rows up to it go on, younger ones are held.
    Rows that come behind the mark are left out and counted in ``clock``. With ``last`` all
    rows go on: the end of the stream.
    """
    hold = int(round(hold_seconds * 1_000_000))

    def run(batch: DataFrame, states: dict[str, DataFrame]) -> tuple[DataFrame, dict[str, DataFrame]]:
        us, clock = F.unix_micros(ts), states["clock"]
        before = clock.agg(F.max("mark_us")).scalar()
        passed = F.coalesce(before, F.lit(-(2**62)))
        pool = batch.filter(us > passed).select(*columns).unionByName(states["held"])
        mark_us = F.lit(2**62) if last else F.greatest(pool.agg(F.max(us)).scalar() - F.lit(hold), before)
        rows, new = step(pool.filter(us <= mark_us), states)
        late = batch.agg(F.count_if(us <= passed).alias("late"))
        tick = late.select(
            mark_us.alias("mark_us"),
            (F.col("late") + F.coalesce(clock.agg(F.sum("late")).scalar(), F.lit(0))).alias("late"),
            (F.coalesce(clock.agg(F.max("batch")).scalar(), F.lit(-1)) + 1).cast("bigint").alias("batch"),
        )
        return rows, {**new, "held": pool.filter((us > mark_us) | mark_us.isNull()), "clock": tick}

    return run


def flush(spark: SparkSession, step: Step, empty: DataFrame, *, work: str, out: str, schemas: dict[str, str]) -> int | None:
    """Let out what a stopped job still holds, as its next batch, whose number is returned.

    ``step`` is a :func:`held_back` step with ``last`` and ``empty`` a table of the stream's columns
    without rows. States are not written: a job that is started again takes the held
    rows up once more, and its next batch replaces what was let out here.
    """
    carry = Carry(f"{work}/carry", schemas)
    done = None
    for place in (0, 1):
        try:
            found = spark.read.schema(CLOCK).parquet(carry._path("clock", place)).agg(F.max("batch")).first()[0]
        except AnalysisException as err:
            if "PATH_NOT_FOUND" not in str(err):
                raise
            continue
        done = found if done is None else max(done, found)
    if done is None:
        return None
    rows, _ = step(empty, carry.read(spark, done + 1))
    rows.write.mode("overwrite").parquet(f"{out}/batch_id={done + 1}")
    return done + 1
