"""Order-dependent results per key when one key may hold a large share of the rows.

A plain ``Window.partitionBy(key).orderBy(ts)`` puts every row of a key in one
task. Here the rows of a key are cut into consecutive *pieces*: epoch-aligned
time slots, and inside a slot that is too full, equal steps between the slot's own
lowest and highest time (or id, where all times are equal), divided once more
where a burst fills a step. Pieces keep the order, so a running value is

    value inside the piece  +  value carried from the earlier pieces

and only one row per piece is ever brought together per key. All piece limits
are exact aggregates of the data, so a recomputed task cuts the same pieces.
"""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetloom.functions.timing import slot_of
from packetloom.session import written

KEY, SLOT, STEP = "_key", "_slot", "_step"
PIECE = (KEY, SLOT, STEP)
DAY = 86_400.0
PIECE_ROWS = 1_000_000
MAX_DIVISIONS = 5
STEPS_PER_DIVISION = 1 << 12
GROUP_LIMIT = 1000


def attach(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join in which NULL keys meet NULL keys; right keeps only its new columns.

    The keys are compared as one struct: equal NULL fields are equal there, and the
    join stays a plain equi-join.
    """
    named = right.select(
        F.struct(*keys).alias("_right"), *[c for c in right.columns if c not in keys]
    )
    return left.join(named, F.struct(*keys) == F.col("_right"), "left").drop("_right")


def cut_pieces(
    df: DataFrame,
    keys: Sequence[str],
    position: str,
    tie: str,
    *,
    slot: Column,
    piece_rows: int = PIECE_ROWS,
    staged: bool = True,
) -> DataFrame:
    """Add the piece of each row: ``_key``, ``_slot`` and ``_step``.

    ``position`` and ``tie`` are numeric columns in the wanted order and ``slot``
    an expression that never decreases with ``position``. Over-full pieces are found
    first and written as a table, of fewer than rows / piece_rows rows; usually it
    is empty, and then nothing is joined. Pieces that a burst leaves over-full are
    divided again. With ``staged`` off nothing is written and pieces are divided once:
    for micro-batches, which come by the thousand.
    """
    placed = _placed(df, keys, slot)
    if not staged:
        full = _full_pieces(placed, position, tie, piece_rows)
        return _divide(placed, full, position, tie, piece_rows)
    return _divided(placed, position, tie, piece_rows)[0]


def key_pieces(
    df: DataFrame, keys: Sequence[str], position: str, tie: str, *, piece_rows: int = PIECE_ROWS
) -> tuple[DataFrame, DataFrame | None]:
    """Pieces that are whole keys, but for over-full keys, and a small table of those (``_key``).

    Without an over-full key the second is None, and nothing has to be carried between pieces.
    """
    placed, full = _divided(_placed(df, keys, F.lit(0).cast("bigint")), position, tie, piece_rows)
    return placed, None if full is None else full.select(KEY)


def over_full_keys(
    df: DataFrame, keys: Sequence[str], position: str, *, slot: Column, piece_rows: int = PIECE_ROWS
) -> DataFrame | None:
    """Keys (``_key``) with more than ``piece_rows`` rows in a slot, a small table; None if none."""
    placed = _placed(df, keys, slot)
    full = placed.groupBy(KEY, SLOT).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > piece_rows)
    found = written(full.select(KEY).distinct(), "full-keys")
    return None if found.isEmpty() else found


def _placed(df: DataFrame, keys: Sequence[str], slot: Column) -> DataFrame:
    return (
        df.withColumn(KEY, F.struct(*keys))
        .withColumn(SLOT, slot)
        .withColumn(STEP, F.lit(0).cast("bigint"))
    )


def _divided(
    placed: DataFrame, position: str, tie: str, piece_rows: int
) -> tuple[DataFrame, DataFrame | None]:
    """The rows with over-full pieces divided, and which these were (None: none)."""
    first = None
    for level in range(MAX_DIVISIONS):
        most = piece_rows * (1 if level == 0 else 2)
        full = written(_full_pieces(placed, position, tie, most), "full-pieces")
        if full.isEmpty():
            break
        first = full if first is None else first
        placed = _divide(placed, full, position, tie, piece_rows)
    else:
        left = _full_pieces(placed, position, tie, piece_rows * 2).count()
        if left:
            warnings.warn(f"{left} pieces hold more than {piece_rows * 2} rows that position and tie do not tell apart")
    return placed, first


def _full_pieces(placed: DataFrame, position: str, tie: str, most: int) -> DataFrame:
    sizes = placed.groupBy(*PIECE).agg(
        F.count(F.lit(1)).alias("_n"),
        F.min(position).alias("_p0"),
        F.max(position).alias("_p1"),
        F.min(tie).alias("_t0"),
        F.max(tie).alias("_t1"),
    )
    return sizes.filter(F.col("_n") > most)


def _divide(
    placed: DataFrame, full: DataFrame, position: str, tie: str, piece_rows: int
) -> DataFrame:
    """Divide the over-full pieces into equal steps; the others keep their place."""
    steps = F.least(F.ceil(F.col("_n") / F.lit(piece_rows)), F.lit(STEPS_PER_DIVISION - 1))

    def step(value: str, low: str, high: str) -> Column:
        span = F.col(high).cast("double") - F.col(low).cast("double")
        share = (F.col(value).cast("double") - F.col(low).cast("double")) / span
        return F.least(F.floor(share * steps), steps - 1)

    limits = full.withColumnsRenamed({c: f"_full{c}" for c in PIECE})
    on = [F.col(c) == F.col(f"_full{c}") for c in PIECE]
    inner = F.when(F.col("_p1") > F.col("_p0"), step(position, "_p0", "_p1")).when(
        F.col("_t1") > F.col("_t0"), step(tie, "_t0", "_t1")
    )
    return (
        placed.join(limits, on, "left")
        .withColumn(STEP, F.col(STEP) * STEPS_PER_DIVISION + F.coalesce(inner, F.lit(0)))
        .drop(*limits.columns)
    )


def _carried(pieces: DataFrame, summary: Column, carry) -> DataFrame:
    """Per piece, ``carry`` of the summaries of the key's earlier pieces."""
    earlier = (
        Window.partitionBy(KEY)
        .orderBy(SLOT, STEP)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        pieces.groupBy(*PIECE)
        .agg(summary.alias("_summary"))
        .select(*PIECE, carry("_summary").over(earlier).alias("_carry"))
    )


def _inside(order: Sequence[str]):
    return Window.partitionBy(*PIECE).orderBy(*order)


def _so_far(order: Sequence[str]):
    return _inside(order).rowsBetween(Window.unboundedPreceding, 0)


def running_sum(pieces: DataFrame, order: Sequence[str], value: Column, out: str) -> DataFrame:
    """Add ``out``: sum of ``value`` over the key's rows up to and including this one."""
    valued = pieces.withColumn("_v", value.cast("bigint"))
    local = valued.withColumn("_local", F.sum("_v").over(_so_far(order)))
    carried = _carried(valued, F.sum("_v"), F.sum)
    return (
        local.join(carried, list(PIECE), "left")
        .withColumn(out, F.col("_local") + F.coalesce("_carry", F.lit(0)))
        .drop("_v", "_local", "_carry")
    )


def running_max(pieces: DataFrame, order: Sequence[str], value: Column, out: str) -> DataFrame:
    """Add ``out``: greatest non-null ``value`` up to and including this row."""
    valued = pieces.withColumn("_v", value)
    local = valued.withColumn("_local", F.max("_v").over(_so_far(order)))
    carried = _carried(valued, F.max("_v"), F.max)
    return (
        local.join(carried, list(PIECE), "left")
        .withColumn(out, F.greatest("_local", "_carry"))
        .drop("_v", "_local", "_carry")
    )


def previous_position(pieces: DataFrame, position: str, order: Sequence[str], out: str) -> DataFrame:
    """Add ``out``: ``position`` of the key's row just before this one, NULL for the first."""
    local = pieces.withColumn("_local", F.lag(position).over(_inside(order)))
    carried = _carried(pieces, F.max(position), F.max)
    return (
        local.join(carried, list(PIECE), "left")
        .withColumn(out, F.coalesce("_local", "_carry"))
        .drop("_local", "_carry")
    )


def lagged_position(
    pieces: DataFrame, position: str, order: Sequence[str], n: int, out: str
) -> DataFrame:
    """Add ``out``: ``position`` of the key's row ``n`` places before this one.

    Inside a piece that is a plain lag. Only the first ``n`` rows of a piece miss it,
    and the rows they look for are among the first and last ``n`` rows of the pieces:
    these edge rows alone are brought together per key. Both branches read the same
    shuffled rows, and nothing is joined back.
    """
    inside = _inside(order)
    seen = pieces.withColumns(
        {out: F.lag(position, n).over(inside), "_next": F.lead(position, n).over(inside)}
    )
    settled = seen.filter(F.col(out).isNotNull()).drop("_next")
    edges = seen.filter(F.col(out).isNull() | F.col("_next").isNull())
    across = Window.partitionBy(KEY).orderBy(SLOT, STEP, *order)
    found = (
        edges.withColumn("_open", F.col(out).isNull())
        .withColumn(out, F.lag(position, n).over(across))
        .filter("_open")
        .drop("_open", "_next")
    )
    return settled.unionByName(found)


def drop_pieces(df: DataFrame) -> DataFrame:
    return df.drop(*PIECE)


def time_pieces(
    df: DataFrame,
    keys: Sequence[str],
    position: str,
    tie: str,
    *,
    slot_seconds: float = DAY,
    piece_rows: int = PIECE_ROWS,
    staged: bool = True,
) -> DataFrame:
    """Pieces for a position in epoch microseconds."""
    return cut_pieces(
        df,
        keys,
        position,
        tie,
        slot=slot_of(F.col(position), slot_seconds),
        piece_rows=piece_rows,
        staged=staged,
    )


def occurrence_number(
    df: DataFrame,
    keys: Sequence[str],
    position: str,
    tie: str,
    *,
    out: str = "occurrence",
    more_order: Sequence[str] = (),
    slot_seconds: float = DAY,
    piece_rows: int = PIECE_ROWS,
) -> DataFrame:
    """Add the exact 1-based occurrence number of each row within its key."""
    pieces = time_pieces(
        df, keys, position, tie, slot_seconds=slot_seconds, piece_rows=piece_rows
    )
    order = [position, tie, *more_order]
    return drop_pieces(running_sum(pieces, order, F.lit(1), out))


def first_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, out: str = "occurrence"
) -> DataFrame:
    """The first ``n`` rows of each key with their number.

    Up to 1000, Spark's own bound, the constant lets it cut each key to ``n`` rows per
    task before the shuffle (WindowGroupLimit), so a hot key costs no more than a cold
    one. Beyond, the rows of a key are first cut to ``n`` in each of 64 parts by hash.
    """
    if n > GROUP_LIMIT:
        part = F.pmod(F.xxhash64(*[c for c, t in df.dtypes if "map<" not in t]), F.lit(64))
        inner = Window.partitionBy(*keys, "_part").orderBy(*order)
        df = df.withColumn("_part", part).withColumn("_n", F.row_number().over(inner))
        df = df.filter(F.col("_n") <= n).drop("_part", "_n")
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).filter(F.col(out) <= n)
