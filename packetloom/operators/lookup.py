"""Indicator lookups: addresses, ranges, domains, hashes, references, services, countries.

Equi-joins throughout and without hints: Spark broadcasts a list that its own
size check finds small and shuffles one that is not. Ranges become equi-joins on
aligned address blocks, probed once per distinct address.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.functions.net import cidr_bounds, ip_number

INDICATOR_SCORE = 100


def _flagged(
    df: DataFrame, keys: DataFrame, column: str, out: str
) -> DataFrame:
    """Add boolean ``out``: whether ``column`` is one of ``keys.indicator``."""
    listed = keys.select(F.col("indicator").alias("_key")).distinct().withColumn("_hit", F.lit(True))
    return (
        df.join(listed, F.col(column) == F.col("_key"), "left")
        .withColumn(out, F.coalesce("_hit", F.lit(False)))
        .drop("_key", "_hit")
    )


def score_indicators(
    df: DataFrame,
    intel: DataFrame,
    columns: Sequence[str] = ("src_ip", "dst_ip"),
    *,
    kind: str = "ip",
    out: str = "intel_score",
) -> DataFrame:
    """+100 for each of ``columns`` that is a known indicator of the kind (exact text)."""
    keys = intel.filter(F.col("kind") == kind)
    total: Column = F.lit(0)
    marked = df
    for i, column in enumerate(columns):
        marked = _flagged(marked, keys, column, f"_f{i}")
        total = total + F.when(F.col(f"_f{i}"), INDICATOR_SCORE).otherwise(0)
    return marked.withColumn(out, total).drop(*[f"_f{i}" for i in range(len(columns))])


def cidr_blocks(ranges: DataFrame, column: str = "indicator") -> DataFrame:
    """Ranges as whole 8-bit-aligned blocks ``(bits, block)``; at most 256 per range."""
    low, high = cidr_bounds(F.col(column))
    bounded = ranges.withColumn("_lo", low).withColumn("_hi", high).filter(F.col("_lo").isNotNull())
    size = F.col("_hi") - F.col("_lo") + 1
    bits = (
        F.when(size >= 16777216, 8)
        .when(size >= 65536, 16)
        .when(size >= 256, 24)
        .otherwise(32)
    )
    width = F.pow(F.lit(2.0), 32 - F.col("bits")).cast("bigint")
    return (
        bounded.withColumn("bits", bits)
        .withColumn(
            "block",
            F.explode(
                F.sequence(
                    (F.col("_lo") / width).cast("bigint"), (F.col("_hi") / width).cast("bigint")
                )
            ),
        )
        .drop("_lo", "_hi")
    )


def cidr_hits(df: DataFrame, ip: str, ranges: DataFrame, column: str = "indicator") -> DataFrame:
    """``(ip, indicator)`` for every distinct address inside a range."""
    levels = F.array(
        *[
            F.struct(
                F.lit(bits).alias("bits"),
                F.shiftright(F.col("_no"), 32 - bits).alias("block"),
            )
            for bits in (8, 16, 24, 32)
        ]
    )
    probes = (
        df.select(F.col(ip).alias("ip"))
        .distinct()
        .withColumn("_no", ip_number(F.col("ip")))
        .select("ip", F.inline(levels))
    )
    return probes.join(cidr_blocks(ranges, column), ["bits", "block"]).select("ip", column).distinct()


def in_ranges(df: DataFrame, ip: str, ranges: DataFrame, out: str = "in_range") -> DataFrame:
    """Add boolean ``out``: whether the address lies in one of the ranges."""
    hits = cidr_hits(df, ip, ranges).select(F.col("ip").alias("indicator"))
    return _flagged(df, hits, ip, out)


def range_blocks(ranges: DataFrame, lo: str = "lo", hi: str = "hi") -> DataFrame:
    """Address ranges as the fewest aligned blocks ``(width, block)`` of 2^width addresses.

    A range has at most two blocks of each width: one that begins it and one that ends it, where
    the range's inner part of wider blocks does not reach so far.
    """
    begin, end = F.col(lo).cast("bigint"), F.col(hi).cast("bigint") + 1
    first = lambda s: F.call_function("shiftright", begin + F.call_function("shiftleft", F.lit(1).cast("bigint"), s) - 1, s)
    last = lambda s: F.call_function("shiftright", end, s)

    def blocks(s: Column) -> Column:
        some = first(s) < last(s)
        left = F.when(some & (first(s) % 2 == 1), F.struct(s.alias("width"), first(s).alias("block")))
        right = F.when(some & (last(s) % 2 == 1), F.struct(s.alias("width"), (last(s) - 1).alias("block")))
        return F.array(left, right)

    every = F.array_compact(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(32)), blocks)))
    return ranges.select("*", F.inline(every))


def _address_blocks(df: DataFrame, ip: str, blocks: DataFrame) -> DataFrame:
    """ip, width, block: each distinct address once for every width in use."""
    widths = [r.width for r in blocks.select("width").distinct().collect()]  # 33 at most
    each = F.explode(F.array(*[F.lit(w) for w in sorted(widths)]).cast("array<int>")).alias("width")
    known = df.select(F.col(ip).alias("ip")).distinct().withColumn("_no", ip_number(F.col("ip")))
    probes = known.where("_no is not null").select("ip", "_no", each)
    return probes.withColumn("block", F.call_function("shiftright", "_no", "width")).drop("_no")


def range_hits(df: DataFrame, ip: str, ranges: DataFrame, *keep: str) -> DataFrame:
    """``(ip, *keep)`` for addresses in free ``[lo, hi]`` ranges; all candidates are hits."""
    blocks = range_blocks(ranges).select("width", "block", *keep)
    return _address_blocks(df, ip, blocks).join(blocks, ["width", "block"]).select("ip", *keep)


def with_country(df: DataFrame, ip: str, blocks: DataFrame, unknown: str = "UNKNOWN") -> DataFrame:
    """Add ``country`` of an address from ``(lo, hi, country)`` blocks.

    Where blocks overlap, the smallest holds, of equal ones the first: rows are not multiplied.
    Each aligned block has one owner before addresses meet it, so however many ranges
    share a network, an address meets one candidate for each width.
    """
    rank = F.struct((F.col("hi") - F.col("lo")).alias("size"), "lo", "country")
    owners = range_blocks(blocks).groupBy("width", "block").agg(F.min(rank).alias("_owner"))
    hits = _address_blocks(df, ip, owners).join(owners, ["width", "block"])
    hits = hits.groupBy(F.col("ip").alias("_ip")).agg(F.min("_owner").alias("_owner"))
    return (
        df.join(hits.select("_ip", F.col("_owner.country").alias("country")), F.col(ip) == F.col("_ip"), "left")
        .withColumn("country", F.coalesce("country", F.lit(unknown)))
        .drop("_ip")
    )


def hash_hits(df: DataFrame, digest: Column, hashes: DataFrame) -> DataFrame:
    """Rows whose content digest is a listed hash."""
    return (
        df.withColumn("digest", digest)
        .join(hashes.select(F.col("indicator").alias("digest")), "digest", "left_semi")
    )


def blocked_unless_allowed(
    df: DataFrame, column: str, block: DataFrame, allow: DataFrame
) -> DataFrame:
    """Rows on the block list and not on the allow list, which wins."""
    names = lambda d: d.select(F.col("indicator").alias(column))
    return df.join(names(block), column, "left_semi").join(names(allow), column, "left_anti")


def with_references(alerts: DataFrame, refs: DataFrame, key: str = "sid") -> DataFrame:
    """Alerts with the references of their rule, one row per reference, NULL for none."""
    return alerts.join(refs, key, "left")


def exposed_services(packets: DataFrame, services: DataFrame) -> DataFrame:
    """Distinct ``(host, port)`` with the service and its risk."""
    seen = packets.filter(F.col("dport").isNotNull()).select(
        F.col("dst_ip").alias("host"), F.col("dport").alias("port")
    ).distinct()
    return seen.join(services, "port")


def exposure_report(packets: DataFrame, services: DataFrame) -> DataFrame:
    """Exposed services, worst risk first."""
    rank = (
        F.when(F.col("risk") == "critical", 0)
        .when(F.col("risk") == "high", 1)
        .when(F.col("risk") == "medium", 2)
        .otherwise(3)
    )
    return exposed_services(packets, services).orderBy(rank, "host", "port")
