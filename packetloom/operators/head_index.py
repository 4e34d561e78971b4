"""Rule heads as an index: each rule under the blocks of its most selective address or port.

The part of a head (source, destination, either port) that admits the least share of values
gives a rule's place: the aligned blocks that cover its ranges, of the finest of four widths that
needs few of them. A packet has one block of each part and width, and so meets a rule at
most once; negations, exact limits and the other parts are checked then. Rules that
admit everything are listed for all packets of their protocol.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.operators.match import (
    alert_columns,
    content_matches,
    head_condition,
    packet_class,
    rule_classes,
    size_matches,
)

#: Blocks that a rule may be listed under before a wider block is taken.
MOST_BLOCKS = 64
# part: column of packets, number of values, bits below a block for each width
PARTS = {
    "src": ("src_no", 1 << 32, (0, 8, 16, 24)),
    "dst": ("dst_no", 1 << 32, (0, 8, 16, 24)),
    "sport": ("sport", 1 << 16, (0, 4, 8, 12)),
    "dport": ("dport", 1 << 16, (0, 4, 8, 12)),
}
ALL = len(PARTS)
TURNED = {"src": "dst", "dst": "src", "sport": "dport", "dport": "sport"}


def _place(part: int, width: int, block: Column | None = None) -> Column:
    """One number for a part, a width and a block of it."""
    head = F.lit((part * 4 + width) << 34)
    return head if block is None else head + block


def _plain(ranges: str) -> Column:
    """Ranges that admit values."""
    return F.filter(ranges, lambda r: ~r["negated"] & (r["lo"] <= r["hi"]))


def _share(part: str) -> Column:
    """Part of all values that a rule's ranges admit; all, where it names none."""
    ranges, size = F.col(f"{part}_ranges"), PARTS[part][1]
    sums = F.aggregate(_plain(f"{part}_ranges"), F.lit(0.0), lambda n, r: n + (r["hi"] - r["lo"] + 1) / size)
    return F.when(F.exists(ranges, lambda r: ~r["negated"]), F.least(sums, F.lit(1.0))).otherwise(1.0)


def _blocks(part: str, code: int) -> Column:
    ranges, shifts = _plain(f"{part}_ranges"), PARTS[part][2]

    def count(s: int) -> Column:
        return F.aggregate(ranges, F.lit(0).cast("bigint"), lambda n, r: n + F.shiftright(r["hi"], s) - F.shiftright(r["lo"], s) + 1)

    def keys(width: int) -> Column:
        s = shifts[width]
        each = F.transform(ranges, lambda r: F.sequence(F.shiftright(r["lo"], s), F.shiftright(r["hi"], s)))
        return F.array_distinct(F.transform(F.flatten(each), lambda b: _place(code, width, b)))

    chosen = F.when(count(shifts[0]) <= MOST_BLOCKS, keys(0))
    for width in (1, 2):
        chosen = chosen.when(count(shifts[width]) <= MOST_BLOCKS, keys(width))
    return chosen.otherwise(keys(3))


def head_listing(rules: DataFrame) -> DataFrame:
    """Rules of ``with_head_ranges`` with ``_at``, one row per block and protocol class."""
    shares = {p: _share(p) for p in PARTS}
    least = F.least(*shares.values())
    chosen = F.when(least >= 1.0, F.array(_place(ALL, 0)))
    for code, part in enumerate(PARTS):
        chosen = chosen.when(shares[part] == least, _blocks(part, code))
    classes = rules.select("*", F.explode(chosen).alias("_block"))
    meets = F.transform(rule_classes(F.col("rule_proto")), lambda c: F.col("_block") * 3 + c)
    return classes.select("*", F.explode(meets).alias("_at")).drop("_block")


def widths_in_use(listing: DataFrame) -> list[int]:
    """Parts and widths of the listing, seventeen at most."""
    return sorted(r[0] for r in listing.select(F.shiftright(F.expr("_at div 3"), 34)).distinct().collect())


def _probes(used: Sequence[int], turned: bool) -> Column:
    names = list(PARTS)
    keys = []
    for code in used:
        part, width = divmod(code, 4)
        if part == ALL:
            keys.append(_place(ALL, 0))
            continue
        name = TURNED[names[part]] if turned else names[part]
        value = F.col(PARTS[name][0]).cast("bigint")
        keys.append(_place(part, width, F.shiftright(value, PARTS[name][2][width])))
    met = F.array_compact(F.array(*keys))
    return F.transform(met, lambda k: k * 3 + packet_class(F.col("proto")))


def match_heads(
    packets: DataFrame, rules: DataFrame, *, two_way: bool = False, residual: Sequence[Column] = (), keep: Sequence[str] = ()
) -> DataFrame:
    """One alert per packet and rule whose head, size and content match.

    ``packets`` have ``src_no`` and ``dst_no`` (``match.with_address_numbers``), ``rules`` range
    arrays (``match.with_head_ranges``). With ``two_way`` either direction of a packet may match
    a head, and the packet still alerts once. A missing port meets only rules that admit all.
    """
    listing = head_listing(rules)
    used = widths_in_use(listing)
    payload = F.col("payload") if "payload" in packets.columns else F.lit(None).cast("string")
    found = None
    for turned in (False, True) if two_way else (False,):
        if not used:
            return packets.join(listing, F.lit(False)).select(*alert_columns(keep))
        met = packets.select("*", F.explode(_probes(used, turned)).alias("_meets"))
        on = (F.col("_meets") == F.col("_at")) & size_matches(F.col("packet_size"), F.col("dsize_op"), F.col("dsize_n"))
        on = on & head_condition(turned)
        if turned:  # what matches both ways has come already
            on = on & ~head_condition(False)
        for condition in residual:
            on = on & condition
        hits = met.join(listing, on & content_matches(payload, F.col("content"))).select(*alert_columns(keep))
        found = hits if found is None else found.unionByName(hits)
    return found
