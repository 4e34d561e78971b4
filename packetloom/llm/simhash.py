"""SimHash near-duplicates by generalised pigeonhole over groups of bits.

Two 64-bit fingerprints at most ``max_bits`` apart are at most ``t[p]`` apart in some group
``p`` of bits, if the thresholds satisfy sum(t[p] + 1) > max_bits; a group with t = -1 is not
searched. Correlated bits go to the same group, so that few values of it are common, and
dynamic programming chooses the thresholds from the counts of candidates that the value
histograms of all fingerprints give. A group with threshold t is searched by masks: two
values at most t bits apart are equal once t suitable bits are masked out. Rows that meet
under a masked value are verified by counting differing bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetloom.llm.components import components
from packetloom.llm.tables import set_apart
from packetloom.llm.words import SPACED, slices, text_column, translated
from packetloom.session import written

BITS = 64
TEXT_BYTES = 4 << 20
#: Distinct fingerprints that are compared with each other in one go; larger groups are cut.
BLOCK = 2048
#: Cost of one row of a search, in comparisons of two fingerprints.
ROW_COST = 30


def fingerprint_of(words: list[bytes], size: int, digest) -> int:
    """The SimHash of a word list, its bits as a signed 64-bit number; 0 without words."""
    if not words:
        return 0
    text = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    if len(words) <= size:
        hashes = [digest(text, 42)]
    else:
        first = np.concatenate(([0], ends[:-size] + 1)).tolist()
        hashes = [digest(text[a:b], 42) for a, b in zip(first, ends[size - 1 :].tolist())]
    bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8), bitorder="little").reshape(-1, BITS)
    ones = bits.sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = 4
) -> DataFrame:
    """doc_id, fingerprint (long): SimHash of each whole text's word shingles, repeats included.

    A-Z are lower-cased and words are split at ASCII white space. A shingle's hash is XXH64
    with seed 42. Fewer words than a shingle count as one; null and wordless texts have
    fingerprint zero. One row per row; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for batch in batches:
            for part in slices(batch, 1, TEXT_BYTES):
                texts = translated(text_column(part.column(1)), SPACED).cast(pa.binary())
                marks = [fingerprint_of(t.as_py().split(), shingle, xxh64_intdigest) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(marks, pa.int64())], names=[doc_id, "fingerprint"]
                )

    source = docs.select(F.col(f"`{doc_id}`"), F.col(f"`{text}`"))
    schema = T.StructType([source.schema[0], T.StructField("fingerprint", T.LongType())])
    return source.mapInArrow(run, schema)


def _pair_counts(marks: DataFrame) -> np.ndarray:
    """How often two bits are both set, over all fingerprints: 64 x 64, summed per task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS, BITS))
        for batch in batches:
            raw = batch.column(0).to_numpy(zero_copy_only=False).astype("<i8").view(np.uint8)
            bits = np.unpackbits(raw, bitorder="little").reshape(-1, BITS).astype(np.float32)
            total += bits.T @ bits
        yield pa.RecordBatch.from_pydict(
            {"cell": np.arange(BITS * BITS, dtype=np.int32), "n": total.reshape(-1).astype(np.int64)}
        )

    rows = marks.select("fp").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    out = np.zeros(BITS * BITS)
    for cell, n in rows.collect():
        out[cell] = n
    return out.reshape(BITS, BITS)


def bit_groups(both: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """Bits in ``parts`` groups of equal size, correlated ones together (greedy)."""
    rate = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(rate * (1 - rate), 1e-12))
    bond = np.abs(both / max(n, 1) - np.outer(rate, rate)) / np.outer(spread, spread)
    np.fill_diagonal(bond, 0)
    free, groups = set(range(BITS)), []
    for p in range(parts):
        size = BITS // parts + (p < BITS % parts)
        group: list[int] = []
        while len(group) < size:
            pull = bond[:, group or sorted(free)].sum(1)
            group.append(max(free, key=lambda b: (pull[b], -b)))
            free.remove(group[-1])
        groups.append(sorted(group))
    return groups


def _mask(bits) -> int:
    value = sum(1 << b for b in bits)
    return value - (1 << BITS) if value >> (BITS - 1) else value


def _value_counts(marks: DataFrame, groups: list[list[int]]) -> list[np.ndarray]:
    """For each group of at most 16 bits, an array of axes 2 x 2 x ... with the count of each value.

    At most 65,536 rows per group come to the driver, whatever the input's size.
    """
    each = F.explode(
        F.array(*[F.struct(F.lit(p).alias("p"), F.col("fp").bitwiseAND(F.lit(_mask(g))).alias("v")) for p, g in enumerate(groups)])
    )
    rows = marks.select(each.alias("e")).groupBy("e.p", "e.v").agg(F.count(F.lit(1)).alias("n"))
    table = rows.toPandas()
    out = []
    for p, group in enumerate(groups):
        mine = table[table.p == p]
        value = mine.v.to_numpy(np.int64).astype(np.uint64)
        place = np.zeros(len(mine), np.int64)
        for k, b in enumerate(group):
            place |= ((value >> np.uint64(b)) & np.uint64(1)).astype(np.int64) << k
        counts = np.zeros(1 << len(group), np.int64)
        counts[place] = mine.n.to_numpy(np.int64)
        out.append(counts.reshape((2,) * len(group)))
    return out


def _axis(group: list[int], bit: int) -> int:
    return len(group) - 1 - group.index(bit)


def _merged(counts: np.ndarray, group: list[int], dropped: tuple[int, ...]) -> np.ndarray:
    return counts.sum(axis=tuple(_axis(group, b) for b in dropped)) if dropped else counts


def _pairs_by_masked_bits(counts: np.ndarray, most: int) -> list[float]:
    """For 0 to ``most`` masked bits, how many pairs meet under all masks of so many bits."""
    out = [0.0] * (most + 1)

    def walk(have: np.ndarray, axis: int, bits: int, masked: int) -> None:
        out[masked] += float((have * (have - 1)).sum()) / 2
        if masked < most:
            for k in range(axis, bits):
                halves = have.reshape(1 << k, 2, -1)
                walk((halves[:, 0] + halves[:, 1]).reshape(-1), k, bits - 1, masked + 1)

    walk(counts.reshape(-1).astype(float), 0, counts.ndim, 0)
    return out


def thresholds(groups: list[list[int]], counts: list[np.ndarray], max_bits: int) -> list[int]:
    """Unequal thresholds, sum(t + 1) = max_bits + 1, with the least estimated cost."""
    n = int(counts[0].sum())
    cost = []
    for group, have in zip(groups, counts):
        pairs = _pairs_by_masked_bits(have, min(max_bits, len(group)))
        rows = [ROW_COST * n * comb(len(group), t) for t in range(len(pairs))]
        cost.append([0.0, *(x + y for x, y in zip(pairs, rows))])
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in cost:
        new: dict[int, tuple[float, list[int]]] = {}
        for spent, (total, chosen) in best.items():
            for units, extra in enumerate(row):
                key = spent + units
                if key <= max_bits + 1 and (key not in new or total + extra < new[key][0]):
                    new[key] = total + extra, [*chosen, units - 1]
        best = new
    return best[max_bits + 1][1]


def _forest(fps: np.ndarray, group: np.ndarray, block: np.ndarray, cross: np.ndarray, max_bits: int):
    """Links that connect what all pairs within the limit connect; rows are ordered by group.

    Rows of a group are compared pair by pair, in ``cross`` groups those of different blocks.
    """
    names, node = np.unique(fps, return_inverse=True)
    parent = np.arange(len(names))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    links = []
    at, step = np.arange(len(fps)), 0
    label = parent
    while len(at):
        step += 1
        at = at[at + step < len(fps)]
        at = at[group[at] == group[at + step]]
        a, b = node[at], node[at + step]
        near = (label[a] != label[b]) & (~cross[at] | (block[at] != block[at + step]))
        a, b = a[near], b[near]
        near = np.bitwise_count(names[a] ^ names[b]) <= max_bits
        changed = False
        for x, y in zip(a[near].tolist(), b[near].tolist()):
            p, q = find(x), find(y)
            if p != q:
                parent[max(p, q)] = min(p, q)
                links.append((x, y))
                changed = True
        if changed:
            label = parent
            while (label != parent[label]).any():
                label = parent[label]
    pairs = names[np.array(links, np.int64).reshape(-1, 2)].view(np.int64)
    return pa.RecordBatch.from_pydict({"a": pairs[:, 0], "b": pairs[:, 1]})


def near_links(marks: DataFrame, max_bits: int = 4, parts: int = 4) -> DataFrame:
    """a, b: links between distinct fingerprints that connect all pairs at most ``max_bits`` apart.

    ``marks`` (fp long) is a written table of distinct fingerprints. Not every pair is given:
    each task returns a spanning forest of the links it finds, so that a group of copies
    yields as many links as members. Where more than ``BLOCK`` fingerprints share a masked
    value they are cut into blocks, and each two blocks meet in a task of their own.
    """
    spark = marks.sparkSession
    n = marks.count()
    groups = bit_groups(_pair_counts(marks), n, parts)
    counts = _value_counts(marks, groups)
    limits = thresholds(groups, counts, max_bits)
    masks, crowded = [], []
    for group, have, t in zip(groups, counts, limits):
        for dropped in combinations(group, t) if t >= 0 else ():
            left = [b for b in group if b not in dropped]
            merged = _merged(have, group, dropped)
            for cell in np.argwhere(merged > BLOCK):
                value = _mask(b for b in left if cell[_axis(left, b)])
                crowded.append((len(masks), value, int(-(-merged[tuple(cell)] // BLOCK))))
            masks.append(_mask(left))
    probes = F.posexplode(F.array(*[F.lit(m) for m in masks]))
    found = marks.select("fp", probes.alias("k", "m")).select(
        "fp", "k", F.col("fp").bitwiseAND(F.col("m")).alias("v")
    )
    if crowded:
        # at most 65,536 rows for each mask, whatever the input's size
        blocks = spark.createDataFrame(crowded, "k int, v long, blocks int")
        own = F.pmod(F.xxhash64("fp"), F.coalesce("blocks", F.lit(1))).cast("int")
        found = found.join(F.broadcast(blocks), ["k", "v"], "left").withColumn("own", own)
        other = F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1))
        found = found.withColumn("other", other)
        found = found.select(
            "fp", "k", "v", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")
        )
    else:
        zero = F.lit(0)
        found = found.select("fp", "k", "v", zero.alias("own"), zero.alias("i"), zero.alias("j"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if held is not None:
                columns = [np.concatenate(x) for x in zip(held, columns)]
            # the last group may go on in the next batch
            keys = np.stack([x.astype(np.int64) for x in columns[1:5]])
            new = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1
            cut = new[-1] if len(new) else 0
            held = [x[cut:] for x in columns]
            if cut:
                yield compared([x[:cut] for x in columns])
        if held is not None and len(held[0]):
            yield compared(held)

    def compared(columns: list[np.ndarray]) -> pa.RecordBatch:
        fps, k, v, i, j, own = columns
        new = (np.diff(k) != 0) | (np.diff(v) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)
        group = np.concatenate(([0], np.cumsum(new)))
        return _forest(fps.astype(np.int64).view(np.uint64), group, own, i != j, max_bits)

    keys = ["k", "v", "i", "j"]
    dealt = found.repartition(*keys).sortWithinPartitions(*keys).select("fp", *keys, "own")
    return dealt.mapInArrow(run, "a long, b long").where("a <> b")


def _members(docs: DataFrame, doc_id: str, text: str, shingle: int, max_bits: int, parts: int) -> DataFrame:
    """id, digest (of the text), fp, root (least fingerprint of the component) and component_id."""
    source = docs.select(
        F.struct(F.col(f"`{doc_id}`").alias("id"), F.md5(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("digest")).alias("row"),
        F.col(f"`{text}`").alias("text"),
    )
    rows = written(fingerprints(source, doc_id="row", shingle=shingle).toDF("row", "fp"), "fingerprints")
    marks = written(rows.groupBy("fp").agg(F.min("row.id").alias("first")), "marks")
    roots = components(near_links(marks, max_bits, parts))
    member = marks.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    least = member.groupBy("root").agg(F.min("first").alias("component_id"))
    member = member.join(least, "root").select(F.col("fp").alias("mark"), "root", "component_id")
    return rows.join(member, F.col("fp") == F.col("mark")).select("row.*", "fp", "root", "component_id")


def near_duplicates(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    shingle: int = 4,
    max_bits: int = 4,
    parts: int = 4,
) -> DataFrame:
    """doc_id, fingerprint (long), component_id: the least doc_id that links reach, itself included.

    Documents link where their fingerprints differ in at most ``max_bits`` bits. Wordless and
    null texts have fingerprint zero and link like any other. A null doc_id gets the
    component of its fingerprint; that is null only if no document of it has an id. Repeated
    rows come back each; an empty table gives no rows. Other columns are not read.
    """
    found = _members(docs, doc_id, text, shingle, max_bits, parts)
    return found.select(F.col("id").alias(doc_id), F.col("fp").alias("fingerprint"), "component_id")


def one_of_each(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    shingle: int = 4,
    max_bits: int = 4,
    parts: int = 4,
) -> DataFrame:
    """``docs`` with one row of each component: that with the least doc_id.

    A row without doc_id stays only where no row of the component has one; of rows with equal
    doc_id the least text digest stays, and one of repeated rows.
    """
    return one_by_component(docs, _members(docs, doc_id, text, shingle, max_bits, parts), doc_id, text)


def one_by_component(docs: DataFrame, found: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``docs`` with one row of each ``root`` of ``found`` (id, digest, root)."""
    no_id, key = F.col("id").isNull(), F.coalesce(F.col("id").cast("string"), F.lit(""))
    best = found.groupBy("root").agg(F.min(F.struct(no_id.alias("_k1"), "id", "digest")).alias("b"))
    best = best.select("b.*").select("_k1", key.alias("_k2"), F.col("digest").alias("_k3"))
    docs, back = set_apart(docs, doc_id, text)
    own, keys = F.col(f"`{doc_id}`"), ["_k1", "_k2", "_k3"]
    rows = docs.withColumns(
        {
            "_k1": own.isNull(),
            "_k2": F.coalesce(own.cast("string"), F.lit("")),
            "_k3": F.md5(F.coalesce(F.col(f"`{text}`"), F.lit(""))),
        }
    )
    return back(rows.join(best, keys, "left_semi").dropDuplicates(keys))
