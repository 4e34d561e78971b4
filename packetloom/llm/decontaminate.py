"""Benchmark decontamination by suffix arrays over the training text.

Documents are cut into shards of whole texts. A shard's words are numbered, every document
is closed by an end mark of its own, and all suffixes are sorted: by their first three words
at once, then by doubling, each round only those that are still equal. Every suffix of every
benchmark item is then looked up by binary search, one word deeper at a time, until no
suffix of the shard is left: that gives its longest verbatim match, and at the length of a
window all places where the window occurs.

The benchmark is a stated query set: it goes to the tasks in blocks of bounded size, one
pass over the documents for each block. A shard is never larger than ``TEXT_BYTES``, or one
longer document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetloom.llm.words import ALNUM, slices, words

TEXT_BYTES = 8 << 20
#: Benchmark text sent to the tasks at once, in bytes.
BLOCK_BYTES = 16 << 20

_FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("longest", T.LongType()),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("hit_starts", T.ArrayType(T.IntegerType())),
        T.StructField("hit_ends", T.ArrayType(T.IntegerType())),
    ]
)
_NEW = ["n_words", "n_hit", "longest", "items", "hit_starts", "hit_ends"]


def suffix_array(codes: np.ndarray) -> np.ndarray:
    """Starts of all suffixes in order. ``codes`` end in a number that occurs nowhere else, and
    no two equal runs may reach the end (documents close with marks of their own)."""
    n = len(codes)
    size = int(codes.max()) + 2 if n else 1
    padded = np.concatenate((codes.astype(np.int64) + 1, [0, 0]))
    if size**3 < 2**63:
        key, depth = (padded[:n] * size + padded[1 : n + 1]) * size + padded[2:], 3
    else:
        key, depth = padded[:n], 1
    order = np.argsort(key)
    key = key[order]
    fresh = np.concatenate(([True], key[1:] != key[:-1])) if n else np.zeros(0, bool)
    place = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = place
    open_ = np.flatnonzero(~(fresh & np.append(fresh[1:], True)))
    while len(open_):
        mine = order[open_]
        key = rank[mine] * (n + 1) + rank[mine + depth]
        by = np.argsort(key)
        key, mine = key[by], mine[by]
        order[open_] = mine
        group = place[open_]
        fresh = np.concatenate(([True], key[1:] != key[:-1]))
        # the first of each run of equal keys keeps its own place in the whole order
        at = open_[np.maximum.accumulate(np.where(fresh, np.arange(len(key)), 0))]
        place[open_] = np.maximum(at, group)
        rank[mine] = place[open_]
        open_ = open_[~(fresh & np.append(fresh[1:], True))]
        depth *= 2
    return order


class Items:
    """A block of benchmark items: their words one after another, and their windows."""

    def __init__(self, ids: list[str], texts: list[str | None], window: int):
        self.offsets, self.codes, self.names = words(pa.array(texts, pa.string()), ALNUM)
        self.ids, self.window = np.array(ids, object), window
        sizes = np.diff(self.offsets)
        self.item = np.repeat(np.arange(len(ids)), sizes)
        self.left = np.repeat(self.offsets[1:], sizes) - np.arange(len(self.codes))
        first = np.arange(len(self.codes)) == np.repeat(self.offsets[:-1], sizes)
        #: Words of the window that starts here; 0 where none does.
        self.span = np.where(self.left >= window, window, np.where(first, self.left, 0))


class Shard:
    """Words of whole documents with the sorted order of all their suffixes."""

    def __init__(self, texts: pa.Array):
        self.offsets, codes, self.names = words(texts, ALNUM)
        rows = len(texts)
        self.base = rows  # marks take the numbers below
        marked = np.insert(codes.astype(np.int64) + rows, self.offsets[1:], np.arange(rows))
        self.codes = marked
        #: Starts in ``codes``, which hold one mark for each earlier document.
        self.starts = self.offsets[:-1] + np.arange(rows)
        self.order = suffix_array(marked)

    def _bound(self, low, high, want, depth, right):
        """First place in [low, high) whose word at ``depth`` is not below (or above) ``want``."""
        low, high = low.copy(), high.copy()
        last = len(self.codes) - 1
        while True:
            busy = np.flatnonzero(low < high)
            if not len(busy):
                return low
            mid = (low[busy] + high[busy]) >> 1
            have = self.codes[np.minimum(self.order[mid] + depth, last)]
            less = have <= want[busy] if right else have < want[busy]
            low[busy] = np.where(less, mid + 1, low[busy])
            high[busy] = np.where(less, high[busy], mid)

    def search(self, items: Items) -> tuple[np.ndarray, np.ndarray, list]:
        """For every suffix of the items: words of its longest match, a place of it in
        ``order``, and (suffixes, first, last) of the windows that occur, range by range."""
        n = len(items.codes)
        length, place = np.zeros(n, np.int64), np.zeros(n, np.int64)
        known = pc.index_in(items.names, self.names).to_numpy(zero_copy_only=False)
        known = np.where(np.isnan(known.astype(float)), -1, known).astype(np.int64)
        code = np.where(known[items.codes] >= 0, known[items.codes] + self.base, -1) if n else known[:0]
        active = np.arange(n)
        low, high = np.zeros(n, np.int64), np.full(n, len(self.order), np.int64)
        depth, hits = 0, []
        while len(active):
            going = items.left[active] > depth
            active, low, high = active[going], low[going], high[going]
            want = code[active + depth]
            low, high = self._bound(low, high, want, depth, False), self._bound(low, high, want, depth, True)
            found = (low < high) & (want >= 0)
            active, low, high = active[found], low[found], high[found]
            depth += 1
            length[active], place[active] = depth, low
            whole = items.span[active] == depth
            if whole.any():
                hits.append((active[whole], low[whole], high[whole]))
        return length, place, hits


def _pairs_of(shard: Shard, items: Items, hits: list) -> tuple[np.ndarray, np.ndarray]:
    """Item suffix and place in ``codes`` of each occurrence of each window."""
    if not hits:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    suffix, low, high = (np.concatenate(x) for x in zip(*hits))
    counts = high - low
    ends = np.cumsum(counts)
    at = np.arange(ends[-1]) + np.repeat(low - (ends - counts), counts)
    return np.repeat(suffix, counts), shard.order[at]


def _documents(shard: Shard, items: Items) -> list[dict]:
    """One row of findings per document of the shard."""
    suffix, at = _pairs_of(shard, items, shard.search(items)[2])
    span = items.span[suffix]
    edge = np.zeros(len(shard.codes) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + span, -1)
    hit = np.cumsum(edge[:-1]) > 0
    doc = np.searchsorted(shard.starts, at, "right") - 1
    sizes = np.diff(shard.offsets)
    rows = [{"n_words": int(n), "n_hit": 0, "longest": 0, "items": [], "hit_starts": [], "hit_ends": []} for n in sizes]
    # windows of one item that follow each other along a diagonal are one match
    order = np.lexsort((at, at - suffix))
    s, a, d = suffix[order], at[order], doc[order]
    same = np.zeros(len(s), bool)
    if len(s) > 1:
        same[1:] = (np.diff(a) == 1) & (np.diff(s) == 1) & (np.diff(items.item[s]) == 0)
    head = np.flatnonzero(~same)
    run = np.diff(np.append(head, len(s)))
    most = np.zeros(len(rows), np.int64)
    np.maximum.at(most, d[head], run - 1 + items.span[s[head]])
    pair = np.unique(doc * (len(items.ids) + 1) + items.item[suffix])
    for i in np.unique(doc).tolist():
        span = hit[shard.starts[i] : shard.starts[i] + sizes[i]]
        turn = np.flatnonzero(np.diff(np.concatenate(([0], span.astype(np.int8), [0]))))
        mine = pair[np.searchsorted(pair, i * (len(items.ids) + 1)) : np.searchsorted(pair, (i + 1) * (len(items.ids) + 1))]
        rows[i] |= {
            "n_hit": int(span.sum()), "longest": int(most[i]),
            "items": sorted(set(items.ids[mine % (len(items.ids) + 1)].tolist())),
            "hit_starts": turn[::2].tolist(), "hit_ends": turn[1::2].tolist(),
        }
    return rows


def _joined(old: dict, new: dict) -> dict:
    """Findings of one document from two blocks of items."""
    edges = sorted(zip(old["hit_starts"] + new["hit_starts"], old["hit_ends"] + new["hit_ends"]))
    starts, ends = [], []
    for a, b in edges:
        if starts and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return {
        "n_words": new["n_words"], "n_hit": sum(ends) - sum(starts), "longest": max(old["longest"], new["longest"]),
        "items": sorted({*old["items"], *new["items"]}), "hit_starts": starts, "hit_ends": ends,
    }


def benchmark_blocks(benchmark: DataFrame, item_id: str, text: str, most: int) -> Iterator[tuple[list, list]]:
    """Item ids (as text; ``null`` for none) and texts, in blocks of about ``most`` bytes."""
    ids, texts, size = [], [], 0
    rows = benchmark.select(F.coalesce(F.col(f"`{item_id}`").cast("string"), F.lit("null")), F.col(f"`{text}`"))
    for name, body in rows.toLocalIterator():
        if ids and size + len(body or "") > most:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(name)
        texts.append(body)
        size += len(body or "")
    yield ids, texts


def find_benchmark(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = 10,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``docs`` with what each whole text shares with the benchmark.

    Words are runs of a-z, 0-9 and non-ASCII characters after lower-casing A-Z. A window is
    ``window`` consecutive words of an item, or all words of a shorter one. Added columns:
    ``n_words``; ``n_hit`` (words inside any occurrence of a window); ``longest`` (words of
    the longest verbatim match of at least a window); ``items`` (ids, as sorted text, of
    items with an occurring window); ``hit_starts`` and ``hit_ends`` (word ranges). A null or
    empty text has no words; items without words have no window. Items that share an id
    count once. Columns of ``docs`` with the added names are replaced; repeated rows are
    searched one by one.
    """
    spark = docs.sparkSession
    kept = [f for f in docs.schema.fields if f.name == text or f.name not in _NEW]
    source = docs.select(*[docs[f"`{f.name}`"] for f in kept])
    place = [f.name for f in kept].index(text)
    left = [i for i, f in enumerate(kept) if f.name not in _NEW]
    carry = T.StructType([*kept, T.StructField("_found", _FOUND)])

    def searched(sent, first: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = Items(*sent.value, window)
            for batch in batches:
                for part in slices(batch, place, TEXT_BYTES):
                    rows = _documents(Shard(part.column(place)), items)
                    if not first:
                        rows = [_joined(o, n) for o, n in zip(part.column(len(kept)).to_pylist(), rows)]
                    columns = [*part.columns[: len(kept)], pa.array(rows, _ARROW)]
                    yield pa.RecordBatch.from_arrays(columns, names=carry.names)

        return run

    first = True
    for block in benchmark_blocks(benchmark, item_id, item_text, block_bytes):
        # a block of at most block_bytes, or one longer item
        source = source.mapInArrow(searched(spark.sparkContext.broadcast(block), first), carry)
        first = False
    return source.select(*[F.col(f"`{kept[i].name}`") for i in left], "_found.*")


_ARROW = pa.struct(
    {
        "n_words": pa.int64(), "n_hit": pa.int64(), "longest": pa.int64(), "items": pa.list_(pa.string()),
        "hit_starts": pa.list_(pa.int32()), "hit_ends": pa.list_(pa.int32()),
    }
)


def longest_matches(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    min_words: int = 2,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """item_id, start, words, doc_id, at: for every suffix of every item (``start`` in words)
    its longest verbatim match of at least ``min_words`` in any shard, and one place of it."""
    spark = docs.sparkSession
    out = "item_id string, start long, words long, doc_id string, at long"
    source = docs.select(F.col(f"`{doc_id}`").cast("string"), F.col(f"`{text}`"))
    all_found = spark.createDataFrame([], out)
    for block in benchmark_blocks(benchmark, item_id, item_text, block_bytes):
        sent = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            items = Items(*sent.value, 1)
            for batch in batches:
                for part in slices(batch, 1, TEXT_BYTES):
                    shard = Shard(part.column(1))
                    words_, place, _ = shard.search(items)
                    good = np.flatnonzero(words_ >= min_words)
                    at = shard.order[place[good]]
                    doc = np.searchsorted(shard.starts, at, "right") - 1
                    yield pa.RecordBatch.from_pydict(
                        {
                            "item_id": pa.array(items.ids[items.item[good]].tolist(), pa.string()),
                            "start": good - items.offsets[items.item[good]],
                            "words": words_[good],
                            "doc_id": part.column(0).take(pa.array(doc)),
                            "at": at - shard.starts[doc],
                        }
                    )

        all_found = all_found.union(source.mapInArrow(run, out))
    best = F.max_by(F.struct("words", "doc_id", "at"), F.struct("words", -F.col("at"))).alias("b")
    return all_found.groupBy("item_id", "start").agg(best).select("item_id", "start", "b.*")
