"""Ranked lexical search with range-maximum tables over posting lists.

Documents are indexed in shards, ordered by id. A shard's postings of the items' terms lie term
after term, each with its impact, that is what the term adds to the document's score. A sparse
table over them gives the place of the greatest impact of any range of a list in two lookups.

An interval of documents cannot score more than the sum of the range maxima of an item's
lists in it. The search keeps intervals by that bound, best first: an interval is split at the
document that has its greatest single impact, this document is scored, and the two parts get
bounds of their own. Intervals go once they cannot reach the item's k-th best score, or only
equal it with greater ids. Some intervals of every item are split in one go, in arrays. What
a task has found in one shard bounds its next ones.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from packetloom.llm.words import ALNUM, slices, text_column, words

TEXT_BYTES = 4 << 20
#: Text of items that is searched for in one pass; further blocks make further passes.
BLOCK_BYTES = 4 << 20
#: Intervals of an item that are split at once, at most.
WAVE = 64
#: Parts in which the answers of tasks are ranked first.
PARTS = 64


class Items:
    """A block of items: their ids and distinct terms with repeats."""

    def __init__(self, ids: pa.Array, texts: list[str | None]):
        offsets, codes, names = words(pa.array(texts, pa.string()), ALNUM)
        self.ids, self.terms = ids, names
        item = np.repeat(np.arange(len(ids)), np.diff(offsets))
        pair, self.repeats = np.unique(item * max(len(names), 1) + codes, return_counts=True)
        self.item, self.term = np.divmod(pair, max(len(names), 1))


def _postings(texts: pa.Array, terms: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text, and term, text and occurrences of the terms' postings, by term and text."""
    offsets, codes, names = words(texts, ALNUM)
    sizes = np.diff(offsets)
    if not len(terms) or not len(names):
        return sizes, *(np.zeros(0, np.int64) for _ in range(3))
    known = pc.fill_null(pc.index_in(names, value_set=terms), -1).to_numpy()[codes].astype(np.int64)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    at = np.flatnonzero(known >= 0)
    pair, times = np.unique(known[at] * len(sizes) + doc[at], return_counts=True)
    return sizes, *np.divmod(pair, len(sizes)), times


def statistics(docs: DataFrame, text: str, items: Items) -> tuple[int, int, np.ndarray]:
    """Documents with a word, words of all documents, and documents with each term."""
    sent = docs.sparkSession.sparkContext.broadcast(items.terms)  # terms of one block of items

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = sent.value
        n = total = 0
        df = np.zeros(len(terms), np.int64)
        for batch in batches:
            for part in slices(batch, 0, TEXT_BYTES):
                sizes, term, _, _ = _postings(part.column(0), terms)
                n += int((sizes > 0).sum())
                total += int(sizes.sum())
                df += np.bincount(term, minlength=len(terms))
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict({"term": np.concatenate(([-2, -1], some)), "n": np.concatenate(([n, total], df[some]))})

    rows = docs.select(f"`{text}`").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    found = dict(rows.collect())  # one row per term of the block
    df = np.zeros(len(items.terms), np.int64)
    for term, n in found.items():
        if term >= 0:
            df[term] = n
    return found.get(-2, 0), found.get(-1, 0), df


def impact(weight: np.ndarray, tf: np.ndarray, n_words: np.ndarray, docs: int, total: int) -> np.ndarray:
    """What a term adds to a document's score, in whole numbers."""
    m = 75 + (25 * n_words.astype(np.int64) * docs) // total
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 12 * m))


class Shard:
    """Postings of the terms in some documents, ordered by id, with their sparse table."""

    def __init__(self, doc_ids: np.ndarray, term: np.ndarray, doc: np.ndarray, gain: np.ndarray):
        self.ids, self.term, self.doc, self.gain = doc_ids, term, doc, gain
        self.size = len(doc_ids)
        self.keys = term * self.size + doc
        longest = int(np.bincount(term).max()) if len(term) else 0
        self.table = [np.arange(len(gain), dtype=np.int32)]
        while 2 << (len(self.table) - 1) <= longest:
            half, last = 1 << (len(self.table) - 1), self.table[-1]
            a, b = last[:-half], last[half:]
            # what would end behind the postings is never looked up
            self.table.append(np.concatenate((np.where(gain[a] >= gain[b], a, b), last[len(a) :])))
        self.levels = np.stack(self.table)

    def greatest(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Place of the greatest gain in each range of postings (not empty), the first of equals."""
        level = np.frexp((b - a).astype(np.float64))[1] - 1
        one, two = self.levels[level, a], self.levels[level, b - (1 << level)]
        return np.where(self.gain[one] >= self.gain[two], one, two)


class Frontier:
    """Intervals of documents, each with the ranges of its item's lists in it."""

    def __init__(self, shard: Shard, item, low, first, a, b, times):
        """``first`` is where each interval's ranges begin; intervals without ranges are left out."""
        self.item, self.low, self.first, self.a, self.b, self.times = item, low, first, a, b, times
        place = shard.greatest(a, b)
        gain = times * shard.gain[place]
        if len(item):
            self.bound = np.add.reduceat(gain, first)
            top = np.maximum.reduceat(gain, first)
            sizes = np.diff(np.append(first, len(a)))
            best = np.flatnonzero(gain == np.repeat(top, sizes))
            best = best[np.searchsorted(best, first)]
            self.split = shard.doc[place[best]]
        else:
            self.bound = self.split = np.zeros(0, np.int64)

    def take(self, rows: np.ndarray) -> "Frontier":
        out = object.__new__(Frontier)
        sizes = np.diff(np.append(self.first, len(self.a)))[rows]
        out.first = np.cumsum(sizes) - sizes
        at = np.repeat(self.first[rows] - out.first, sizes) + np.arange(sizes.sum())
        for name in ("item", "low", "bound", "split"):
            setattr(out, name, getattr(self, name)[rows])
        for name in ("a", "b", "times"):
            setattr(out, name, getattr(self, name)[at])
        return out

    def joined(self, other: "Frontier") -> "Frontier":
        out = object.__new__(Frontier)
        for name in ("item", "low", "bound", "split", "a", "b", "times"):
            setattr(out, name, np.concatenate((getattr(self, name), getattr(other, name))))
        out.first = np.concatenate((self.first, other.first + len(self.a)))
        return out


class Best:
    """The best answers to each item so far: score falling, then id rising."""

    def __init__(self, items: int, answers: int):
        self.answers = answers
        self.item = self.score = self.doc_id = np.zeros(0, np.int64)
        self.least = np.zeros(items, np.int64)
        self.last_id = np.full(items, np.iinfo(np.int64).max)

    def add(self, item: np.ndarray, score: np.ndarray, doc_id: np.ndarray) -> None:
        item, score, doc_id = (np.concatenate(x) for x in ((self.item, item), (self.score, score), (self.doc_id, doc_id)))
        order = np.lexsort((doc_id, -score, item))
        item, score, doc_id = item[order], score[order], doc_id[order]
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        keep = rank < self.answers
        self.item, self.score, self.doc_id = item[keep], score[keep], doc_id[keep]
        last = rank == self.answers - 1
        self.least[item[last]], self.last_id[item[last]] = score[last], doc_id[last]


def search(shard: Shard, items: Items, best: Best) -> int:
    """Adds to ``best`` what the shard has for the items; how many documents were scored."""
    begin = np.searchsorted(shard.term, items.term, "left")
    end = np.searchsorted(shard.term, items.term, "right")
    some = begin < end
    item, a, b, times = items.item[some], begin[some], end[some], items.repeats[some]
    of, first = np.unique(item, return_index=True)
    front = Frontier(shard, of, np.zeros(len(of), np.int64), first, a, b, times)
    wave, scored = 1, 0
    while True:
        least = best.least[front.item]
        hope = (front.bound > least) | ((front.bound == least) & (shard.ids[front.low] < best.last_id[front.item]))
        order = np.flatnonzero(hope)
        if not len(order):
            return scored
        order = order[np.lexsort((front.low[order], -front.bound[order], front.item[order]))]
        rank = np.arange(len(order)) - np.searchsorted(front.item[order], front.item[order])
        now, later = front.take(order[rank < wave]), front.take(order[rank >= wave])
        wave = min(2 * wave, WAVE)
        # score the documents where intervals are split
        sizes = np.diff(np.append(now.first, len(now.a)))
        node = np.repeat(np.arange(len(sizes)), sizes)
        x = now.split[node]
        cut = np.searchsorted(shard.keys, shard.term[now.a] * shard.size + x)
        has = (cut < now.b) & (shard.doc[np.minimum(cut, len(shard.doc) - 1)] == x)
        gain = np.where(has, now.times * shard.gain[np.minimum(cut, len(shard.gain) - 1)], 0)
        best.add(now.item, np.add.reduceat(gain, now.first), shard.ids[now.split])
        scored += len(now.item)
        # the parts before and behind them
        node = np.concatenate((2 * node, 2 * node + 1))
        a, b = np.concatenate((now.a, cut + has)), np.concatenate((cut, now.b))
        times = np.concatenate((now.times, now.times))
        keep = np.flatnonzero(a < b)
        keep = keep[np.argsort(node[keep], kind="stable")]
        name, first = np.unique(node[keep], return_index=True)
        low = np.where(name % 2, now.split[name // 2] + 1, now.low[name // 2])
        front = later.joined(Frontier(shard, now.item[name // 2], low, first, a[keep], b[keep], times[keep]))


def item_blocks(items: DataFrame, item_id: str, text: str, most: int) -> Iterator[Items]:
    """Items in blocks of about ``most`` bytes of text, or one longer item."""
    rows = items.select(F.col(f"`{item_id}`"), F.col(f"`{text}`")).distinct()
    kind = to_arrow_type(rows.schema[0].dataType)
    ids, texts, size = [], [], 0
    for name, body in rows.toLocalIterator():
        if ids and size + len(body or "") > most:
            yield Items(pa.array(ids, kind), texts)
            ids, texts, size = [], [], 0
        ids.append(name)
        texts.append(body)
        size += len(body or "")
    if ids:
        yield Items(pa.array(ids, kind), texts)


def ranked_documents(
    docs: DataFrame,
    items: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    answers: int = 20,
    text_bytes: int = TEXT_BYTES,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """item_id, rank, doc_id (long), score (long): each item's highest-scoring documents.

    Terms are runs of a-z, 0-9 and non-ASCII characters after lower-casing A-Z, over whole
    texts. With N documents that have a term, L terms in all, n in the document, df documents
    with the term and tf occurrences, a term's weight is floor(1000 ln((2N+2)/(2df+1))), a
    document's m is 75 + 25nN div L, and its score sums weight * (10^9 tf div (1000 tf + 12 m))
    over the item's terms with repeats. Documents that score 0 are no answers; equal scores
    rank by smaller id.

    Null and empty texts have no terms. Documents without an integer id count in the statistics
    but are no answers. Repeated rows of documents are documents each, also as answers. Repeated
    rows of items count once; of rows with equal item_id and other texts each is ranked for
    itself. Empty tables give no rows; other columns are not read. Items are read in
    blocks, each of which makes one pass for its statistics and one for the search.
    """
    spark = docs.sparkSession
    out = T.StructType(
        [T.StructField("item", T.LongType()), T.StructField("item_id", items.schema[item_id].dataType),
         T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())]
    )
    source = docs.select(F.col(f"`{doc_id}`").cast("long"), F.col(f"`{text}`"))
    found = spark.createDataFrame([], out)
    for block, asked in enumerate(item_blocks(items, item_id, item_text, block_bytes)):
        n, total, df = statistics(docs, text, asked)
        if not n:
            continue
        weight = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * int(x) + 1))) for x in df], np.int64)
        sent = spark.sparkContext.broadcast((asked, weight, n, total, block))
        found = found.unionByName(source.mapInArrow(_searcher(sent, answers, text_bytes), out))
    rank = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "doc_id"))
    part = F.pmod(F.xxhash64("doc_id"), F.lit(PARTS))
    found = found.withColumn("part", part).withColumn("rank", rank("item", "part")).where(F.col("rank") <= answers)
    found = found.withColumn("rank", rank("item")).where(F.col("rank") <= answers)
    return found.select("item_id", "rank", "doc_id", "score")


def _searcher(sent, answers: int, text_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weight, n, total, block = sent.value
        best = Best(len(items.ids), answers)
        for batch in batches:
            for part in slices(batch, 1, text_bytes):
                known = pc.is_valid(part.column(0))
                part = part.filter(known) if pc.any(pc.invert(known)).as_py() else part
                part = part.take(pc.array_sort_indices(part.column(0)))
                sizes, term, doc, times = _postings(text_column(part.column(1)), items.terms)
                gain = impact(weight[term], times, sizes[doc], n, total)
                some = gain > 0
                if some.any():
                    shard = Shard(part.column(0).to_numpy(), term[some], doc[some], gain[some])
                    search(shard, items, best)
        yield pa.RecordBatch.from_arrays(
            [pa.array(best.item + (block << 32)), items.ids.take(pa.array(best.item)), pa.array(best.doc_id), pa.array(best.score)],
            names=["item", "item_id", "doc_id", "score"],
        )

    return run
