"""Language-model scores from the lattice of all subword segmentations.

The pieces of an existing vocabulary, with its scores for a start, weight every way to cut a
word: the first piece is drawn from one distribution, the following ones from another, and
a word's weight is the sum over all segmentations, by a forward recursion in log space over
its bytes. Divided by the sum of all words of its length, and times the share of that length,
it is a distribution over words. Expectation-maximisation over the distinct training words,
which resemble new words more than frequent ones do, turns the vocabulary's scores into
probabilities of this corpus. A word of the training text is also one edge of its own
lattice, with its discounted count, so that

    P(word) = (max(c - d(c), 0) + (D + 1) lattice(word)) / (N + 2)
    P(end)  = (documents + 1) / (N + 2)

with ``d(c)`` the usual discounts for counts of 1, 2, and more from the counts of counts, and
``D`` their sum over all words. This is a proper distribution over words and the end of a
text; a text's probability is the product over its words and its end.

Nothing grows with the corpus in one place: word counts are a table, summed per task before
the shuffle. Only words with at least 1 in ``2 ** 19`` of all occurrences, so at most that
many, are sent to all tasks; all others meet their counts in a join.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetloom.llm.words import SPACED, slices, words
from packetloom.session import written

TEXT_BYTES = 4 << 20
HEAVY = 1 << 19
_CELLS = 1 << 19
_NONE = -np.inf


def vocabulary(path: str) -> tuple[list[bytes], np.ndarray]:
    """Pieces in lower case and their start weights, from a SentencePiece file.

    A file with ranks for scores (merge order, falling by one) gives the weight
    1 / (rank + 3); log probabilities give their exponentials. Equal pieces add up. All single
    bytes are pieces.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    weight: dict[bytes, float] = {}
    special = (model.is_control, model.is_unknown, model.is_byte, model.is_unused)
    usual = [i for i in range(model.get_piece_size()) if not any(f(i) for f in special)]
    scores = {i: model.get_score(i) for i in usual if model.id_to_piece(i).replace("▁", "")}
    ranked = all(s == int(s) for s in scores.values())
    for i in scores:
        name = model.id_to_piece(i).replace("▁", "").encode()
        name = bytes(b + 32 if 65 <= b <= 90 else b for b in name)
        if name:
            value = 1 / (3 - scores[i]) if ranked else math.exp(scores[i])
            weight[name] = weight.get(name, 0.0) + value
    least = min(weight.values(), default=1.0)
    for b in range(256):
        weight.setdefault(bytes((b,)), least)
    names = sorted(weight)
    return names, np.array([weight[n] for n in names])


@dataclass
class Lattice:
    """Log probabilities of the pieces as first and as later pieces of a word."""

    names: list[bytes]
    first: np.ndarray
    later: np.ndarray

    @classmethod
    def started(cls, names: list[bytes], weights: np.ndarray) -> Lattice:
        p = np.log(weights / weights.sum())
        return cls(names, p, p)

    def totals(self, longest: int = 4096) -> np.ndarray:
        """Log of the summed weights of all words of each byte length; the last holds beyond it."""
        first, later = (
            np.bincount([len(n) for n in self.names], np.exp(p), self.longest + 1) for p in (self.first, self.later)
        )
        rest = np.zeros(longest + 1)
        rest[0] = 1
        for m in range(1, longest + 1):
            k = min(m, self.longest)
            rest[m] = later[1 : k + 1] @ rest[m - k : m][::-1]
        out = np.zeros(longest + 1)
        for m in range(1, longest + 1):
            k = min(m, self.longest)
            out[m] = first[1 : k + 1] @ rest[m - k : m][::-1]
        return np.log(np.maximum(out, 1e-300))

    def __post_init__(self):
        self.tables, self.long = {}, {}
        self.longest = max(map(len, self.names))
        for size in range(1, 9):
            mine = [i for i, n in enumerate(self.names) if len(n) == size]
            keys = np.array([int.from_bytes(self.names[i], "big") for i in mine], np.uint64)
            self.tables[size] = keys, np.array(mine, np.int64)  # names are sorted, so keys are
        heads = {n[:8] for n in self.names if len(n) > 8}
        self.heads = np.array(sorted(int.from_bytes(h, "big") for h in heads), np.uint64)
        self.long = {n: i for i, n in enumerate(self.names) if len(n) > 8}

    def _edges(self, m: np.ndarray) -> dict[int, np.ndarray]:
        """For each length, the piece (or -1) at each start, words x starts."""
        n, size = m.shape
        out, packed = {}, np.zeros((n, size), np.uint64)
        for k in range(1, min(8, size) + 1):
            packed = (packed[:, : size - k + 1] << np.uint64(8)) | m[:, k - 1 :]
            keys, ids = self.tables[k]
            if len(keys):
                at = np.minimum(np.searchsorted(keys, packed), len(keys) - 1)
                out[k] = np.where(keys[at] == packed, ids[at], -1)
        if size > 8 and len(self.heads):
            at = np.minimum(np.searchsorted(self.heads, packed), len(self.heads) - 1)
            raw = m.astype(np.uint8).tobytes()
            for i, j in np.argwhere(self.heads[at] == packed).tolist():
                base = i * size
                for k in range(9, min(self.longest, size - j) + 1):
                    piece = self.long.get(raw[base + j : base + j + k])
                    if piece is not None:
                        if k not in out:
                            out[k] = np.full((n, size - k + 1), -1)
                        out[k][i, j] = piece
        return out

    def _run(self, m: np.ndarray, counts: np.ndarray | None, gained: np.ndarray | None) -> np.ndarray:
        n, size = m.shape
        edges = self._edges(m)
        first, later = np.append(self.first, _NONE), np.append(self.later, _NONE)
        weight = {k: np.concatenate((first[e[:, :1]], later[e[:, 1:]]), 1) for k, e in edges.items()}
        ahead = np.full((n, size + 1), _NONE)
        ahead[:, 0] = 0
        for j in range(1, size + 1):
            ahead[:, j] = _total([ahead[:, j - k] + w[:, j - k] for k, w in weight.items() if k <= j])
        whole = ahead[:, size]
        if gained is not None:
            back = np.full((n, size + 1), _NONE)
            back[:, size] = 0
            for i in range(size - 1, -1, -1):
                back[:, i] = _total([w[:, i] + back[:, i + k] for k, w in weight.items() if i + k <= size])
            for k, w in weight.items():
                with np.errstate(invalid="ignore"):
                    p = np.exp(ahead[:, : size - k + 1] + w + back[:, k:] - whole[:, None]) * counts[:, None]
                p = np.nan_to_num(p)
                for row, part in ((0, slice(0, 1)), (1, slice(1, None))):
                    e = edges[k][:, part]
                    has = e >= 0
                    gained[row] += np.bincount(e[has], p[:, part][has], len(self.names))
        return whole

    def words(
        self, names: pa.Array, counts: np.ndarray | None = None, gained: np.ndarray | None = None
    ) -> np.ndarray:
        """Log of each word's summed segmentations; adds expected piece counts to ``gained``."""
        names = names.cast(pa.binary())
        if names.offset:
            names = pa.concat_arrays([names, pa.array([], pa.binary())])
        n = len(names)
        out = np.zeros(n)
        if not n:
            return out
        edges = np.frombuffer(names.buffers()[1], np.int32, n + 1).astype(np.int64)
        data = np.frombuffer(names.buffers()[2], np.uint8)
        sizes = np.diff(edges)
        order = np.argsort(sizes, kind="stable")
        cuts = np.flatnonzero(np.diff(sizes[order])) + 1
        for same in np.split(order, cuts):
            size = int(sizes[same[0]])
            step = max(1, _CELLS // max(size, 1))
            for a in range(0, len(same), step):
                at = same[a : a + step]
                m = data[edges[at][:, None] + np.arange(size)].astype(np.uint64)
                out[at] = self._run(m, None if counts is None else counts[at], gained)
        return out


def _total(terms: list[np.ndarray]) -> np.ndarray:
    """Log of the sum of exponentials."""
    if not terms:
        raise ValueError("every byte is a piece")
    stacked = np.stack(terms)
    top = stacked.max(0)
    with np.errstate(divide="ignore", invalid="ignore"):
        total = top + np.log(np.exp(stacked - top).sum(0))
    return np.where(np.isneginf(top), _NONE, total)


def word_counts(docs: DataFrame, text: str, training: Column) -> DataFrame:
    """word, c (in training rows), a (in all rows), as a written table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0, TEXT_BYTES):
                offsets, codes, names = words(part.column(0), SPACED)
                mine = np.repeat(part.column(1).to_numpy(zero_copy_only=False), np.diff(offsets))
                a = np.bincount(codes, minlength=len(names))
                c = np.bincount(codes[mine], minlength=len(names))
                yield pa.RecordBatch.from_arrays([names, pa.array(c), pa.array(a)], names=["word", "c", "a"])

    source = docs.select(F.col(f"`{text}`"), F.coalesce(training, F.lit(False)).alias("_t"))
    found = source.mapInArrow(run, "word string, c long, a long")
    return written(found.groupBy("word").agg(F.sum("c").alias("c"), F.sum("a").alias("a")), "word-counts")


def trained(counts: DataFrame, names: list[bytes], weights: np.ndarray, rounds: int = 2) -> Lattice:
    """The lattice after ``rounds`` of expectation-maximisation over all training words."""
    model = Lattice.started(names, weights)
    spark = counts.sparkSession
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast((model.names, model.first, model.later))  # 32,000 pieces

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            lattice = Lattice(*sent.value)
            gained = np.zeros((2, len(lattice.names)))
            for batch in batches:
                lattice.words(batch.column(0), np.ones(len(batch)), gained)
            flat = gained.reshape(-1)
            some = np.flatnonzero(flat)
            yield pa.RecordBatch.from_pydict({"i": some.astype(np.int32), "n": flat[some]})

        rows = counts.where("c > 0").select("word").mapInArrow(run, "i int, n double")
        total = np.full(2 * len(names), 0.01)
        for i, n in rows.groupBy("i").agg(F.sum("n").alias("n")).collect():  # at most two for each piece
            total[i] += n
        first, later = total.reshape(2, -1)
        model = Lattice(names, np.log(first / first.sum()), np.log(later / later.sum()))
    return model


TAIL = 256


def length_shares(counts: DataFrame) -> np.ndarray:
    """Log share of each byte length among distinct training words; the last is all from ``TAIL`` on."""
    size = F.least(F.octet_length("word"), F.lit(TAIL))
    found = counts.where("c > 0").groupBy(size.alias("k")).agg(F.count(F.lit(1)).alias("n"))
    n = np.full(TAIL + 1, 1 / TAIL)
    for k, x in found.collect():  # at most TAIL
        n[k] += x
    return np.log(n / n[1:].sum())


def length_scores(sizes: np.ndarray, shares: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """What a word's length adds to its lattice's log weight; beyond ``TAIL`` shares fall by 1 %."""
    beyond = np.maximum(sizes - TAIL, 0) * math.log(0.99) + (sizes >= TAIL) * math.log(0.01)
    return shares[np.minimum(sizes, TAIL)] + beyond - totals[np.minimum(sizes, len(totals) - 1)]


def _piece_scores(counts: DataFrame, model: Lattice, shares: np.ndarray) -> DataFrame:
    sent = counts.sparkSession.sparkContext.broadcast((model.names, model.first, model.later, shares))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        *parts, shares = sent.value
        lattice = Lattice(*parts)
        totals = lattice.totals()
        for batch in batches:
            sizes = pc.binary_length(batch.column(0)).to_numpy().astype(np.int64)
            scores = lattice.words(batch.column(0)) + length_scores(sizes, shares, totals)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], names=["word", "c", "a", "lattice"])

    return counts.mapInArrow(run, "word string, c long, a long, lattice double")


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Discounts of counts 1, 2 and more from the numbers of words that occur 1 to 4 times."""
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    raw = [k - (k + 1) * y * b / a if a else k * y for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return tuple(min(k * 0.95, max(0.05, d)) for k, d in zip((1, 2, 3), raw))


def score(
    docs: DataFrame,
    vocabulary_path: str,
    training: Column,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    rounds: int = 2,
    heavy: int = HEAVY,
) -> DataFrame:
    """doc_id, training, n_tokens, n_known, train_tokens, base_score, score, lattice_score, for every row.

    Learns from rows for which ``training`` holds (null: not) and scores all. A-Z are
    lower-cased and words split at ASCII white space; the end of a text is a token, so a null
    or empty text has one. ``score`` is log10 of the model's probability of the text,
    ``base_score`` that of add-one word counts, ``lattice_score`` that of the lattice alone, with
    the training text's share of words and ends. Repeated rows are learnt from and scored one
    by one. Without training rows all words are unknown and scored by the vocabulary alone.
    """
    spark = docs.sparkSession
    source = docs.select(
        F.col(f"`{doc_id}`").alias("id"),
        F.coalesce(training, F.lit(False)).alias("training"),
        F.col(f"`{text}`").alias("text"),
    )
    counts = word_counts(source, "text", F.col("training"))
    ends = source.where("training").count()
    times = [F.sum((F.col("c") == k).cast("long")) for k in range(1, 5)]
    sums = counts.agg(F.sum("c"), F.sum((F.col("c") > 0).cast("long")), F.sum("a"), *times).first()
    n, v, everywhere, *times = (int(x or 0) for x in sums)
    tokens, kinds = n + ends, v + (ends > 0)
    d1, d2, d3 = discounts(*times)
    spare = d1 * times[0] + d2 * times[1] + d3 * (v - times[0] - times[1]) + 1
    model = trained(counts, *vocabulary(vocabulary_path), rounds)
    base_of = (F.log10(F.col("c") + 1) - math.log10(tokens + kinds + 1)).alias("base")
    off = F.when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3)
    new = F.lit(math.log10(spare)) + F.col("lattice") / F.lit(math.log(10))
    own = F.log10(F.col("c") - off + F.lit(spare) * F.exp("lattice"))
    score_of = F.when(F.col("c") == 0, new).otherwise(own) - F.lit(math.log10(tokens + 2))
    scored = written(
        _piece_scores(counts, model, length_shares(counts)).select(
            "word", "a", base_of, score_of.alias("score"), (F.col("c") > 0).cast("int").alias("known"),
            (F.col("lattice") / F.lit(math.log(10)) + math.log10(n + 1) - math.log10(tokens + 2)).alias("lattice"),
        ),
        "word-scores",
    )
    limit = max(1, -(-everywhere // heavy))
    often = scored.where(F.col("a") >= limit).select("word", "base", "score", "known", "lattice").toArrow().combine_chunks()
    sent = spark.sparkContext.broadcast([often.column(i).combine_chunks() for i in range(5)])  # at most ``heavy`` words
    last = math.log10(ends + 1) - math.log10(tokens + 2)
    end = (math.log10(ends + 1) - math.log10(tokens + kinds + 1), last, int(ends > 0), last)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names_often, *values = sent.value
        values = [np.append(x.to_numpy(zero_copy_only=False), 0) for x in values]
        for batch in batches:
            for part in slices(batch, 1, TEXT_BYTES):
                rows = len(part)
                offsets, codes, names = words(part.column(1), SPACED)
                at = pc.fill_null(pc.index_in(names, names_often), -1).to_numpy(zero_copy_only=False)
                text_of = np.repeat(np.arange(rows), np.diff(offsets))
                sums = [np.bincount(text_of, x[at[codes]], rows) + e for x, e in zip(values, end)]
                rare = at[codes] < 0
                pair, times = np.unique(text_of[rare] * (len(names) + 1) + codes[rare], return_counts=True)
                row = np.concatenate((pair // (len(names) + 1), np.arange(rows)))
                key = part.column(0).take(pa.array(row))
                # one row per text carries what is known already; its word has a space, like none
                mark = pc.binary_join_element_wise(" ", part.column(0).cast(pa.string()), "")
                word = pa.concat_arrays([names.take(pa.array(pair % (len(names) + 1))), mark])
                none = np.arange(len(row)) < len(pair)
                n_tokens = np.diff(offsets) + 1
                columns = [key, word, pa.array(np.concatenate((times, np.zeros(rows, np.int64))).astype(np.int32))]
                for x in part.columns[2:]:
                    columns.append(pc.if_else(pa.array(none), pa.scalar(None, x.type), x.take(pa.array(row))))
                for x in (n_tokens.astype(float), *sums):
                    columns.append(pa.array(np.concatenate((np.zeros(len(pair)), x)), mask=none))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    keyed = source.withColumn("key", F.monotonically_increasing_id()).select("key", "text", "id", "training")
    schema = T._parse_datatype_string("key long, word string, times int")
    carried = [T.StructField(f.name, f.dataType, True) for f in keyed.schema.fields[2:]]
    schema = T.StructType([*schema.fields, *carried, *T._parse_datatype_string(_OWN).fields])
    parts = keyed.mapInArrow(run, schema)
    rare = scored.where(F.col("a") < limit).select(
        "word", F.col("base").alias("rare_base"), F.col("score").alias("rare_score"), "known", F.col("lattice").alias("rare_lattice")
    )
    joined = parts.join(rare, "word", "left")

    def total(own: str, each: str) -> Column:
        return F.sum(F.coalesce(F.col(own), F.col("times") * F.col(each)))

    return (
        joined.groupBy("key")
        .agg(
            F.max("id").alias(doc_id),
            F.max("training").alias("training"),
            F.max("n_tokens").cast("long").alias("n_tokens"),
            total("own_known", "known").cast("long").alias("n_known"),
            F.lit(tokens).cast("long").alias("train_tokens"),
            total("own_base", "rare_base").alias("base_score"),
            total("own_score", "rare_score").alias("score"),
            total("own_lattice", "rare_lattice").alias("lattice_score"),
        )
        .drop("key")
    )


_OWN = "n_tokens double, own_base double, own_score double, own_known double, own_lattice double"
