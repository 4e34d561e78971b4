"""Quality classifier from weak labels.

Heuristic labellers vote good (1), bad (0) or abstain (-1) on every document.
Expectation-maximisation over the counts of vote patterns (at most 3 to the number of
labellers) estimates how often each labeller is right for either class, without any true
label; it gives each pattern a posterior. These soft labels train a linear scorer over hashed
word features by logistic regression, on a sample whose size is a parameter. Votes and
scores are computed for every whole text, in two passes without a shuffle of texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetloom.llm.words import SPACED, slices, text_column, words

TEXT_BYTES = 4 << 20
TABLE = 1 << 16
_MIX = np.uint64(0x9E3779B97F4A7C15)
# Classes of bytes (letters, capitals, signs, bars, calls, digits; 0 others).
_CLASS = np.zeros(256, np.int64)
for _k, _bytes in ((1, b"abcdefghijklmnopqrstuvwxyz"), (2, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (3, b"#$%&*<>{}[]\\^~`_=+@"), (4, b"|"), (5, b"!"), (6, b"0123456789")):
    _CLASS[list(_bytes)] = _k
_CLASS[128:] = 1
LABELLERS = ("signs", "capitals", "bars", "calls", "odd_words", "marks", "stops", "variety", "repeats")
#: Table place of the share of words that equal the word before.
REPEAT = 0


def repeated(codes: np.ndarray, text_of: np.ndarray) -> np.ndarray:
    """Whether a word equals the one before it in its text."""
    out = np.zeros(len(codes), bool)
    out[1:] = (codes[1:] == codes[:-1]) & (text_of[1:] == text_of[:-1])
    return out


def votes(texts: pa.StringArray) -> np.ndarray:
    """Votes of the labellers, texts x labellers; none of them judges a text without words.

    ``signs``, ``capitals``, ``bars``, ``calls``, ``variety`` (few distinct words) and ``repeats``
    only know what is bad; ``odd_words`` (without letters, all capitals, ending in a sign, or
    equal to the word before), ``marks`` (share
    of characters that are neither letters nor digits; not asked where words repeat) and
    ``stops`` (sentence ends) vote both ways.
    """
    n = len(texts)
    raw = texts.buffers()
    edges = np.frombuffer(raw[1], np.int32, n + 1).astype(np.int64)
    data = np.frombuffer(raw[2], np.uint8)[edges[0] : edges[-1]] if raw[2] is not None else np.zeros(0, np.uint8)
    row = np.repeat(np.arange(n), np.diff(edges))
    of = np.bincount(row * 7 + _CLASS[data], minlength=7 * n).reshape(n, 7).astype(float)
    offsets, codes, names = words(texts, bytes(range(256)))
    size = np.diff(offsets)
    text_of = np.repeat(np.arange(n), size)
    kinds = np.bincount(np.unique(text_of * (len(names) + 1) + codes) // (len(names) + 1), minlength=n) if n else size

    again = repeated(codes, text_of)

    def share(regex: str, also: np.ndarray | bool = False) -> np.ndarray:
        hit = pc.match_substring_regex(names, regex).to_numpy(zero_copy_only=False)
        return np.bincount(text_of, hit[codes] | also, n) / count

    count = np.maximum(size, 1)
    letters = np.maximum(of[:, 1] + of[:, 2], 1)
    blank = np.maximum(size - 1, 0)  # spaces between words
    marks = np.maximum(of[:, 0] + of[:, 3:6].sum(1) - blank, 0) / np.maximum(of.sum(1) - blank, 1)

    def vote(value, good, bad, asked):
        """Good up to ``good`` and bad from ``bad``, where at least ``asked`` words stand."""
        return np.where(size < asked, -1, np.where(value <= good, 1, np.where(value >= bad, 0, -1)))

    stops = share(r"[.?;:]$")
    loop = np.bincount(text_of, again, n) / count
    return np.stack(
        [
            vote(of[:, 3] / count, -1, 0.2, 1),
            vote(of[:, 2] / letters, -1, 0.3, 5),
            vote(of[:, 4] / count, -1, 0.15, 1),
            vote(of[:, 5] / count, -1, 0.2, 1),
            vote(share(r"^[^\pL0-9]+$|[\pL0-9][#$%&*<>{}\[\]\\^~`_=+@|!]+$|^[A-Z]{3,}[^a-z]*$", again), 0.08, 0.2, 1),
            np.where(loop >= 0.15, -1, vote(marks, 0.06, 0.11, 1)),
            np.where(size < 20, -1, np.where((stops >= 0.02) & (stops <= 0.4), 1, np.where(stops < 0.005, 0, -1))),
            vote(1 - kinds / count, -1, 0.8, 50),
            vote(loop, -1, 0.15, 10),
        ],
        1,
    )


def pattern(v: np.ndarray) -> np.ndarray:
    """One number per row of votes."""
    return (v + 1) @ 3 ** np.arange(v.shape[1])


def fit_labels(counts: dict[int, int], size: int, rounds: int = 100) -> tuple[dict[int, float], np.ndarray, float]:
    """Posterior of good for each vote pattern, each labeller's accuracy, and the prior.

    A labeller that votes is right with its accuracy, whatever the class, and independently
    of the others; abstaining tells nothing. Accuracies start at 0.8 and stay in 0.7 to
    0.99 (eight right and two wrong votes count in advance), which names the classes.
    """
    keys = np.array(sorted(counts), np.int64)
    if not len(keys):
        return {}, np.full(size, 0.8), 0.5
    n = np.array([counts[int(k)] for k in keys], float)
    vote = keys[:, None] // 3 ** np.arange(size) % 3  # 0 abstain, 1 bad, 2 good
    good, bad = (vote == 2).astype(float), (vote == 1).astype(float)
    right, prior = np.full(size, 0.8), 0.8
    for _ in range(rounds):
        odds = (good - bad) @ np.log(right / (1 - right)) + np.log(prior / (1 - prior))
        z = 1 / (1 + np.exp(-odds))
        agree = (n * z) @ good + (n * (1 - z)) @ bad
        right = np.clip((agree + 8) / (n @ (good + bad) + 10), 0.7, 0.99)
        prior = float(np.clip((n @ z + 4) / (n.sum() + 5), 0.05, 0.95))
    return dict(zip(keys.tolist(), z.tolist())), right, prior


def _hash(data: np.ndarray, start: np.ndarray, size: np.ndarray, kind: int) -> np.ndarray:
    """Places in the table of byte runs of one array; empty runs have one of their own."""
    out = np.full(len(start), kind, np.uint64)
    some = np.flatnonzero(size > 0)
    if len(some):
        s = size[some]
        total = np.cumsum(s)
        inside = np.arange(total[-1]) - np.repeat(total - s, s)
        power = np.cumprod(np.full(int(s.max()), _MIX))[inside]
        value = (data[np.repeat(start[some], s) + inside].astype(np.uint64) + np.uint64(kind)) * power
        out[some] = np.add.reduceat(value, total - s)
    return ((out ^ (out >> np.uint64(31))) * _MIX >> np.uint64(48)).astype(np.int64)


_SHAPE = bytes(
    97 if 97 <= b <= 122 or b >= 128 else 65 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else b for b in range(256)
)


def word_features(names: pa.StringArray) -> np.ndarray:
    """Hashed word, first and last three bytes, and shape: words x 4 table places."""
    n = len(names)
    if not n:
        return np.zeros((0, 4), np.int64)
    names = pa.concat_arrays([names, pa.array([""])])
    edges = np.frombuffer(names.buffers()[1], np.int32, n + 1).astype(np.int64)
    data = np.frombuffer(names.buffers()[2], np.uint8)
    shape = np.frombuffer(data.tobytes().translate(_SHAPE), np.uint8)
    start, size = edges[:-1], np.diff(edges)
    three = np.minimum(size, 3)
    return np.stack(
        [
            _hash(data, start, size, 1), _hash(data, start, three, 2), _hash(data, start + size - three, three, 3),
            _hash(shape, start + size - np.minimum(size, 6), np.minimum(size, 6), 4),
        ],
        1,
    )


@dataclass
class Scorer:
    """Posteriors by vote pattern and the hashed weights."""

    posterior: dict[int, float]
    accuracies: np.ndarray
    prior: float
    weights: np.ndarray
    bias: float

    def __call__(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Posterior of the votes, and the score, both 0 to 1; a text without words has score 0."""
        weak = np.array([self.posterior.get(k, self.prior) for k in pattern(votes(texts)).tolist()])
        offsets, codes, names = words(texts, bytes(range(256)))
        each = self.weights[word_features(names)].sum(1)
        n = np.diff(offsets)
        text_of = np.repeat(np.arange(len(texts)), n)
        value = each[codes] + self.weights[REPEAT] * repeated(codes, text_of)
        value = np.bincount(text_of, value, len(texts)) / np.maximum(n, 1) + self.bias
        return weak, np.where(n > 0, 1 / (1 + np.exp(-np.clip(value, -500, 500))), 0.0)


def _train(rows: list[tuple[np.ndarray, np.ndarray, float]], epochs: int) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels; rows are (places, shares, label)."""
    weights, past = np.zeros(TABLE), np.full(TABLE, 1e-4)
    bias, rng = 0.0, np.random.default_rng(3)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for low in range(0, len(order), 128):
            part = [rows[i] for i in order[low : low + 128]]
            places = np.concatenate([r[0] for r in part])
            shares = np.concatenate([r[1] for r in part])
            row = np.repeat(np.arange(len(part)), [len(r[0]) for r in part])
            value = np.bincount(row, weights[places] * shares, len(part)) + bias
            error = 1 / (1 + np.exp(-np.clip(value, -500, 500))) - np.array([r[2] for r in part])
            step = np.bincount(places, error[row] * shares, TABLE) / len(part)
            past += step * step
            weights -= 0.5 * step / np.sqrt(past)
            bias -= 0.1 * error.mean()
    return weights, bias


def fit(docs: DataFrame, *, text: str = "text", sample: int = 6000, epochs: int = 8) -> Scorer:
    """Labellers' accuracies from all texts, and the scorer from at most ``sample`` of them.

    The sample is the different texts that come first by hash; it does not depend on their order,
    and a text that is a large share of the table is in it once.
    """
    source = docs.select(F.col(f"`{text}`").alias("text"))

    def voted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0, TEXT_BYTES):
                keys, n = np.unique(pattern(votes(text_column(part.column(0)))), return_counts=True)
                yield pa.RecordBatch.from_pydict({"pattern": keys, "n": n})

    found = source.mapInArrow(voted, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n"))
    counts = {int(k): int(n) for k, n in found.collect()}  # at most 3 ** 8
    posterior, accuracies, prior = fit_labels(counts, len(LABELLERS))
    few = source.where("text is not null").withColumn("hash", F.xxhash64("text"))
    different = few.agg(F.approx_count_distinct("hash")).first()[0]
    if different > 2 * sample:
        few = few.where(F.col("hash") < F.lit(2**64 * (sample + 200) // different * 5 // 4 - 2**63))
    few = few.dropDuplicates(["text"]).select("text", "hash")

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, 0, TEXT_BYTES):
                texts = text_column(piece.column(0))
                keys = pattern(votes(texts))
                offsets, codes, names = words(texts, bytes(range(256)))
                table = word_features(names)
                again = repeated(codes, np.repeat(np.arange(len(texts)), np.diff(offsets)))
                places, shares = [], []
                for a, b in zip(offsets[:-1], offsets[1:]):
                    here = np.append(table[codes[a:b]].reshape(-1), np.full(again[a:b].sum(), REPEAT))
                    at, n = np.unique(here, return_counts=True)
                    places.append(at.astype(np.int32).tobytes())
                    shares.append((n / max(b - a, 1)).astype(np.float32).tobytes())
                yield pa.RecordBatch.from_pydict({"pattern": keys, "places": places, "shares": shares, "hash": piece.column(1)})

    rows = few.mapInArrow(featured, "pattern long, places binary, shares binary, hash long")
    rows = rows.orderBy("hash", "places", "shares").limit(sample).toArrow()  # at most ``sample`` rows
    data = [
        (np.frombuffer(p, np.int32), np.frombuffer(s, np.float32), posterior[k])
        for k, p, s in zip(rows["pattern"].to_pylist(), rows["places"].to_pylist(), rows["shares"].to_pylist())
        if len(p)
    ]
    weights, bias = _train(data, epochs) if data else (np.zeros(TABLE), 0.0)
    return Scorer(posterior, accuracies, prior, weights, bias)


def score(docs: DataFrame, model: Scorer, *, text: str = "text", least: float = 0.5) -> DataFrame:
    """``docs`` with ``weak_label`` (posterior of the votes), ``quality_score`` and ``keep``.

    ``keep`` holds from ``least`` on. Null and wordless texts have score 0. Columns of
    ``docs`` with the added names are replaced; repeated rows are scored one by one; an empty
    table gives an empty one.
    """
    added = [T.StructField("weak_label", T.DoubleType()), T.StructField("quality_score", T.DoubleType()), T.StructField("keep", T.BooleanType())]
    names = [f.name for f in added]
    kept = [f for f in docs.schema.fields if f.name == text or f.name not in names]
    source = docs.select(*[docs[f"`{f.name}`"] for f in kept])
    place = [f.name for f in kept].index(text)
    left = [i for i, f in enumerate(kept) if f.name not in names]
    schema = T.StructType([kept[i] for i in left] + added)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a table of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, place, TEXT_BYTES):
                weak, value = sent.value(text_column(part.column(place)))
                columns = [part.column(i) for i in left] + [pa.array(weak), pa.array(value), pa.array(value >= least)]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return source.mapInArrow(run, schema)
