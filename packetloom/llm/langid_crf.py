"""Language of every word of code-switched text by a linear-chain conditional random field.

A word's score for each language is a sum of learned weights: its prefixes and suffixes of one
to four bytes, its three-byte runs, the word itself (all hashed into one table) and the
languages whose lexicon holds it. Learned transition scores join neighbouring words, and
forward-backward gives each word's label probabilities. A document's language is the one
with the largest mean probability over its words with letters.

Fitting takes a sample whose size is a parameter: for each language the ``per_language``
labelled rows that come first by hash, and at most ``words_each`` words of each, in runs spread
over the whole text. Training sequences join runs of several rows, so that transitions
between languages occur. Prediction is one pass over whole texts without a shuffle.

Long texts do not lengthen the recursion: texts are cut into runs of ``RUN`` words, the
transfer matrices of all runs are multiplied side by side, the few matrices of each text are
chained, and all runs are then labelled side by side.
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

from packetloom.llm.tables import first_by_hash
from packetloom.llm.words import SPACED, slices, words

TEXT_BYTES = 4 << 20
TABLE = 1 << 16
RUN = 32
UNKNOWN = "und"
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _hashed(codes: np.ndarray, kind: int) -> np.ndarray:
    mixed = (codes + np.uint64(kind << 56)) * _MIX
    return ((mixed ^ (mixed >> np.uint64(29))) * _MIX >> np.uint64(48)).astype(np.int64)


def bare(names: pa.StringArray) -> pa.StringArray:
    """Words without anything but letters, marks and apostrophes, in lower case."""
    return pc.utf8_lower(pc.replace_substring_regex(names, r"[^\pL\pM']+", ""))


def features(names: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of each word: row offsets and table places."""
    n = len(names)
    flat = pc.binary_join_element_wise("^", names, "$", "")
    flat = pa.concat_arrays([flat, pa.array(["", "\0\0\0\0"])])
    edges = np.frombuffer(flat.buffers()[1], np.int32, n + 1).astype(np.int64)
    data = np.frombuffer(flat.buffers()[2], np.uint8).astype(np.uint64)
    start, size = edges[:-1], np.diff(edges)
    out, owner = [], []
    at = np.arange(edges[-1]) if n else np.zeros(0, np.int64)
    word = np.repeat(np.arange(n), size)
    inside = at + 3 <= edges[1:][word]
    at, word = at[inside], word[inside]
    out.append(_hashed(data[at] | data[at + 1] << np.uint64(8) | data[at + 2] << np.uint64(16), 1))
    owner.append(word)
    for k in range(1, 5):
        long = np.flatnonzero(size >= k + 2)
        for kind, first in ((1 + k, start[long] + 1), (5 + k, start[long] + size[long] - 1 - k)):
            code = np.zeros(len(long), np.uint64)
            for i in range(k):
                code |= data[first + i] << np.uint64(8 * i)
            out.append(_hashed(code, kind))
            owner.append(long)
    if n:
        place = np.arange(edges[-1]) - np.repeat(start, size)
        power = np.cumprod(np.full(int(size.max()), _MIX))[place]
        whole = np.add.reduceat((data[: edges[-1]] + np.uint64(1)) * power, start)
        out.append(_hashed(whole & np.uint64((1 << 56) - 1), 10))
        owner.append(np.arange(n))
    owner = np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return np.searchsorted(owner[order], np.arange(n + 1)), np.concatenate(out)[order]


@dataclass
class Crf:
    """A fitted model; ``lexicon_of`` has a row of 0 and 1 per lexicon word."""

    languages: list[str]
    weights: np.ndarray
    lexicon: list[str]
    lexicon_of: np.ndarray
    lexicon_weights: np.ndarray
    moves: np.ndarray

    def scores(self, names: pa.StringArray) -> np.ndarray:
        """Words x languages."""
        names = bare(names)
        if not len(names):
            return np.zeros((0, len(self.languages)), np.float32)
        offsets, places = features(names)
        out = np.add.reduceat(self.weights[places], offsets[:-1])
        at = pc.fill_null(pc.index_in(names, pa.array(self.lexicon, pa.string())), -1)
        at = at.to_numpy(zero_copy_only=False)
        has = at >= 0
        out[has] += self.lexicon_of[at[has]] @ self.lexicon_weights
        out[pc.equal(names, "").to_numpy(zero_copy_only=False)] = 0
        return out

    def marginals(self, scores: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Label probabilities of every word; rows of ``scores`` are the texts' words in order."""
        n, size = len(scores), len(self.languages)
        lengths = np.diff(offsets)
        runs = -(-lengths // RUN)
        total = int(runs.sum())
        if not n:
            return np.zeros((0, size))
        first_run = np.cumsum(runs) - runs
        text = np.repeat(np.arange(len(lengths)), lengths)
        inside = np.arange(n) - offsets[text]
        slot = (first_run[text] + inside // RUN) * RUN + inside % RUN
        e = np.ones((total * RUN, size))
        e[slot] = np.exp(scores - scores.max(1, keepdims=True))
        e = np.ascontiguousarray(e.reshape(total, RUN, size).transpose(1, 0, 2))
        used = np.zeros(total * RUN, bool)
        used[slot] = True
        used = used.reshape(total, RUN).T
        opens = np.zeros(total, bool)
        opens[first_run[lengths > 0]] = True
        a = np.exp(self.moves - self.moves.max())
        # a step multiplies by the moves, but for a text's first word and behind its last
        step = used.copy()
        step[0] &= ~opens
        matrix = np.broadcast_to(np.eye(size), (total, size, size)).copy()
        for t in range(RUN):
            matrix = np.where(step[t][:, None, None], matrix @ a, matrix) * e[t][:, None, :]
            matrix /= matrix.max((1, 2), keepdims=True)
        enter, leave = np.ones((total, size)), np.ones((total, size))
        order = np.argsort(-runs, kind="stable")
        most = int(runs.max())
        count = np.searchsorted(-runs[order], -np.arange(most), "left")  # texts with more than k runs
        for k in range(1, most):
            at = first_run[order[: count[k]]] + k
            x = np.einsum("ri,rij->rj", enter[at - 1], matrix[at - 1])
            enter[at] = x / x.max(1, keepdims=True)
        for k in range(most - 2, -1, -1):
            at = first_run[order[: count[k + 1]]] + k
            x = np.einsum("rij,rj->ri", matrix[at + 1], leave[at + 1])
            leave[at] = x / x.max(1, keepdims=True)
        forward, now = np.empty_like(e), enter
        for t in range(RUN):
            now = np.where(step[t][:, None], now @ a, now) * e[t]
            now /= now.max(1, keepdims=True)
            forward[t] = now
        now = leave
        for t in range(RUN - 1, -1, -1):
            forward[t] *= now
            now = now * e[t]
            now = np.where(step[t][:, None], now @ a.T, now)
            now /= now.max(1, keepdims=True)
        out = forward.transpose(1, 0, 2).reshape(total * RUN, size)[slot]
        return out / out.sum(1, keepdims=True)


def _sample(labelled: DataFrame, text: str, lang: str, per_language: int, words_each: int) -> list:
    """(language, words) of at most ``per_language`` different texts a language."""
    rows = labelled.select(F.col(f"`{lang}`").alias("lang"), F.col(f"`{text}`").alias("text"))
    rows = rows.where("lang is not null and text is not null")
    rows = first_by_hash(rows, "lang", ["text"], per_language)
    all_words = F.split(F.trim("text"), r"\s+")
    each, runs = words_each // 8, 8
    spread = F.flatten(
        F.transform(
            F.sequence(F.lit(0), F.lit(runs - 1)),
            lambda i: F.slice("w", (i * (F.size("w") - each) / (runs - 1)).cast("int") + 1, F.lit(each)),
        )
    )
    taken = F.when(F.size("w") <= words_each, F.col("w")).otherwise(spread)
    return rows.withColumn("w", all_words).select("lang", taken.alias("w")).orderBy("lang", "w").collect()


def fit(
    labelled: DataFrame,
    *,
    text: str = "text",
    lang: str = "lang",
    per_language: int = 150,
    words_each: int = 400,
    epochs: int = 3,
    lexicon_words: int = 500,
    seed: int = 7,
) -> Crf:
    """A model from rows with a language; rows without one, or without text, are not used.

    Without any labelled row the model knows no language and finds ``und`` everywhere.
    """
    rows = [(r.lang, r.w) for r in _sample(labelled, text, lang, per_language, words_each) if r.w]
    names = sorted({r[0] for r in rows})
    size = len(names)
    if not size:
        return Crf([], np.zeros((TABLE, 0), np.float32), [], np.zeros((0, 0)), np.zeros((0, 0)), np.zeros((0, 0)))
    rng = np.random.default_rng(seed)
    flat = pa.array([w for _, ws in rows for w in ws], pa.string()).dictionary_encode()
    kinds = bare(flat.dictionary)
    code = flat.indices.to_numpy()
    lengths = np.array([len(ws) for _, ws in rows])
    begins = np.cumsum(lengths) - lengths
    label = np.array([names.index(x) for x, _ in rows])
    of_word = np.repeat(label, lengths)
    # lexicon: a language's most frequent words of which it has most occurrences
    counts = np.zeros((len(kinds), size))
    np.add.at(counts, (code, of_word), 1)
    share = counts / np.maximum(counts.sum(1, keepdims=True), 1)
    chosen: dict[str, np.ndarray] = {}
    texts = kinds.to_pylist()
    for k in range(size):
        for i in np.argsort(-counts[:, k], kind="stable")[:lexicon_words]:
            if texts[i] and share[i, k] > 0.5:
                chosen.setdefault(texts[i], np.zeros(size))[k] = 1
    lexicon = list(chosen)
    lexicon_of = np.array([chosen[w] for w in lexicon]).reshape(-1, size)
    offsets, places = features(kinds)
    in_lexicon = pc.fill_null(pc.index_in(kinds, pa.array(lexicon, pa.string())), -1).to_numpy(zero_copy_only=False)
    weights = np.zeros((TABLE, size))
    words_w, moves = np.zeros((size, size)), np.zeros((size, size))
    past = [np.full_like(x, 1e-2) for x in (weights, words_w, moves)]
    width, batch = 64, 64
    for _ in range(max(1, epochs) * max(1, -(-len(code) // (width * batch)))):
        at, gold = np.zeros((width, batch), np.int64), np.zeros((width, batch), np.int64)
        for b in range(batch):
            cuts = sorted(rng.integers(1, width, rng.integers(0, 3)).tolist())
            for i, j in zip([0, *cuts], [*cuts, width]):
                d = int(rng.integers(len(rows)))
                place = begins[d] + (int(rng.integers(lengths[d])) + np.arange(j - i)) % lengths[d]
                at[i:j, b], gold[i:j, b] = code[place], label[d]
        kind, back = np.unique(at, return_inverse=True)
        span = offsets[kind + 1] - offsets[kind]
        own = np.repeat(np.arange(len(kind)), span)
        feat = places[np.arange(len(own)) + np.repeat(offsets[kind] - (np.cumsum(span) - span), span)]
        known = in_lexicon[kind] >= 0
        lex = np.where(known[:, None], lexicon_of[in_lexicon[kind]] if lexicon else 0.0, 0.0)
        score = np.stack([np.bincount(own, weights[feat, k], len(kind)) for k in range(size)], 1)
        e = np.exp((s := (score + lex @ words_w)[back.reshape(width, batch)]) - s.max(2, keepdims=True))
        a = np.exp(moves)
        forward, backward = np.empty_like(e), np.ones_like(e)
        forward[0] = e[0] / e[0].sum(1, keepdims=True)
        for t in range(1, width):
            forward[t] = (forward[t - 1] @ a) * e[t]
            forward[t] /= forward[t].sum(1, keepdims=True)
        for t in range(width - 2, -1, -1):
            backward[t] = (backward[t + 1] * e[t + 1]) @ a.T
            backward[t] /= backward[t].sum(1, keepdims=True)
        p = forward * backward
        p /= p.sum(2, keepdims=True)
        pair = forward[:-1, :, :, None] * a * (backward[1:] * e[1:])[:, :, None, :]
        pair /= pair.sum((2, 3), keepdims=True)
        seen = np.zeros((size, size))
        np.add.at(seen, (gold[:-1].ravel(), gold[1:].ravel()), 1)
        error = (p - np.eye(size)[gold]).reshape(-1, size)
        by_kind = np.stack([np.bincount(back.ravel(), error[:, k], len(kind)) for k in range(size)], 1)
        steps = [
            np.stack([np.bincount(feat, by_kind[own, k], TABLE) for k in range(size)], 1),
            lex.T @ by_kind,
            pair.sum((0, 1)) - seen,
        ]
        for x, step, old in zip((weights, words_w, moves), steps, past):
            step = step / (width * batch)
            old += step * step * 1e4
            x -= 0.3 * step * 1e2 / np.sqrt(old)
    return Crf(names, weights.astype(np.float32), lexicon, lexicon_of, words_w, moves)


_SPAN = "array<struct<start:int,end:int,lang:string>>"


def identify(docs: DataFrame, model: Crf, *, text: str = "text", spans: bool = True) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (its mean probability, 0 to 1) and ``spans``.

    ``spans`` are the runs of words (white-space separated, numbered from 0) with one most
    likely language. A text that is null or has no letter is ``und`` with score 0 and no
    spans. Nothing but the text is read for a prediction; columns of ``docs`` with the
    added names are replaced; repeated rows are labelled one by one.
    """
    added = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    if spans:
        added = added.add("spans", T._parse_datatype_string(_SPAN))
    kept = [f for f in docs.schema.fields if f.name == text or f.name not in added.names]
    source = docs.select(*[docs[f"`{f.name}`"] for f in kept])
    place = [f.name for f in kept].index(text)
    left = [i for i, f in enumerate(kept) if f.name not in added.names]
    schema = T.StructType([kept[i] for i in left] + added.fields)
    # the table of hashed weights has a fixed size
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf: Crf = sent.value
        labels = np.array([*crf.languages, UNKNOWN], object)
        size = len(crf.languages)
        for batch in batches:
            for part in slices(batch, place, TEXT_BYTES):
                offsets, codes, names = words(part.column(place), SPACED)
                letters = pc.match_substring_regex(names, r"\pL").to_numpy(zero_copy_only=False)[codes]
                text_of = np.repeat(np.arange(len(part)), np.diff(offsets))
                p = crf.marginals(crf.scores(names)[codes], offsets) if size else np.zeros((len(codes), 0))
                sums = [np.bincount(text_of[letters], p[letters, k], len(part)) for k in range(size)]
                sums = np.stack([*sums, np.full(len(part), 1e-300)], 1)
                n = np.bincount(text_of[letters], minlength=len(part))
                best = sums.argmax(1)
                score = np.where(n > 0, sums[np.arange(len(part)), best] / np.maximum(n, 1), 0.0)
                score = np.where(best == size, 0.0, np.clip(score, 0.0, 1.0))
                columns = [part.column(i) for i in left]
                columns += [pa.array(labels[best].tolist(), pa.string()), pa.array(score)]
                if spans:
                    columns.append(_spans(p, offsets, text_of, best == size, labels))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return source.mapInArrow(run, schema)


def _spans(p: np.ndarray, offsets: np.ndarray, text_of: np.ndarray, none: np.ndarray, labels: np.ndarray) -> pa.Array:
    n = len(text_of)
    top = p.argmax(1) if p.shape[1] else np.zeros(n, np.int64)
    new = np.ones(n, bool)
    new[1:] = (top[1:] != top[:-1]) | (text_of[1:] != text_of[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], n)[: len(first)]
    ok = ~none[text_of[first]]
    first, last = first[ok], last[ok]
    base = offsets[text_of[first]]
    rows = pa.StructArray.from_arrays(
        [
            pa.array((first - base).astype(np.int32)),
            pa.array((last - base).astype(np.int32)),
            pa.array(labels[top[first]].tolist(), pa.string()),
        ],
        names=["start", "end", "lang"],
    )
    bounds = np.searchsorted(text_of[first], np.arange(len(offsets)))
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), rows)
