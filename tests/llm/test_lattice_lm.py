"""Lattice probabilities against enumeration, sums to one, and whole tables against plain counts."""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from packetloom.llm import lattice_lm as lm
from packetloom.llm.language_queries import remainder

PATH = public_tokenizers.path("piece_bpe_32k.model")


def words_of(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()


def cuts(word, names):
    if not word:
        yield []
    for k in range(1, len(word) + 1):
        if word[:k] in names:
            for rest in cuts(word[k:], names):
                yield [word[:k], *rest]


def test_forward_equals_all_segmentations():
    rng = np.random.default_rng(1)
    names = sorted({b"a", b"b", b"ab", b"ba", b"aba", b"abababab", b"ababababab", b"bababababab", b"c"})
    model = lm.Lattice(names, np.log(rng.dirichlet(np.ones(9))), np.log(rng.dirichlet(np.ones(9))))
    texts = [b"a", b"abab", b"cabababababababc", b"bababababababa", b"abababab", b"abababab"]
    gained = np.zeros((2, 9))
    counts = np.array([1.0, 2, 3, 1, 1, 1])
    got = model.words(pa.array(texts, pa.binary()), counts, gained)
    want = np.zeros((2, 9))
    for text, c, value in zip(texts, counts, got):
        paths = list(cuts(text, set(names)))
        p = [math.exp(model.first[names.index(s[0])] + sum(model.later[names.index(x)] for x in s[1:])) for s in paths]
        assert math.isclose(math.log(sum(p)), value, rel_tol=1e-9)
        for s, q in zip(paths, p):
            want[0, names.index(s[0])] += c * q / sum(p)
            for x in s[1:]:
                want[1, names.index(x)] += c * q / sum(p)
    assert np.allclose(gained, want)


def test_words_of_a_length_sum_to_its_total():
    names = [b"a", b"aa", b"ab", b"b"]
    model = lm.Lattice(names, np.log([0.4, 0.3, 0.2, 0.1]), np.log([0.2, 0.2, 0.4, 0.2]))
    totals = model.totals()
    for n in range(1, 9):
        every = [bytes(97 + (i >> k & 1) for k in range(n)) for i in range(2**n)]
        assert math.isclose(np.exp(model.words(pa.array(every, pa.binary()))).sum(), math.exp(totals[n]), rel_tol=1e-9)
    shares = np.log(np.append(0.0001, np.full(lm.TAIL, 1 / lm.TAIL)))
    sizes = np.arange(1, 5000)
    assert 0.999 < np.exp(lm.length_scores(sizes, shares, np.zeros(9))).sum() <= 1.001


def test_discounts():
    assert lm.discounts(0, 0, 0, 0) == pytest.approx((0.5, 1.0, 1.5))
    assert all(0 < d < k for k, d in zip((1, 2, 3), lm.discounts(100, 40, 20, 10)))


@pytest.mark.parametrize("heavy", [4, 1 << 19])
def test_documents_equal_plain_counts(spark, data, heavy):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    rows = docs.collect()
    train = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 7 != 2 for r in rows}
    c = Counter(w for r in rows if train[r.doc_id] for w in words_of(r.text))
    ends = sum(train.values())
    n, v = sum(c.values()) + ends, len(c) + 1
    got = lm.score(docs, PATH, remainder("doc_id", 7) != 2, heavy=heavy).collect()
    assert len(got) == len(rows)
    # the model again, word by word
    counts = lm.word_counts(docs, "text", remainder("doc_id", 7) != 2)
    model, shares = lm.trained(counts, *lm.vocabulary(PATH)), lm.length_shares(counts)
    every = sorted({w for r in rows for w in words_of(r.text)})
    weight = model.words(pa.array(every, pa.binary())) + lm.length_scores(np.array([len(w) for w in every]), shares, model.totals())
    weight = dict(zip(every, weight.tolist()))
    of = Counter(c.values())
    d = lm.discounts(*(of[k] for k in range(1, 5)))
    off = {w: d[min(k, 3) - 1] for w, k in c.items()}
    spare = sum(off.values()) + 1
    texts = {r.doc_id: r.text for r in rows}
    held = [0.0, 0.0]
    for r in got:
        ws = words_of(texts[r.doc_id])
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws) + math.log10((ends + 1) / (n + v + 1))
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and r.train_tokens == n
        assert (r.n_tokens, r.n_known, r.training) == (len(ws) + 1, sum(c[w] > 0 for w in ws) + 1, train[r.doc_id])
        last = math.log10((ends + 1) / (n + 2))
        score = sum(math.log10((c[w] - off.get(w, 0) + spare * math.exp(weight[w])) / (n + 2)) for w in ws) + last
        pure = sum(weight[w] / math.log(10) + math.log10((sum(c.values()) + 1) / (n + 2)) for w in ws) + last
        assert math.isclose(r.score, score, rel_tol=1e-6) and math.isclose(r.lattice_score, pure, rel_tol=1e-6)
        if not r.training:
            held = [held[0] + r.score, held[1] + r.base_score]
    chars = sum(len(texts[r.doc_id] or "") for r in got if not r.training)
    assert held[0] / chars > -0.8


def test_odd_rows(spark):
    rows = [(1, None, 5), (None, "", 5), (3, "a A a", 5), (3, "a A a", 5), (4, "b" * 3000, 5), (5, "the " * 30_000, 5), (6, "é\x00☃", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key int")
    got = lm.score(docs, PATH, F.col("doc_id") > 1).collect()
    assert len(got) == len(rows) and all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert {r.n_tokens for r in got if r.doc_id in (1, None)} == {1}
    assert [r.training for r in got if r.doc_id is None] == [False]
    assert len({(r.n_known, r.score) for r in got if r.doc_id == 3}) == 1
    assert lm.score(docs.limit(0), PATH, F.lit(True)).count() == 0
    alone = lm.score(docs, PATH, F.lit(False)).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 and math.isfinite(r.score) for r in alone)


def test_long_pieces_count():
    names, weights = lm.vocabulary(PATH)
    longest = max(names, key=len)
    assert len(longest) > 16
    model = lm.Lattice.started(names, weights)
    without = lm.Lattice.started([n for n in names if n != longest], np.array([w for n, w in zip(names, weights) if n != longest]))
    assert model.words(pa.array([longest], pa.binary()))[0] > without.words(pa.array([longest], pa.binary()))[0]
