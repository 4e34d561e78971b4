"""Ranked search with range maxima against brute force."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pytest

from packetloom.llm import range_rank

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, answers=20):
    bags = [(d, Counter(terms(t))) for d, t in docs]
    n_docs, total = sum(1 for _, c in bags if c), sum(c.total() for _, c in bags)
    df = Counter(t for _, c in bags for t in c)
    out = []
    for item, text in set(items):
        scores = []
        for d, c in bags:
            score = 0
            for t in terms(text):
                if t in c:
                    m = 75 + 25 * c.total() * n_docs // total
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m))
            if score > 0 and d is not None:
                scores.append((-score, d))
        out += [(item, k + 1, d, -s) for k, (s, d) in enumerate(sorted(scores)[:answers])]
    return sorted(out, key=str)


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("text_bytes, wave", [(4 << 20, 64), (20_000, 1), (3_000, 7)])
def test_table(spark, data, monkeypatch, text_bytes, wave):
    monkeypatch.setattr(range_rank, "WAVE", wave)
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{data}/benchmark.parquet").select("item_id", "text")
    found = range_rank.ranked_documents(docs, items, text_bytes=text_bytes)
    assert got(found) == brute([tuple(r) for r in docs.collect()], [tuple(r) for r in items.collect()])


def test_blocks_of_items_and_ties(spark):
    rng = np.random.default_rng(1)
    vocabulary = [f"w{i}" for i in range(40)] + ["ñandú", "Don't", "x1"]
    docs = [(int(i), " ".join(rng.choice(vocabulary, rng.integers(0, 30)))) for i in rng.permutation(150)]
    docs += [(1000 - i, "w1 w2 w2 rare") for i in range(100)] + [(5, "w1 w2 w2 rare"), (5, "w1 w2 w2 rare")]
    items = [(f"i{i}", " ".join(rng.choice(vocabulary, rng.integers(1, 12)))) for i in range(12)] + [("t", "rare w2")]
    a, b = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id string, text string")
    assert got(range_rank.ranked_documents(a, b, block_bytes=60, answers=7)) == brute(docs, items, 7)


def test_few_documents_are_scored():
    rng = np.random.default_rng(2)
    n = 4000
    post = [(t, d, int(rng.integers(1, 1000)) * (20 if t == 0 else 1)) for t in range(6) for d in np.flatnonzero(rng.random(n) < (0.02 if t == 0 else 0.3))]
    term, doc, gain = (np.array(x, np.int64) for x in zip(*post))
    items = range_rank.Items(range_rank.pa.array([0]), ["a b c d e f"])
    best = range_rank.Best(1, 10)
    scored = range_rank.search(range_rank.Shard(np.arange(n), term, doc, gain), items, best)
    total = np.bincount(doc, gain, n).astype(int)
    want = sorted(range(n), key=lambda d: (-total[d], d))[:10]
    assert best.doc_id.tolist() == want and best.score.tolist() == total[want].tolist()
    assert scored < n / 3


def test_odd_rows(spark):
    docs = [(1, None, 7), (2, "", 7), (None, "one two", 7), (3, "One, two; three", 7), (3, "One, two; three", 7), (4, "x " * 200_000 + "two", 7), (5, "!!", 7), (6, "ÀB ab", 7)]
    items = [(1, "two"), (1, "two"), (1, "three one"), (2, None), (None, "x àb Àb ONE"), (3, "")]
    a = spark.createDataFrame(docs, "doc_id long, text string, score long")
    b = spark.createDataFrame(items, "item_id long, text string")
    assert got(range_rank.ranked_documents(a, b)) == brute([d[:2] for d in docs], items)
    for x, y in ((a.limit(0), b), (a, b.limit(0)), (a.where("doc_id < 3"), b)):
        found = range_rank.ranked_documents(x, y)
        assert found.columns == ["item_id", "rank", "doc_id", "score"] and found.collect() == []
