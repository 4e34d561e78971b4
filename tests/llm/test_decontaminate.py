"""Suffix arrays, windows and longest matches against brute force."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pytest

from packetloom.llm import decontaminate as dc

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def plain_words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(text, items, window):
    words, hit, found = plain_words(text), set(), set()
    for name, body in items:
        w = plain_words(body)
        size = min(window, len(w))
        for p in range(len(w) - size + 1) if w else ():
            for i in range(len(words) - size + 1):
                if words[i : i + size] == w[p : p + size]:
                    hit |= set(range(i, i + size))
                    found.add("null" if name is None else str(name))
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("seed", range(6))
def test_suffix_array(seed):
    rng = np.random.default_rng(seed)
    docs = [rng.integers(10, 10 + [2, 3, 50][seed % 3], int(rng.integers(0, 60))).tolist() for _ in range(9)]
    docs += docs[:4]
    codes = [c for k, d in enumerate(docs) for c in [*d, k - 20]]
    codes = np.array(codes) + 20
    got = dc.suffix_array(codes).tolist()
    assert got == sorted(range(len(codes)), key=lambda i: codes[i:].tolist())


def test_search_gives_longest_matches():
    texts = ["a b c d e f", "x b c d e y", None, "", "a b c d e f"]
    shard, items = dc.Shard(pa.array(texts)), dc.Items(["1"], ["z b c d e f q a"], 3)
    length, place, _ = shard.search(items)
    assert length.tolist() == [0, 5, 4, 3, 2, 1, 0, 1]
    at = shard.order[place[1]]
    assert (shard.codes[at : at + 5] - shard.base).tolist() == [shard.names.to_pylist().index(w) for w in "bcdef"]


@pytest.mark.parametrize("block", [1, 40, 1 << 20])
def test_small_tables(spark, block):
    texts = [
        "The quick, brown fox: jumps over the lazy dog and runs far away today", "quick brown fox", None, "", "...",
        "a1 b2 c3 É é", "the THE the", "runs far away", "one two three four five six seven eight nine ten eleven " * 40,
    ]
    items = [
        (1, "quick brown fox jumps over the lazy dog and runs far"), (2, "the"), (2, "far away"), (None, "b2 c3 É"), (4, None),
        (5, "!!"), (10, "five six seven eight nine ten eleven one two three four five"), (3, "nothing of this"),
    ]
    docs = spark.createDataFrame([(i, t, "n", i) for i, t in enumerate(texts)] + [(None, texts[0], "n", 1)], "doc_id long, text string, items string, n_hit int")
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    got = dc.find_benchmark(docs, bench, block_bytes=block).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        assert (r.n_words, r.n_hit, r["items"]) == plain(r.text, items, 10), r
        assert r.n_hit == sum(r.hit_ends) - sum(r.hit_starts)
        assert r.longest == 0 if not r["items"] else r.longest >= 1
    assert {r.longest for r in got if r.text == texts[0]} == {11}
    assert dc.find_benchmark(docs.limit(0), bench).count() == 0
    none = dc.find_benchmark(docs, bench.limit(0)).collect()
    assert all(r.n_hit == 0 for r in none)
    best = {(r.item_id, r.start): r.words for r in dc.longest_matches(docs, bench, block_bytes=block).collect()}
    assert best["1", 0] == 11 and best["10", 0] == 12 and ("3", 0) not in best


def test_documents_equal_brute_force(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    bench = spark.read.parquet(f"{data}/benchmark.parquet")
    grams = {}
    for r in bench.collect():
        w = plain_words(r.text)
        for p in range(max(1, len(w) - 9)) if w else ():
            grams.setdefault(tuple(w[p : p + 10]), set()).add(str(r.item_id))
    seen = 0
    for r in dc.find_benchmark(docs, bench).collect():
        w, hit, found = plain_words(r.text), set(), set()
        for size in {len(g) for g in grams}:
            for i in range(len(w) - size + 1):
                if (g := tuple(w[i : i + size])) in grams:
                    hit |= set(range(i, i + size))
                    found |= grams[g]
        assert (r.n_words, r.n_hit, r["items"]) == (len(w), len(hit), sorted(found))
        seen += bool(found)
    assert seen
