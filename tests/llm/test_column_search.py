"""Columnar branch and bound against brute force in whole numbers."""

from __future__ import annotations

import math

import numpy as np
import pytest

from packetloom.llm import column_search


def brute(rows, every=20, answers=20, scale=64):
    whole = lambda x: math.floor(scale * x) if abs(x) < 2**50 else int(x) * scale
    kept = {(i, tuple(min(max(whole(x), -(2**63)), 2**63 - 1) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    found = {}
    for i, q in kept:
        if i % every == 0:
            score = lambda v: min(max(sum(a * b for a, b in zip(q, v)), -(2**63)), 2**63 - 1)
            found.setdefault(i, []).extend((-score(v), j) for j, v in kept if j != i)
    return {i: [(j, -s) for s, j in sorted(x)[:answers]] for i, x in found.items() if x}


def answers_of(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


@pytest.mark.parametrize("shard_rows, query_rows, chunk, sparse", [(8192, 8192, 256, 1 / 32), (150, 30, 7, 0.9), (300, 40, 64, 0.0)])
def test_table(spark, monkeypatch, shard_rows, query_rows, chunk, sparse):
    monkeypatch.setattr(column_search, "CHUNK", chunk)
    monkeypatch.setattr(column_search, "SPARSE", sparse)
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    kept = [(i, v) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    ids, whole = np.array([i for i, _ in kept]), np.floor(64 * np.array([v for _, v in kept], np.float64)).astype(np.int64)
    got = answers_of(column_search.exact_nearest(df, shard_rows=shard_rows, query_rows=query_rows))
    assert sorted(got) == sorted({int(i) for i in ids if i % 20 == 0})
    for i, q in zip(ids, whole):
        if i % 20 == 0:
            s = whole @ q
            order = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:20]
            assert got[i] == [(ids[j], s[j]) for j in order]


@pytest.mark.parametrize("norms", [0.0, 1.5])
def test_pruned_by_norms(spark, norms):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(1200, 24)) * rng.lognormal(0, norms, (1200, 1)) * np.linspace(2, 0.01, 24)
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert answers_of(column_search.exact_nearest(df, shard_rows=100, query_rows=20)) == brute(rows)


def test_odd_rows(spark):
    one, nan, inf = [1.0, 0.25], float("nan"), float("inf")
    rows = [(i, one) for i in range(60)]
    rows += [(100, [0.0, 0.0]), (120, None), (140, [None, 1.0]), (160, [nan, 1.0]), (180, [inf, 1.0]), (200, [1.0, 2.0, 3.0])]
    rows += [(None, one), (220, [0.0, -1.0]), (40, one), (221, [0.5, 0.5]), (240, []), (260, [-0.001, 0.0]), (20, [3.0, 3.0]), (21, [2.0, 9.0])]
    rows += [(280, [1e18, -1e18]), (300, [3e300, 1.0]), (301, [1e9, 1e9]), (21, [7.0, 1.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, query_id string")
    assert answers_of(column_search.exact_nearest(df)) == brute(rows)
    assert answers_of(column_search.exact_nearest(df, shard_rows=9, query_rows=2, answers=3)) == brute(rows, answers=3)
    assert column_search.exact_nearest(df.limit(0)).collect() == []
    few = [(0, one), (220, [0.0, -1.0]), (221, [0.5, 0.5])]
    df = spark.createDataFrame(few, "vec_id long, embedding array<double>")
    assert answers_of(column_search.exact_nearest(df)) == brute(few)
    assert column_search.exact_nearest(df.where("vec_id = 0")).collect() == []
