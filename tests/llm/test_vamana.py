"""Graph search against brute force."""

from __future__ import annotations

import numpy as np
import pytest

from packetloom.llm import vamana


def brute(ids, v, every, k):
    out = {}
    for i, q in zip(ids, v):
        if i % every == 0:
            s = v @ q
            order = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
            out[int(i)] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def answers(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def recall(got, want):
    hit = sum(len({i for i, _ in got.get(q, [])} & {i for i, _ in w}) for q, w in want.items())
    return hit / sum(len(w) for w in want.values())


@pytest.mark.parametrize("shard_rows", [150, 8192])
def test_table_recall(spark, data, shard_rows):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    rows = [r for r in df.collect() if r.embedding and all(x is not None and np.isfinite(x) for x in r.embedding) and any(r.embedding)]
    ids, v = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows])
    want = brute(ids, v, 20, 20)
    got = answers(vamana.nearest(df, shard_rows=shard_rows))
    assert set(got) == set(want)
    assert recall(got, want) > 0.95
    place = {int(i): x for i, x in zip(ids, v)}
    for q, found in got.items():
        assert len(found) == 20 and all(abs(s - place[q] @ place[i]) < 1e-12 for i, s in found)
        assert found == sorted(found, key=lambda x: (-x[1], x[0]))


@pytest.mark.parametrize("scale", [0.3, 1.0, 2.0])
def test_unequal_norms(spark, scale):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(1500, 12)) * rng.lognormal(0, scale, (1500, 1))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    assert recall(answers(vamana.nearest(df, shard_rows=600)), brute(np.arange(1500), v, 20, 20)) > 0.95


def test_a_shard_that_no_beam_searches_is_scanned(spark, monkeypatch):
    """A dense clump of nearly equal vectors, and beams that always count as too narrow."""
    rng = np.random.default_rng(1)
    v = np.concatenate([rng.normal(size=(300, 8)), np.ones((500, 8)) + rng.normal(size=(500, 8)) * 1e-6])
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    assert recall(answers(vamana.nearest(df)), brute(np.arange(800), v, 20, 20)) > 0.95
    x = np.concatenate((v, np.zeros((800, 1))), 1).astype(np.float32)
    graph, start = vamana.build_graph(x)
    assert vamana.wide_enough(x, np.full_like(graph, -1), start, 20) == 800
    row = {"counts": np.ones(800, np.int32).tobytes(), "ids": np.arange(800).tobytes(), "vectors": np.concatenate((v, np.zeros((800, 1))), 1).tobytes(),
           "graph": graph.astype(np.int32).tobytes(), "start": start, "beam": 800}
    found = vamana._Shard(row).answers(np.arange(0, 800, 20), v[::20], 96, 20).to_pydict()
    got = {}
    for q, i in zip(found["query_id"], found["vec_id"]):
        got.setdefault(q, []).append((i, 0.0))
    assert recall(got, brute(np.arange(800), v, 20, 20)) == 1


def test_odd_rows(spark):
    one = [1.0, 0.0]
    rows = [(i, one, "x") for i in range(60)]
    rows += [(100, [0.0, 0.0], "x"), (120, None, "x"), (140, [None, 1.0], "x"), (160, [float("nan"), 1.0], "x"), (180, [float("inf"), 1.0], "x"),
             (200, [1.0, 2.0, 3.0], "x"), (None, one, "x"), (220, [0.0, -1.0], "x"), (40, one, "x"), (221, [0.5, 0.5], "x"), (240, [], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, query_id string")
    got = answers(vamana.nearest(df))
    assert sorted(got) == [0, 20, 40, 220]
    assert [i for i, _ in got[0]] == list(range(1, 21)) and [i for i, _ in got[20]] == [*range(20)]
    assert [i for i, _ in got[220]] == list(range(20))
    assert vamana.nearest(df.limit(0)).count() == 0
    few = vamana.nearest(df.where("vec_id in (0, 220, 221)"))
    assert {q: [i for i, _ in a] for q, a in answers(few).items()} == {0: [221, 220], 220: [0, 221]}
