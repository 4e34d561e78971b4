"""The weak-label model against simulated votes and the labels of the table."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from packetloom.llm import quality as q


def test_em_recovers_accuracies():
    rng = np.random.default_rng(0)
    truth = rng.random(40_000) < 0.7
    right = np.array([0.95, 0.9, 0.8, 0.75, 0.85])
    v = np.where(rng.random((40_000, 5)) < right, truth[:, None], ~truth[:, None]).astype(int)
    v[rng.random(v.shape) < 0.3] = -1
    keys, n = np.unique(q.pattern(v), return_counts=True)
    posterior, got, prior = q.fit_labels(dict(zip(keys.tolist(), n.tolist())), 5)
    assert np.abs(got - right).max() < 0.03 and abs(prior - 0.7) < 0.03
    guess = np.array([posterior[k] for k in q.pattern(v).tolist()]) > 0.5
    assert (guess == truth).mean() > 0.93


def test_votes_of_plain_cases():
    texts = ["A plain text of simple words goes on for some while and then it ends. " * 3, "a | b | c | d | e | f | g", "THIS!! IS!! ALL!! LOUD!! YES!!", "x$$$ y### z%%% w&&&", "", "no no no no no no no no no no no no"]
    got = q.votes(pa.array(texts))
    name = q.LABELLERS.index
    assert got[0, name("odd_words")] == got[0, name("marks")] == got[0, name("stops")] == 1
    assert got[1, name("bars")] == got[2, name("capitals")] == got[2, name("calls")] == got[3, name("signs")] == 0
    assert (got[4] == -1).all() and got[5, name("repeats")] == 0 and got[1, name("odd_words")] == 0


def test_table_labels(spark):
    folder = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    got = q.score(docs, q.fit(docs)).join(labels, "doc_id")
    row = got.agg(
        F.avg(F.when(F.col("quality") == 1, F.col("keep").cast("int"))).alias("kept"),
        F.avg(F.when(F.col("quality") == 0, F.col("keep").cast("int"))).alias("missed"),
    ).first()
    assert row.kept > 0.995 and row.missed < 0.25


@pytest.mark.parametrize("n", [0, 6])
def test_odd_rows(spark, n):
    rows = [(None, "a"), ("", "b"), (" \n ", None), ("One two three. Four five six.", "x"), ("One two three. Four five six.", "x"), ("word " * 100_000, "y")][:n]
    docs = spark.createDataFrame(rows, "text string, keep string")
    model = q.fit(docs)
    got = q.score(docs, model).collect()
    assert len(got) == n
    for r in got:
        assert 0 <= r.quality_score <= 1 and 0 <= r.weak_label <= 1
        if not (r.text or "").strip():
            assert r.quality_score == 0 and not r.keep


def test_sample_is_bounded_and_of_different_texts(spark, monkeypatch):
    rows = [("one common text of some words. It is a third of all.",)] * 400 + [(f"Text number {i} goes on. It has words {i * 7}.",) for i in range(800)]
    docs = spark.createDataFrame(rows, "text string")
    seen = []
    monkeypatch.setattr(q, "_train", lambda data, epochs: seen.append(data) or (np.zeros(q.TABLE), 0.0))
    q.fit(docs, sample=50)
    assert len(seen[0]) == 50 and len({(p.tobytes(), s.tobytes()) for p, s, _ in seen[0]}) == 50


def test_scores_equal_plain_computation(spark, data):
    """Votes, posterior and scorer again, text by text."""
    docs = spark.read.parquet(f"{data}/documents.parquet").select("text")
    model = q.fit(docs)
    for r in q.score(docs, model).collect():
        v = q.votes(pa.array([r.text or ""]))
        assert r.weak_label == pytest.approx(model.posterior[int(q.pattern(v)[0])] if (r.text or "").split() else 0.0)
        names = (r.text or "").encode().split()
        if not names:
            continue
        table = dict(zip(names, q.word_features(pa.array([n.decode() for n in names]))))
        again = q.repeated(np.unique(names, return_inverse=True)[1], np.zeros(len(names), int))
        places = [p for n, more in zip(names, again) for p in [*table[n], *([q.REPEAT] if more else [])]]
        value = sum(model.weights[p] for p in places) / len(names) + model.bias
        assert r.quality_score == pytest.approx(1 / (1 + np.exp(-value)), abs=1e-6)
