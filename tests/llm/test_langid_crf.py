"""The random field against plain forward-backward, on held-out rows and on mixed text."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from packetloom.llm import langid_crf as lc
from packetloom.llm.language_queries import op9_language_crf, remainder


@pytest.fixture(scope="module")
def model(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").where(remainder("doc_id", 4) != 2)
    return lc.fit(docs, per_language=40)


@pytest.mark.parametrize("lengths", [[1], [0, 3, 0], [31, 32, 33, 64, 65, 200], [0], []])
def test_marginals_equal_enumeration_by_words(lengths):
    rng = np.random.default_rng(3)
    crf = lc.Crf(["a", "b", "c"], None, [], None, None, rng.normal(size=(3, 3)) * 2)
    offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int64)
    scores = rng.normal(size=(int(offsets[-1]), 3)) * 3
    got = crf.marginals(scores, offsets)
    a = np.exp(crf.moves)
    for i, n in enumerate(lengths):
        e = np.exp(scores[offsets[i] : offsets[i + 1]])
        f, b = np.zeros((n, 3)), np.ones((n, 3))
        for t in range(n):
            f[t] = e[t] * (f[t - 1] @ a if t else 1)
            f[t] /= f[t].sum()
        for t in range(n - 2, -1, -1):
            b[t] = a @ (e[t + 1] * b[t + 1])
            b[t] /= b[t].sum()
        want = f * b
        assert np.allclose(got[offsets[i] : offsets[i + 1]], want / want.sum(1, keepdims=True) if n else want)


def test_held_out_accuracy(spark, data, model):
    docs = spark.read.parquet(f"{data}/documents.parquet").where(remainder("doc_id", 4) == 2)
    got = lc.identify(docs, model).where("lang_pred <> 'und'")
    right = got.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.97


def test_mixed_text(spark, data, model):
    docs = spark.read.parquet(f"{data}/documents.parquet").where(remainder("doc_id", 4) == 2)
    texts = {r.lang: r.text.split()[:40] for r in docs.where("n_chars > 800").collect()}
    en, de = texts["en"], texts["de"]
    mixed = spark.createDataFrame([(" ".join(en + de + en),)], "text string")
    row = lc.identify(mixed, model).first()
    label = [s.lang for s in row.spans for _ in range(s.end - s.start)]
    want = ["en"] * len(en) + ["de"] * len(de) + ["en"] * len(en)
    assert sum(a == b for a, b in zip(label, want)) > 0.9 * len(want)
    assert row.spans[0].start == 0 and row.spans[-1].end == len(want)


def test_odd_rows(spark, model):
    rows = [(None, "a"), ("", "b"), ("123 !!", "c"), ("the", None), ("the", None), ("é " * 100_000, "x"), ("日本語", "x")]
    docs = spark.createDataFrame(rows, "text string, score string")
    got = lc.identify(docs, model).collect()
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (r.text in (None, "", "123 !!"))
    assert lc.identify(docs.limit(0), model).count() == 0
    empty = lc.fit(spark.createDataFrame([(None, "x"), ("y", None)], "lang string, text string"))
    assert {r.lang_pred for r in lc.identify(docs, empty).collect()} == {"und"}


def test_query(spark, data):
    got = op9_language_crf(spark, data)
    docs = spark.read.parquet(f"{data}/documents.parquet")
    assert got.count() == docs.count()
    assert {x[0] for x in got.select("lang_pred").distinct().collect()} <= {"en", "de", "fr", "es", "und"}


def test_predictions_equal_plain_computation(spark, data, model):
    """Word by word: features looked up, forward and backward over the text, mean over words with letters."""
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    a = np.exp(model.moves)
    for r in lc.identify(docs, model).limit(80).collect():
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in r.text or "")
        names = [w for w in re.split(r"[ \t-\r]+", lowered) if w]
        letters = [bool(regex.search(r"\p{L}", w)) for w in names]
        if not any(letters):
            assert r.lang_pred == "und" and r.score == 0
            continue
        e = np.stack([np.exp(model.scores(pa.array([w]))[0].astype(float)) for w in names])
        f, b = np.zeros_like(e), np.ones_like(e)
        for t in range(len(e)):
            f[t] = e[t] * (f[t - 1] @ a if t else 1)
            f[t] /= f[t].sum()
        for t in range(len(e) - 2, -1, -1):
            b[t] = a @ (e[t + 1] * b[t + 1])
            b[t] /= b[t].sum()
        p = f * b / (f * b).sum(1, keepdims=True)
        mean = p[np.array(letters)].mean(0)
        assert r.lang_pred == model.languages[int(mean.argmax())] and r.score == pytest.approx(mean.max(), abs=1e-5)


def test_sample_of_a_hot_text(spark):
    rows = [("en", "the same words and no others")] * 300 + [("en", f"the words of text {i}") for i in range(100)] + [("de", f"der text {i}") for i in range(5)]
    got = lc._sample(spark.createDataFrame(rows, "lang string, text string"), "text", "lang", 20, 400)
    assert sum(r.lang == "en" for r in got) == 20 and len({(r.lang, tuple(r.w)) for r in got}) == len(got) == 25
