"""The pipeline's stages on the given documents and on odd rows."""

from __future__ import annotations

import re

import public_tokenizers
import regex

import corpus_pipeline
from packetloom.llm import piece_offsets, secret_forest

from .test_simhash import brute, plain_fingerprint


def test_stages(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, before = docs.columns, {r.doc_id: r for r in docs.collect()}
    ids = set(before)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        rows = docs.collect()
        now = {r.doc_id for r in rows}
        assert now <= ids and len(rows) == len(now)
        docs = spark.createDataFrame(rows, docs.schema)
        if name != "pieces":
            assert docs.columns == columns
        lost = ids - now
        if name == "language":
            assert all(not re.search(r"[^\W\d_]", before[i].text or "") for i in lost)
        if name in ("secrets", "pieces"):
            assert not lost
        if name == "copies":
            assert len({" ".join(r.text.lower().split()) for r in rows}) == len(rows)
        ids = now
    assert not any(re.search('token = "[0-9a-f]{40}"', r.text) for r in rows)
    assert any(secret_forest.MARK in r.text for r in rows)
    assert all(len(r.ids) == len(r.begins) == len(r.ends) for r in rows)


def test_run_on_odd_rows(spark, tmp_path):
    rows = [(1, None, "en", "a", 0), (2, "", None, "a", 0), (None, "the word and that", None, None, 3), (3, "the word and that", "en", "a", 4)]
    rows += [(4, "the word and that", "en", "a", 4), (4, "the word and that", "en", "a", 4), (5, "x " * 60_000, "en", "a", 4)]
    for name, data in (("a", rows), ("b", [])):
        folder = str(tmp_path / name)
        spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(None, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        got = corpus_pipeline.run(spark, folder).collect()
        assert sorted(r.doc_id for r in got) == ([3, 5] if data else [])


def test_no_language_to_learn(spark):
    rows = [(1, "the word and that", None, "a", 3), (2, "12 34", None, "a", 3), (3, None, None, "a", 3), (4, "слово", None, "a", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.known_language(spark, docs, "").collect()) == [1, 4]


def test_added_names_in_the_input_stay(spark, tmp_path):
    folder = str(tmp_path / "a")
    names = ["score", "lang_pred", "spans", "items", "longest", "n_hit", "n_words", "hit_starts", "_found", "_k1", "_k2", "_k3", "_hits", "fp", "root", "component_id", "probability", "digest"]
    rows = [(i, f"the word and that number {i} of which we speak here at some length {'x' * i}", "en", "a", 4, *[f"{n}{i}" for n in names]) for i in range(4)]
    rows[1] = (1, 'so the token = "0123456789abcdef0123456789abcdef01234567" leaks', *rows[1][2:])
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names)
    docs = spark.createDataFrame(rows, schema)
    columns = docs.columns
    spark.createDataFrame([(1, "no such words")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == columns
    got = {r.doc_id: r for r in docs.collect()}
    assert len(got) >= 2
    for i, r in got.items():
        assert [r[n] for n in names] == [f"{n}{i}" for n in names]


def test_run_keeps_what_plain_rules_keep(spark):
    """Letters, components of plain fingerprints and plain windows, document by document."""
    folder = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    ids = sorted(i for i, t in docs.items() if t and regex.search(r"\p{L}", t))
    marks = [plain_fingerprint(docs[i]) for i in ids]
    ids = sorted(set(brute(ids, marks, corpus_pipeline.COPY_BITS)))
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    windows = set()
    for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect():
        w = words(r.text)
        windows |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(w) for w in windows}
    ids = [i for i in ids if not any(tuple(w[k : k + n]) in windows for w in [words(docs[i])] for n in sizes for k in range(len(w) - n + 1))]
    got = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, folder).select("doc_id", "ids").collect()}
    assert sorted(got) == ids
    # a text without candidates of secrets comes out as it is
    library = piece_offsets.pieces(public_tokenizers.path("piece_bpe_32k.model")).library
    plain = [i for i in ids if not re.search(r"[A-Za-z0-9+/_=-]{16,}|[=:]", docs[i])]
    assert plain and all(got[i] == library.encode(docs[i]) for i in plain)
