"""Pieces and spans against the library, for the given model and for a compiled character map."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece

from packetloom.llm import piece_offsets

PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    "Plain words here.\nNext line", " lead", "trail ", "two  spaces   three", "", "▁ literal▁x", "日本 é ☃ 🎉",
    "  ", "\n\n", "a" * 3000, "x\x00y", "<s> </s> <0x41>", "tab\tand space 　wide", "é́",
]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_column_equals_library(library):
    work = piece_offsets.pieces(PATH)
    assert work.by_word
    offsets, ids, begins, ends = work.column(pa.array(TEXTS))
    for i, text in enumerate(TEXTS):
        span = slice(offsets[i], offsets[i + 1])
        assert ids[span].tolist() == library.encode(text)
        source, _, _ = text.encode(), None, None
        one = work.one(text)
        assert [x.tolist() for x in one] == [x[span].tolist() for x in (ids, begins, ends)]
        if len(one[0]):
            assert begins[span][0] == 0 and ends[span][-1] == len(source)
            assert (begins[span][1:] == ends[span][:-1]).all()
        for k, a, b in zip(ids[span].tolist(), begins[span], ends[span]):
            name = library.id_to_piece(k)
            if not library.is_byte(k) and "▁" not in name:
                assert source[a:b].decode() == name
            if library.is_byte(k):
                assert source[a:b] == bytes((int(name[3:5], 16),))


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc", "nmt_nfkc_cf"])
def test_character_map_equals_library(rule):
    want = sentencepiece.SentencePieceNormalizer(rule_name=rule)
    proto = want.serialized_model_proto()
    spec = b"".join(v for k, v in piece_offsets._fields(proto) if k == 3)
    own = piece_offsets.Normaliser(spec)
    for text in [*TEXTS, "ﬁne ①② ｶﾞ Ａ ㍿ Straße ½", "​zero﻿   x"]:
        norm, source = own(text.encode())
        assert norm.decode() == want.normalize(text)
        assert len(source) == len(norm) + 1 and (np.diff(source) >= 0).all()
        assert source[-1] <= len(text.encode())


def test_squeezed_spaces():
    spec = bytes([0x18, 1, 0x20, 1, 0x28, 1])
    norm, source = piece_offsets.Normaliser(spec)(b"  a  b ")
    assert norm.decode() == "▁a▁b" and source.tolist() == [2, 2, 2, 2, 3, 3, 3, 5, 6]


def test_frames(spark, library):
    rows = [(i, t, "x", [1]) for i, t in enumerate(TEXTS)] + [(None, None, "y", None), (1, " lead", "x", [1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, begins string, ids array<int>")
    got = piece_offsets.encode(docs, PATH, decoded="back")
    assert got.columns == ["doc_id", "text", "ids", "begins", "ends", "back"]
    found = got.collect()
    assert len(found) == len(rows)
    for r in found:
        ids = library.encode(r.text or "")
        assert r.ids == ids and r.back == library.decode(ids)
    again = piece_offsets.decode(got, PATH).collect()
    assert all(r.decoded == r.back for r in again)
    assert piece_offsets.encode(docs.limit(0), PATH).count() == 0


def test_given_table_equals_library(spark, data, library):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    for r in piece_offsets.encode(docs.withColumn("t", docs.text), PATH, decoded="d").collect():
        ids = library.encode(r.t or "")
        assert r.ids == ids and r.d == library.decode(ids)
