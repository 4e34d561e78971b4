"""Links, groups and pair counts of two tokenizers against brute force."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from packetloom.llm import pair_bitmaps

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
FIRST = Tokenizer.from_file(A)
FIRST.encode_special_tokens = True
SECOND = sentencepiece.SentencePieceProcessor(model_file=B)
BYTE = pair_bitmaps.byte_of_characters()


def tokens(text):
    """Ids and bytes of both, or nothing."""
    if not text:
        return [], []
    a = [(i, bytes(BYTE[c] for c in FIRST.id_to_token(i))) for i in FIRST.encode(" " + text, add_special_tokens=False).ids]
    b = []
    for i in SECOND.encode(text):
        piece = SECOND.id_to_piece(i)
        b.append((i, bytes([int(piece[3:5], 16)]) if SECOND.is_byte(i) else piece.replace("▁", " ").encode()))
    want = (" " + text).encode()
    if b"".join(x for _, x in a) != want or b"".join(x for _, x in b) != want:
        return [], []
    return a, b


def spans(side):
    at, out = 0, []
    for i, x in side:
        out.append((i, at, at + len(x)))
        at += len(x)
    return out


def brute(docs):
    rows, links, counts = [], [], Counter()
    for doc_id, text in docs:
        a, b = map(spans, tokens(text))
        mine = []
        j = 0
        for i, s, e in a:
            while j < len(b) and b[j][2] <= s:
                j += 1
            k = j
            while k < len(b) and b[k][1] < e:
                mine.append((i, b[k][0]))
                k += 1
        ends = sorted({e for *_, e in a} & {e for *_, e in b})
        groups, x, y = [], 0, 0
        for end in ends:
            p = [x]
            while x < len(a) and a[x][2] <= end:
                x += 1
            p += [x, y]
            while y < len(b) and b[y][2] <= end:
                y += 1
            p.append(y)
            groups.append(",".join(str(i) for i, *_ in a[p[0] : p[1]]) + "|" + ",".join(str(i) for i, *_ in b[p[2] : p[3]]))
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""
        rows.append([doc_id, len(a), len(b), len(groups), len(mine), digest])
        links.append(mine)
        counts.update(mine)
    best = {}
    for (i, j), n in counts.items():
        best[j] = max(n, best.get(j, 0))
    return sorted([(*r, sum(counts[p] == best[p[1]] for p in m), sum(counts[p] for p in m)) for r, m in zip(rows, links)], key=str), counts, links


ODD = [
    None, "", " ", "  ", "a", " lead", "trail ", "two  spaces", "a   b", "tab\tand\nline\n\nbreak", "x\n y", "x \ny", "x\n \ny", "end\n ", "a b", " x y",
    "<|endoftext|> in text <s> </s> <unk> <0x41>", "literal ▁ mark", "naïve café ñandú 东京 😀😀", "it's we'll 'tis 12345 3.14", "a" * 3000, "\x00\x01 x", "\r\n x \r\n",
    "é ﬁ Ａ", "word " * 500 + "end", "x\x0b \x0by", "  a",
]


def table_of(spark, docs):
    return spark.createDataFrame(docs, "doc_id long, text string")


def test_words_are_encoded_as_whole_texts():
    rng = random.Random(4)
    texts = ["".join(rng.choices(["a", "B", " ", " ", "\n", "\t", "é", "9", "'s", ".", " ", "word"], k=rng.randint(0, 14))) for _ in range(3000)]
    both = pair_bitmaps.encoded(pa.array(texts), [pair_bitmaps.byte_level(A), pair_bitmaps.piece_model(B)])
    for (ids, offsets), encode in zip(both, (lambda t: FIRST.encode(" " + t, add_special_tokens=False).ids, SECOND.encode)):
        for i, text in enumerate(texts):
            want = encode(text) if tokens(text)[0] else []
            assert ids[offsets[i] : offsets[i + 1]].tolist() == want, repr(text)


@pytest.mark.parametrize("slice_bytes, block_bytes, block_docs", [(2 << 20, 8 << 20, 1 << 16), (40, 400, 5), (9_000, 30_000, 1 << 16)])
def test_documents_equal_brute_force(spark, data, monkeypatch, slice_bytes, block_bytes, block_docs):
    for name, value in (("SLICE_BYTES", slice_bytes), ("BLOCK_BYTES", block_bytes), ("BLOCK_DOCS", block_docs)):
        monkeypatch.setattr(pair_bitmaps, name, value)
    docs = [(k, t) for k, t in enumerate(ODD)] + [(3, "a"), (None, "it's two  spaces")]
    if block_docs > 5:
        docs += [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").limit(60).collect()]
    want, counts, links = brute(docs)
    df = table_of(spark, docs).repartition(2)
    got = pair_bitmaps.align(df, A, B)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "n_best", "count_sum"]
    assert sorted(map(tuple, got.collect()), key=str) == want
    pairs = {(r.a, r.b): (r.docs, r.links) for r in pair_bitmaps.pair_counts(pair_bitmaps.build_index(df, A, B)).collect()}
    assert pairs == {p: (sum(p in m for m in map(set, links)), n) for p, n in counts.items()}


def test_bitmaps():
    rng = np.random.default_rng(6)
    for docs in (1, 9, 300):
        bits = rng.random((40, docs)) < rng.random((40, 1))
        code, doc = np.nonzero(bits)
        plane = pair_bitmaps.packed(code, doc, 40, docs)
        assert pair_bitmaps.popcounts(plane, docs).tolist() == bits.sum(1).tolist()
        back = np.zeros_like(bits)
        back[pair_bitmaps.unpacked(plane, docs)] = True
        assert (back == bits).all()


def test_empty_table_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "one two", 5, "x")], "doc_id long, text string, block long, scores string")
    assert pair_bitmaps.align(docs.limit(0), A, B).collect() == []
    assert [tuple(r) for r in pair_bitmaps.align(docs, A, B).collect()] == brute([(1, "one two")])[0]
    assert [tuple(r) for r in pair_bitmaps.align(docs.withColumn("text", pair_bitmaps.F.lit(None).cast("string")), A, B).collect()] == [(1, 0, 0, 0, 0, "", 0, 0)]
