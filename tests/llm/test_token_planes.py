"""Token ids in files of planes: round trips and whole texts against the library."""

from __future__ import annotations

import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
from tokenizers import Tokenizer

from packetloom.llm import token_planes
from packetloom.llm.words import expanded
from packetloom.session import scratch_path

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("unit", ["bit", "byte"])
@pytest.mark.parametrize("n", [0, 1, 4095, 4096, 4097, 20_000])
def test_round_trip(unit, n):
    ids = np.random.default_rng(n).integers(0, 2**32 if n % 2 else 50_000, n, np.uint32)
    assert (token_planes.unpack(token_planes.pack(ids, unit)) == ids).all()


@pytest.mark.parametrize("chunk_ids", [1, 50, 1 << 18])
def test_written_set_equals_library(spark, chunk_ids):
    texts = [
        "'sound !!'s 'S x'LL don't", None, "", " \n", "a\x1cb ñ̃ ño ﬁ İstanbul ΑΣ Σ", "日本 123 ١٢٣",
        "<|endoftext|>foo <|endoftext|>", "word " * 5000, "same", "same", "x\x00y á \xa0z",
    ]
    rows = [(None if t == "x" else 100 - i, t, i, "c") for i, t in enumerate(texts)]
    rows.append((rows[-1][0], "again", 0, "c"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard int, ids string").repartition(3)
    path = scratch_path(spark, "t")
    token_planes.write_tokens(docs, path, PATH, chunk_ids=chunk_ids)
    got = token_planes.read_tokens(spark, path).orderBy("start").collect()
    whole, start = Tokenizer.from_file(PATH), 0
    want = {}
    for d, t, *_ in rows:
        ids = whole.encode(t or "", add_special_tokens=False).ids + [1]
        want.setdefault(d, []).append(zlib.crc32(np.array(ids, "<u4").tobytes()))
    assert [r.doc_id for r in got] == sorted(r.doc_id for r in got) and len(got) == len(rows)
    for r in got:
        assert r.start == start and len(r.ids) == 4 * r.n_tokens
        want[r.doc_id].remove(zlib.crc32(r.ids))
        start += r.n_tokens


def test_empty_table(spark):
    path = scratch_path(spark, "t")
    token_planes.write_tokens(spark.createDataFrame([], "doc_id long, text string"), path, PATH)
    assert token_planes.read_tokens(spark, path).count() == 0


def test_given_table_equals_library(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    path = scratch_path(spark, "given")
    token_planes.write_tokens(docs, path, PATH, end_id=1)
    library, start = Tokenizer.from_file(PATH), 0
    got = {r.doc_id: r for r in token_planes.read_tokens(spark, path).collect()}
    for r in sorted(docs.collect(), key=lambda r: r.doc_id):
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 1]
        mine = got.pop(r.doc_id)
        assert np.frombuffer(mine.ids, "<u4").tolist() == ids and (mine.start, mine.n_tokens) == (start, len(ids))
        start += len(ids)
    assert not got


@pytest.mark.parametrize("codes", [[], [1], [0, 2, 1, 2, 2, 0]])
def test_expanded(codes):
    entries = [np.array(x, np.int32).tobytes() for x in ([7, -8], [], [9])]
    ids, counts = expanded(np.array(codes, np.int32), entries)
    want = [np.frombuffer(entries[c], np.int32).tolist() for c in codes]
    assert ids.tolist() == sum(want, []) and counts.tolist() == [len(w) for w in want]


def test_expanding_takes_little_beside_the_result():
    entries = [np.full(6, i, np.int32).tobytes() for i in range(100)]
    codes = np.random.default_rng(0).integers(0, 100, 500_000, np.int32)
    expanded(codes[:1], entries)  # what is imported on first use does not count
    pool = pa.default_memory_pool()
    before = pool.bytes_allocated()
    tracemalloc.start()
    try:
        ids, counts = expanded(codes, entries)
        numpy_peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(ids) == 3_000_000 and (counts == 6).all()
    # Arrow holds the ids and offsets, numpy the counts
    assert pool.bytes_allocated() - before + numpy_peak < 3 * ids.nbytes
