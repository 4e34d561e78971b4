"""Token ids as compressed planes of bits or bytes.

A chunk holds the ids of whole consecutive documents. Its ids are cut into blocks of
``BLOCK`` ids, the last one filled with zeros, and each block is transposed: all first bits
(or bytes) of its ids, then all second ones, and so on. Plane ``p`` of a chunk is the
planes ``p`` of its blocks one after another, compressed as one zstandard frame; planes
above the highest bit in use are not stored.

Chunk, little endian: ``PLN1``, u32 ids, u16 block, u8 unit (1 bit planes, 8 byte planes),
u8 planes, u32 length of each frame, frames.

A written set is a folder of Parquet files, so that Spark's commit keeps it whole when
executors are lost: one row per chunk with its bytes (``planes``) and its part of the chunk
index: ``shard`` (in order of doc_id), ``chunk`` and ``first`` (its first id's place) in the
shard, ``n_ids``, and ``doc_ids`` and ``doc_sizes`` of its documents. Parquet reads the index
without the planes, and single chunks by filter.
"""

from __future__ import annotations

import re
import struct
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from packetloom.llm.words import Remembered, expanded, slices, total_before, words

BLOCK = 4096
CHUNK_IDS = 1 << 18
TEXT_BYTES = 4 << 20  # of texts encoded at once
_HEAD = struct.Struct("<4sIHBB")


def pack(ids: np.ndarray, unit: str = "byte", level: int = 3) -> bytes:
    """One chunk from unsigned 32-bit ids; no ids give a chunk without planes."""
    ids = np.ascontiguousarray(ids, "<u4")
    bits = int(ids.max()).bit_length() if len(ids) else 0
    blocks = np.zeros((-(-len(ids) // BLOCK), BLOCK), "<u4")
    blocks.reshape(-1)[: len(ids)] = ids
    frames = []
    if unit == "bit":
        frames = [np.packbits((blocks >> p & 1).astype(np.uint8), axis=1) for p in range(bits)]
    else:
        each = blocks.view(np.uint8).reshape(len(blocks), BLOCK, 4)
        frames = [np.ascontiguousarray(each[:, :, p]) for p in range((bits + 7) // 8)]
    press = zstandard.ZstdCompressor(level=level)
    frames = [press.compress(f.tobytes()) for f in frames]
    head = _HEAD.pack(b"PLN1", len(ids), BLOCK, 1 if unit == "bit" else 8, len(frames))
    return b"".join([head, struct.pack(f"<{len(frames)}I", *map(len, frames)), *frames])


def unpack(data: bytes) -> np.ndarray:
    """The ids of one chunk."""
    magic, n, block, unit, planes = _HEAD.unpack_from(data)
    if magic != b"PLN1":
        raise ValueError("not a chunk of token planes")
    sizes = struct.unpack_from(f"<{planes}I", data, _HEAD.size)
    rows, at = -(-n // block), _HEAD.size + 4 * planes
    out = np.zeros((rows, block), "<u4")
    open_ = zstandard.ZstdDecompressor()
    for p, size in enumerate(sizes):
        plane = np.frombuffer(open_.decompress(data[at : at + size]), np.uint8).reshape(rows, -1)
        if unit == 1:
            plane = np.unpackbits(plane, axis=1)
        out |= plane.astype("<u4") << np.uint32(p * unit)
        at += size
    return out.reshape(-1)[:n]


# Printable ASCII and the Latin-1 letters: composed already, and their case is one to one.
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: visible Latin-1 itself, the others from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def word_encoder(path: str) -> Remembered:
    """Ids of words without white space, as bytes of int32, by the tokenizers library.

    The vocabulary drops white space, so a text's ids are its words' ids. Words of plain
    letters go to the library's model in the pieces that its pre-tokenizer cuts; any other
    word goes through the whole tokenizer.
    """
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    tokenize, letters = whole.model.tokenize, _byte_letters()

    def piece(text: str) -> bytes:
        if not text.isascii():
            text = text.encode().decode("latin-1").translate(letters)
        return array("i", [t.id for t in tokenize(text)]).tobytes()

    pieces = Remembered(lambda texts: list(map(piece, texts)), 500_000)
    plain, cut = _PLAIN.fullmatch, _PIECE.findall

    def encode(names: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(names)
        found: list[str] = []
        ends: list[tuple[int, int]] = []
        for i, word in enumerate(names):
            if plain(word) and "<|" not in word:
                found += cut(word.lower())
                ends.append((i, len(found)))
            else:
                ids = whole.encode(word, add_special_tokens=False).ids
                out[i] = array("i", ids).tobytes()
        got, start = pieces(found), 0
        for i, end in ends:
            out[i] = got[start] if end == start + 1 else b"".join(got[start:end])
            start = end
        return out

    return Remembered(encode, 300_000)


def encoded(texts: pa.Array, path: str, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the texts, each text's closed by ``end_id``, and row offsets."""
    offsets, codes, names = words(texts)
    entries = word_encoder(path)(names.to_numpy(zero_copy_only=False).tolist())
    entries.append(np.array([end_id], np.int32).tobytes())
    codes = np.insert(codes, offsets[1:], len(entries) - 1)
    ids, counts = expanded(codes, entries)
    return ids, total_before(counts, offsets + np.arange(len(offsets)))


def write_tokens(
    docs: DataFrame,
    folder: str,
    tokenizer: str,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    end_id: int = 1,
    unit: str = "byte",
    chunk_ids: int = CHUNK_IDS,
) -> None:
    """Encodes every whole text and writes the ids below ``folder`` in ascending doc_id order.

    ``tokenizer`` is a file of the tokenizers library that every executor can open, with a
    vocabulary that drops white space. A null text is empty: it has its end id only. A null
    doc_id comes first; equal doc_ids stand in the order of their texts' hash. A chunk holds
    about ``chunk_ids`` ids, or one longer document. An empty table writes an empty set.
    Other columns are not read.
    """

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, number, first = TaskContext.get().partitionId(), 0, 0
        held: list[tuple[np.ndarray, list, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            nonlocal number, first, held
            ids = np.concatenate([h[0] for h in held])
            sizes = np.concatenate([h[2] for h in held])
            row = {
                "shard": [shard], "chunk": [number], "first": [first], "n_ids": [len(ids)],
                "doc_ids": [[x for h in held for x in h[1]]], "doc_sizes": [sizes],
                "planes": [pack(ids, unit)],
            }
            number, first, held = number + 1, first + len(ids), []
            return pa.RecordBatch.from_pydict(row, schema=_CHUNK_ARROW)

        waiting = 0
        for batch in batches:
            for part in slices(batch, 1, TEXT_BYTES):
                ids, offsets = encoded(part.column(1), tokenizer, end_id)
                names, start = part.column(0).to_pylist(), 0
                for i in range(len(names)):
                    if waiting + offsets[i + 1] - offsets[start] >= chunk_ids or i + 1 == len(names):
                        span = slice(offsets[start], offsets[i + 1])
                        held.append((ids[span], names[start : i + 1], np.diff(offsets[start : i + 2])))
                        waiting += span.stop - span.start
                        start = i + 1
                        if waiting >= chunk_ids:
                            yield flush()
                            waiting = 0
        if held:
            yield flush()

    order = [F.col("_id"), F.xxhash64("_text")]
    (
        docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).alias("_text"))
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .mapInArrow(chunks, _CHUNK)
        .write.option("compression", "none")
        .parquet(folder)
    )


_CHUNK = (
    "shard int, chunk int, first long, n_ids long, doc_ids array<long>, doc_sizes array<int>, planes binary"
)
_CHUNK_ARROW = pa.schema(
    {
        "shard": pa.int32(), "chunk": pa.int32(), "first": pa.int64(), "n_ids": pa.int64(),
        "doc_ids": pa.list_(pa.int64()), "doc_sizes": pa.list_(pa.int32()), "planes": pa.binary(),
    }
)


def chunk_index(spark: SparkSession, folder: str) -> DataFrame:
    """shard, chunk, start (ids of the whole set before it), n_ids, doc_ids, doc_sizes.

    Reads no planes. Only one total per shard meets in a single task.
    """
    chunks = spark.read.schema(_CHUNK).parquet(folder)
    totals = chunks.groupBy("shard").agg(F.sum("n_ids").alias("_n"))
    before = totals.select(
        "shard", (F.sum("_n").over(Window.orderBy("shard")) - F.col("_n")).alias("_before")
    )
    # one row per written file: a few bytes for each of its many megabytes
    return chunks.join(F.broadcast(before), "shard").select(
        "shard", "chunk", (F.col("_before") + F.col("first")).alias("start"), "n_ids", "doc_ids",
        "doc_sizes", "planes",
    )


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids (binary of little-endian u32) per document of a written set."""

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                ids = unpack(batch.column(3)[k].as_py()).astype("<u4")
                sizes = batch.column(2)[k].values.to_numpy().astype(np.int64)
                starts = np.cumsum(sizes) - sizes
                raw = pa.BinaryArray.from_buffers(
                    pa.binary(),
                    len(sizes),
                    [None, pa.py_buffer((4 * np.append(starts, starts[-1:] + sizes[-1:])).astype(np.int32)), pa.py_buffer(ids)],
                )
                first = batch.column(0)[k].as_py()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1)[k].values, pa.array(first + starts), pa.array(sizes), raw],
                    names=["doc_id", "start", "n_tokens", "ids"],
                )

    return (
        chunk_index(spark, folder)
        .select("start", "doc_ids", "doc_sizes", "planes")
        .mapInArrow(documents, "doc_id long, start long, n_tokens long, ids binary")
    )
