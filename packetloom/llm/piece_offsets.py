"""SentencePiece encoding that keeps the source bytes of every piece.

A text is normalised from left to right: at each place the longest entry of the model's
compiled character map that the text starts with is replaced; without one, a character
stands for itself. Each normalised byte records the source byte it comes from. The pieces of
an encoding cover the normalised text in order, so their lengths and this record give each
piece its span of original bytes. Ids are the library's own.

Pieces never run across a space in vocabularies that are split there. For those without a
character map, words are encoded once per batch and looked up; any text that this does not
fit (runs of spaces, literal U+2581, other models) is handed to the library whole.
"""

from __future__ import annotations

import re
import struct
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from packetloom.llm.words import Remembered, expanded, numbered, slices, text_column, total_before

TEXT_BYTES = 4 << 20
SPACE = "▁"
_RUNS = re.compile(f"{SPACE}+[^{SPACE}]*")


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a serialised protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = varint() if kind == 2 else 8 if kind == 1 else 4
            yield key >> 3, data[at : at + size]
            at += size


class CharacterMap:
    """Longest-prefix replacement from a compiled map: a double-array trie and its strings."""

    def __init__(self, compiled: bytes):
        size = struct.unpack_from("<I", compiled)[0] if compiled else 0
        self.trie = np.frombuffer(compiled, "<u4", size // 4, 4).tolist() if size else []
        self.strings = compiled[4 + size :]

    @staticmethod
    def _jump(unit: int) -> int:
        return (unit >> 10) << ((unit & 512) >> 6)

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """End of the longest entry that ``text`` has at ``at``, and what replaces it."""
        trie, found = self.trie, None
        node = self._jump(trie[0])
        for i in range(at, len(text)):
            node ^= text[i]
            unit = trie[node]
            if unit & 0x800000FF != text[i]:
                break
            node ^= self._jump(unit)
            if unit & 256:
                found = i + 1, trie[node] & 0x7FFFFFFF
        if found is None:
            return None
        return found[0], self.strings[found[1] : self.strings.index(b"\0", found[1])]


def _char_end(text: bytes, at: int) -> int:
    lead = text[at]
    return at + (1 if lead < 0xC0 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4)


class Normaliser:
    """Normalised bytes of a text and, for each of them and the end, the source byte."""

    def __init__(self, spec: bytes):
        fields = dict(_fields(spec))
        self.map = CharacterMap(fields.get(2, b""))
        self.dummy, self.squeeze, self.escape = (bool(fields.get(k, 1)) for k in (3, 4, 5))

    def units(self, text: bytes) -> Iterator[tuple[int, int, bytes]]:
        """Source start and end and the replacement, left to right."""
        at = 0
        while at < len(text):
            hit = self.map.longest(text, at) if self.map.trie else None
            end, new = hit or (_char_end(text, at), None)
            yield at, end, text[at:end] if new is None else new
            at = end

    def __call__(self, text: bytes) -> tuple[bytes, np.ndarray]:
        out, source = bytearray(), array("i")
        space = SPACE.encode() if self.escape else b" "
        fresh = self.squeeze  # at the start, or after a space
        for start, end, new in self.units(text):
            if self.squeeze and fresh:
                new = new.lstrip(b" ")
            if not new:
                continue
            if not out and self.dummy:
                out += space
                source.extend([start] * len(space))
            same = new == text[start:end]
            for k, byte in enumerate(new):
                piece = space if byte == 32 else bytes((byte,))
                out += piece
                source.extend([start + k if same else start] * len(piece))
            fresh = self.squeeze and new.endswith(b" ")
        last = len(text)
        if self.squeeze:
            while out.endswith(space):
                del out[-len(space) :]
                last = source[len(out)]
                del source[len(out) :]
        source.append(last)
        return bytes(out), np.array(source, np.int32)


class Pieces:
    """A model file: the library's processor, its normaliser and the bytes of each piece."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        with open(path, "rb") as file:
            spec = b"".join(v for k, v in _fields(file.read()) if k == 3)
        self.normalise = Normaliser(spec)
        n = self.library.get_piece_size()
        names = [self.library.id_to_piece(i) for i in range(n)]
        byte = [self.library.is_byte(i) for i in range(n)]
        self.sizes = np.array([1 if b else len(x.encode()) for x, b in zip(names, byte)], np.int32)
        self.bytes_only = any(byte)
        spaces = np.array([0 if b else x.count(SPACE) for x, b in zip(names, byte)], np.int32)
        self.source_sizes = self.sizes - 2 * spaces
        n = self.normalise
        self.by_word = (
            n.dummy and n.escape and not n.squeeze and not n.map.trie and self.bytes_only
            and not any(SPACE in x.lstrip(SPACE) for x in names)
        )
        self.lone = array("i", [self.library.piece_to_id(SPACE)]).tobytes()
        self.words = Remembered(self._encode_words, 300_000)

    def _encode_words(self, names: list[str]) -> list[bytes]:
        got = self.library.encode(names, num_threads=1)
        return [array("i", ids).tobytes() if word else self.lone for word, ids in zip(names, got)]

    def one(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of a text and the source bytes at which each piece begins and ends."""
        norm, source = self.normalise(text.encode())
        if self.by_word:
            runs = _RUNS.findall(norm.decode())
            entries = self.words([r[1:].replace(SPACE, " ") for r in runs])
            ids = np.frombuffer(b"".join(entries), np.int32)
        else:
            ids = np.array(self.library.encode(text), np.int32)
        if self.bytes_only:
            sizes = self.sizes[ids]
        else:  # an unknown piece stands for as many bytes as its surface has
            proto = self.library.encode(text, out_type="immutable_proto")
            sizes = np.array([len(p.piece.encode()) for p in proto.pieces], np.int32)
        ends = np.cumsum(sizes)
        return ids, source[ends - sizes], source[ends]

    def column(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Row offsets, and ids, begins and ends of all texts one after another."""
        n = len(texts)
        slow = np.ones(n, bool)
        if self.by_word:
            odd = pc.match_substring_regex(texts, f"  |^ | $|{SPACE}|^$")
            slow = odd.to_numpy(zero_copy_only=False)
        plain = pc.if_else(pa.array(slow), "", texts) if slow.any() else texts
        offsets, codes, names = numbered(pc.split_pattern(plain, " "))
        entries = self.words(names.to_pylist()) if len(names) else []
        ids, counts = expanded(codes, entries)
        offsets = total_before(counts, offsets)
        sizes = self.source_sizes[ids].astype(np.int64)
        first = offsets[:-1][~slow]
        sizes[first] -= 1  # the space put before the text
        ends = np.cumsum(sizes)
        base = np.concatenate(([0], ends))[offsets]
        ends -= np.repeat(base[:-1], np.diff(offsets))
        begins = ends - sizes
        columns = [ids, begins.astype(np.int32), ends.astype(np.int32)]
        if not slow.any():
            return offsets, *columns
        rows = [
            self.one(texts[i].as_py()) if slow[i] else [c[offsets[i] : offsets[i + 1]] for c in columns]
            for i in range(n)
        ]
        offsets = np.concatenate(([0], np.cumsum([len(r[0]) for r in rows])))
        return offsets, *(np.concatenate([r[k] for r in rows]) for k in range(3))

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        out: list[str] = []
        for a in range(0, len(offsets) - 1, 256):
            bounds = offsets[a : a + 257]
            out += self.library.decode([ids[i:j].tolist() for i, j in zip(bounds[:-1], bounds[1:])])
        return out


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def encode(docs: DataFrame, model: str, *, text: str = "text", decoded: str | None = None) -> DataFrame:
    """``docs`` with ``ids``, ``begins`` and ``ends`` (array<int>) of every whole text.

    ``begins`` and ``ends`` are offsets in the text's UTF-8 bytes. Without begin or end ids
    and without sampling. A null or empty text has none. With ``decoded``, a column of that
    name holds what the library decodes from the ids. ``model`` is a path that every executor
    can open. Columns of ``docs`` with the added names are replaced; repeated rows are
    encoded one by one; an empty table gives an empty one.
    """
    ints = T.ArrayType(T.IntegerType())
    added = {"ids": ints, "begins": ints, "ends": ints} | ({decoded: T.StringType()} if decoded else {})
    kept = [f for f in docs.schema.fields if f.name == text or f.name not in added]
    source = docs.select(*[docs[f"`{f.name}`"] for f in kept])
    place = [f.name for f in kept].index(text)
    left = [i for i, f in enumerate(kept) if f.name not in added]
    schema = T.StructType([kept[i] for i in left] + [T.StructField(k, t) for k, t in added.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = pieces(model)
        for batch in batches:
            for part in slices(batch, place, TEXT_BYTES):
                offsets, ids, begins, ends = work.column(text_column(part.column(place)))
                bounds = pa.array(offsets.astype(np.int32))
                new = [pa.ListArray.from_arrays(bounds, pa.array(x)) for x in (ids, begins, ends)]
                if decoded:
                    new.append(pa.array(work.decode(ids, offsets), pa.string()))
                columns = [part.column(i) for i in left] + new
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return source.mapInArrow(run, schema)


def decode(rows: DataFrame, model: str, *, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """``rows`` with the text that the library decodes from ``ids``; null ids give an empty text."""
    kept = [f for f in rows.schema.fields if f.name != into]
    place = [f.name for f in kept].index(ids)
    schema = T.StructType([*kept, T.StructField(into, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = pieces(model)
        for batch in batches:
            texts = [work.library.decode(x or []) for x in batch.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=schema.names)

    return rows.select(*[rows[f"`{f.name}`"] for f in kept]).mapInArrow(run, schema)
