"""Words of whole Arrow text columns: split and numbered in native code, batch by batch."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Lower-cases A-Z and leaves other bytes alone; words are then split at ASCII white space.
SPACED = _LOWER
#: Lower-cases A-Z and turns every ASCII byte but letters and digits into a space.
ALNUM = bytes(
    x if x >= 0x80 or 0x30 <= x <= 0x39 or 0x61 <= x <= 0x7A else 0x20 for x in _LOWER
)


def text_column(column: pa.Array | pa.ChunkedArray) -> pa.StringArray:
    """One plain string array without nulls (null: empty) and without an offset."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.string()), "")
    if column.offset:
        column = pa.concat_arrays([column, pa.array([], pa.string())])
    return column


def translated(texts: pa.StringArray, table: bytes) -> pa.StringArray:
    """Every byte of every text through a table of 256 bytes that keeps UTF-8 valid."""
    _, offsets, data = texts.buffers()
    if data is None or not len(texts):
        return texts
    return pa.StringArray.from_buffers(
        len(texts), offsets, pa.py_buffer(data.to_pybytes().translate(table))
    )


def numbered(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, pa.StringArray]:
    """Row offsets, one number per non-empty string, and the distinct strings."""
    coded = lists.flatten().dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    names = coded.dictionary
    offsets = lists.offsets.to_numpy().astype(np.int64)
    offsets -= offsets[0] if len(offsets) else 0
    empty = pc.index(names, pa.scalar("", names.type)).as_py()
    if empty >= 0:
        keep = codes != empty
        offsets = np.concatenate(([0], np.cumsum(keep)))[offsets]
        codes = codes[keep]
        codes = codes - (codes > empty)
        names = pa.concat_arrays([names.slice(0, empty), names.slice(empty + 1)])
    return offsets, codes, names


def words(
    texts: pa.Array | pa.ChunkedArray, table: bytes = SPACED
) -> tuple[np.ndarray, np.ndarray, pa.StringArray]:
    """Words of each text: offsets (rows + 1), word numbers, distinct words."""
    texts = translated(text_column(texts), table)
    return numbered(pc.ascii_split_whitespace(texts))


def slices(batch: pa.RecordBatch, column: int, most: int) -> list[pa.RecordBatch]:
    """The batch in order, cut so that each part has about ``most`` bytes of text or one row."""
    texts = batch.column(column)
    sizes = pc.fill_null(pc.binary_length(texts.cast(pa.string())), 0).to_numpy(zero_copy_only=False)
    out, start, size = [], 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and size + n > most:
            out.append(batch.slice(start, i - start))
            start, size = i, 0
        size += n
    if start < len(sizes):
        out.append(batch.slice(start))
    return out


class Remembered:
    """Encodings of words by word; at ``limit`` words it forgets all and goes on."""

    def __init__(self, encode, limit: int = 200_000):
        self.encode, self.limit, self.known = encode, limit, {}

    def __call__(self, names: list[str]) -> list[bytes]:
        known = self.known
        missing = [w for w in names if w not in known]
        if len(known) + len(missing) > self.limit:
            known.clear()
            missing = names
        known.update(zip(missing, self.encode(missing)))
        return [known[w] for w in names]


def expanded(codes: np.ndarray, entries: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The int32 entries of each code one after another, and how many each code has.

    Arrow copies them as bytes; an index of every single number would take six times the result.
    """
    taken = pa.array(entries, pa.large_binary()).take(pa.array(codes))
    counts = pc.binary_length(taken).to_numpy().astype(np.int64) // 4
    return np.frombuffer(taken.buffers()[2], np.int32), counts


def total_before(counts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Row offsets in expanded entries from row offsets in words."""
    return np.concatenate(([0], np.cumsum(counts)))[offsets]
