"""Cross-tokenizer alignment with an inverted index of document bitmaps per token pair.

Both tokenizers cut the same bytes. Cutting at all ends of either gives stretches that lie in
one token of each: a stretch is a link of the two, and the ends that both share close a group.

The index holds for every block of documents and every pair of ids linked in it a bitmap of the
block's documents, and planes of bitmaps with the bits of how many links beyond the first each
document has. A bitmap is stored as 16-bit document numbers or as plain bits, whichever is less.
Slices of a block are merged by OR into its bitmaps; blocks number different documents, so the
popcounts of a pair's bitmaps add up to its documents, and those of its planes, doubled from
plane to plane, to its further links. A pair has one row per block and none per document, so
the commonest pair is a small share of all rows.

Scores of pairs go back to the blocks that hold them. There the postings of the bitmaps hand
them to the documents.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetloom.llm.piece_offsets import SPACE, pieces
from packetloom.llm.words import numbered, slices, text_column, total_before
from packetloom.session import written

#: Text of a slice, and of a block of slices; a longer text is a block of its own.
SLICE_BYTES, BLOCK_BYTES = 2 << 20, 8 << 20
#: Documents of a block have numbers of 16 bits, ids fewer than ``PAIR_BITS`` bits.
BLOCK_DOCS, PAIR_BITS = 1 << 16, 23
_ALL_SPACE = r"\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: Texts in which words at single spaces cannot be encoded one by one.
_WHOLE = rf"  |^ | $|{SPACE}|[\t-\r] [\t-\r]|[{_ALL_SPACE}]"
_PLANE = "struct<sizes:binary,sparse:binary,dense:binary>"
_ZEROS = ("n_a", "n_b", "n_groups", "n_links")


def byte_of_characters() -> dict[str, int]:
    """Byte-level vocabularies write printable Latin-1 bytes as themselves, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class TokenBytes:
    """The bytes of every id, one after another."""

    def __init__(self, each: list[bytes]):
        self.sizes = np.array([len(x) for x in each], np.int64)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.data = np.frombuffer(b"".join(each), np.uint8)

    def joined(self, ids: np.ndarray) -> bytes:
        n = self.sizes[ids]
        ends = np.cumsum(n)
        at = np.repeat(self.first[ids] - (ends - n), n)
        at += np.arange(len(at))
        return self.data[at].tobytes()


class Encoder:
    """A tokenizer that puts a space in front of a text, and the bytes of its ids.

    ``whole`` encodes texts one by one, ``joined`` a text of words between single spaces, in
    which tokens never run across a space; ``apart`` matches words that it may not take.
    """

    def __init__(self, known: TokenBytes, whole, joined=None, apart: str = "$^"):
        self.bytes, self.whole, self.joined, self.apart = known, whole, joined, apart

    def words(self, names: pa.StringArray) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of all words one after another and how many each has; None if bytes do not fit."""
        if self.joined is None:
            return None
        odd = pc.match_substring_regex(names, self.apart).to_numpy(zero_copy_only=False)
        found = self._together(names.filter(pa.array(~odd)) if odd.any() else names)
        if found is None or not odd.any():
            return found
        alone = self.whole(names.filter(pa.array(odd)).to_pylist())
        sizes = np.empty(len(names), np.int64)
        sizes[~odd], sizes[odd] = found[1], [len(x) for x in alone]
        of_odd = np.repeat(odd, sizes)
        ids = np.empty(len(of_odd), np.int32)
        ids[~of_odd], ids[of_odd] = found[0], np.concatenate(alone)
        return ids, sizes

    def _together(self, names: pa.StringArray) -> tuple[np.ndarray, np.ndarray] | None:
        if not len(names):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        listed = names.to_pylist()
        ids = self.joined(listed)
        if self.bytes.joined(ids) != (" " + " ".join(listed)).encode():
            return None
        # bytes tell where a word's tokens end
        ends = np.cumsum(self.bytes.sizes[ids])
        words = np.cumsum(pc.binary_length(names).to_numpy().astype(np.int64) + 1)
        last = np.searchsorted(ends, words)
        if (ends[last] != words).any():
            return None
        return ids, np.diff(last, prepend=-1)


# Fixed value: how byte-level tokenizers of this kind cut a text before they merge bytes.
CUTS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words with other characters, or white space in front, go to the file's own library.
_STEADY = r"[^\x{0}-\x{52F}\x{3041}-\x{3096}\x{30A1}-\x{30FA}\x{4E00}-\x{9FA5}\x{AC00}-\x{D7A3}]|^[\t-\r]"


@lru_cache(maxsize=2)
def byte_level(path: str) -> Encoder:
    """A byte-level tokenizer file.

    If its merges have their ids in order, they are ranks, and the faster library for ranks
    encodes the words that both cut alike.
    """
    import tiktoken
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    with open(path, encoding="utf-8") as file:
        stored = json.load(file)
    byte, model = byte_of_characters(), stored["model"]
    names = {i: bytes(byte[c] for c in w) for w, i in model["vocab"].items() if all(c in byte for c in w)}
    added = {x["id"]: x["content"].encode() for x in stored["added_tokens"]}
    each = [added[i] if i in added else names.get(i, b"") for i in range(1 + max([*names, *added]))]

    def whole(texts: list[str]) -> list[np.ndarray]:
        found = library.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)
        return [np.array(e.ids, np.int32) for e in found]

    made = [model["vocab"].get("".join(m) if isinstance(m, list) else m.replace(" ", "")) for m in model["merges"]]
    ranks = {w: i for i, w in names.items() if i not in added}
    joined = None
    if made == sorted(made) and len(set(made)) == len(made) and len(ranks) == 256 + len(made) and stored["normalizer"] is None and stored["pre_tokenizer"] == _BYTE_LEVEL:
        by_rank = tiktoken.Encoding("file", pat_str=CUTS, mergeable_ranks=ranks, special_tokens={})

        def joined(words: list[str]) -> np.ndarray:
            return np.array(by_rank.encode_ordinary(" " + " ".join(words)), np.int32)

    return Encoder(TokenBytes(each), whole, joined, _STEADY)


_BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
#: Words that a SentencePiece model encodes as one text.
TOGETHER = 200


@lru_cache(maxsize=2)
def piece_model(path: str) -> Encoder:
    """A SentencePiece model file, which puts the space in front itself."""
    model = pieces(path)
    library = model.library
    names = [library.id_to_piece(i) for i in range(library.get_piece_size())]
    each = [bytes([int(x[3:5], 16)]) if library.is_byte(i) else x.replace(SPACE, " ").encode() for i, x in enumerate(names)]

    def whole(texts: list[str]) -> list[np.ndarray]:
        return [np.array(ids, np.int32) for ids in library.encode(texts, num_threads=1)]

    def joined(words: list[str]) -> np.ndarray:
        return np.concatenate(whole([" ".join(words[i : i + TOGETHER]) for i in range(0, len(words), TOGETHER)]))

    return Encoder(TokenBytes(each), whole, joined if model.by_word else None)


def _spread(codes: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of each code one after another, and how many each code has."""
    first = np.cumsum(counts) - counts
    n = counts[codes]
    at = np.repeat(first[codes] - (np.cumsum(n) - n), n)
    at += np.arange(len(at))
    return ids[at], n


def encoded(texts: pa.StringArray, encoders: list[Encoder]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each encoder, ids of all texts and row offsets; texts that one does not give back have none."""
    empty = pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    slow = pc.match_substring_regex(texts, _WHOLE).to_numpy(zero_copy_only=False) & ~empty
    plain = pc.if_else(pa.array(slow), "", texts) if slow.any() else texts
    offsets, codes, names = numbered(pc.split_pattern(plain, " "))
    by_word = [e.words(names) for e in encoders]
    if any(w is None for w in by_word):
        slow, by_word = ~empty, [(np.zeros(0, np.int32), np.zeros(len(names), np.int64)) for _ in encoders]
    odd = np.flatnonzero(slow)
    wanted = [texts[i].as_py() for i in odd.tolist()]
    alone = [e.whole(wanted) if wanted else [] for e in encoders]
    good = np.array([all(e.bytes.joined(a[k]) == (" " + t).encode() for e, a in zip(encoders, alone)) for k, t in enumerate(wanted)], bool)
    out = []
    for (ids, counts), found in zip(by_word, alone):
        flat, n = _spread(codes, ids, counts)
        sizes = np.diff(total_before(n, offsets))
        found = [x if ok else x[:0] for x, ok in zip(found, good)]
        sizes[odd] = [len(x) for x in found]
        if found:
            of_odd = np.repeat(slow, sizes)
            both = np.empty(int(sizes.sum()), np.int32)
            both[~of_odd], both[of_odd] = flat, np.concatenate(found)
            flat = both
        out.append((flat, np.concatenate(([0], np.cumsum(sizes)))))
    return out


class Aligned:
    """Texts cut by both tokenizers: ``a`` and ``b`` ids, and links as places in them."""

    def __init__(self, texts: pa.StringArray, a_file: str, b_file: str):
        first, second = byte_level(a_file), piece_model(b_file)
        (self.a, self.a_at), (self.b, self.b_at) = encoded(texts, [first, second])
        # bytes run on over all texts, so the end of each text is an end of both
        ends_a, ends_b = (np.cumsum(e.bytes.sizes[x]) for e, x in ((first, self.a), (second, self.b)))
        total = np.concatenate(([0], ends_a))[self.a_at]  # bytes before each text
        in_a, in_b = (np.zeros(int(total[-1]) + 1, bool) for _ in range(2))
        in_a[ends_a], in_b[ends_b] = True, True
        cuts = np.flatnonzero(in_a | in_b)
        # a stretch that ends at a cut lies in the token with the first end there or behind
        self.link_a, self.link_b = ((np.cumsum(x, dtype=np.int32) - x)[cuts] for x in (in_a, in_b))
        shared = in_a & in_b
        closed = np.cumsum(shared, dtype=np.int32)
        self.n_groups = np.diff(closed[total]).astype(np.int64)
        self.n_links = np.diff(np.searchsorted(cuts, total, "right"))
        self.doc = np.repeat(np.arange(len(texts)), self.n_links)
        closed -= shared
        self.group_a, self.group_b = closed[ends_a], closed[ends_b]

    def groups(self) -> list[str]:
        """``a1,a2|b1;a3|b2,b3`` for each text: the ids of its groups; without tokens nothing."""
        n = int(self.n_groups.sum())
        of_a, of_b = np.bincount(self.group_a, minlength=n), np.bincount(self.group_b, minlength=n)
        before_a, before_b = np.cumsum(of_a) - of_a, np.cumsum(of_b) - of_b
        code = np.empty(len(self.a) + len(self.b), np.int64)
        # of a group first the a ids, then the b ids
        code[np.arange(len(self.a)) + before_b[self.group_a]] = self.a.astype(np.int64) * 4
        code[np.arange(len(self.b)) + (before_a + of_a)[self.group_b]] = self.b.astype(np.int64) * 4
        code[np.cumsum(of_a + of_b) - of_b - 1] += 1  # the last a id of each group
        last = np.cumsum(of_a + of_b) - 1
        code[last] += 2
        ends = self.a_at + self.b_at
        code[ends[1:][self.n_groups > 0] - 1] += 1  # nothing follows the last token of a text
        names = spelled(int(max(self.a.max(initial=0), self.b.max(initial=0))))
        said = list(map(names.__getitem__, code.tolist()))
        ends = ends.tolist()
        return ["".join(said[x:y]) for x, y in zip(ends, ends[1:])]


_SPELLED: list[str] = []


def spelled(most: int) -> list[str]:
    """The number k // 4 and what follows it, for all ids up to ``most``."""
    for i in range(len(_SPELLED) // 4, most + 1):
        _SPELLED.extend((f"{i},", f"{i}|", f"{i};", str(i)))
    return _SPELLED


class BlockIndex:
    """Bitmaps of the pairs of one block, merged from slices."""

    def __init__(self):
        self.docs = 0
        self.links: list[np.ndarray] = []

    def add(self, slice_: Aligned) -> None:
        """Take in a slice; its documents get the next numbers."""
        pair = slice_.a[slice_.link_a].astype(np.int64) << PAIR_BITS | slice_.b[slice_.link_b]
        self.links.append(pair << 16 | (slice_.doc + self.docs))
        self.docs += len(slice_.n_links)

    def planes(self) -> tuple[np.ndarray, np.ndarray, list[dict]]:
        """Both ids of the pairs, and their bitmaps: of the documents, then planes of further links."""
        posting, links = np.unique(np.concatenate(self.links), return_counts=True)
        pair, doc = posting >> 16, posting & 0xFFFF
        new = np.ones(len(pair), bool)
        new[1:] = pair[1:] != pair[:-1]
        names, code = pair[new], np.cumsum(new) - 1
        out = [packed(code, doc, len(names), self.docs)]
        more = links - 1
        for bit in range(int(more.max(initial=0)).bit_length()):
            some = (more >> bit & 1).astype(bool)
            out.append(packed(code[some], doc[some], len(names), self.docs))
        return (names >> PAIR_BITS).astype(np.int32), (names & (1 << PAIR_BITS) - 1).astype(np.int32), out


def packed(code: np.ndarray, doc: np.ndarray, pairs: int, docs: int) -> dict:
    """Bitmaps of documents by pair: numbers of 16 bits for few, plain bits for many."""
    sizes = np.bincount(code, minlength=pairs)
    dense = sizes * 16 > max(docs, 1)
    many = dense[code]
    row = (np.cumsum(dense) - 1)[code[many]]
    bits = np.zeros((int(dense.sum()), -(-docs // 8) * 8), np.uint8)
    bits[row, doc[many]] = 1
    return {
        "sizes": sizes.astype(np.int32).tobytes(), "sparse": doc[~many].astype(np.uint16).tobytes(),
        "dense": np.packbits(bits, 1).tobytes(),
    }


def unpacked(plane: dict, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Pair and document of each set bit."""
    sizes = np.frombuffer(plane["sizes"], np.int32)
    dense = sizes.astype(np.int64) * 16 > max(docs, 1)
    few = np.repeat(np.flatnonzero(~dense), sizes[~dense])
    bits = np.frombuffer(plane["dense"], np.uint8).reshape(int(dense.sum()), -(-docs // 8))
    row, doc = np.nonzero(np.unpackbits(bits, axis=1))
    return np.concatenate((few, np.flatnonzero(dense)[row])), np.concatenate((np.frombuffer(plane["sparse"], np.uint16).astype(np.int64), doc))


def popcounts(plane: dict, docs: int) -> np.ndarray:
    """Set bits of each pair's bitmap."""
    sizes = np.frombuffer(plane["sizes"], np.int32).astype(np.int64)
    dense = sizes * 16 > max(docs, 1)
    out = np.where(dense, 0, sizes)
    bits = np.frombuffer(plane["dense"], np.uint8).reshape(int(dense.sum()), -(-docs // 8))
    out[dense] = np.bitwise_count(bits).sum(1, dtype=np.int64)
    return out


def build_index(docs: DataFrame, a_file: str, b_file: str, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per block of documents, as a written table.

    ``block``; of its documents in order ``ids``, ``n_a``, ``n_b``, ``n_groups``, ``n_links`` and
    ``groups`` (the SHA-256 of the groups' text, '' without tokens); of its pairs ``pair_a`` and
    ``pair_b``; and ``planes``, the packed bitmaps. Every row of ``docs`` is in one block.
    """
    source = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`"))
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("ids", T.ArrayType(source.schema[0].dataType))])
    for name in _ZEROS:
        schema = schema.add(name, T.ArrayType(T.LongType()))
    schema = schema.add("groups", T.ArrayType(T.StringType()))
    schema = schema.add("pair_a", T.ArrayType(T.IntegerType())).add("pair_b", T.ArrayType(T.IntegerType()))
    schema = schema.add("planes", T.ArrayType(T._parse_datatype_string(_PLANE)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256

        me, done = TaskContext.get().partitionId() << 32, 0
        held: BlockIndex | None = None
        size, columns = 0, {}

        def closed() -> pa.RecordBatch:
            pair_a, pair_b, planes = held.planes()
            one = lambda values, kind=None: pa.array([values], pa.list_(kind)) if kind else pa.array([values])
            arrays = [pa.array([me + done], pa.int64())]
            ids = pa.concat_arrays(columns["ids"])
            arrays.append(pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids))
            arrays += [one(np.concatenate(columns[name]), pa.int64()) for name in _ZEROS]
            arrays.append(one(sum(columns["groups"], []), pa.string()))
            arrays += [one(pair_a, pa.int32()), one(pair_b, pa.int32())]
            kind = pa.struct({"sizes": pa.binary(), "sparse": pa.binary(), "dense": pa.binary()})
            arrays.append(one(planes, kind))
            return pa.RecordBatch.from_arrays(arrays, names=schema.names)

        for batch in batches:
            for part in slices(batch, 1, SLICE_BYTES):
                for low in range(0, len(part), BLOCK_DOCS):
                    piece = part.slice(low, BLOCK_DOCS)
                    texts = text_column(piece.column(1))
                    nbytes = int(pc.sum(pc.binary_length(texts)).as_py() or 0)
                    if held is not None and (size + nbytes > BLOCK_BYTES or held.docs + len(piece) > BLOCK_DOCS):
                        yield closed()
                        done, held = done + 1, None
                    if held is None:
                        held, size = BlockIndex(), 0
                        columns = {name: [] for name in ("ids", "groups", *_ZEROS)}
                    found = Aligned(texts, a_file, b_file)
                    held.add(found)
                    size += nbytes
                    columns["ids"].append(piece.column(0))
                    columns["groups"].append([sha256(x.encode()).hexdigest() if x else "" for x in found.groups()])
                    for name, values in zip(_ZEROS, (np.diff(found.a_at), np.diff(found.b_at), found.n_groups, found.n_links)):
                        columns[name].append(values)
        if held is not None:
            yield closed()

    return written(source.mapInArrow(run, schema), "pair-index")


def pair_counts(index: DataFrame) -> DataFrame:
    """a, b, docs and links of every linked pair of ids over the corpus, and whether ``best``: no
    id has more links with this b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, a, b, planes in zip(*(batch.column(k) for k in range(4))):
                n, planes = n.as_py(), planes.as_py()
                docs = popcounts(planes[0], n)
                links = docs + sum(popcounts(plane, n) << k for k, plane in enumerate(planes[1:]))
                yield pa.RecordBatch.from_arrays([a.values, b.values, pa.array(docs), pa.array(links)], names=["a", "b", "docs", "links"])

    rows = index.select(F.size("ids").alias("n"), "pair_a", "pair_b", "planes").mapInArrow(run, "a int, b int, docs long, links long")
    rows = rows.groupBy("a", "b").agg(F.sum("docs").alias("docs"), F.sum("links").alias("links"))
    # at most as many rows of a b as the first vocabulary has ids
    most = F.max("links").over(Window.partitionBy("b"))
    return rows.withColumn("best", F.col("links") == most)


def scored_documents(index: DataFrame, pairs: DataFrame) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups, n_best, count_sum of every indexed document."""
    place = F.posexplode(F.arrays_zip(F.col("pair_a").alias("a"), F.col("pair_b").alias("b"))).alias("nth", "pair")
    asked = index.select("block", place).select("block", "nth", "pair.a", "pair.b")
    scores = asked.join(pairs.select("a", "b", "links", "best"), ["a", "b"])
    scores = scores.groupBy("block").agg(F.collect_list(F.struct("nth", "links", "best")).alias("scores"))  # the pairs of one block
    rows = index.drop("pair_a", "pair_b").join(scores, "block", "left")
    kept = ["ids", *_ZEROS, "groups"]
    names = ["doc_id", *_ZEROS, "groups", "n_best", "count_sum"]
    schema = T.StructType([T.StructField(n, index.schema[k].dataType.elementType) for n, k in zip(names, kept)])
    schema = schema.add("n_best", T.LongType()).add("count_sum", T.LongType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                get = lambda name: batch.column(name)[k]
                n = len(get("ids"))
                best, total = np.zeros(n, np.int64), np.zeros(n, np.int64)
                found = get("scores").values
                if found is not None and len(found):
                    nth = found.field("nth").to_numpy()
                    links, is_best = np.zeros(len(nth), np.int64), np.zeros(len(nth), np.int64)
                    links[nth] = found.field("links").to_numpy()
                    is_best[nth] = found.field("best").to_numpy(zero_copy_only=False)
                    for p, plane in enumerate(get("planes").as_py()):
                        pair, doc = unpacked(plane, n)
                        np.add.at(total, doc, links[pair] << max(p - 1, 0))
                        np.add.at(best, doc, is_best[pair] << max(p - 1, 0))
                columns = [get(name).values for name in kept] + [pa.array(best), pa.array(total)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.select(*kept, "planes", "scores").mapInArrow(run, schema)


def align(docs: DataFrame, a_file: str, b_file: str, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups, n_best, count_sum for every row of ``docs``.

    A space and the text are encoded by the byte-level tokenizer ``a_file``, the text by the
    SentencePiece model ``b_file``, which puts the space in front itself; both without special
    tokens. A link is a token of each whose bytes overlap. ``count_sum`` sums over a document's
    links how many links the corpus has between the same two ids; ``n_best`` counts the links
    whose number is the highest of their second id, ties included. ``groups`` is the
    SHA-256 of the groups of tokens between common ends.

    Null and empty texts, and texts that either tokenizer does not give back byte for byte, have
    no tokens: zeros and ''. Repeated rows count each; a null doc_id stays null; an empty
    table gives no rows; other columns are not read. Both files are paths that every
    executor can open.
    """
    index = build_index(docs, a_file, b_file, doc_id=doc_id, text=text)
    return scored_documents(index, written(pair_counts(index), "pair-counts"))
