"""Fingerprints, links and components against brute force."""

from __future__ import annotations

import numpy as np
import pytest
import xxhash

from packetloom.llm import simhash
from packetloom.llm.components import components
from packetloom.session import written


def plain_fingerprint(text, size=4):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    grams = [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    value = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    return value


def brute(ids, marks, limit):
    root = list(range(len(marks)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(marks)):
        for j in range(i):
            if (marks[i] ^ marks[j]).bit_count() <= limit:
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) for i in range(len(ids))]


def test_documents_equal_brute_force(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    rows = docs.collect()
    marks = [plain_fingerprint(r.text) for r in rows]
    want = dict(zip([r.doc_id for r in rows], zip(marks, brute([r.doc_id for r in rows], marks, 4))))
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.fingerprint % 2**64, r.component_id) for r in got} == want
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c in want.values()})


@pytest.mark.parametrize("block", [4, 2048])
@pytest.mark.parametrize("parts", [4, 5])
def test_links_equal_brute_force(spark, monkeypatch, block, parts):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = np.random.default_rng(block + parts)
    base = [int(x) for x in rng.integers(0, 2**63, 30)]
    marks = set(base)
    for b in base[:12]:
        for _ in range(12):
            for bit in rng.choice(64, int(rng.integers(1, 6)), replace=False):
                b ^= 1 << int(bit)
            marks.add(b)
    marks = sorted(marks)
    df = spark.createDataFrame([(m - 2**64 if m >= 2**63 else m,) for m in marks], "fp long").repartition(3)
    links = simhash.near_links(written(df, "t"), 4, parts).collect()
    assert all(((r.a ^ r.b) % 2**64).bit_count() <= 4 for r in links)
    signed = [m - 2**64 if m >= 2**63 else m for m in marks]
    want = brute(signed, marks, 4)
    roots = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()} if links else {}
    assert [roots.get(s, s) for s in signed] == want


def test_odd_rows(spark):
    rows = [
        (5, None, "z"), (3, "", "z"), (None, "  ", "z"), (9, "One two", "z"), (9, "one TWO", "z"), (None, "a b c d e", "z"),
        (None, "a b c d e", "z"), (7, "x " * 50_000, "z"), (7, "x " * 50_000, "z"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = [tuple(r) for r in simhash.near_duplicates(docs).collect()]
    assert sorted([g[0] or 0, g[1] % 2**64, g[2] or 0] for g in got) == sorted(
        [d or 0, plain_fingerprint(t), c]
        for (d, t, _), c in zip(rows, [3, 3, 3, 9, 9, 0, 0, 7, 7])
    )
    kept = simhash.one_of_each(docs).collect()
    assert sorted((r.doc_id or 0, r.text[:3] if r.text else r.text) for r in kept)[0] == (0, "a b")
    assert sorted(r.doc_id or 0 for r in kept) == [0, 3, 7, 9]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    assert simhash.one_of_each(docs.limit(0)).count() == 0
