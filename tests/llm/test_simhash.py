"""Fingerprints and classes against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash

from lumenframe.llm import simhash
from lumenframe.llm.common import connected_components

from .conftest import prose


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", low) if w]
    if not words:
        return 0
    sh = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_classes(rows):
    fps = [plain_fingerprint(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return [(d, f"{fp:016x}", least.get(root(i))) for i, (d, _), fp in zip(range(len(rows)), rows, fps, strict=True)]


def rows_of(seed=1):
    r = random.Random(seed)
    rows = []
    for g in range(12):
        base = prose(r, 400).split()
        for _ in range(6):
            w = list(base)
            for _ in range(r.randrange(4)):
                w[r.randrange(len(w))] = "changed"
            rows.append((len(rows) * 3, " ".join(w)))
    rows += [(1000 + i, prose(r, r.randrange(1, 30))) for i in range(60)]
    rows += [(5000, None), (5001, ""), (5002, " \t\n"), (5003, "one"), (5004, "One"), (5005, "a b c"), (5006, rows[0][1]), (7, "Straße ÉCOLE x y z"), (5007, "long " * 40_000), (5007, "long " * 40_000)]
    return rows


def test_against_brute_force(make_docs):
    rows = rows_of()
    got = sorted(tuple(r) for r in simhash.near_duplicates(make_docs(rows, clash=True)).collect())
    assert got == sorted(plain_classes(rows))


def test_null_ids(make_docs):
    rows = [(None, "a b c d e"), (None, "a b c d e"), (3, "a b c d e"), (None, "lonely text here now")]
    got = sorted(((r[0], r[2]) for r in simhash.near_duplicates(make_docs(rows)).collect()), key=str)
    assert got == sorted([(None, 3), (None, 3), (3, 3), (None, None)], key=str)


def test_empty_table(make_docs):
    out = simhash.near_duplicates(make_docs([]))
    assert out.columns == ["doc_id", "fingerprint", "component_id"] and out.count() == 0


@pytest.mark.parametrize("segments", [simhash.THREE_SEGMENTS, simhash.TWO_SEGMENTS])
def test_every_link_is_found(spark, segments):
    r = np.random.default_rng(2)
    base = r.integers(0, 2**63, 40, dtype=np.int64).tolist()
    fps = set(base)
    for b in base:
        for _ in range(6):
            x = b
            for bit in r.choice(64, int(r.integers(1, 7)), replace=False):
                x ^= 1 << int(bit)
            fps.add(x - (1 << 64) if x >= 1 << 63 else (x + (1 << 64) if x < -(1 << 63) else x))
    fps = sorted(fps)
    nodes = spark.createDataFrame([(f,) for f in fps], "fp long")
    got = {(a, b) for a, b in simhash.hamming_links(nodes, 4, segments).collect()}
    want = {(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if ((a ^ b) & (2**64 - 1)).bit_count() <= 4}
    assert got == want and want


@pytest.mark.parametrize("parts", ["own", "two", "near"])
def test_a_segment_that_all_share_is_split(spark, parts, monkeypatch):
    """Many fingerprints of one segment value, some of them linked."""
    monkeypatch.setattr(simhash, "HOT", 64)
    r = np.random.default_rng(4)
    fps = {int(x) << 22 | 777 for x in r.integers(0, 1 << 41, 600)}
    for b in list(fps)[:60]:
        fps |= {b ^ (1 << int(i)) ^ (1 << int(j)) for i, j in r.integers(22, 63, (3, 2))}
    fps = sorted(fps)
    assert len(fps) > 4 * simhash.HOT
    part = {f: f if parts == "own" else i % 2 if parts == "two" else f >> 40 for i, f in enumerate(fps)}
    nodes = spark.createDataFrame([(f, part[f]) for f in fps], "fp long, part long")
    got = {(a, b) for a, b in simhash.hamming_links(nodes).collect()}
    want = {(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if (a ^ b).bit_count() <= 4 and part[a] != part[b]}
    assert got == want and want


def test_segments_must_cover():
    with pytest.raises(ValueError):
        simhash.hamming_links(None, 5)


def test_components_of_a_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 200)] + [(7, 7)]
    random.Random(1).shuffle(chain)
    got = dict(map(tuple, connected_components(spark, spark.createDataFrame(chain, "a long, b long")).collect()))
    assert got == {i: 0 for i in range(61)} | {100 + i: 100 for i in range(200)}
    assert connected_components(spark, spark.createDataFrame([], "a long, b long")).count() == 0


def test_keep_one(make_docs):
    rows = rows_of(3)
    classes = plain_classes(rows)
    want = sorted({c for _, _, c in classes})
    got = sorted(r.doc_id for r in simhash.keep_one(make_docs(rows)).collect())
    assert got == want
    nameless = [(None, "x y z w v"), (None, "x y z w v"), (None, "other words stand in here"), (1, "p q r s")]
    assert simhash.keep_one(make_docs(nameless)).count() == 3


def test_keep_one_tells_texts_of_one_id_apart(make_docs):
    a, b = "the text that stands here is a copy", "quite another matter is told in these words"
    got = lambda rows: sorted((r.doc_id, r.text) for r in simhash.keep_one(make_docs(rows, clash=True)).collect())
    assert got([(5, a), (5, b)]) == sorted([(5, a), (5, b)])
    assert got([(3, a), (5, a), (5, b)]) == sorted([(3, a), (5, b)])
    assert len(got([(7, f"text {i} " * 5) for i in range(40)] * 2)) == 40
