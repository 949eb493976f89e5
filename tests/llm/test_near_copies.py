"""Near copies at similarity 0.8 against brute force."""

from __future__ import annotations

import random

import numpy as np

import corpus_pipeline
from lumenframe.llm import near_copies, simhash

from .conftest import prose


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_kept(rows):
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(d, least.get(root(i), d))
    return sorted(least.values())


def rows_of(seed):
    """Groups whose members differ in up to a tenth of their words, about the border."""
    r = random.Random(seed)
    rows = []
    for n in (8, 30, 200, 200, 600):
        base = prose(r, n).split()
        for k in range(12):
            w = list(base)
            for _ in range(k * n // 220):
                w[r.randrange(n)] = f"changed{r.randrange(999)}"
            rows.append((len(rows) * 3, " ".join(w)))
    rows += [(1000 + i, prose(r, r.randrange(1, 40))) for i in range(40)]
    return rows + [(2000, None), (2001, ""), (2002, "one"), (2003, "One"), (2004, rows[0][1])]


def test_stage_against_brute_force(spark, make_docs):
    rows = rows_of(5)
    out = corpus_pipeline.drop_near_copies(spark, make_docs(rows), None)
    assert sorted(r.doc_id for r in out.collect()) == plain_kept(rows)


def test_texts_of_one_id_and_rows_without_ids(make_docs):
    a, b = "the text that stands here is a copy", "quite another matter is told in these words"
    rows = [(3, a), (5, a), (5, b), (None, a), (None, "lonely text"), (None, "lonely text")]
    out = simhash.keep_one(make_docs(rows, clash=True), shingle=5, similarity=0.8)
    assert sorted((str(r.doc_id), r.text) for r in out.collect()) == sorted([("3", a), ("5", b), ("None", "lonely text")])
    assert simhash.keep_one(make_docs([]), shingle=5, similarity=0.8).count() == 0


def test_bands_find_similar_sets():
    r = np.random.default_rng(3)
    for _ in range(300):
        h = r.integers(0, 1 << 63, 225, np.uint64)
        assert set(near_copies.bands(h[:200])) & set(near_copies.bands(h[25:]))  # 175 of 225


def test_rows_grow_with_texts_that_share_a_passage(make_docs, monkeypatch):
    """No table has a row a pair, and what lies about the border is still found."""
    r = random.Random(8)
    passage, base = prose(r, 60), prose(r, 120).split()
    rows = [(i, passage + " " + prose(r, r.randrange(30, 60))) for i in range(400)]
    for k in range(120):
        w = list(base)
        for _ in range(k % 10):
            w[r.randrange(120)] = f"changed{r.randrange(999)}"
        rows.append((1000 + k, " ".join(w)))
    written = {}

    def counted(df, name, write=near_copies.materialise):
        out = write(df, name)
        written[name] = out.count()
        return out

    monkeypatch.setattr(near_copies, "materialise", counted)
    out = simhash.keep_one(make_docs(rows), shingle=5, similarity=0.8)
    assert sorted(x.doc_id for x in out.collect()) == plain_kept(rows)
    assert max(written.values()) <= near_copies.BANDS * len(rows), written
    assert 0 < written["linkable_sets"] < written["open_sets"]


def test_block_links_against_all_pairs(monkeypatch):
    monkeypatch.setattr(near_copies, "STRIP", 7)
    monkeypatch.setattr(near_copies, "MOST_VALUES", 1)  # 64 columns at once
    r = np.random.default_rng(5)
    base = r.integers(-(1 << 62), 1 << 62, 200)
    sets = [np.unique(np.concatenate([r.choice(base, 170, replace=False)[: 170 - k], r.integers(0, 1 << 62, k)])) for k in r.integers(0, 30, 60)]
    fp, part = np.arange(60), np.arange(60) // 2
    size = n = np.array([len(x) for x in sets])
    two = [(np.arange(60), np.arange(60)), (np.arange(0, 60, 3), np.arange(1, 60, 3)), (np.zeros(0, np.int64), np.arange(4))]
    for left, right in two:
        want = [(i, j) for i in left for j in right if part[i] != part[j] and near_copies.similarity(sets[i], sets[j]) >= 0.68]
        a, b = near_copies.block_links(fp, part, size, left, right, n, np.concatenate(sets), 0.68)
        assert {(min(x), max(x)) for x in zip(a.tolist(), b.tolist(), strict=True)} <= {(min(x), max(x)) for x in want}
        assert len(a) == len(near_copies._spanning(*(part[[w[k] for w in want]] if want else part[:0] for k in (0, 1))))
        assert len(want) > len(a) > 0 or not len(left)
