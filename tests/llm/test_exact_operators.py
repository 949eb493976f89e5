"""Top-k search, URL filters, mixing, tokenisation and the pipeline against brute force."""

from __future__ import annotations

import hashlib
import math
import os
import random
import shutil

import duckdb
import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from lumenframe.llm import mixing, pieces, queries, topk, urls

from .conftest import prose


@pytest.fixture(scope="module")
def mid():
    return "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, mid, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{mid}/{t}.parquet'")
    want = c.sql(queries.ORACLE_SQL[name])
    got = queries.QUERIES[name](spark, mid)
    assert sorted(got.columns) == sorted(want.columns)
    at = [want.columns.index(x) for x in got.columns]
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())


# --- top-k --------------------------------------------------------------------------------


def plain_topk(rows, k=5, step=50):
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for i, q in ok:
        if i % step == 0:
            s = sorted((-min(max(sum(a * b for a, b in zip(q, v, strict=False)), -(1 << 63)), (1 << 63) - 1), j) for j, v in ok if j != i)[:k]
            out |= {(i, n, j, -x) for n, (x, j) in enumerate(s, 1)}
    return out


def test_topk_against_brute_force(spark):
    r = np.random.default_rng(3)
    centres = r.normal(size=(6, 16))
    rows = [(i, (centres[i % 6] * (0.2 + i % 3) + r.normal(0, 0.3, 16)).tolist()) for i in range(1200)]
    rows += [(2000, None), (2001, [None] * 16), (2050, [float("nan")] * 16), (2100, [0.0] * 16), (2101, [0.5] * 8), (None, [1.0] * 16), (2150, [1e300] + [0.0] * 15), (2200, rows[0][1]), (2201, rows[0][1])]
    df = spark.createDataFrame([(*x, "c") for x in rows], "vec_id long, embedding array<double>, score string")
    got = {tuple(x) for x in topk.search(df, F.col("vec_id") % 50 == 0).collect()}
    assert got == plain_topk(rows)


def test_topk_of_large_components_and_empty_vectors(spark):
    r = np.random.default_rng(4)
    rows = [(i, (r.normal(size=8) * 10.0 ** int(r.integers(0, 9))).tolist()) for i in range(400)]  # to 10^8 and beyond
    rows += [(500, []), (501, []), (550, [1.0]), (600, [70_000.0, 0.0]), (601, [90_000.0, 0.0]), (650, [3e15] * 8)]
    for part in (rows, [(50, [1.0]), (51, []), (52, [])], [(0, []), (1, [])]):
        df = spark.createDataFrame(part, "vec_id long, embedding array<double>")
        assert {tuple(x) for x in topk.search(df, F.col("vec_id") % 50 == 0).collect()} == plain_topk(part)


def test_topk_sql_on_large_components_and_empty_vectors(spark, tmp_path):
    rows = [(0, [1e6, -2e6]), (1, [3e6, 4.0]), (2, []), (50, []), (51, [0.5]), (52, None)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    c = duckdb.connect()
    c.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    got = {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in queries.op5_topk(spark, str(tmp_path)).collect()}
    assert got == set(c.sql(queries.ORACLE_SQL["op5_topk"]).fetchall()) == plain_topk(rows)


def test_topk_scores_few_vectors_exactly():
    r = np.random.default_rng(5)
    centres = r.normal(size=(40, 32))
    for m in (r.normal(size=(4000, 32)), centres[r.integers(0, 40, 4000)] + r.normal(0, 0.2, (4000, 32))):
        m = np.floor(64 * m).astype(np.int32)
        index = topk.ImpactIndex(np.arange(4000), m)
        for i in range(0, 4000, 200):
            ids, scores = index.top(m[i].astype(float), 5, i, -np.inf)
            plain = m.astype(float) @ m[i]
            plain[i] = -np.inf
            assert ids.tolist() == np.lexsort((np.arange(4000), -plain))[:5].tolist() and scores.tolist() == plain[ids].tolist()
        assert index.scored <= (topk.REMAIN + 0.01) * index.seen


def test_plans_do_not_depend_on_what_ran_before(spark, make_docs):
    """Operators leave no setting behind that another one reads."""
    told = lambda: [spark.conf.get(f"spark.sql.{k}") for k in ("execution.arrow.maxRecordsPerBatch", "shuffle.partitions", "autoBroadcastJoinThreshold")]
    before = told()
    queries.token_digests(make_docs([(1, "a b")])).collect()
    mixing.mix(make_docs([(1, "a b")])).collect()
    assert before == told()


def test_topk_proof_and_chunks(spark, monkeypatch):
    monkeypatch.setattr(topk, "CHUNK", 7)
    rows = [(i, [float((i * 7) % 5), float(i % 3), 1.0]) for i in range(400)]  # many ties
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert {tuple(x) for x in topk.search(df, F.col("vec_id") % 10 == 0).collect()} == plain_topk(rows, step=10)
    assert topk.search(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert topk.search(df.where("vec_id < 3"), F.col("vec_id") % 50 == 0).count() == 2


# --- URLs -----------------------------------------------------------------------------------


def plain_url(u):
    if u is None or "://" not in u:
        return "", "", None, "allow"
    rest = u.split("://", 1)[1]
    n = min([rest.index(c) for c in "/?#" if c in rest] + [len(rest)])
    host, tail = rest[:n], rest[n:]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    path = tail[: min([tail.index(c) for c in "?#" if c in tail] + [len(tail)])]
    fits = [(h + p, v) for h, p, v in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule, verdict = max(fits, key=lambda f: len(f[0]), default=(None, "allow"))
    return host, path, rule, verdict


def test_urls_against_brute_force(spark):
    hosts = ["com", "a.com", "example.com", "www.example.com", "x.www.example.com", "notexample.com", "b.net", "net", "fr", "Example.COM", "", ".", "a..com", "ÀB.com"]
    tails = ["", "/", "/en", "/en/", "/en/x/y", "/es/", "/fr/1?q=/en/", "?x=/en/", "#/es/", "//", "/EN/", "/en//x", "/de/en/"]
    rows = [f"http://{h}{t}" for h in hosts for t in tails] + ["://", "nothing", "", None, "a://b://net/es/", "x" * 5000 + "://net/fr/" + "y/" * 300]
    df = spark.createDataFrame([(i, u, 1) for i, u in enumerate(rows)] + [(0, rows[0], 1)], "page_id long, url string, key int")
    got = sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in urls.judge_urls(df).collect())
    assert got == sorted([(i, *plain_url(u)) for i, u in enumerate(rows)] + [(0, *plain_url(rows[0]))])
    assert urls.judge_urls(df.limit(0)).count() == 0
    assert {r.verdict for r in urls.judge_urls(df, rules=()).collect()} == {"allow"}


def test_long_urls(spark):
    rows = ["http://www.example.com" + "/" * 100_000, "http://www.example.com/en" + "/x" * 100_000, "http://" + "a." * 100_000 + "example.com/en/", "http://" + "." * 100_000 + "/" * 100_000, "http://net/es/" + "y" * 100_000]
    df = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
    got = sorted(tuple(r) for r in urls.judge_urls(df).select("page_id", "host", "path", "rule", "verdict").collect())
    assert got == [(i, *plain_url(u)) for i, u in enumerate(rows)]


def test_cascade_of_several_pieces(spark, monkeypatch):
    monkeypatch.setattr(urls, "PIECE_BITS", 1 << 10)
    df = spark.createDataFrame([(f"k{i}",) for i in range(4000)], "key string")
    listed = df.where(F.xxhash64("key") % 7 == 0)
    for size in (0, 4000):
        c = urls.Cascade(listed, df, size, bits_per_key=8)
        assert len(c.levels[0].words) > 1
        assert {r.key for r in df.where(c.holds(F.col("key"))).collect()} == {r.key for r in listed.collect()}


def test_cascade_is_exact_over_its_universe(spark):
    """Few bits a key, so that several levels are needed."""
    keys = [f"k{i}" for i in range(3000)]
    df = spark.createDataFrame([(k,) for k in keys], "key string")
    listed = df.where(F.xxhash64("key") % 10 == 0)
    c = urls.Cascade(listed, df, bits_per_key=6)
    assert len(c.levels) > 2
    got = {r.key for r in df.where(c.holds(F.col("key"))).collect()}
    assert got == {r.key for r in listed.collect()}


# --- mixing ---------------------------------------------------------------------------------


def test_targets():
    t = mixing.targets({"a": 100, "b": 1000, None: 10})
    assert t[None] == 20 and t["a"] == 200 and t["b"] == pytest.approx(1.5 * 1110 - 220)
    assert mixing.targets({}) == {} and mixing.targets({"a": 0}) == {"a": 0.0}


def test_mixture(spark, make_docs):
    r = random.Random(5)
    rows = [(i, prose(r, r.randrange(1, 40)), ["hot", "b", "c", None][min(i % 7, 3)]) for i in range(700)]
    rows += [(None, "a b c", "b"), (None, "a b c", "b"), (9001, None, "zero"), (9002, "", "zero"), (9003, "w " * 50_000, "big"), (9003, "w " * 50_000, "big")]
    docs = make_docs(rows, clash=True)
    out = mixing.mix(docs).collect()
    assert len(out) == len(rows)
    by = {}
    for x in out:
        s = by.setdefault(x.source, [0, 0, x.target, 0])
        s[0] += x.size
        s[1] += x.taken
        s[3] = max(s[3], x.size)
        assert x.taken in (0, x.size, 2 * x.size) and x.target <= 2 * x.source_size
    for name, (size, taken, target, most) in by.items():
        assert abs(taken - target) <= 2 * most, name
        assert size == sum(len((t or "").split()) for _, t, s in rows if s == name)
    assert sorted(map(repr, mixing.mix(docs.repartition(7)).collect())) == sorted(map(repr, out))
    taken = mixing.take(make_docs(rows))
    assert taken.count() == sum(x.copies for x in out)
    assert mixing.mix(make_docs([])).count() == 0 and mixing.take(make_docs([])).count() == 0


@pytest.mark.parametrize("text", ["w w w w w", None])
def test_repeated_rows_and_null_ids_are_split_at_the_boundary(spark, make_docs, tmp_path, text):
    """A source of equal rows, and one of different texts without ids."""
    r = random.Random(8)
    rows = [(None, "a b c d e f g", "same")] * 100 + [(7, "a b c", "same")] * 40 + [(None, prose(r, r.randrange(1, 9)), "nameless") for _ in range(200)] + [(i, prose(r, 20), "other") for i in range(60)] + [(1, text, None)] * 50
    docs = make_docs(rows, clash=True)
    out = mixing.mix(docs).collect()
    by = {}
    for x in out:
        by.setdefault(x.source, []).append(x)
    for name, held in by.items():
        assert abs(sum(x.taken for x in held) - held[0].target) <= max(x.size for x in held), name
    assert sorted(map(repr, mixing.mix(docs.repartition(5)).collect())) == sorted(map(repr, out))
    taken = mixing.take(docs)
    assert taken.columns == docs.columns
    count = lambda rows_: sorted(((str(k), n) for k, n in rows_.items()))
    want, got = {}, {}
    for x in out:
        want[x.doc_id, x.source, x.size] = want.get((x.doc_id, x.source, x.size), 0) + x.copies
    for x in taken.collect():
        k = x.doc_id, x.source, len((x.text or "").split())
        got[k] = got.get(k, 0) + 1
    assert count(got) == count({k: n for k, n in want.items() if n})
    make_docs(rows).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    sql = c.sql(queries.ORACLE_SQL["op7_mixing"])
    mine = queries.op7_mixing(spark, str(tmp_path)).select(*sql.columns).collect()
    assert sorted(map(repr, map(tuple, mine))) == sorted(map(repr, sql.fetchall()))


def test_many_sources_are_shared_out_in_one_pass():
    t = mixing.targets({f"s{i:06d}": i % 977 for i in range(200_000)})
    assert sum(t.values()) == pytest.approx(1.5 * sum(i % 977 for i in range(200_000)))


def test_budgets_are_nested(make_docs):
    r = random.Random(6)
    docs = make_docs([(i, prose(r, r.randrange(1, 40)), f"s{i % 3}") for i in range(400)])
    few = {x.doc_id for x in mixing.mix(docs, share=0.3).collect() if x.taken}
    many = {x.doc_id for x in mixing.mix(docs, share=0.6).collect() if x.taken}
    assert few < many


# --- tokenisation -----------------------------------------------------------------------------


@pytest.fixture(scope="module")
def both():
    path = queries.tokenizer_path()
    return pieces.model(path), sentencepiece.SentencePieceProcessor(model_file=path)


def test_encoding_is_the_library(both, spark, mid):
    mine, lib = both
    r = random.Random(7)
    texts = [x.text for x in spark.read.parquet(f"{mid}/documents.parquet").limit(300).collect()]
    alphabet = "ab \n\t▁aathe ing ein ñéç😀漢字<>#0x²A\r\x00́.,;:²."
    texts += ["".join(r.choice(alphabet) for _ in range(r.randrange(40))) for _ in range(5000)]
    texts += ["", " ", "   ", "▁", "<s>", "<0x41>", "a" * 30_000, " " * 5000, "é" * 3000 + "x", "x²." * 50]
    for t in texts:
        ids = lib.encode(t)
        assert mine.encode(t) == ids, t
        assert mine.decode(ids) == lib.decode(ids), t
    assert mine.encode(None) == [] and mine.decode([]) == ""
    for _ in range(3000):
        ids = [r.randrange(32000) if r.random() < 0.5 else r.randrange(3, 259) for _ in range(r.randrange(9))]
        assert mine.decode(ids) == lib.decode(ids), ids


def test_border_check_is_merging_anew(both):
    m, _ = both
    r = random.Random(8)
    alone = sorted(m.alone)
    for _ in range(20_000):
        a, b = r.choice(alone), r.choice(alone)
        assert m._border(a, b) == (m.merge(a + b) == [a, b])


def test_digests(make_docs, both):
    _, lib = both
    rows = [(1, "some words, more"), (2, None), (3, ""), (None, "x"), (1, "some words, more"), (4, "é" * 70_000)]
    got = sorted(map(repr, (tuple(r) for r in queries.token_digests(make_docs(rows, clash=True)).collect())))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = [(d, len(i := lib.encode(t or "")), sha(",".join(map(str, i))), sha(lib.decode(i) if i else "")) for d, t in rows]
    assert got == sorted(map(repr, want))
    assert queries.token_digests(make_docs([])).count() == 0


def test_decode_column(make_docs, both, spark):
    rows = spark.createDataFrame([([1318, 28705],), (None,), ([],)], "ids array<int>")
    assert [r.decoded for r in pieces.decode_ids(rows, queries.tokenizer_path()).collect()] == ["x ", "", ""]


# --- pipeline ---------------------------------------------------------------------------------


def test_pipeline_stages(spark, tmp_path, both, mid):
    """Each stage on its own input, against what its operator decides row by row."""
    d = str(tmp_path / "sf")
    os.makedirs(d)
    for t in ("documents", "labels"):
        shutil.copy(f"{mid}/{t}.parquet", d)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, seen[-1], d)
        out.write.parquet(str(tmp_path / name))
        seen.append(spark.read.parquet(str(tmp_path / name)))
    for x in seen[:-1]:
        assert x.columns == list(corpus_pipeline.COLUMNS)
    ids = [[r.doc_id for r in x.select("doc_id").collect()] for x in seen]
    assert set(ids[1]) < set(ids[0]) and set(ids[2]) <= set(ids[1]) and sorted(ids[3]) == sorted(ids[2]) and set(ids[4]) <= set(ids[3])
    taken = {r.doc_id: r.copies for r in mixing.mix(seen[3]).collect()}
    assert all(ids[4].count(i) == n for i, n in taken.items())
    lib = both[1]
    texts = {r.doc_id: r.text for r in seen[4].collect()}
    for r in seen[5].collect():
        assert r.n_tokens == len(lib.encode(texts[r.doc_id]))
    run = corpus_pipeline.run(spark, d)
    assert sorted(map(repr, run.collect())) == sorted(map(repr, seen[5].collect()))


def test_pipeline_on_an_empty_table(spark, tmp_path, make_docs):
    make_docs([]).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_on_edges(spark, tmp_path, make_docs):
    rows = [(1, None, None, None), (2, "", "a"), (None, "no id"), (None, "no id"), (3, "x y z w " * 30_000), (4, "same", "a"), (4, "same", "a"), (5, "q", "b")]
    make_docs(rows, clash=True).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(4, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert out and {r.doc_id for r in out} <= {None, 1, 2, 3, 4, 5}
