"""Order-dependent operators against plain loops, and small cases written by hand."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from lumenframe.functions import geometry as G
from lumenframe.functions import text as T
from lumenframe.functions import vector
from lumenframe.operators import boxes, facets, lexical, metrics, predicates, ranking


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


def plain_iou(a, b):
    w = max(0, min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0]))
    h = max(0, min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1]))
    return w * h / (a[2] * a[3] + b[2] * b[3] - w * h)


def test_suppression_is_the_greedy_loop(spark):
    r = random.Random(3)
    rows = [(f, i, [r.random() * 0.5, r.random() * 0.5, 0.2 + r.random() * 0.3, 0.2 + r.random() * 0.3], round(r.random(), 3)) for f in range(6) for i in range(12)]
    df = spark.createDataFrame(rows, "frame long, k long, box array<double>, s double")
    got = sorted((x["frame"], x["k"]) for x in boxes.deduplicate(df, "frame", "box", "s", "k", 0.4).collect())
    want = []
    for f in range(6):
        kept = []
        for _, k, b, s in sorted((x for x in rows if x[0] == f), key=lambda x: (-x[3], -x[2][2] * x[2][3], x[1])):
            if all(plain_iou(b, y) < 0.4 for y in kept):
                kept.append(b)
                want.append((f, k))
    assert got == sorted(want)


@pytest.mark.parametrize("w,h,tile,most", [(100, 80, 288, 64), (1000, 700, 288, 64), (4000, 3000, 288, 64), (4000, 3000, 288, 6), (289, 10, 288, 1)])
def test_tiles_as_columns(spark, w, h, tile, most):
    df = spark.createDataFrame([(1, w, h)], "k int, w int, h int")
    got = sorted((r["left"], r["top"], r["tile_width"], r["tile_height"], r["label"]) for r in boxes.tile_grid(df, "k", "w", "h", tile, 0.25, most).collect())
    want = boxes.tiles(w, h, tile, 0.25, most)
    assert got == sorted(want) and len(want) <= max(most, 1)
    if want:
        assert max(x[0] + x[2] for x in want) == w and max(x[1] + x[3] for x in want) == h


def test_tiles_reject_nonsense():
    for bad in ((0, 0.1, 3), (10, 1.0, 3), (10, 0.1, 0)):
        with pytest.raises(ValueError):
            boxes.tiles(100, 100, *bad)


def plain_same(a, b):
    small, large = sorted((a[2] * a[3], b[2] * b[3]))
    w = max(0, min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0]))
    h = max(0, min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1]))
    return plain_iou(a, b) >= 0.55 or large <= 3 * small and w * h >= 0.8 * small


def plain_instances(rows, limit):
    """rows: (key, kind, box, score, facet) of one frame."""
    pool = [x for x in rows if x[1] == "object"] or rows
    facets_ = [x[4] for x in pool if x[4] is not None]
    if facets_:
        pool = sorted((x for x in pool if x[4] is not None and x[4] >= max(facets_) - 0.15), key=lambda x: (-(x[2][2] * x[2][3]) if x[2] else 0, x[0]))
    else:
        pool = sorted(pool, key=lambda x: (-x[3], x[0]))
    out = []
    for x in pool:
        if x[2] and 0 <= x[2][0] <= 1 and 0 <= x[2][1] <= 1 and x[2][2] > 0 and x[2][3] > 0 and not any(plain_same(x[2], y[2]) for y in out):
            out.append(x)
    return [x[0] for x in (out or pool)[:limit]]


def test_instances_are_the_greedy_loop(spark):
    r = random.Random(9)
    rows = []
    for f in range(30):
        for i in range(r.randrange(1, 14)):
            box = [r.random() * 0.4, r.random() * 0.4, 0.1 + r.random() * 0.5, 0.1 + r.random() * 0.5] if r.random() < 0.9 and f % 7 else None if r.random() < 0.5 else [0.2, 0.2, 0.0, 0.1]
            rows.append((f, f * 100 + i, r.choice(["object", "tile"]) if f % 3 else "tile", box, round(r.random(), 2), round(r.random(), 2) if f % 2 and r.random() < 0.7 else None))
    df = spark.createDataFrame(rows, "frame long, k long, kind string, box array<double>, s double, facet double")
    got = {}
    for x in boxes.instances(df, "frame", "k", "kind", "box", "s", "facet", 3).orderBy("frame", "place").collect():
        got.setdefault(x.frame, []).append(x.k)
    assert got == {f: plain_instances([x[1:] for x in rows if x[0] == f], 3) for f in range(30)}


def test_instances_prefer_objects_and_confident_facets(spark):
    b = [0.1, 0.1, 0.2, 0.2]
    told = [(1, "tile", [0.0, 0.0, 1.0, 1.0], 0.9, 0.99), (2, "object", b, 0.5, 0.8), (3, "object", [0.11, 0.1, 0.2, 0.2], 0.6, 0.75), (4, "object", [0.6, 0.6, 0.3, 0.3], 0.4, 0.7), (5, "object", [0.6, 0.1, 0.3, 0.3], 0.4, 0.2)]
    df = spark.createDataFrame([(0, *x) for x in told], "frame int, key int, kind string, box array<double>, score double, facet double")
    assert [x.key for x in boxes.instances(df, "frame", "key", "kind", "box", "score", "facet").orderBy("place").collect()] == [4, 2]


def test_named_boxes_hide_plain_ones(spark):
    b = [0.1, 0.1, 0.3, 0.3]
    rows = [(0, 1, b, 1.0, "woman"), (0, 2, b, 0.9, "child"), (0, 3, b, 2.0, ""), (0, 4, b, 0.8, "woman"), (1, 5, b, 0.5, None), (1, 6, [0.12, 0.12, 0.1, 0.1], 0.4, ""), (1, 7, [0.6, 0.6, 0.2, 0.2], 0.3, None)]
    df = spark.createDataFrame(rows, "frame int, key int, box array<double>, score double, entity string")
    got = [(x.frame, x.place, x.key, x.entity) for x in boxes.shown_boxes(df, "frame", "key", "box", "score", "entity").orderBy("frame", "place").collect()]
    assert got == [(0, 1, 1, "woman"), (0, 2, 2, "child"), (1, 1, 5, ""), (1, 2, 7, "")]


def test_proposals_become_regions(spark):
    df = spark.createDataFrame([(1, 10, 20, 60, 70, 100, 200), (2, 0, 0, 100, 199, 100, 200), (3, 0, 0, 1, 1, 1000, 1000)], "k int, l int, t int, r int, b int, w int, h int")
    got = {x.k: x.bbox for x in boxes.regions_of(df, ("l", "t", "r", "b"), "w", "h").collect()}
    assert set(got) == {1} and got[1] == pytest.approx([0.1, 0.1, 0.5, 0.25])
    assert {x.k for x in boxes.regions_of(df, ("l", "t", "r", "b"), "w", "h", general=False).collect()} == {1, 2}
    big = spark.createDataFrame([(0, 1, [0.0, 0.0, 0.1, 0.1]), (0, 2, [0.0, 0.0, 0.5, 0.5]), (0, 3, [0.5, 0.5, 0.5, 0.5]), (1, 4, None)], "f int, k int, box array<double>")
    assert sorted(map(tuple, boxes.prominent(big, "f", "k", "box").collect())) == [(0, 2), (1, 4)]


def test_terms_meet_in_one_spelling(spark):
    """Composed and decomposed, full-width, ligatures, capitals and sharp s."""
    pairs = [("caf\u00e9", "cafe\u0301"), ("\uff21\uff22\uff23\uff11", "abc1"), ("Stra\u00dfe", "STRASSE"), ("\ufb01nd", "find"), ("Київ", "КИЇВ")]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "k int, a string, b string")
    for r in df.select("k", T.tokens(F.col("a")).alias("a"), T.tokens(F.col("b")).alias("b")).collect():
        assert r.a == r.b and r.a, pairs[r.k]
    assert {r.k for r in lexical.sparse_search(df, "k", "a", "strasse CAFE\u0301", 9).collect()} == {0, 2}
    assert T.words_of("x \u00bd ab 7 Stra\u00dfe") == ["1", "2", "ab", "7", "strasse"]  # the half is folded to its digits


def test_term_table_is_the_plain_count(spark):
    r = random.Random(4)
    texts = [" ".join("".join(r.choice("abcdeÄß½9_-") for _ in range(r.randrange(1, 7))) for _ in range(r.randrange(30))) for _ in range(60)] + [None, "", "  "]
    rows = [(i % 50, t) for i, t in enumerate(texts)]  # some keys stand on two rows
    df = spark.createDataFrame(rows, "k int, t string")
    want = {}
    for k, t in rows:
        for w in T.words_of(t or ""):
            for x in T.terms_of(w):
                want[k, T.fnv(x)] = want.get((k, T.fnv(x)), 0) + 1
    assert {(x.k, x.term_id): x.tf for x in lexical.terms(df, "k", "t").collect()} == want
    jvm = df.where("t is not null").select("k", F.explode(T.tokens(F.col("t"))).alias("x")).select("k", T.term_id(F.col("x")).alias("id")).groupBy("k", "id").count().collect()
    assert {(x.k, x.id): x["count"] for x in jvm} == want


def test_unknown_is_not_false(spark):
    df = spark.createDataFrame([(1, True), (2, False), (3, None)], "k int, cat_mask boolean")
    assert [r.k for r in df.where(predicates.all_of(must_not={"cat_mask": True})).orderBy("k").collect()] == [2, 3]
    assert [r.k for r in df.where(predicates.all_of({"cat_mask": False})).collect()] == [2]
    assert df.where(predicates.all_of()).count() == 3


def test_nothing_stands_out_without_spread(spark):
    df = spark.createDataFrame([(1, 0.5, 0.001), (2, 0.5, 0.001), (3, 0.5, 0.5)], "k int, score double, p double")
    assert [r.k for r in predicates.stand_out(df, "score", "p").collect()] == [3]


def test_scopes(spark):
    r = spark.createDataFrame([(1, 10, 0.5), (2, 10, 0.7), (3, 11, 0.1), (4, None, 0.3)], "point_id long, frame_id long, score double")
    f = spark.createDataFrame([(8, 10, 0.9), (9, 12, 0.2)], "point_id long, frame_id long, score double")
    told = lambda s: {x.frame_id: (x.point_id, x.siblings) for x in ranking.roll_up(r, f, s).collect()}
    assert told("auto") == {10: (2, [1, 2]), 11: (3, [3]), 12: (9, []), None: (4, [4])}
    assert told("both") == {10: (8, [1, 2]), 11: (3, [3]), 12: (9, []), None: (4, [4])}
    assert told("frames") == {10: (8, []), 12: (9, [])}
    assert set(told("regions")) == {10, 11, None}
    with pytest.raises(ValueError):
        ranking.roll_up(r, f, "some")


def plain_gap(values):
    v = sorted(values, reverse=True)
    pos = [x for x in v if x > 0]
    if not pos:
        return 0.0
    cand = [*pos, 0.0]
    for ratio in (0.25, 0.6):
        h = max(1, min(len(cand) - 1, int(len(v) * ratio) + 1))
        gaps = [cand[i] - cand[i + 1] for i in range(h)]
        if max(gaps) >= 0.01:
            i = gaps.index(max(gaps))
            return (cand[i] + cand[i + 1]) / 2
    return None


@pytest.mark.parametrize("seed", range(6))
def test_gap_threshold_is_the_loop(spark, seed):
    r = random.Random(seed)
    values = [round(r.uniform(-0.3, 0.3 if seed % 2 else -0.1), 3) + (0.5 if i < seed else 0) for i in range(40)]
    df = spark.createDataFrame([(x,) for x in values], "raw double")
    got = facets.gap_threshold(df, "raw").first()["threshold"]
    want = plain_gap(values)
    assert got == want if want is None else got == pytest.approx(want)


def test_gap_threshold_of_an_absent_category_is_zero(spark):
    df = spark.createDataFrame([(-0.1,), (-0.2,)], "raw double")
    assert facets.gap_threshold(df, "raw").first()["threshold"] == 0.0


def test_calibration(spark):
    df = spark.createDataFrame([(i / 10, i >= 5) for i in range(10)], "v double, y boolean")
    r = facets.calibrate(df, "v", "y").first()
    assert r["f1"] == 1.0 and r["threshold"] == pytest.approx(0.4)
    with pytest.raises(Exception, match="too few"):
        facets.calibrate(df.where("v >= 0.3"), "v", "y").collect()


def test_gates_and_stored_forms(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "k int, v array<double>")
    p = facets.Prototype("person", (1.0, 0.0), (0.0, 1.0))
    g = facets.Prototype("glasses", (0.0, 1.0), (1.0, 0.0), kind="attribute", gate="person")
    rows = {r.k: r for r in facets.apply(df, [p, g], "v", 10.0, 0.0).collect()}
    assert (rows[1].cat_person, rows[1].attr_glasses, rows[2].cat_person, rows[2].attr_glasses) == (True, False, None, None)
    assert rows[1].cat_person_score == 1.0 and rows[2].cat_person_score is None


def test_thresholds_in_order():
    p = facets.Prototype("a", (1.0,), None, threshold=0.7)
    assert p.default_threshold == 0.5 and not p.contrastive and p.key == "cat_a"
    assert facets.needs_refresh(None, 5) and facets.needs_refresh(100, 125) and not facets.needs_refresh(100, 124)


def test_tokens(spark):
    assert sorted(one(spark, T.tokens(F.lit("AA1234BB x 7")))) == ["1234", "7", "aa", "bb"]
    assert one(spark, T.tokens(F.lit("Straße abc"))) == ["strasse", "abc", "#str", "#tra", "#ras", "#ass", "#sse"]
    assert one(spark, T.words(F.lit(""))) == []


def test_normalise(spark):
    df = spark.createDataFrame([("München",), ("München",), ("ABC",), (None,), ("ﬁ ẞ",)], "t string")
    assert [r.x for r in df.select(T.normalise(F.col("t")).alias("x")).collect()] == ["münchen", "münchen", "abc", None, "fi ss"]


def test_term_id(spark):
    def fnv(s):
        h = 2166136261
        for b in s.encode():
            h = (h ^ b) * 16777619 % (1 << 32)
        return h or 1

    for s in ("", "a", "слово", "漢字", "x" * 200):
        assert one(spark, T.term_id(F.lit(s))) == fnv(s)


def test_coverage_and_cleaning(spark):
    assert one(spark, T.coverage(F.lit("red CAR"), F.lit("a car, red."))) == 1.0
    assert one(spark, T.coverage(F.lit(""), F.lit("a car"))) == 0.0
    for marker in (" - ", "—", "N/A", "...", ""):
        assert one(spark, T.clean_recognised(F.lit(marker))) == ""
    assert len(one(spark, T.clean_recognised(F.lit("ab " * 2000)))) == 2000
    assert one(spark, T.confidence(F.lit(0.123))) == "12%" and one(spark, T.confidence(F.lit(0.034))) == "3.4%"
    assert one(spark, T.clock(F.lit(61500))) == "01:01.5"


def test_boxes(spark):
    lit = lambda b: F.array(*[F.lit(float(x)) for x in b])
    a, b = lit([0, 0, 0.4, 0.4]), lit([0.1, 0.1, 0.2, 0.2])
    assert one(spark, G.containment(b, a)) == pytest.approx(1.0) and one(spark, G.iou(a, b)) == pytest.approx(0.25)
    assert one(spark, G.same_instance(a, b)) is False
    assert one(spark, G.to_pixels(lit([0.5, 0.5, 1e-9, 1e-9]), F.lit(101), F.lit(101))) == [50, 50, 51, 51]
    assert one(spark, G.valid(lit([0, 0, 0, 1]))) is False
    assert one(spark, G.with_context(lit([0.9, 0.0, 0.1, 0.1]))) == pytest.approx([0.85, 0.0, 0.15, 0.15])


def test_vectors(spark):
    v = F.array(*[F.lit(float(x)) for x in (3, 4)])
    assert one(spark, vector.unit(v)) == pytest.approx([0.6, 0.8])
    assert one(spark, vector.unit(F.array(F.lit(0.0), F.lit(0.0)))) == [0.0, 0.0]
    none = F.lit(None).cast("array<double>")
    assert one(spark, vector.rocchio(v, none, none)) == pytest.approx([0.6, 0.8])


def test_metrics_by_hand(spark):
    ranked = spark.createDataFrame([("q", x, i + 1) for i, x in enumerate("abcd")], "query_id string, item string, rank int")
    truth = spark.createDataFrame([("q", "b", 1.0, False), ("q", "z", 1.0, False), ("q", "a", 0.0, True), ("e", "a", 0.0, True)], "query_id string, item string, gain double, forbidden boolean")
    got = {r.query_id: r for r in metrics.evaluate(ranked, truth, 2).collect()}
    q = got["q"]
    assert (q.recall, q.precision, q.average_precision, q.reciprocal_rank, q.forbidden_hits, q.purity) == (0.5, 0.5, 0.25, 0.5, 1, 0.5)
    assert got["e"].recall == 1.0 and got["e"].reciprocal_rank == 0.0 and got["e"].purity == 1.0
    inverted = {r.query_id: r.inverted for r in metrics.binding_inverted(ranked, truth).collect()}
    assert inverted["q"] is True
    with pytest.raises(ValueError):
        metrics.evaluate(ranked, truth, 0)
    got = metrics.summary(metrics.evaluate(ranked, truth, 2)).first()
    assert (got.queries, got.map, got.mrr, got.clean_rate) == (2, 0.625, 0.25, 0.5)
    none = metrics.summary(metrics.evaluate(ranked, truth, 2).where("false")).first()
    assert (none.queries, none.map, none.mrr, none.clean_rate) == (0, 0.0, 0.0, 1.0)
    assert [tuple(r) for r in metrics.forbidden_items(ranked, truth, 2).collect()] == [("q", 1, "a")]
    with pytest.raises(ValueError):
        metrics.forbidden_items(ranked, truth, 0)


def test_ideal_gains_need_no_sort_of_the_truth(spark):
    truth = spark.createDataFrame([("q", i, float(i % 7), False) for i in range(200)], "query_id string, item long, gain double, forbidden boolean")
    ranked = truth.select("query_id", "item", (F.col("item") + 1).cast("int").alias("rank")).where("rank <= 20")
    out = metrics.evaluate(ranked, truth, 5)
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()
    dcg = lambda gains: sum(g / math.log2(i + 2) for i, g in enumerate(gains))
    assert out.first().ndcg == pytest.approx(dcg([0, 1, 2, 3, 4]) / dcg([6] * 5), abs=1e-6)


def test_labelled_set_helpers(spark):
    assets = spark.createDataFrame([("a", "p/a", {"k": "1"}), ("b", "p/b", None), ("c", None, {"k": "2"})], "asset_id string, path string, labels map<string,string>")
    files = spark.createDataFrame([("p/a",), ("p/a",)], "path string")
    assert sorted(r.asset_id for r in metrics.missing_files(assets, files).collect()) == ["b", "c"]
    assert [r.asset_id for r in metrics.assets_with(assets, {"k": "1"}).collect()] == ["a"] and metrics.assets_with(assets, {}).count() == 3
    queries = spark.createDataFrame([("q", ["a"], [], {"a": 1.0, "x": 2.0}), ("r", ["a"], [], None)], "query_id string, relevant array<string>, forbidden array<string>, gains map<string,double>")
    assert [tuple(r) for r in metrics.problems(assets, queries).collect()] == [("q", "unknown graded asset x")]


def test_ranks_by_buckets_are_the_window(spark):
    r = random.Random(9)
    rows = [(i % 3, i, round(r.gauss(0, 0.3), 2)) for i in range(900)]
    df = spark.createDataFrame(rows, "channel int, k int, score double")
    told = lambda pool: sorted((x.channel, x.k, x._rank) for x in ranking.rank_in_channel(df, "k", pool=pool).collect())
    assert told(True) == told(False)
