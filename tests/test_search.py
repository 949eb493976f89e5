"""The query model, the search plan's invariants, tables, sources and streams."""

from __future__ import annotations

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.plans import licences, profiles, query
from lumenframe.plans.plugins import HashEmbedder
from lumenframe.plans.search import Searcher
from lumenframe.sources import golden, media, tables
from lumenframe.streaming import keyframes

E = HashEmbedder()
TEXTS = ["a man in a red coat", "a woman with glasses", "a black car", "a dog on a street", "a house at night", "a bag on a table"]


@pytest.fixture(scope="module")
def searcher(spark):
    r = np.random.default_rng(1)
    rows, frames = [], []
    for i in range(60):
        v = E.embed_texts([TEXTS[i % 6]])[0] + r.normal(0, 0.05, 64)
        v = (v / np.linalg.norm(v)).tolist()
        rows.append((f"{i}:r0", i, i // 2, v, i % 6 < 2 or None, True if i % 6 == 1 else False if i % 6 == 0 else None, i % 6 == 2 or None))
        frames.append((f"f{i}", i, i // 2, v, f"s{i // 5}" if i >= 40 else None, f"plate AA{i:04d}BB" if i % 7 == 0 else ""))
    regions = spark.createDataFrame(rows, "point_id string, frame_id long, asset_id long, vector array<double>, cat_person boolean, attr_glasses boolean, cat_vehicle boolean").cache()
    return Searcher(spark.createDataFrame(frames, "point_id string, frame_id long, asset_id long, vector array<double>, shot_id string, ocr_text string").cache(), regions, E)


def ids(response):
    return [r.frame_id for r in response.results.orderBy("place").collect()]


def test_smaller_limit_is_a_prefix_and_repeats_agree(searcher):
    many, few = ids(searcher.search("a black car", 30)), ids(searcher.search("a black car", 5))
    assert many[:5] == few and ids(searcher.search("a black car", 30)) == many


def test_negation_is_exact(searcher):
    got = searcher.search("a person without glasses", 60, hide_weak=False)
    assert got.parsed.must[0].conditions() == {"cat_person": True, "attr_glasses": False}
    assert got.results.count() > 0 and all(i % 6 == 0 for i in ids(got))
    assert got.results.where("entity_confidence is not null").isEmpty()  # no scores are stored
    scored = Searcher(searcher.frames, searcher.regions.withColumn("cat_person_score", F.lit(0.9)).withColumn("attr_glasses_score", F.lit(0.3)), E)
    sure = {r.entity_confidence for r in scored.search("a person without glasses", 60, hide_weak=False).results.collect()}
    assert sure == {0.7}
    banned = searcher.search("anything", 60, exclusions=[{"cat_vehicle": True}], hide_weak=False, lexical=False)
    assert not [i for i in ids(banned) if i % 6 == 2]


def test_falls_back_with_a_notice(searcher):
    q = query.StructuredQuery("x", "en", (query.Entity("weapon"), query.Entity("person")))
    got = searcher.search("a weapon", 10, parsed=q, min_strict=200)
    assert got.degraded and any("similarity" in n for n in got.notices) and any("cat_weapon" in n for n in got.notices)


def test_categories_scopes_feedback(searcher):
    assert all(i % 6 == 2 for i in ids(searcher.search("street", 20, category="vehicle", scope="regions", hide_weak=False, lexical=False)))
    assert any("no facet" in n for n in searcher.search("street", 5, category="boat").notices)
    with pytest.raises(ValueError):
        searcher.search("x", category="vehicle", where=F.lit(True))
    got = searcher.search("a dog", 5, positive=["4", "999"])
    assert any("999" in n for n in got.notices)


def test_recognised_text_comes_first(searcher):
    got = searcher.search("AA0049BB", 10)
    top = got.results.orderBy("place").first()
    assert top.lexical and top.lexical_coverage >= 0.5


def test_one_result_a_shot(searcher):
    shots = [r.shot_id for r in searcher.search("a house at night", 60, hide_weak=False).results.where("shot_id is not null").collect()]
    assert len(shots) == len(set(shots))


def test_refinement_keeps_the_order(searcher):
    class D:
        def detect(self, frame_id, term):
            return ([0, 0, 1, 1], 0.9) if frame_id % 2 else None

    got = searcher.search("a dog", 4)
    last = list(searcher.refine(got, D(), 2))[-1]
    assert [r.frame_id for r in last.orderBy("place").collect()] == ids(got)


def test_parse_and_conditions():
    q = query.parse("two women with red bags and without masks")
    assert [e.object for e in q.must][:1] == ["person"] and q.must[0].count == 2
    assert query.parse("  ") == query.EMPTY
    e = query.Entity("person", (query.Attribute("gender", "female"), query.Attribute("hair", "Brunette"), query.Attribute("wearing", "a Coat")))
    assert e.conditions() == {"cat_person": True, "attr_gender_male": False, "attr_hair": "dark", "attr_wearing": "a coat"}
    assert e.describe() == "woman (Brunette hair, a Coat)" and query.Entity("bag", (), 2).describe(count=True) == "2× bag"
    assert query.Entity("person", (query.Attribute("age_band", "senior"), query.Attribute("mask", "False"))).describe("uk") == "літня людина (без маски)" and query.Entity("other").describe() == "object"
    assert query.categories_in("a License plate and a bagged dog", None) == ["license_plate"]
    assert query.phrases("attr_camouflage") == ("something camouflage",) and query.phrases("attr_hair", "red_hair") == ("a person with red hair hair",)
    assert query.phrases("cat_license_plate") == ("a license plate", "a photo of a license plate") and query.opposites("attr_wearing") and not query.opposites("cat_bag")
    bad = query.StructuredQuery("", must=(query.Entity("person"),), relations=(query.Relation(0, "near", 3),))
    assert bad.repaired("t").relations == () and bad.repaired("t").query_en == "t"
    with pytest.raises(ValueError):
        query.Entity("boat")
    assert len(query.CATEGORIES) == 36 and ("cat_blood", "boolean") in query.facet_columns()


def test_profiles(monkeypatch):
    monkeypatch.setenv(profiles.VARIABLE, "fast")
    assert profiles.profile().name == "fast" and profiles.profile("quality").tile == 224
    with pytest.raises(KeyError):
        profiles.profile("x")
    assert profiles.profile("fast").signature("e") != profiles.profile("balanced").signature("e")


def test_catalog_tables(spark, tmp_path):
    c = tables.Catalog(spark, str(tmp_path))
    c.set_signature({"dim": "64"})
    c.assert_compatible({"dim": "64"})
    with pytest.raises(ValueError, match="dim"):
        c.assert_compatible({"dim": "65"})
    c.save_note("a", "p", "look", 1)
    c.save_note("a", "p", "look again", 2)
    assert [r.note for r in c.read("notes").collect()] == ["look again"]
    c.save_note("a", "p", " ", 3)
    assert c.counts()["notes"] == 0
    row = spark.createDataFrame([("f", "a", None, None, 1, 1)], tables.SCHEMAS["frames"])
    c.insert_missing("frames", row)
    c.insert_missing("frames", row.withColumn("width", F.lit(9)))
    assert [r.width for r in c.read("frames").collect()] == [1] and c.clear("frames") == {"frames": 1}


def test_media(spark, tmp_path):
    for name, text in {"a.JPG": "x", "b/c.png": "x", "b/d.heic": "y", "e.txt": "z", "v.mp4": "w"}.items():
        os.makedirs(tmp_path / os.path.dirname(name), exist_ok=True)
        (tmp_path / name).write_text(text)
    files = media.identify(media.discover(spark, str(tmp_path)))
    told = {os.path.basename(r.path): r for r in files.collect()}
    assert set(told) == {"a.JPG", "c.png", "d.heic", "v.mp4"} and told["d.heic"].problem and told["a.JPG"].asset_id == told["c.png"].asset_id
    known = spark.createDataFrame([(told["v.mp4"].asset_id,)], "asset_id string")
    assert media.unseen(files, known).count() == 2
    one = told["a.JPG"]
    cached = spark.createDataFrame([(one.path, one.length, one.modified.timestamp(), "cached")], "path string, size long, mtime double, sha256 string")
    assert {r.asset_id for r in media.identify(media.discover(spark, str(tmp_path / "a.JPG")), cached).collect()} == {"cached"}
    seen = []
    q = media.watch(spark, str(tmp_path), lambda df, i: seen.append(df.count()), str(tmp_path / "_ck"), 2)
    q.awaitTermination(60)
    assert sum(seen) == 4


def test_golden_lines(spark, tmp_path):
    (tmp_path / "q.jsonl").write_text('// c\n\n{"query_id":"1","text":"x","relevant":["a"]}\nnot json\n')
    rows = golden.read_queries(spark, str(tmp_path / "q.jsonl")).collect()
    assert [r._line for r in rows if r._line] == ["not json"] and [r for r in rows if not r._line][0].lang == "uk"


def test_licences(spark):
    m = spark.createDataFrame([("a", "MIT"), ("b", "ELv2"), ("c", "UNVERIFIED")], "model string, license string")
    assert {r.model: r.verdict for r in licences.audit(m).collect()} == {"a": "ok", "b": "rejected", "c": "unverified"}
    assert not licences.is_clean(m) and licences.is_clean(m.where("model <> 'b'")) and not licences.is_clean(m.where("model <> 'b'"), strict=True)


def _frames(spark, n=400):
    r = np.random.default_rng(5)
    rows, d = [], 0
    for i in range(n):
        if i % 37 == 0:
            d = int(r.integers(-(1 << 62), 1 << 62))
        rows.append((i % 3, i * 100, d ^ int(r.integers(0, 4))))
    return spark.createDataFrame(rows, "recording long, ts_ms long, digest long"), rows


def test_keyframes_are_the_loop(spark):
    df, rows = _frames(spark)
    want = []
    for rec in range(3):
        s = keyframes.State()
        want += [(rec, *k) for _, t, d in sorted(x for x in rows if x[0] == rec) if (k := keyframes.step(s, t, d, 2000))]
    got = keyframes.select(df, interval_ms=2000).collect()
    assert sorted(map(tuple, got)) == sorted(want) and want
    assert keyframes.interval_of(0.5) == 2000 and keyframes.interval_of(0) == 0


def test_keyframe_stream_equals_batch(spark, tmp_path):
    df, _ = _frames(spark)
    for i, (a, b) in enumerate(((0, 15_000), (15_000, 28_000), (28_000, 99_000))):
        df.where(f"ts_ms >= {a} and ts_ms < {b}").coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
        for f in (tmp_path / f"in/{i}").iterdir():
            os.utime(f, (1_700_000_000 + 60 * i,) * 2)  # a stream takes older files first
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = keyframes.select_stream(stream, interval_ms=2000).writeStream.format("memory").queryName("kf").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("kf").collect())) == sorted(map(tuple, keyframes.select(df, interval_ms=2000).collect()))
