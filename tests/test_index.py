"""Indexing end to end with stand-in models, incremental runs, categories, the command line."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from lumenframe import cli
from lumenframe.operators import facets
from lumenframe.plans.index import Index, default_prototypes, group_prototypes
from lumenframe.plans.plugins import HashEmbedder
from lumenframe.plans.profiles import profile
from lumenframe.sources.registry import Registry


class Proposer:
    def propose(self, content):
        return [([0.0, 0.0, 0.5, 0.5], "r0c0", 1.0), ([0.5, 0.5, 0.4, 0.4], "handbag", 0.7)]


class Reader:
    def read(self, content):
        return " plate  AA1234BB " if b"car" in content else "-"


class Decoder:
    def frames(self, content):
        return [(i * 1000, (0 if i < 5 else 0x7FFFFFFFFFFF) ^ (i % 2), content + bytes([65 + i])) for i in range(10)]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    media = tmp_path_factory.mktemp("media")
    for n, t in {"a.jpg": "a black car", "b.jpg": "a dog", "copy.jpg": "a dog", "v.mp4": "a street"}.items():
        (media / n).write_text(t)
    e = HashEmbedder()
    i = Index(spark, str(tmp_path_factory.mktemp("index")), e, profile("balanced"), Proposer(), Reader(), Decoder(), default_prototypes(e, ("person", "vehicle"), ("glasses",)))
    i.media = media
    i.first = i.add(str(media))
    return i


def test_contents_are_indexed_once(index):
    assert index.first["assets"] == 3 and index.first["regions"] == 2 * index.first["frames"]
    assert index.add(str(index.media)) == {"assets": 0, "frames": 0, "regions": 0}
    frames = index.read("frames")
    assert frames.select("point_id").distinct().count() == frames.count() == index.first["frames"]
    video = frames.where("media_type = 'video'")
    assert video.where("shot_id is null or ts_ms is null").isEmpty() and video.select("shot_id").distinct().count() >= 2
    assert frames.where("ocr_text = 'plate AA1234BB'").count() == 1


def test_new_files_only(index):
    (index.media / "new.jpg").write_text("a red bag")
    before = index.read("frames").count()
    assert index.add(str(index.media))["assets"] == 1 and index.read("frames").count() == before + 1


def test_search_over_the_index(index):
    got = index.searcher().search("a black car AA1234BB", 3)
    assert got.results.orderBy("place").first()["path"].endswith("a.jpg")


def test_category_over_an_existing_index(index):
    rep = {r["table"]: r for r in index.add_category("dogs", ["a dog"]).collect()}
    assert rep["frames"]["scanned"] == index.read("frames").count()
    assert "cat_dogs" in index.read("regions").columns and "cat_dogs" in index.searcher().known_facets()


def test_other_settings_are_refused(index, spark):
    with pytest.raises(ValueError, match="tile"):
        Index(spark, index.root, HashEmbedder(), profile("quality"), prototypes=[]).add(str(index.media))


def test_colours_are_derived_on_demand(spark, tmp_path):
    (tmp_path / "media").mkdir()
    (tmp_path / "media/a.jpg").write_text("a red bag")
    e = HashEmbedder()
    i = Index(spark, str(tmp_path / "index"), e, profile("balanced"), Proposer(), Reader(), Decoder(), default_prototypes(e, ("person",), ()))
    i.add(str(tmp_path / "media"))
    assert "attr_color" not in i.read("regions").columns
    assert sum(r["regions"] for r in i.derive_group("color").collect()) == i.read("regions").count()
    tiles = i.read("regions").where("region_type = 'tile'")
    assert tiles.count() and tiles.where("attr_color is not null").isEmpty()
    (tmp_path / "media/b.jpg").write_text("a blue bag")
    i.add(str(tmp_path / "media"))
    rows = i.read("regions").where("region_type = 'object'").collect()
    scale, bias = e.calibration
    for r in rows:  # new regions have the group as well, by the same rule
        v = F.array(*map(F.lit, r["vector"]))
        told = spark.range(1).select(*[facets.raw_score(p, v, scale, bias).alias(p.name) for p in group_prototypes(e, "color")]).first().asDict()
        first, second = sorted(told, key=told.get, reverse=True)[:2]
        won = told[first] > 0 and told[first] - told[second] >= facets.EXCLUSIVE_MARGIN
        assert r["attr_color"] == (first if won else None)
    assert len(rows) == 2 and "attr_color" in i.searcher().known_facets()
    with pytest.raises(ValueError):
        i.derive_group("size")


def test_threshold_is_remembered(index):
    p = facets.Prototype("vehicle", *(tuple(x) for x in ([1.0] + [0.0] * 63, [0.0] * 64)))
    rows = index.read("regions")
    first = index.corpus_threshold(p, rows)
    assert index.corpus_threshold(p, rows) == first
    assert index.status()["points_regions"] == rows.count()


def test_command_line(index, spark, tmp_path, capsys):
    root = ["--root", index.root, "--profile", "balanced"]
    assert cli.main(["parse", "a man without glasses"]) == 0 and "no glasses" in capsys.readouterr().out
    assert cli.main([*root, "search", "a dog", "--limit", "2"], spark) == 0 and "query: a dog" in capsys.readouterr().out
    asset = index.read("frames").first()["asset_id"]
    assert cli.main([*root, "notes", "--asset", asset, "--text", "look"], spark) == 0 and "look" in capsys.readouterr().out
    assert cli.main([*root, "doctor"], spark) == 0 and "assets: 4" in capsys.readouterr().out
    spec = {"repo_id": "r", "revision": "0" * 40, "license": "MIT", "local_dir": "a-1", "files": [{"path": "w.bin", "sha256": "00"}]}
    (tmp_path / "manifest.lock").write_text(json.dumps({"models": {"a": spec, "b": {**spec, "license": "ELv2", "files": [], "revision": "main"}}}))
    assert cli.main(["licences", str(tmp_path)], spark) == 1
    r = Registry(str(tmp_path))
    assert not r.fetched("a") and r.wrong_files("a") == ["w.bin"] and r.model("a").pinned and "b" in r and not r.model("b").pinned
    with pytest.raises(KeyError):
        r.model("c")
    with pytest.raises(FileNotFoundError):
        r.path("a")
    (tmp_path / "assets.jsonl").write_text('{"asset_id":"x","path":"p"}\n')
    (tmp_path / "queries.jsonl").write_text('{"query_id":"1","text":"t","relevant":["y"]}\n')
    assert cli.main(["golden", str(tmp_path / "assets.jsonl"), str(tmp_path / "queries.jsonl")], spark) == 1 and "unknown relevant asset y" in capsys.readouterr().out


def test_threshold_is_learned_from_all_rows(spark, tmp_path):
    e = HashEmbedder()
    i = Index(spark, str(tmp_path), e, profile("balanced"), prototypes=[])
    p = default_prototypes(e, ("person",), ())[0]
    near, n = [float(x) for x in p.positive], 12_000
    rows = spark.range(n, numPartitions=4).select(F.col("id").cast("string").alias("point_id"), F.transform(F.array(*map(F.lit, near)), lambda x: x * F.when(F.col("id") >= n - 12, 0.5 + 0.02 * (F.col("id") - n + 12)).otherwise(F.col("id") / n * 0.3)).alias("vector"))
    scale, bias = e.calibration
    raw = rows.select(F.round(facets.raw_score(p, F.col("vector"), scale, bias), 6).alias("raw"))
    values = sorted((r.raw for r in raw.where("raw > 0").collect()), reverse=True) + [0.0]
    want = None
    for share in facets.GAP_SHARES:
        head = max(1, min(len(values) - 1, int(n * share) + 1))
        gap, at = max((values[k] - values[k + 1], -k) for k in range(head))
        if want is None and gap >= facets.MIN_GAP:
            want = (values[-at] + values[1 - at]) / 2
    assert want is not None and i.corpus_threshold(p, rows) == pytest.approx(want, abs=1e-12)
