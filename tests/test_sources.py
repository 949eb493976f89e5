"""Scaffolds, statistics, spreading, streams with watermarks, presentation columns."""

from __future__ import annotations

import datetime as dt
import os

from pyspark.sql import functions as F

from lumenframe.operators.spread import spread
from lumenframe.plans import present
from lumenframe.sources import golden, media
from lumenframe.streaming import windows


def test_scaffold_can_be_read_again(spark, tmp_path):
    assets = spark.createDataFrame([("a", "p/a.jpg", "image")], "asset_id string, path string, media_type string")
    golden.scaffold(spark, str(tmp_path), assets)
    assert [r.asset_id for r in golden.read_assets(spark, str(tmp_path / "assets")).collect()] == ["a"]
    q = golden.read_queries(spark, str(tmp_path / "queries")).first()
    assert q.query_id == "q_a" and q.relevant == [] and q.lang == "uk"
    assert golden.repeated_assets(assets.union(assets)).count() == 1


def test_statistics(spark):
    files = spark.createDataFrame([("a", None, 5), ("b", "bad", 7), ("a", None, 5)], "asset_id string, problem string, length long")
    regions = spark.createDataFrame([("f1",), ("f1",), ("f2",)], "frame_id string")
    r = media.statistics(files, regions).first()
    assert (r.assets, r.failed, r.regions, r.frames, r.regions_per_frame) == (2, 1, 3, 2, 1.5)


def test_spread_deals_out_small_scans_only(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    cores = spark.sparkContext.defaultParallelism
    assert spread(docs).rdd.getNumPartitions() == cores and spread(docs).count() == docs.count()
    wide = docs.repartition(3)
    assert spread(wide) is wide and spread(docs.groupBy("lang").count()).count() == docs.select("lang").distinct().count()


def test_streams_drop_late_rows_and_repeats(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1, 10, 0)
    batches = [[("a", t0, 1.0), ("a", t0, 2.0)], [("b", t0 + dt.timedelta(hours=5), 3.0)], [("d", t0 + dt.timedelta(hours=6), 3.0)], [("a", t0, 4.0), ("c", t0 + dt.timedelta(hours=9), 5.0)]]
    schema = "k string, ts timestamp, value double"
    for i, b in enumerate(batches):
        spark.createDataFrame(b, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
        for f in (tmp_path / f"in/{i}").iterdir():
            os.utime(f, (1_700_000_000 + 60 * i,) * 2)  # a stream takes older files first
    read = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    out = windows.tumbling(read(), "ts", "k", "value", late="1 hour")
    q = out.writeStream.format("memory").queryName("tumbled").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.k, r.n, r.total) for r in spark.table("tumbled").collect()}
    assert ("a", 2, 3.0) in got and ("a", 1, 4.0) not in got
    q = windows.first_of_content(read(), "k", "ts").writeStream.format("memory").queryName("firsts").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {"a", "b", "c", "d"} == {r.k for r in spark.table("firsts").collect()}


def test_presentation(spark):
    rows = spark.createDataFrame(
        [(1, "/x/a.jpg", 0.5, 0.96, None, "object", 3, [0.0, 0.0, 0.5, 0.5], 61500, None)],
        "rank int, path string, probability double, entity_confidence double, detection_confidence double, kind string, shot_frames int, bbox array<double>, ts_ms long, warning string",
    )
    r = present.table_rows(rows).first()
    assert tuple(r) == ("1", "a.jpg", "50%", "96%", "", "object", "shot 3", "25.0%", "01:01.5", "", "")
    label = lambda *a: spark.range(1).select(present.region_label(*map(F.lit, a)).alias("x")).first().x
    assert label(0, 0.5, "r3c0", "", None) == "50%" and label(1, 0.5, "handbag", "", None) == "2: 50% · handbag" and label(0, 0.5, "x", "woman", 0.9) == "woman · 90%"
    text = spark.range(1).select(present.explain(F.lit(0.5), F.lit(0.123), F.lit(2), F.lit(1500).cast("long")).alias("x")).first().x
    assert text == "confidence 50% (cos 0.123); regions found: 2; at 1.5s"
