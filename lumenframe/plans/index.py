"""The index: from media files to frames and regions with facets, incrementally.

A run hashes files (or takes remembered hashes), leaves out contents that are known,
embeds what is new, proposes regions, derives facets for the new rows with remembered
thresholds, and merges the rows into versioned tables.  Everything is one lineage of
DataFrames; models run as Arrow batches of a plug-in.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.identity import point_id
from ..functions.text import clean_recognised
from ..operators import facets
from ..sources import media, tables
from ..sources.tables import Catalog
from ..streaming import keyframes
from .plugins import phrase_vector
from .profiles import Profile, profile
from .query import CATEGORIES, COLORS, HAIR, PERSON_ATTRIBUTES, phrases
from .search import BACKGROUND, Searcher

FRAME = "point_id string, frame_id string, asset_id string, media_type string, ts_ms long, shot_id string, path string, indexed_at long, source_damaged boolean, ocr_text string, vector array<double>"
REGION = "point_id string, frame_id string, asset_id string, path string, media_type string, ts_ms long, shot_id string, region_type string, label string, bbox array<double>, area_ratio double, indexed_at long, vector array<double>"


def default_prototypes(embedder, names: Sequence[str] = CATEGORIES, attributes: Sequence[str] = PERSON_ATTRIBUTES) -> list[facets.Prototype]:
    """One prototype a category against a common background, and person attributes that
    are gated by ``person``."""
    ground = phrase_vector(embedder, BACKGROUND)
    out = [facets.Prototype(n, phrase_vector(embedder, phrases(f"cat_{n}")), ground) for n in names]
    if "person" in names:
        out += [facets.Prototype(a, phrase_vector(embedder, phrases(f"attr_{a}")), ground, kind="attribute", gate="person") for a in attributes]
    return out


#: Groups of which a region has one member at most, and the region types that may have one.
GROUPS, GROUP_TYPES = {"color": COLORS, "hair": HAIR}, ("object", "person")


def group_prototypes(embedder, group: str) -> list[facets.Prototype]:
    """One prototype a member of a group, against the common background."""
    ground = phrase_vector(embedder, BACKGROUND)
    return [facets.Prototype(m, phrase_vector(embedder, phrases(f"attr_{group}", m)), ground, kind="attribute") for m in GROUPS[group]]


@dataclass
class Index:
    """An index below ``root``.

    ``embedder``: dim, calibration, embed_texts, embed_images(list of bytes).
    ``proposer`` (optional): propose(bytes) -> [(box, label, score)].
    ``reader`` (optional): read(bytes) -> text.
    ``decoder`` (optional): frames(bytes) -> [(ts_ms, digest, image bytes)] of a video.
    """

    spark: SparkSession
    root: str
    embedder: object
    profile: Profile = field(default_factory=profile)
    proposer: object | None = None
    reader: object | None = None
    decoder: object | None = None
    prototypes: list[facets.Prototype] | None = None

    def __post_init__(self) -> None:
        self.catalog = Catalog(self.spark, f"{self.root}/catalog")
        self.rows = Catalog(self.spark, f"{self.root}/points")
        self.prototypes = default_prototypes(self.embedder) if self.prototypes is None else self.prototypes

    # --- tables -------------------------------------------------------------------------

    def _columns(self, base: str) -> str:
        extra = []
        for p in self._all_prototypes():
            extra += [f"{p.key} boolean", f"{p.key}_score double"]
        if base == REGION:
            for g in self._groups():
                extra += [f"attr_{g} string", f"attr_{g}_confidence double"]
        return ", ".join([base, *extra])

    def read(self, name: str) -> DataFrame:
        """``frames`` or ``regions``; columns of facets added later are null in older rows."""
        kind = self._columns({"frames": FRAME, "regions": REGION}[name])
        v = self.rows._version(name)
        if not v:
            return self.spark.createDataFrame([], kind)
        return self.spark.read.schema(kind).parquet(f"{self.rows.root}/{name}/v{v}")

    def _write(self, name: str, rows: DataFrame) -> None:
        v = self.rows._version(name) + 1
        rows.write.mode("overwrite").parquet(f"{self.rows.root}/{name}/v{v}")

    # --- facets -------------------------------------------------------------------------

    def _all_prototypes(self) -> list[facets.Prototype]:
        known = {p.name for p in self.prototypes}
        out = list(self.prototypes)
        for r in self.catalog.read("prototypes").orderBy("kind", "name").collect():
            if r["name"] not in known:
                negative = json.loads(r["negative"]) or list(BACKGROUND)
                out.append(facets.Prototype(r["name"], phrase_vector(self.embedder, json.loads(r["positive"])), phrase_vector(self.embedder, negative), r["kind"], r["threshold"], bool(r["calibrated"])))
        return out

    def corpus_threshold(self, p: facets.Prototype, rows: DataFrame) -> float | None:
        """Remembered in ``meta`` with the corpus size; learned anew after growth by a
        quarter.  That none was found is remembered too."""
        n = rows.count()
        if p.threshold is not None or p.kind != "category" or n < facets.LEAST_CORPUS:
            return None
        key = f"threshold:{p.name}"
        known = self.catalog.read("meta").where(F.col("key") == key).collect()
        if known:
            told = json.loads(known[0]["value"])
            if not facets.needs_refresh(told["n"], n):
                return told["threshold"]
        scale, bias = self.embedder.calibration
        raw = rows.select(F.round(facets.raw_score(p, F.col("vector"), scale, bias), 6).alias("raw"))
        cut = facets.gap_threshold(raw, "raw").first()["threshold"]
        self.catalog.upsert("meta", self.spark.createDataFrame([(key, json.dumps({"n": n, "threshold": cut}))], tables.SCHEMAS["meta"]))
        return cut

    def _with_facets(self, rows: DataFrame, corpus: dict[str, float]) -> DataFrame:
        scale, bias = self.embedder.calibration
        return facets.apply(rows, self._all_prototypes(), "vector", scale, bias, {k: v for k, v in corpus.items() if v is not None})

    def add_category(self, name: str, phrases: Sequence[str], negative: Sequence[str] = (), description: str = "") -> DataFrame:
        """Registers a category by text and derives it for all rows; its report by table."""
        row = (name, "category", json.dumps(list(phrases)), json.dumps(list(negative)), None, False, 0, description, int(time.time()))
        self.catalog.upsert("prototypes", self.spark.createDataFrame([row], tables.SCHEMAS["prototypes"]))
        p = next(p for p in self._all_prototypes() if p.name == name)
        scale, bias = self.embedder.calibration
        report = None
        for t in ("frames", "regions"):
            old = self.read(t)
            cut = self.corpus_threshold(p, self.read("regions"))
            new = facets.apply(old.drop(p.key, p.key + "_score"), [p], "vector", scale, bias, {} if cut is None else {name: cut})
            self._write(t, new.select(*old.columns))
            one = facets.report(self.read(t), p.key).withColumn("table", F.lit(t))
            report = one if report is None else report.unionByName(one)
        return report

    def derive_group(self, group: str) -> DataFrame:
        """``attr_<group>`` and its confidence for all regions, on demand; (value, regions).

        Derived groups are remembered, and regions that are added later get theirs with the
        other facets.  Any other region type than GROUP_TYPES has no value."""
        if group not in GROUPS:
            raise ValueError(f"no such group: {group}")
        self.catalog.upsert("meta", self.spark.createDataFrame([(f"group:{group}", "derived")], tables.SCHEMAS["meta"]))
        rows = self.read("regions")
        self._write("regions", self._with_group(rows, group).select(*rows.columns))
        return self.read("regions").groupBy(F.col(f"attr_{group}").alias("value")).agg(F.count("*").alias("regions"))

    def _groups(self) -> list[str]:
        told = {r["key"] for r in self.catalog.read("meta").where(F.col("key").startswith("group:")).select("key").collect()}
        return [g for g in GROUPS if f"group:{g}" in told]

    def _with_group(self, rows: DataFrame, group: str) -> DataFrame:
        scale, bias = self.embedder.calibration
        contrast = {p.name: facets.raw_score(p, F.col("vector"), scale, bias) for p in group_prototypes(self.embedder, group)}
        allowed = F.coalesce(F.col("region_type").isin(*GROUP_TYPES), F.lit(False))
        return facets.exclusive(rows.drop(f"attr_{group}", f"attr_{group}_confidence"), group, contrast, allowed)

    # --- ingest -------------------------------------------------------------------------

    def _decoded(self, files: DataFrame) -> DataFrame:
        """(asset_id, path, media_type, index, ts_ms, shot_id, content) of all frames."""
        images = files.where("media_type = 'image' and problem is null")
        out = images.select("asset_id", "path", "media_type", F.lit(0).cast("long").alias("index"), F.lit(None).cast("long").alias("ts_ms"), F.lit(None).cast("string").alias("shot_id"), "content")
        if self.decoder is None:
            return out
        decoder = self.decoder

        def unpack(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in it:
                for a, p, c in zip(pdf["asset_id"], pdf["path"], pdf["content"], strict=True):
                    told = [(a, p, i, t, d, b) for i, (t, d, b) in enumerate(decoder.frames(c))]
                    yield pd.DataFrame(told, columns=["asset_id", "path", "index", "ts_ms", "digest", "content"])

        videos = files.where("media_type = 'video' and problem is null").select("asset_id", "path", "content")
        frames = videos.mapInPandas(unpack, "asset_id string, path string, index long, ts_ms long, digest long, content binary")
        keys = keyframes.select(frames, "asset_id", "ts_ms", "digest", keyframes.interval_of(self.profile.fps_floor))
        taken = frames.join(keys.select("asset_id", "ts_ms", "digest", "shot"), ["asset_id", "ts_ms", "digest"])
        shot = F.concat("asset_id", F.lit(":s"), F.col("shot").cast("string"))
        return out.unionByName(taken.select("asset_id", "path", F.lit("video").alias("media_type"), "index", "ts_ms", shot.alias("shot_id"), "content"))

    def _embedded(self, decoded: DataFrame) -> DataFrame:
        embedder, reader, proposer = self.embedder, self.reader if self.profile.recognise_text else None, self.proposer
        fields = ["asset_id", "path", "media_type", "index", "ts_ms", "shot_id"]

        def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in it:
                contents = [bytes(c) for c in pdf["content"]]
                out = pdf[fields].copy()
                out["vector"] = embedder.embed_images(contents).tolist()
                out["text"] = [reader.read(c) if reader else "" for c in contents]
                boxes = [proposer.propose(c) if proposer else [] for c in contents]
                out["regions"] = [[{"box": list(map(float, b)), "label": n, "vector": embedder.embed_images([c + repr(b).encode()])[0].tolist()} for b, n, _ in bs] for c, bs in zip(contents, boxes, strict=True)]
                yield out

        kind = "asset_id string, path string, media_type string, index long, ts_ms long, shot_id string, vector array<double>, text string, regions array<struct<box: array<double>, label: string, vector: array<double>>>"
        return decoded.mapInPandas(run, kind)

    def add(self, path: str) -> dict[str, int]:
        """Indexes what is new below ``path``; counts of assets, frames and regions added.
        An index made with other settings raises before anything is read."""
        told = self.profile.signature(type(self.embedder).__name__)
        self.catalog.assert_compatible(told) if self._signed() else None
        return self.add_files(media.discover(self.spark, path))

    def _signed(self) -> bool:
        return not self.catalog.read("meta").where("key = 'embedder'").isEmpty()

    def add_files(self, files: DataFrame) -> dict[str, int]:
        """The same for rows of ``discover``, also as the body of a micro-batch."""
        now = int(time.time())
        told = self.profile.signature(type(self.embedder).__name__)
        named = media.identify(files, self.catalog.read("file_hashes"))
        fresh = media.unseen(named, self.catalog.read("assets")).persist()
        try:
            n = fresh.count()
            if not n:
                return {"assets": 0, "frames": 0, "regions": 0}
            rows = self._embedded(self._decoded(fresh)).withColumn("frame_id", F.concat("asset_id", F.lit(":"), F.col("index").cast("string"))).persist()
            frames = rows.select(
                point_id(F.col("frame_id")).alias("point_id"), "frame_id", "asset_id", "media_type", "ts_ms", "shot_id", "path", F.lit(now).cast("long").alias("indexed_at"),
                F.lit(False).alias("source_damaged"), clean_recognised(F.col("text")).alias("ocr_text"), "vector",
            )
            r = rows.select("*", F.posexplode("regions").alias("n", "r"))
            key = F.concat("frame_id", F.lit(":r"), F.col("n").cast("string"))
            regions = r.select(
                point_id(key).alias("point_id"), "frame_id", "asset_id", "path", "media_type", "ts_ms", "shot_id", F.when(F.col("r.label").rlike("^r[0-9]+c[0-9]+$"), "tile").otherwise("object").alias("region_type"),
                F.col("r.label").alias("label"), F.col("r.box").alias("bbox"), (F.col("r.box")[2] * F.col("r.box")[3]).alias("area_ratio"), F.lit(now).cast("long").alias("indexed_at"), F.col("r.vector").alias("vector"),
            )
            corpus = {}
            all_regions = self.read("regions").select("point_id", "vector").unionByName(regions.select("point_id", "vector"))
            for p in self._all_prototypes():
                corpus[p.name] = self.corpus_threshold(p, all_regions)
            added = {"assets": n}
            for name, new in (("frames", frames), ("regions", regions)):
                old = self.read(name)
                fresh_rows = self._with_facets(new, corpus)
                for g in self._groups() if name == "regions" else ():
                    fresh_rows = self._with_group(fresh_rows, g)
                fresh_rows = fresh_rows.select(*old.columns)
                self._write(name, tables.upsert(old, fresh_rows, ["point_id"]))
                added[name] = new.count()
            asset = fresh.select("asset_id", "path", "media_type", F.col("length").alias("size_bytes"), F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"), F.lit(None).cast("long").alias("duration_ms"), F.lit(now).cast("long").alias("indexed_at"), F.lit(self.profile.name).alias("profile"))
            self.catalog.upsert("assets", asset)
            self.catalog.insert_missing("frames", frames.select("frame_id", "asset_id", "ts_ms", "shot_id", F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height")))
            self.catalog.upsert("file_hashes", fresh.select("path", F.col("length").alias("size"), (F.unix_micros("modified") / 1e6).alias("mtime"), F.col("asset_id").alias("sha256")))
            if not self._signed():
                self.catalog.set_signature(told)
            rows.unpersist()
            return added
        finally:
            fresh.unpersist()

    def watch(self, path: str, checkpoint: str, files_per_batch: int = 8):
        """Indexes files as they appear; one micro-batch after another, each once."""
        return media.watch(self.spark, path, lambda df, _: self.add_files(df), checkpoint, files_per_batch)

    def searcher(self, **how) -> Searcher:
        return Searcher(self.read("frames"), self.read("regions"), self.embedder, **how)

    def status(self) -> dict[str, int]:
        """Rows of every table."""
        return self.catalog.counts() | {"points_frames": self.read("frames").count(), "points_regions": self.read("regions").count()}
