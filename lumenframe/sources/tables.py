"""Keyed tables on plain files: versioned directories, one pointer, merge by key.

A table is a folder of versions.  A write makes a new version and then moves the pointer,
so readers see either the old or the new rows, and a failed job leaves the old ones.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SCHEMAS = {
    "meta": "key string, value string",
    "assets": "asset_id string, path string, media_type string, size_bytes long, width int, height int, duration_ms long, indexed_at long, profile string",
    "frames": "frame_id string, asset_id string, ts_ms long, shot_id string, width int, height int",
    "file_hashes": "path string, size long, mtime double, sha256 string",
    "notes": "asset_id string, path string, note string, updated_at long",
    "prototypes": "name string, kind string, positive string, negative string, threshold double, calibrated boolean, example_count int, description string, created_at long",
    "model_versions": "scope string, model_name string, repo_id string, revision string, recorded_at long",
}
KEYS = {
    "meta": ("key",), "assets": ("asset_id",), "frames": ("frame_id",), "file_hashes": ("path",), "notes": ("asset_id",),
    "prototypes": ("name",), "model_versions": ("scope", "model_name", "revision"),
}


def upsert(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``source`` replace those of equal key."""
    return target.join(source, list(keys), "left_anti").unionByName(source.select(*target.columns))


def insert_missing(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``source`` are added only where their key is new."""
    return target.unionByName(source.join(target, list(keys), "left_anti").select(*target.columns))


def latest(rows: DataFrame, keys: Sequence[str], *order) -> DataFrame:
    """The last row of each key by ``order`` (columns, most important first)."""
    n = F.row_number().over(W.partitionBy(*keys).orderBy(*[F.desc(c) for c in order]))
    return rows.withColumn("_n", n).where("_n = 1").drop("_n")


def delete(target: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    return target.join(keys, list(on), "left_anti")


def signature_differences(stored: DataFrame, wanted: DataFrame) -> DataFrame:
    """(key, stored, wanted) of settings that differ; an empty stored signature accepts all."""
    some = stored.limit(1).select(F.lit(True).alias("_some"))
    s, w = stored.select("key", F.col("value").alias("stored")), wanted.select("key", F.col("value").alias("wanted"))
    out = s.join(w, "key", "full_outer").where(~F.col("stored").eqNullSafe(F.col("wanted")))
    return out.join(F.broadcast(some), how="cross").select("key", "stored", "wanted")


def notes_with_state(notes: DataFrame, assets: DataFrame, files: DataFrame) -> DataFrame:
    """Notes with one of: current, content changed, file missing, out of index.

    ``files``: (path, sha256) of what is on disk now.
    """
    a = assets.select("asset_id", F.lit(True).alias("_indexed"))
    f = files.select("path", F.col("sha256").alias("_now"))
    out = notes.join(a, "asset_id", "left").join(f, "path", "left")
    state = F.when(F.col("_now").isNull(), "file missing").when(F.col("_now") != F.col("asset_id"), "content changed").when(F.col("_indexed").isNull(), "out of index").otherwise("current")
    return out.withColumn("state", state).drop("_indexed", "_now")


class Catalog:
    """The seven tables of an index below one folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _version(self, name: str) -> int:
        at = self._path(f"{self.root}/{name}")
        if not self._fs.exists(at):
            return 0
        done = [s.getPath().getName() for s in self._fs.listStatus(at) if self._fs.exists(self._path(s.getPath(), "_SUCCESS"))]
        return max((int(n[1:]) for n in done if n[0] == "v"), default=0)

    def read(self, name: str) -> DataFrame:
        v = self._version(name)
        if not v:
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.root}/{name}/v{v}")

    def write(self, name: str, rows: DataFrame, keep: int = 2) -> None:
        """Makes the next version; versions older than ``keep`` back are removed."""
        v = self._version(name) + 1
        kinds = [f.split(" ")[0] for f in SCHEMAS[name].split(", ")]
        rows.select(*kinds).write.mode("overwrite").parquet(f"{self.root}/{name}/v{v}")
        if v > keep:
            self._fs.delete(self._path(f"{self.root}/{name}/v{v - keep}"), True)

    def upsert(self, name: str, rows: DataFrame) -> None:
        self.write(name, upsert(self.read(name), rows, KEYS[name]))

    def insert_missing(self, name: str, rows: DataFrame) -> None:
        self.write(name, insert_missing(self.read(name), rows, KEYS[name]))

    def clear(self, *names: str) -> dict[str, int]:
        """Empties tables; the number of rows removed by table."""
        removed = {n: self.read(n).count() for n in names}
        for n in names:
            self.write(n, self.spark.createDataFrame([], SCHEMAS[n]))
        return removed

    def counts(self) -> dict[str, int]:
        return {n: self.read(n).count() for n in SCHEMAS}

    def assert_compatible(self, wanted: Mapping[str, str]) -> None:
        """Raises with the differing settings if the index was made with others."""
        rows = self.spark.createDataFrame(sorted(wanted.items()), "key string, value string")
        settings = self.read("meta").where(~F.col("key").contains(":"))  # others are remembered thresholds
        bad = signature_differences(settings, rows).orderBy("key").collect()
        if bad:
            raise ValueError("index made with other settings: " + ", ".join(f"{r['key']}: {r['stored']} != {r['wanted']}" for r in bad))

    def set_signature(self, wanted: Mapping[str, str]) -> None:
        self.upsert("meta", self.spark.createDataFrame(sorted(wanted.items()), "key string, value string"))

    def save_note(self, asset_id: str, path: str, note: str, at: int) -> None:
        """Keeps a note; an empty one deletes it."""
        row = self.spark.createDataFrame([(asset_id, path, note, at)], SCHEMAS["notes"])
        if note.strip():
            self.upsert("notes", row)
        else:
            self.write("notes", delete(self.read("notes"), row.select("asset_id"), ("asset_id",)))
