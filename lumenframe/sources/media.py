"""Media files: discovery, content identity, incremental and streaming ingest."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.identity import content_id

#: File name endings of pictures, of videos, and of pictures that can't be decoded.
IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png", ".webp", ".bmp", ".tif", ".tiff", ".gif")
VIDEO_SUFFIXES = (".mp4", ".mov", ".mkv", ".avi", ".webm", ".m4v")
UNDECODABLE_SUFFIXES = (".heic", ".heif")
FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def _told(files: DataFrame) -> DataFrame:
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    kind = F.when(suffix.isin(*IMAGE_SUFFIXES), "image").when(suffix.isin(*VIDEO_SUFFIXES), "video").when(suffix.isin(*UNDECODABLE_SUFFIXES), "image")
    reason = F.when(suffix.isin(*UNDECODABLE_SUFFIXES), F.concat(suffix, F.lit(" can't be decoded: convert it to JPEG or PNG")))
    return files.withColumn("media_type", kind).withColumn("problem", reason).where("media_type is not null")


def discover(spark: SparkSession, root: str, contents: bool = True) -> DataFrame:
    """(path, length, modified, media_type, problem[, content]) of all media files below
    ``root``, or of ``root`` itself if it is a file.  Contents are read only if asked for."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    cols = ["path", "length", F.col("modificationTime").alias("modified"), "media_type", "problem"]
    return _told(files).select(*cols, *(["content"] if contents else []))


def identify(files: DataFrame, known: DataFrame | None = None, tolerance: float = 1e-6) -> DataFrame:
    """Adds ``asset_id``, the content's SHA-256.  ``known`` (path, size, mtime, sha256) spares
    hashing where path, size and time agree; the time within ``tolerance`` seconds."""
    fresh = content_id(F.col("content"))
    if known is None:
        return files.withColumn("asset_id", fresh)
    k = known.select(F.col("path").alias("_p"), F.col("size").alias("_s"), F.col("mtime").alias("_t"), F.col("sha256").alias("_h"))
    same = (F.col("path") == F.col("_p")) & (F.col("length") == F.col("_s")) & (F.abs(F.unix_micros("modified") / 1e6 - F.col("_t")) <= tolerance)
    out = files.join(k, same, "left")
    return out.withColumn("asset_id", F.coalesce("_h", fresh)).drop("_p", "_s", "_t", "_h")


def unseen(files: DataFrame, assets: DataFrame) -> DataFrame:
    """One file a content, and only contents that aren't among ``assets``."""
    first = files.groupBy("asset_id").agg(F.min("path").alias("path"))
    return files.join(first, ["asset_id", "path"], "left_semi").join(assets.select("asset_id").distinct(), "asset_id", "left_anti")


def statistics(files: DataFrame, regions: DataFrame) -> DataFrame:
    """Counts of assets, problems and regions, and regions per frame."""
    a = files.agg(F.countDistinct("asset_id").alias("assets"), F.count("problem").alias("failed"), F.sum("length").alias("bytes"))
    r = regions.agg(F.count("*").alias("regions"), F.countDistinct("frame_id").alias("frames"))
    return a.join(F.broadcast(r), how="cross").withColumn("regions_per_frame", F.round(F.col("regions") / F.greatest("frames", F.lit(1)), 4))


def watch(spark: SparkSession, root: str, each: Callable[[DataFrame, int], None], checkpoint: str, files_per_batch: int = 8):
    """A query over new files below ``root``: micro-batches of ``files_per_batch``, each
    handed to ``each`` once; it ends when nothing is left."""
    files = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_per_batch).load(root)
    told = _told(files.withColumnRenamed("modificationTime", "modified"))
    return told.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
