"""Labelled sets as JSON lines; blank lines and lines that start with ``//`` are skipped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ASSETS = (
    "asset_id string, path string, media_type string, labels map<string,string>, "
    "objects array<struct<label: string, bbox: array<double>, area_ratio: double>>, ts_ms long, notes string"
)
QUERIES = (
    "query_id string, text string, lang string, relevant array<string>, forbidden array<string>, gains map<string,double>, "
    "expected_parse string, known_limit string, notes string"
)


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Parsed lines with ``_line``, the text of a line that doesn't parse (else null)."""
    lines = spark.read.text(path).where(~F.trim("value").startswith("//") & (F.trim("value") != ""))
    read = F.from_json("value", schema + ", _line string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_line"})
    return lines.select(read.alias("r")).select("r.*")


def read_assets(spark: SparkSession, path: str) -> DataFrame:
    out = read_lines(spark, path, ASSETS)
    return out.na.fill("image", ["media_type"]).na.fill("", ["notes"])


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    out = read_lines(spark, path, QUERIES).na.fill("uk", ["lang"]).na.fill("", ["known_limit", "notes"])
    none = F.array().cast("array<string>")
    return out.withColumn("relevant", F.coalesce("relevant", none)).withColumn("forbidden", F.coalesce("forbidden", none))


def repeated_assets(assets: DataFrame) -> DataFrame:
    """Asset ids that stand there more than once; a set with any is invalid."""
    return assets.groupBy("asset_id").count().where("count > 1").select("asset_id")


def scaffold(spark: SparkSession, path: str, assets: DataFrame) -> None:
    """Writes the lines of a new labelled set, to be filled in by hand."""
    empty = F.array().cast("array<string>")
    assets.select("asset_id", "path", "media_type", F.lit("").alias("notes")).write.json(f"{path}/assets")
    assets.select(F.concat(F.lit("q_"), F.col("asset_id")).alias("query_id"), F.lit("").alias("text"), empty.alias("relevant"), empty.alias("forbidden")).write.json(f"{path}/queries")
