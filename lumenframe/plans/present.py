"""Presentation columns of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clock, confidence


def is_tile_label(label: Column) -> Column:
    """Grid coordinates such as r3c0 say nothing to a reader."""
    return label.rlike(r"^r[0-9]*c[0-9c]*$") & label.rlike("[0-9]")


def source_of(kind: Column) -> Column:
    """object, tile, region or frame."""
    return F.coalesce(F.when(kind != "", kind), F.lit("frame"))


def region_label(order: Column, probability: Column, label: Column, entity: Column, entity_score: Column) -> Column:
    named = F.concat_ws(" · ", entity, confidence(F.coalesce(entity_score, probability)))
    place = F.when(order == 0, F.lit("")).otherwise(F.concat((order + 1).cast("string"), F.lit(": ")))
    shown = F.when((F.length(label) > 0) & ~is_tile_label(label), label)
    return F.when(F.length(entity) > 0, named).otherwise(F.concat_ws(" · ", F.concat(place, confidence(probability)), shown))


def caption(rank: Column, probability: Column, path: Column, ts_ms: Column) -> Column:
    """Rank, confidence, file name and, for videos, the time."""
    return F.concat_ws(" · ", F.concat(F.lit("#"), rank.cast("string")), confidence(probability), F.element_at(F.split(path, "/"), -1), clock(ts_ms))


def table_rows(results: DataFrame) -> DataFrame:
    """The eleven text columns of a result table; the last is for comments."""
    size = F.when(F.col("bbox").isNotNull(), F.format_string("%.1f%%", F.col("bbox")[2] * F.col("bbox")[3] * 100)).otherwise("")
    told = lambda c: F.when(F.col(c).isNotNull(), confidence(F.col(c))).otherwise("")
    return results.select(
        F.col("rank").cast("string").alias("rank"), F.element_at(F.split("path", "/"), -1).alias("file"), confidence(F.col("probability")).alias("confidence"),
        told("entity_confidence").alias("entities"), told("detection_confidence").alias("detected"), source_of(F.col("kind")).alias("source"),
        F.coalesce(F.concat(F.lit("shot "), F.col("shot_frames").cast("string")), F.lit("")).alias("evidence"), size.alias("size"),
        F.coalesce(clock(F.col("ts_ms")), F.lit("")).alias("time"), F.coalesce("warning", F.lit("")).alias("warning"), F.lit("").alias("comment"),
    )


def sources_summary(results: DataFrame, kind: str) -> DataFrame:
    """(source, n), most frequent first."""
    return results.groupBy(source_of(F.col(kind)).alias("source")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source")


def explain(probability: Column, score: Column, regions: Column, ts_ms: Column) -> Column:
    """One line on why a result is there."""
    return F.concat_ws(
        "; ",
        F.format_string("confidence %.0f%% (cos %.3f)", probability * 100, score),
        F.when(regions > 1, F.format_string("regions found: %d", regions)),
        F.when(ts_ms.isNotNull(), F.format_string("at %.1fs", ts_ms / 1000)),
    )
