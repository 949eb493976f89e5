"""Nearest neighbours, roll-ups and fusion of rankings.

Orders always end with a unique key, and a limit is always the last step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import vector

#: The constant of reciprocal rank fusion, the weight of the canonical
#: channel, the least depth of a search and the factor for regions.
RRF_K, CANONICAL_WEIGHT, MIN_DEPTH, REGION_FACTOR, FRAME_FACTOR = 60, 3.0, 120, 6, 2

#: Buckets of one unit of score where ranks are counted without a sort.
SCORE_BUCKETS = 4096


def depth(limit: int, regions: bool) -> int:
    """How many rows a channel looks at; never less than MIN_DEPTH."""
    return max(limit * (REGION_FACTOR if regions else FRAME_FACTOR), MIN_DEPTH)


def nearest(rows: DataFrame, query: Column, k: int, vector_col: str, key: str, where: Column | None = None, digits: int | None = 6) -> DataFrame:
    """The k rows of highest inner product, ties to the smaller key.  The filter runs
    before any arithmetic; the plan ends in one top-k, not in a sort."""
    rows = rows if where is None else rows.where(where)
    score = vector.dot(F.col(vector_col), query)
    rows = rows.withColumn("score", F.round(score, digits) if digits is not None else score)
    return rows.orderBy(F.desc("score"), key).limit(k)


def nearest_two_phase(rows: DataFrame, query: Column, k: int, vector_col: str, key: str, dim: int, oversampling: float = 4.0, digits: int = 6) -> DataFrame:
    """Sign bits choose ``k * oversampling`` rows by Hamming distance, exact products rank them."""
    near = vector.hamming(vector.sign_words(F.col(vector_col), dim), vector.sign_words(query, dim))
    few = rows.withColumn("_d", near).orderBy("_d", key).limit(max(k, int(k * oversampling))).drop("_d")
    return nearest(few, query, k, vector_col, key, digits=digits)


def roll_up(regions: DataFrame, frames: DataFrame, scope: str = "auto", frame: str = "frame_id", key: str = "point_id") -> DataFrame:
    """Best row of each frame with ``siblings``, its region rows.

    ``regions``: region rows only.  ``frames``: frame rows only.  ``both``: they compete.
    ``auto``: a frame row counts only where no region of the frame surfaced.  Only region
    rows become siblings.  Rows: (key, frame, score).
    """
    if scope not in ("auto", "frames", "regions", "both"):
        raise ValueError(f"unknown scope: {scope}")
    r = regions.select(key, frame, "score").withColumn("region", F.lit(True))
    f = frames.select(key, frame, "score").withColumn("region", F.lit(False))
    rows = {"regions": lambda: r, "frames": lambda: f}.get(scope, lambda: r.unionByName(f))()
    region_first = (~F.col("region")).cast("int") if scope == "auto" else F.lit(0)
    best = F.min(F.struct(region_first.alias("r"), (-F.col("score")).alias("s"), F.col(key))).alias("b")
    alone = F.when(F.col(frame).isNull(), F.col(key)).alias("_alone")  # a row without a frame stands for itself
    out = rows.groupBy(frame, alone).agg(best, F.sort_array(F.collect_list(F.when(F.col("region"), F.col(key)))).alias("siblings"))
    return out.select(frame, F.col(f"b.{key}").alias(key), (-F.col("b.s")).alias("score"), "siblings")


def rank_in_channel(runs: DataFrame, key: str, channel: str = "channel", score: str = "score", pool: bool = True) -> DataFrame:
    """Adds ``_rank``, the place from 0 by score, ties to the smaller key.

    For a pool (bounded by a search depth) this is one window.  For any number of rows the
    scores are cut into buckets: a row's place is the number of rows in higher buckets,
    from a small histogram, plus its place in its own bucket; no task sees a whole channel.
    """
    if pool:
        return runs.withColumn("_rank", F.row_number().over(W.partitionBy(channel).orderBy(F.desc(score), key)) - 1)
    rows = runs.withColumn("_bucket", F.floor(F.col(score) * SCORE_BUCKETS))
    sums = rows.groupBy(channel, "_bucket").agg(F.count("*").alias("_n"))
    higher = F.sum("_n").over(W.partitionBy(channel).orderBy(F.desc("_bucket"))) - F.col("_n")
    rows = rows.withColumn("_place", F.row_number().over(W.partitionBy(channel, "_bucket").orderBy(F.desc(score), key)) - 1)
    out = rows.join(sums.withColumn("_higher", higher).drop("_n"), [channel, "_bucket"])
    return out.withColumn("_rank", F.col("_higher") + F.col("_place")).drop("_bucket", "_place", "_higher")


def reciprocal_ranks(runs: DataFrame, key: str, channel: str = "channel", score: str = "score", weight: Column | None = None, digits: int = 10, pool: bool = True) -> DataFrame:
    """(key, fused): the sum over channels of weight / (61 + rank from 0)."""
    share = (F.lit(1.0) if weight is None else weight) / (F.lit(float(RRF_K + 1)) + F.col("_rank"))
    return rank_in_channel(runs, key, channel, score, pool).withColumn("_s", share).groupBy(key).agg(F.round(F.sum("_s"), digits).alias("fused"))


def fuse_by_key(runs: DataFrame, key: str, canonical: object, limit: int, channel: str = "channel", score: str = "score") -> DataFrame:
    """Fused rows with a representative score: the canonical channel's, else the best."""
    weight = F.when(F.col(channel) == canonical, CANONICAL_WEIGHT).otherwise(1.0)
    fused = reciprocal_ranks(runs, key, channel, score, weight)
    chosen = F.max(F.struct((F.col(channel) == canonical).cast("int").alias("c"), F.col(score).alias("s")))
    shown = runs.groupBy(key).agg(chosen.alias("x")).select(key, F.col("x.s").alias(score))
    return fused.join(shown, key).orderBy(F.desc("fused"), key).limit(limit)


def fuse_by_frame(runs: DataFrame, frame: str, canonical: object, channel: str = "channel", score: str = "score", key: str = "point_id", pool: bool = True) -> DataFrame:
    """Ranks over distinct frames: only a frame's best row of a channel counts."""
    best = F.row_number().over(W.partitionBy(channel, frame).orderBy(F.desc(score), key))
    first = runs.where(F.col(frame).isNotNull()).withColumn("_n", best).where("_n = 1").drop("_n")
    weight = F.when(F.col(channel) == canonical, CANONICAL_WEIGHT).otherwise(1.0)
    return reciprocal_ranks(first, frame, channel, score, weight, pool=pool)


def fuse_evidence(results: DataFrame, position: str = "position", digits: int = 10) -> DataFrame:
    """New order of results from up to three witnesses: probability times entity
    confidence (unknown counts as one), entity confidence, detection confidence.  A
    witness takes part if any row has it; earlier positions win ties."""
    witness = F.col("probability") * F.coalesce("entity_confidence", F.lit(1.0))
    rank = lambda c: F.row_number().over(W.orderBy(c.desc_nulls_last(), position)) - 1
    share = lambda c: F.lit(1.0) / (F.lit(float(RRF_K + 1)) + rank(c))
    extra = F.lit(0.0)
    for name in ("entity_confidence", "detection_confidence"):
        has = F.max(F.col(name).isNotNull()).over(W.partitionBy())
        extra = extra + F.when(has, share(F.coalesce(F.col(name), F.lit(0.0)))).otherwise(0.0)
    out = results.withColumn("_first", rank(witness)).withColumn("evidence", F.round(share(witness) + extra, digits))
    return out.withColumn("place", F.row_number().over(W.orderBy(F.desc("evidence"), "_first"))).drop("_first")


def collapse_shots(results: DataFrame, shot: str = "shot_id", position: str = "position") -> DataFrame:
    """The first row of each shot with ``shot_frames``; rows without a shot all stay."""
    w = W.partitionBy(shot)
    out = results.withColumn("_n", F.row_number().over(w.orderBy(position))).withColumn("shot_frames", F.count("*").over(w))
    out = out.where((F.col("_n") == 1) | F.col(shot).isNull()).drop("_n")
    return out.withColumn("shot_frames", F.when(F.col(shot).isNotNull(), F.col("shot_frames")))


def rescore(hits: DataFrame, vectors: DataFrame, query: Column, key: str, vector_col: str, digits: int = 6) -> DataFrame:
    """Hits with the score of one channel's query, so that all stand on one scale.  Hits
    are a bounded pool (a search depth), hence broadcast."""
    out = vectors.select(key, F.col(vector_col).alias("_v")).join(F.broadcast(hits.drop("score")), key)
    return out.withColumn("score", F.round(vector.dot(F.col("_v"), query), digits)).drop("_v")
