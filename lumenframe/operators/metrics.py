"""Retrieval metrics over ranked lists, for all queries in one pass.

``ranked``: (query_id, item, rank from 1).  ``truth``: (query_id, item, gain, forbidden).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def evaluate(ranked: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """One row a query of ``truth`` with recall, precision, average precision, reciprocal
    rank, ndcg, the number of forbidden items and purity, all at ``k`` where it applies."""
    if k <= 0:
        raise ValueError("k must be positive")
    told = truth.withColumn("relevant", F.col("gain") > 0)
    hits = ranked.join(told, ["query_id", "item"], "left")
    hits = hits.withColumn("relevant", F.coalesce("relevant", F.lit(False))).withColumn("forbidden", F.coalesce("forbidden", F.lit(False)))
    seen = F.sum(F.col("relevant").cast("long")).over(W.partitionBy("query_id").orderBy("rank"))
    hits = hits.withColumn("seen", seen)
    top = F.col("rank") <= k
    per = hits.groupBy("query_id").agg(
        F.sum((top & F.col("relevant")).cast("long")).alias("found"),
        F.sum(top.cast("long")).alias("shown"),
        F.sum(F.when(F.col("relevant"), F.col("seen") / F.col("rank")).otherwise(0.0)).alias("ap"),
        F.min(F.when(F.col("relevant"), F.col("rank"))).alias("first"),
        F.sum(F.when(top & (F.col("gain") > 0), F.col("gain") / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias("dcg"),
        F.sum((top & F.col("forbidden")).cast("long")).alias("forbidden_hits"),
    )
    # the k best gains of a query: the group limit leaves k rows a partition before the shuffle
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("gain"), "item"))
    best = told.where("relevant").select("query_id", "item", "gain").withColumn("place", place).where(F.col("place") <= k)
    ideal = best.groupBy("query_id").agg(F.sum(F.col("gain") / F.log2(F.col("place") + 1.0)).alias("idcg"))
    asked = told.groupBy("query_id").agg(F.sum(F.col("relevant").cast("long")).alias("relevant"))
    out = asked.join(ideal, "query_id", "left").join(per, "query_id", "left").na.fill(0, ["idcg", "found", "shown", "ap", "dcg", "forbidden_hits"])
    n = F.col("relevant")
    return out.select(
        "query_id",
        F.round(F.when(n == 0, 1.0).otherwise(F.col("found") / n), 6).alias("recall"),
        F.round(F.when(F.col("shown") == 0, 0.0).otherwise(F.col("found") / F.col("shown")), 6).alias("precision"),
        F.round(F.when(n == 0, 1.0).otherwise(F.col("ap") / n), 6).alias("average_precision"),
        F.round(F.coalesce(F.lit(1.0) / F.col("first"), F.lit(0.0)), 6).alias("reciprocal_rank"),
        F.round(F.when(F.col("idcg") == 0, 1.0).otherwise(F.col("dcg") / F.col("idcg")), 6).alias("ndcg"),
        "forbidden_hits",
        F.round(F.when(F.col("shown") == 0, 1.0).otherwise(1 - F.col("forbidden_hits") / F.col("shown")), 6).alias("purity"),
    )


def summary(evaluated: DataFrame) -> DataFrame:
    """One row over the queries of ``evaluate``: their number, mean average precision, mean
    reciprocal rank, and the share of queries without a forbidden item (1 for no query)."""
    one = lambda c, none: F.round(F.coalesce(F.avg(c), F.lit(none)), 6)
    clean = (F.col("forbidden_hits") == 0).cast("double")
    return evaluated.agg(F.count("*").alias("queries"), one("average_precision", 0.0).alias("map"), one("reciprocal_rank", 0.0).alias("mrr"), one(clean, 1.0).alias("clean_rate"))


def forbidden_items(ranked: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """(query_id, place, item): the forbidden items among the first ``k``, numbered in the
    order in which they are shown."""
    if k <= 0:
        raise ValueError("k must be positive")
    bad = ranked.where(F.col("rank") <= k).join(truth.where("forbidden").select("query_id", "item").distinct(), ["query_id", "item"], "left_semi")
    place = F.row_number().over(W.partitionBy("query_id").orderBy("rank", "item"))
    return bad.select("query_id", place.alias("place"), "item")


def binding_inverted(ranked: DataFrame, truth: DataFrame) -> DataFrame:
    """(query_id, inverted): a trap stands no later than the last relevant item.  Items
    that weren't returned count as standing behind the list."""
    n = ranked.groupBy("query_id").agg(F.max("rank").alias("n"))
    at = truth.join(n, "query_id", "left").join(ranked, ["query_id", "item"], "left").withColumn("at", F.coalesce("rank", F.coalesce("n", F.lit(0)) + 1))
    out = at.groupBy("query_id").agg(F.min(F.when(F.col("forbidden"), F.col("at"))).alias("trap"), F.max(F.when(F.col("gain") > 0, F.col("at"))).alias("last"))
    return out.select("query_id", F.coalesce(F.col("trap") <= F.col("last"), F.lit(False)).alias("inverted"))


def latency(rows: DataFrame, group: str, value: str) -> DataFrame:
    """p50, p95 and maximum by group, linearly interpolated."""
    pick = lambda q: F.round(F.percentile(value, F.lit(q)), 6)
    return rows.groupBy(group).agg(pick(0.5).alias("p50"), pick(0.95).alias("p95"), F.max(value).alias("most"))


def problems(assets: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, problem) of a labelled set: repeated ids, unknown assets, items both
    relevant and forbidden, queries that check nothing; with a column ``gains`` (a map)
    also grades of unknown assets."""
    named = assets.select(F.col("asset_id").alias("item")).distinct()
    one = lambda c, text: queries.select("query_id", F.explode_outer(c).alias("item")).where("item is not null").join(named, "item", "left_anti").select("query_id", F.concat(F.lit(text), F.col("item")).alias("problem"))
    out = [
        queries.groupBy("query_id").count().where("count > 1").select("query_id", F.lit("repeated query id").alias("problem")),
        one("relevant", "unknown relevant asset "),
        one("forbidden", "unknown forbidden asset "),
        queries.where(F.arrays_overlap("relevant", "forbidden")).select("query_id", F.lit("relevant and forbidden").alias("problem")),
        queries.where((F.size("relevant") <= 0) & (F.size("forbidden") <= 0)).select("query_id", F.lit("checks nothing").alias("problem")),
    ]
    if "gains" in queries.columns:
        graded = F.coalesce(F.map_keys("gains"), F.array().cast("array<string>"))
        out.append(one(graded, "unknown graded asset "))
    all_ = out[0]
    for x in out[1:]:
        all_ = all_.unionByName(x)
    return all_


def missing_files(assets: DataFrame, files: DataFrame) -> DataFrame:
    """(asset_id, path) of the labelled assets whose file isn't among ``files`` (path)."""
    return assets.select("asset_id", "path").join(files.select("path").distinct(), "path", "left_anti").select("asset_id", "path")


def assets_with(assets: DataFrame, labels: dict[str, str]) -> DataFrame:
    """The assets whose map ``labels`` holds all the given pairs."""
    holds = F.lit(True)
    for k, v in labels.items():
        holds &= F.coalesce(F.try_element_at("labels", F.lit(k)) == v, F.lit(False))
    return assets.where(holds)


def spread(rows: DataFrame, group: str, probability: str, rank: str) -> DataFrame:
    """How far paraphrases of one query differ in probability and in rank."""
    return rows.groupBy(group).agg(
        F.round(F.max(probability) - F.min(probability), 6).alias("probability_spread"), (F.max(rank) - F.min(rank)).cast("long").alias("rank_spread")
    )


def best_configuration(rows: DataFrame, name: str, mrr: Column, recall: Column) -> DataFrame:
    """The configuration of highest mean reciprocal rank, then recall, then first name."""
    means = rows.groupBy(name).agg(F.round(F.avg(mrr), 6).alias("mrr"), F.round(F.avg(recall), 6).alias("recall"))
    return means.orderBy(F.desc("mrr"), F.desc("recall"), name).limit(1)
