"""Row predicates, exact negation and multi-entity conditions.

A facet that is null is unknown, not false: an equality needs a known value, an exclusion
keeps unknown rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

Conditions = Mapping[str, object]


def all_of(must: Conditions | None = None, must_not: Conditions | None = None) -> Column:
    """Every equality holds and no excluded one does, on one row.  Nothing asked: true."""
    parts = [F.col(k) == F.lit(v) for k, v in (must or {}).items()]
    parts += [~F.col(k).eqNullSafe(F.lit(v)) for k, v in (must_not or {}).items()]
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def any_of(alternatives: Sequence[Conditions]) -> Column:
    """At least one set of conditions holds in full."""
    return reduce(lambda a, b: a | b, [all_of(c) for c in alternatives], F.lit(False))


def matching(rows: DataFrame, condition: Column, key: str) -> DataFrame:
    """Distinct keys with at least one row that fulfils the condition."""
    return rows.where(condition).select(key).distinct()


def without(rows: DataFrame, banned: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't banned; null keys are never banned."""
    return rows.join(banned, key, "left_anti")


def intersect_entities(regions: DataFrame, entities: Sequence[Column], key: str, score: str) -> DataFrame:
    """(key, score): keys at which every entity has a region; the score is that of the
    weakest entity's best region.  One aggregation over one scan, no join per entity."""
    named = [f"best_{i}" for i in range(len(entities))]
    best = [F.max(F.when(e, F.col(score))).alias(n) for e, n in zip(entities, named, strict=True)]
    out = regions.where(reduce(lambda a, b: a | b, entities)).groupBy(key).agg(*best)
    out = out.where(reduce(lambda a, b: a & b, [F.col(n).isNotNull() for n in named]))
    return out.select(key, (F.least(*named) if len(named) > 1 else F.col(named[0])).alias(score))


def stand_out(rows: DataFrame, score: str, probability: str, least: float = 0.01, sigmas: float = 2.0) -> DataFrame:
    """Hides rows that are both improbable and not above median + sigmas * deviation of
    their pool.  Without a spread (fewer than three rows, or all equal) nothing stands out."""
    pool = rows.agg(F.count("*").alias("_n"), F.median(score).alias("_m"), F.stddev_pop(score).alias("_s"))
    bar = F.when((F.col("_n") >= 3) & (F.col("_s") > 0), F.col("_m") + sigmas * F.col("_s"))
    kept = rows.join(F.broadcast(pool), how="cross")  # one row
    shown = (F.col(probability) >= least) | F.coalesce(F.col(score) >= bar, F.lit(False))
    return kept.where(shown).drop("_n", "_m", "_s")


def first_of_each(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """The first row of each key; rows without a key all stay."""
    n = F.row_number().over(W.partitionBy(key).orderBy(*order))
    return rows.withColumn("_n", n).where((F.col("_n") == 1) | F.col(key).isNull()).drop("_n")
