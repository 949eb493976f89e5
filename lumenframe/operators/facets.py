"""Facets: boolean columns derived from vectors by contrast with prototypes.

All prototypes are scored in one projection.  Thresholds: a calibrated one wins over one
learned from the corpus, that over the default decision.  A category is stored as true
or null, an attribute as true or false where its gate passed.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vector

#: Shares of the corpus in which a gap is looked for, the least gap, the
#: margin between the best and the second of a group, and corpus growth that renews thresholds.
GAP_SHARES, MIN_GAP, EXCLUSIVE_MARGIN, REFRESH_GROWTH, LEAST_CORPUS = (0.25, 0.6), 0.01, 0.01, 0.25, 8


@dataclass(frozen=True)
class Prototype:
    """Positive and optional negative unit vectors of one facet."""

    name: str
    positive: tuple[float, ...]
    negative: tuple[float, ...] | None = None
    kind: str = "category"
    threshold: float | None = None
    calibrated: bool = False
    gate: str | None = None

    @property
    def key(self) -> str:
        prefix = "cat_" if self.kind == "category" else "attr_"
        return self.name if self.name.startswith(("cat_", "attr_")) else prefix + self.name

    @property
    def contrastive(self) -> bool:
        return self.negative is not None

    @property
    def default_threshold(self) -> float:
        return 0.0 if self.contrastive else 0.5


def raw_score(p: Prototype, v: Column, scale: float, bias: float) -> Column:
    """What is compared with the threshold: the contrast, or the calibrated probability."""
    pos = vector.dot(v, vector.literal(p.positive))
    if p.contrastive:
        return pos - vector.dot(v, vector.literal(p.negative))
    return vector.probability(pos, scale, bias)


def facet_probability(p: Prototype, v: Column, scale: float, bias: float) -> Column:
    """The contrast through the sigmoid without bias; else the calibrated probability."""
    raw = raw_score(p, v, scale, bias)
    return vector.sigmoid(raw * F.lit(scale)) if p.contrastive else raw


def score_many(rows: DataFrame, prototypes: Sequence[Prototype], vector_col: str, scale: float, bias: float) -> DataFrame:
    """Rows with ``raw``, the scores of all prototypes in order, by one matrix product a
    batch.  Worth it for many prototypes; ``apply`` writes one expression for each."""
    m = np.array([p.positive for p in prototypes], float)
    n = np.array([p.negative or [0.0] * m.shape[1] for p in prototypes], float)
    plain = np.array([not p.contrastive for p in prototypes])
    at = rows.columns.index(vector_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = np.array(b.column(at).to_pylist(), float).reshape(len(b), -1)
            raw = v @ m.T - v @ n.T if len(b) else np.zeros((0, len(m)))
            raw[:, plain] = 1 / (1 + np.exp(-(raw[:, plain] * scale + bias)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(raw.tolist(), pa.list_(pa.float64()))], names=[*b.schema.names, "raw"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("raw", T.ArrayType(T.DoubleType()))]))


def gap_threshold(rows: DataFrame, raw: str) -> DataFrame:
    """One row (threshold): the middle of the widest gap among the highest values.

    No positive value: 0.  The gap is looked for in the first 25 %, then 60 %, of the
    corpus; one below MIN_GAP counts as none, and then the threshold is null.  Equal values
    are counted first, so the window holds distinct values, not rows.
    """
    total = rows.agg(F.count("*").alias("n"))
    # only positive values are ordered; the closing zero stands for the rest
    pos = rows.where(F.col(raw) > 0).groupBy(F.col(raw).alias("v")).agg(F.count("*").alias("c"))
    pos = pos.unionByName(rows.sparkSession.range(1).select(F.lit(0.0).alias("v"), F.lit(1).cast("long").alias("c")))
    # the last row of each value is the one above a gap
    spread = pos.withColumn("i", F.sum("c").over(W.orderBy(F.desc("v"))) - 1).withColumn("below", F.lead("v").over(W.orderBy(F.desc("v"))))
    spread = spread.join(F.broadcast(total), how="cross").withColumn("gap", F.col("v") - F.col("below"))
    last = spread.agg(F.max("i").alias("last"))
    spread = spread.join(F.broadcast(last), how="cross").where("below is not null")
    picks = []
    for share in GAP_SHARES:
        head = F.greatest(F.lit(1), F.least(F.col("last"), F.floor(F.col("n") * share) + 1))
        picks.append(F.max(F.when(F.col("i") < head, F.struct("gap", -F.col("i"), ((F.col("v") + F.col("below")) / 2).alias("middle")))))
    out = spread.agg(*[p.alias(f"p{i}") for i, p in enumerate(picks)], F.count("*").alias("m"))
    chosen = F.lit(None).cast("double")
    for i in reversed(range(len(picks))):
        chosen = F.when(F.col(f"p{i}.gap") >= MIN_GAP, F.col(f"p{i}.middle")).otherwise(chosen)
    return out.select(F.when(F.col("m") == 0, F.lit(0.0)).otherwise(chosen).alias("threshold"))


def calibrate(rows: DataFrame, value: str, label: str, least: int = 4) -> DataFrame:
    """One row (threshold, f1): the lowest value above which predicting true has the best
    F1.  Fewer than ``least`` of either label raise an error when the row is read."""
    # at threshold v, predicted true are the rows with a value strictly above v
    per = rows.groupBy(F.col(value).alias("v")).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("t"))
    above = W.orderBy(F.desc("v")).rowsBetween(W.unboundedPreceding, -1)
    all_ = W.partitionBy()
    run = per.select("v", F.coalesce(F.sum("n").over(above), F.lit(0)).alias("said"), F.coalesce(F.sum("t").over(above), F.lit(0)).alias("hit"), F.sum("t").over(all_).alias("true"), F.sum("n").over(all_).alias("all"))
    f1 = F.when(F.col("hit") > 0, 2 * F.col("hit") / (F.col("said") + F.col("true"))).otherwise(F.lit(0.0))
    best = run.withColumn("f1", F.round(f1, 12)).agg(F.max(F.struct("f1", -F.col("v"), "v")).alias("b"), F.first("true").alias("t"), F.first("all").alias("a"))
    enough = (F.col("t") >= least) & (F.col("a") - F.col("t") >= least)
    told = best.select(F.when(enough, F.col("b.v")).otherwise(F.raise_error(F.lit("too few labelled rows")).cast("double")).alias("threshold"), F.col("b.f1").alias("f1"))
    return told


def decide(p: Prototype, v: Column, scale: float, bias: float, corpus: float | None = None) -> Column:
    """Whether the facet holds, by the threshold that ranks highest."""
    cut = p.threshold if p.threshold is not None else corpus if corpus is not None and p.kind == "category" else p.default_threshold
    return raw_score(p, v, scale, bias) > F.lit(float(cut))


def apply(rows: DataFrame, prototypes: Sequence[Prototype], vector_col: str, scale: float, bias: float, corpus: dict[str, float] | None = None) -> DataFrame:
    """Rows with every facet's column and ``_score``, gates first, in one projection.

    Stored scores have two decimals.  A row whose gate fails has neither.
    """
    named = {p.name: p for p in prototypes}
    v = F.col(vector_col)
    out: dict[str, Column] = {}
    for p in prototypes:
        holds = decide(p, v, scale, bias, (corpus or {}).get(p.name))
        open_ = F.lit(True)
        if p.gate is not None:
            g = named[p.gate]
            open_ = decide(g, v, scale, bias, (corpus or {}).get(g.name))
        shown = open_ if p.kind == "attribute" else open_ & holds
        out[p.key] = F.when(shown, holds)
        out[p.key + "_score"] = F.when(shown, F.round(facet_probability(p, v, scale, bias), 2))
    return rows.withColumns(out)


def exclusive(rows: DataFrame, group: str, scores: dict[str, Column], allowed: Column) -> DataFrame:
    """``attr_<group>`` and its confidence: the member of highest contrast where the row's
    type is allowed, the contrast is positive and beats the second by EXCLUSIVE_MARGIN."""
    if len(scores) < 2:
        raise ValueError("a group has two members or more")
    order = F.sort_array(F.array(*[F.struct(F.round(c, 8).alias("s"), F.lit(n).alias("n")) for n, c in scores.items()]), asc=False)
    lead = F.col("_o")[0]["s"] - F.col("_o")[1]["s"]
    won = allowed & (F.col("_o")[0]["s"] > 0) & (lead >= EXCLUSIVE_MARGIN)
    out = rows.withColumn("_o", order).withColumn(f"attr_{group}", F.when(won, F.col("_o")[0]["n"]))
    return out.withColumn(f"attr_{group}_confidence", F.when(won, F.round(lead, 4))).drop("_o")


def confidence(conditions: Mapping[str, object], columns: Sequence[str]) -> Column:
    """How sure a row's facets are of all conditions: the least of their stored scores (or
    confidences), one minus it for a condition that is false; null if none is known."""
    known = []
    for k, v in conditions.items():
        held = next((c for c in (f"{k}_score", f"{k}_confidence") if c in columns), None)
        if held is not None:
            known.append(1 - F.col(held) if v is False else F.col(held))
    if not known:
        return F.lit(None).cast("double")
    return F.array_min(F.array(*[c.cast("double") for c in known]))  # nulls are skipped


def report(rows: DataFrame, facet: str) -> DataFrame:
    """scanned, updated, positive, gated_out and rate of one facet column."""
    c = F.col(facet)
    return rows.agg(
        F.count("*").alias("scanned"), F.count(c).alias("updated"), F.sum(F.coalesce(c, F.lit(False)).cast("long")).alias("positive"),
        F.sum(c.isNull().cast("long")).alias("gated_out"), F.round(F.sum(F.coalesce(c, F.lit(False)).cast("long")) / F.count("*"), 6).alias("rate"),
    )


def needs_refresh(known_size: int | None, size: int) -> bool:
    """Whether a remembered threshold is too old: the corpus grew by a quarter."""
    return known_size is None or size >= known_size * (1 + REFRESH_GROWTH)
