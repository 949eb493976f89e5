"""Quality rules: decision lists learned by sequential covering.

Each rule is a short conjunction of thresholds over text statistics.  Rules are grown
one condition at a time on two thirds of the labelled rows (highest information gain; rows
of equal statistics, such as copies, stand on one side), pruned on the remaining third (drop last conditions while (p - n) / (p + n) doesn't
fall), kept while they are precise enough there, and the rows they cover are set aside.
Thresholds are moved to the middle of the gap between what they hold and keep out.
The list becomes one ordered ``CASE WHEN`` expression, so that judging documents is a
plain projection.

Rows
    null or empty text: all counts are zero; the base rule rejects it.
    null id: judged like any row; it has no label.
    very long texts: counted whole.  Ties between conditions: the first statistic and cut.
    repeated ids and repeated rows: each row is judged; equal labelled rows count once.
    null labels are left out; without labels of both kinds the list is empty and only
    the base rule rejects.  Empty table: empty result.
    other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, materialise
from .textstats import document_counts, ratios

#: Bound on the labelled rows that the list is learned from.
MOST_LABELLED = 40_000
#: Thresholds tried for each statistic.
CUTS = 32


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def covers(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] > self.threshold if self.above else x[self.feature] <= self.threshold

    def column(self, features: dict[str, Column]) -> Column:
        c = features[self.feature]
        return c > F.lit(self.threshold) if self.above else c <= F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


@dataclass
class Rule:
    conditions: list[Condition]
    positives: int = 0
    negatives: int = 0

    def covers(self, x: dict[str, np.ndarray], n: int) -> np.ndarray:
        out = np.ones(n, bool)
        for c in self.conditions:
            out &= c.covers(x)
        return out

    def __str__(self) -> str:
        return " and ".join(map(str, self.conditions))


@dataclass
class DecisionList:
    """Ordered rules; the first that covers a row rejects it."""

    rules: list[Rule] = field(default_factory=list)

    def name(self, features: dict[str, Column]) -> Column:
        """The first rule that covers the row, as text; null if none does."""
        out = F.lit(None).cast("string")
        for r in reversed(self.rules):
            hit = F.lit(True)
            for c in r.conditions:
                hit = hit & c.column(features)
            out = F.when(hit, F.lit(str(r))).otherwise(out)
        return out


def _grow(x: dict[str, np.ndarray], y: np.ndarray, most: int) -> Rule:
    here, rule = np.ones(len(y), bool), Rule([])
    for _ in range(most):
        p0, n0 = int((here & y).sum()), int((here & ~y).sum())
        if n0 == 0 or p0 == 0:
            break
        best, gain0 = None, 1e-9
        base = np.log2(p0 / (p0 + n0))
        for name, v in x.items():
            for t in np.unique(np.quantile(v[here], np.linspace(0.01, 0.99, CUTS))):
                above = v > t
                for up in (True, False):
                    hit = here & (above if up else ~above)
                    p = int((hit & y).sum())
                    n = int(hit.sum()) - p
                    if p and (gain := p * (np.log2(p / (p + n)) - base)) > gain0:
                        best, gain0 = Condition(name, up, float(t)), gain
        if best is None:
            break
        rule.conditions = [c for c in rule.conditions if (c.feature, c.above) != (best.feature, best.above)] + [best]
        here &= best.covers(x)
    return rule


def _worth(rule: Rule, x: dict[str, np.ndarray], y: np.ndarray) -> float:
    hit = rule.covers(x, len(y))
    p, n = int((hit & y).sum()), int((hit & ~y).sum())
    return (p - n) / (p + n) if p + n else -1.0


def _centre(rule: Rule, x: dict[str, np.ndarray], y: np.ndarray) -> None:
    """Moves each threshold to the middle between the bad rows that its condition holds
    and the good rows that it alone keeps out, where these lie apart."""
    for i, c in enumerate(rule.conditions):
        others = Rule(rule.conditions[:i] + rule.conditions[i + 1 :]).covers(x, len(y))
        inside = c.covers(x)
        sign, v = (1 if c.above else -1), x[c.feature]
        bad, good = sign * v[others & inside & y], sign * v[others & ~inside & ~y]
        if bad.size and good.size and good.max() < bad.min():
            rule.conditions[i] = Condition(c.feature, c.above, float(sign * (good.max() + bad.min()) / 2))


def learn(x: dict[str, np.ndarray], bad: np.ndarray, most_rules: int = 12, most_conditions: int = 4, precision: float = 0.8, least: int = 3) -> DecisionList:
    """A list of rules for ``bad`` rows.  ``precision``: what a rule must reach on the
    rows kept apart for pruning.  The split depends on a row's statistics alone, so copies
    never stand on both sides."""
    out = DecisionList()
    bad = np.asarray(bad, bool)
    table = np.column_stack([np.asarray(x[k], np.float64) for k in sorted(x)])
    grow = np.array([xxhash.xxh64_intdigest(r.tobytes(), 1) % 3 != 2 for r in table], bool)
    left = np.ones(len(bad), bool)
    while len(out.rules) < most_rules:
        a, b = left & grow, left & ~grow
        if (bad & a).sum() < least or not (~bad & a).any():
            break
        rule = _grow({k: v[a] for k, v in x.items()}, bad[a], most_conditions)
        apart = {k: v[b] for k, v in x.items()}
        while len(rule.conditions) > 1 and _worth(Rule(rule.conditions[:-1]), apart, bad[b]) >= _worth(rule, apart, bad[b]):
            rule.conditions.pop()
        hit = rule.covers(x, len(bad)) & left
        rule.positives, rule.negatives = int((hit & bad).sum()), int((hit & ~bad).sum())
        if not rule.conditions or rule.positives < least or _worth(rule, apart, bad[b]) < 2 * precision - 1:
            break
        _centre(rule, {k: v[left] for k, v in x.items()}, bad[left])
        out.rules.append(rule)
        left &= ~hit
    return out


def learn_from(counts: DataFrame, labels: DataFrame, label: str = "quality", label_id: str = "doc_id", most: int = MOST_LABELLED, **how) -> DecisionList:
    """Learn from labelled rows of ``document_counts`` (label 0: bad), ``most`` at most."""
    known = labels.where(F.col(label).isNotNull()).select(F.col(label_id).cast("long").alias("id"), (F.col(label) == 0).alias("bad")).distinct()
    rows = known.join(counts, "id").select("id", "bad", *[c.alias(k) for k, c in ratios().items()])
    names = list(ratios())
    pdf = bounded_sample(rows, most).toPandas().sort_values(["id", "bad", *names], kind="stable")
    return learn({k: pdf[k].to_numpy(float) for k in names}, pdf["bad"].to_numpy(bool), **how)


def base_failed(min_words: int = 50, most_repeated: int = 50) -> Column:
    """Too few words, or too many of them in repeated windows (per cent)."""
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """Every document with its counts, ``base_failed``, ``rule`` and ``kept``."""
    counts = materialise(document_counts(docs, id_col, text_col), "text_counts")
    rules = learn_from(counts, labels, **how)
    out = counts.withColumn("base_failed", base_failed()).withColumn("rule", rules.name(ratios()))
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull()).withColumnRenamed("id", id_col)
