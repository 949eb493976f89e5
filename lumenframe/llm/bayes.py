"""Quality classifier: hierarchical empirical Bayes over host and path.

A logistic model over text statistics gives each document its own evidence.  Grouped
sums of that evidence give every path and host a posterior; sparse sites are shrunk
towards the level above (path to host, host to the global prior) with a strength that
is estimated from the spread between sites.  A document's final log odds are its own
evidence plus what its site says beyond the global prior, its own share taken out.

Rows
    null or empty text: all counts are zero; scored like any row.
    very long texts: counted whole.  Ties: scores depend on the row alone, in no order.
    null host or path: a site of its own (shown as "no host", "no path"), apart from a site
    that is really called so.
    null id: scored; it has no label.  Repeated ids and rows: each is scored and counts
    for its site; equal labelled rows count once for the evidence.
    without labels of both kinds the evidence is neutral (0.5 for every document).
    empty table: empty result.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, discard, materialise
from .textstats import document_counts, ratios

#: Bound on the labelled rows that the document model is fitted on.
MOST_LABELLED = 40_000
#: A table of sites is broadcast up to this many rows, joined by shuffle beyond it.
MOST_BROADCAST = 20_000
_EPS = 1e-4


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(_EPS)), F.lit(1 - _EPS))
    return F.log(p / (1 - p))


def fit_evidence(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ridge logistic regression by Newton steps: (weights with bias last, centre, scale)."""
    centre = x.mean(axis=0) if len(x) else np.zeros(x.shape[1])
    scale = x.std(axis=0) if len(x) else np.ones(x.shape[1])
    scale[scale < 1e-9] = 1.0
    w = np.zeros(x.shape[1] + 1)
    if len(np.unique(y)) < 2:
        return w, centre, scale
    z = np.column_stack([(x - centre) / scale, np.ones(len(x))])
    keep = ridge * np.eye(len(w))
    keep[-1, -1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        g = z.T @ (p - y) + keep @ w
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + keep, g)
        w -= step
        if np.abs(step).max() < 1e-7:
            break
    return w, centre, scale


def _squashed() -> dict[str, Column]:
    """Features on comparable scales: lengths by logarithm."""
    return {k: F.log1p(c) if k in ("words", "longest_word", "line_length") else c for k, c in ratios().items()}


def _strength(groups: DataFrame, prior: float) -> float:
    """Beta strength from the spread of the groups' means, by moments; in 1 to 10 000."""
    r = groups.where("n > 1").agg(
        F.count("*").alias("k"), F.var_pop(F.col("s") / F.col("n")).alias("v"), F.avg(F.lit(prior * (1 - prior)) / F.col("n")).alias("w")
    ).first()
    if not r["k"] or r["k"] < 2:
        return 100.0
    between = max(float(r["v"]) - float(r["w"]), 1e-6)
    return float(min(max(prior * (1 - prior) / between - 1, 1.0), 10_000.0))


def quality_posterior(docs: DataFrame, labels: DataFrame, host: Column, path: Column, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, most: int = MOST_LABELLED) -> DataFrame:
    """(id, host, path, evidence, host_prior, site_prior, quality, kept) for every document."""
    site = lambda c: F.to_json(F.struct(c.cast("string").alias("s")))  # noqa: E731  # null is a key of its own
    told = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), site(host).alias("host"), site(path).alias("path"))
    counts = materialise(document_counts(told, "id", "text", ("host", "path")), "site_counts")
    known = labels.where("quality is not null").select(F.col("doc_id").cast("long").alias("id"), (F.col("quality") != 0).cast("double").alias("good")).distinct()
    names = list(_squashed())
    rows = known.join(counts, "id").select("id", "good", *[c.alias(k) for k, c in _squashed().items()])
    pdf = bounded_sample(rows, most).toPandas().sort_values(["id", "good", *names], kind="stable")
    w, centre, scale = fit_evidence(pdf[names].to_numpy(float), pdf["good"].to_numpy(float))
    z = F.lit(float(w[-1]))
    for k, weight, c, s in zip(names, w, centre, scale, strict=False):
        z = z + (_squashed()[k] - F.lit(float(c))) * F.lit(float(weight / s))
    rows = materialise(counts.select("id", "host", "path", (1 / (1 + F.exp(-z))).alias("evidence")), "evidence")
    discard(counts)
    paths = materialise(rows.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("evidence").alias("s")), "paths")
    hosts = materialise(paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s")), "hosts")
    total = hosts.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    prior = float(total["s"] / total["n"]) if total["n"] else 0.5
    kh, kp = _strength(hosts, prior), _strength(paths, prior)
    sites = paths.join(hosts.select("host", F.col("n").alias("hn"), F.col("s").alias("hs")), "host")
    sites = materialise(sites, "sites")
    discard(paths)
    discard(hosts)
    if sites.count() <= MOST_BROADCAST:
        sites = F.broadcast(sites)
    host_prior = (F.col("hs") - F.col("evidence") + kh * prior) / (F.col("hn") - 1 + kh)
    site_prior = (F.col("s") - F.col("evidence") + kp * F.col("host_prior")) / (F.col("n") - 1 + kp)
    out = rows.join(sites, ["host", "path"]).withColumn("host_prior", host_prior).withColumn("site_prior", site_prior)
    odds = _logit(F.col("evidence")) + _logit(F.col("site_prior")) - _logit(F.lit(prior))
    out = out.withColumn("quality", 1 / (1 + F.exp(-odds))).withColumn("kept", F.col("quality") >= threshold)
    name = lambda c, none: F.coalesce(F.get_json_object(c, "$.s"), F.lit(none)).alias(c)
    return out.select(F.col("id").alias(id_col), name("host", "no host"), name("path", "no path"), "evidence", "host_prior", "site_prior", "quality", "kept")
