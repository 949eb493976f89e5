"""Licence audit as a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
ALLOWED = ("Apache-2.0", "MIT", "BSD-3-Clause", "BSD-2-Clause", "PostgreSQL", "CC-BY-4.0")
REJECTED = ("AGPL-3.0", "AGPL-3.0-only", "CC-BY-NC-4.0", "CC-BY-NC-SA-4.0", "ELv2", "Qwen-Research", "non-commercial")
UNVERIFIED = "UNVERIFIED"


def classify(licence: Column) -> Column:
    return F.when(licence.isin(*REJECTED), "rejected").when(licence == UNVERIFIED, "unverified").when(licence.isin(*ALLOWED), "ok").otherwise("unknown")


def audit(models: DataFrame) -> DataFrame:
    """Adds verdict and blocks_release (rejected or unknown)."""
    out = models.withColumn("verdict", classify(F.col("license")))
    return out.withColumn("blocks_release", F.col("verdict").isin("rejected", "unknown"))


def is_clean(models: DataFrame, strict: bool = False) -> bool:
    """Nothing blocks a release; strictly, nothing is unverified or unpinned either."""
    bad = F.col("blocks_release")
    if strict:
        bad = bad | (F.col("verdict") == "unverified") | (~F.coalesce("pinned", F.lit(False)) if "pinned" in models.columns else F.lit(False))
    return audit(models).where(bad).isEmpty()
