"""Use of idle cores on inputs that Spark reads in few tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Physical nodes that only read rows and work on them one by one.
PLAIN = frozenset(("Scan", "BatchScan", "FileScan", "LocalTableScan", "Range", "Project", "Filter", "ColumnarToRow", "WholeStageCodegen", "InputAdapter", "Union"))


def is_plain(plan) -> bool:
    """Whether a physical plan has nodes of PLAIN alone."""
    below = plan.children()
    return plan.nodeName().split(" ")[0] in PLAIN and all(is_plain(below.apply(i)) for i in range(below.size()))


def spread(rows: DataFrame) -> DataFrame:
    """Deals rows out to all cores if a plain scan has fewer partitions than there are
    cores; for work that costs far more than moving its input.

    A large input has more partitions than cores and is returned as it is, and so is a
    plan with a shuffle (its partitions are Spark's choice, and asking would run it).
    """
    if not is_plain(rows._jdf.queryExecution().executedPlan()):
        return rows
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows
