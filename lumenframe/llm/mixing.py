"""Mixing sources to target weights by hash-threshold histograms.

Every row has a 60-bit hash of its id and text.  A source takes whole copies of all its rows, as
many as fit its target, and then the rows whose hash lies below a threshold.  The
threshold is found level by level: token sums by source and hash bucket (4096 buckets a
level), the bucket in which the running sum would pass the budget, and then the same
inside that bucket alone, until it holds one hash.  No row is sorted; a level reads only
the rows of boundary buckets, and the rows are chosen by a filter.

The threshold of a smaller budget is never above that of a larger one, so mixtures are
nested.  Only rows equal in id and text share a hash.  Where they are the boundary, as many
of them are taken as come nearest to the budget; which of them makes no difference, since
they are told apart by nothing (a number of the row deals them out, by the same histograms).

Rows
    null or empty text: size zero; takes nothing.
    null source: a source of its own, last in order.  null id: hashed as a value of its own,
    together with the text.  Very long texts: counted whole.
    repeated ids and rows: each row counts.  Ties: see above.  Empty table: empty result.
    a source whose words are all zero has the target zero.
    other columns are left out by ``mix`` and kept by ``take``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, materialise

#: Weights of the sources in the order of their names, repeating.
WEIGHTS = (3, 1, 2)
#: Words of the mixture for each word of the sources, and copies of a source at most.
SHARE, MOST_COPIES = 1.5, 2
LEVEL_BITS, LEVELS = 12, 5
#: Sources up to this many are broadcast, joined by shuffle beyond it.
MOST_BROADCAST = 20_000


def word_count(text: Column) -> Column:
    """Words of a text: each word with the space about it becomes one letter.  No array
    of words is made, so a very long text needs memory for itself only."""
    short = F.regexp_replace(text, r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", "a")
    return F.coalesce(F.length(F.translate(short, " \t\n\v\f\r", "")), F.lit(0)).cast("long")


def row_hash(id_col: Column, text: Column) -> Column:
    """The first 15 hex digits of the md5 of the id's decimal text, a colon and the md5 of the
    text, as a long; nulls count as the word null."""
    told = F.concat_ws(":", F.coalesce(id_col.cast("string"), F.lit("null")), F.coalesce(F.md5(text.cast("binary")), F.lit("null")))
    return F.conv(F.substring(F.md5(told.cast("binary")), 1, 15), 16, 10).cast("long")


def targets(sizes: dict[str | None, int], weights: Sequence[float] = WEIGHTS, share: float = SHARE, most_copies: float = MOST_COPIES) -> dict[str | None, float]:
    """Words that each source should give.  No target is above ``most_copies`` times its
    source; what is cut off is shared anew by weight among the others.  Sources reach
    their limit in the order of limit by weight, so one pass in that order is enough."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    order = sorted(names, key=lambda s: most_copies * sizes[s] / weight[s])
    left, total, out = share * sum(sizes.values()), sum(weight.values()), {}
    full = 0
    for at, s in enumerate(order):
        rest = left - full
        if rest * weight[s] / total <= most_copies * sizes[s]:
            return out | {x: rest * weight[x] / total for x in order[at:]}
        out[s] = float(most_copies * sizes[s])
        full += most_copies * sizes[s]
        total -= weight[s]
    return out


def thresholds(sizes: DataFrame, budgets: dict[str, float]) -> tuple[dict[str, int], dict[str, float]]:
    """By source: the rows of ``sizes`` (src, h, size) with ``h < below`` sum to about the
    source's budget.  The row at the boundary is taken if that comes nearer.  Where several
    rows of one hash are the boundary, they stay above it, and the second result has what
    remains for them of the budget.

    What is known of a source (its boundary so far and the sum before it) stands in the
    plan as a small table; one row a source returns from each level."""
    spark = sizes.sparkSession
    out = dict.fromkeys(budgets, 1 << (LEVEL_BITS * LEVELS))  # every row, unless a boundary is found
    out |= {s: 0 for s, b in budgets.items() if b <= 0}
    tied: dict[str, float] = {}
    state = {s: (b, 0, 0) for s, b in budgets.items() if b > 0}  # budget, start of the boundary bucket, sum before it
    for level in range(LEVELS):
        if not state:
            break
        shift = LEVEL_BITS * (LEVELS - 1 - level)
        table = spark.createDataFrame([(s, *x) for s, x in state.items()], "src string, budget double, below long, sum long").coalesce(1)
        rows = sizes.join(F.broadcast(table) if len(state) <= MOST_BROADCAST else table, "src")
        if level:  # only the boundary bucket of each source
            rows = rows.where(F.shiftright("h", shift + LEVEL_BITS) == F.shiftright("below", shift + LEVEL_BITS))
        sums = rows.groupBy("src", F.shiftright("h", shift).alias("bucket")).agg(
            F.sum("size").alias("size"), F.min("h").alias("low"), F.max("h").alias("high"), F.count("*").alias("rows"), F.first("budget").alias("budget"), F.first("sum").alias("sum")
        )
        run = sums.withColumn("run", F.col("sum") + F.sum("size").over(W.partitionBy("src").orderBy("bucket")))
        # the first bucket that doesn't fit is the boundary; before it everything is taken
        first = run.where(F.col("run") > F.col("budget")).groupBy("src").agg(F.min_by(F.struct("bucket", "run", "size", "low", "high", "rows"), "bucket").alias("f"))
        found = {r["src"]: r["f"] for r in first.collect()}
        asked, state = state, {}
        for s, (budget, _, _) in asked.items():
            if (f := found.get(s)) is None:
                continue  # all its rows fit
            before = f["run"] - f["size"]
            out[s] = f["bucket"] << shift
            if f["low"] != f["high"]:
                state[s] = (budget, out[s], before)
            elif f["rows"] == 1:  # one row alone is the boundary: no finer level is needed
                out[s] = f["low"] + (f["run"] - budget < budget - before)
            else:
                out[s], tied[s] = f["low"], budget - before
    return out, tied


def _source_key(source: Column) -> Column:
    """A key without nulls; no source name looks like the null source's."""
    return F.to_json(F.struct(source.cast("string").alias("s")))


def _sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    source, text = F.col(source_col).cast("string"), F.col(text_col).cast("string")
    named = docs.select(
        F.col(id_col).alias("id"), _source_key(source).alias("src"), source.alias("source"), word_count(text).alias("size"), row_hash(F.col(id_col), text).alias("h"),
        F.xxhash64(F.monotonically_increasing_id()).bitwiseAND(F.lit((1 << (LEVEL_BITS * LEVELS)) - 1)).alias("u"),
    )
    return materialise(named, "sizes")


def _plan(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most_copies: float = MOST_COPIES) -> tuple[DataFrame, int]:
    """One row a source (src, source_size, target, whole, below, tied), and their number.
    ``tied``: null, or what the rows of the hash ``below`` may still take of the budget."""
    totals = {r["src"]: (r["source"], r["n"]) for r in sizes.groupBy("src").agg(F.first("source").alias("source"), F.sum("size").alias("n")).collect()}
    want = targets({s: n for s, n in totals.values()}, weights, share, most_copies)
    whole = {src: min(int(want[s] // n), int(most_copies)) if n else 0 for src, (s, n) in totals.items()}
    below, tied = thresholds(sizes.select("src", "h", "size"), {src: want[s] - whole[src] * n if whole[src] < most_copies else 0.0 for src, (s, n) in totals.items()})
    rows = [(src, n, want[s], whole[src], below[src], tied.get(src)) for src, (s, n) in totals.items()]
    return sizes.sparkSession.createDataFrame(rows, "src string, source_size long, target double, whole int, below long, tied double").coalesce(1), len(rows)


def _with_copies(rows: DataFrame, plan: DataFrame, n: int, most_copies: float) -> DataFrame:
    """``rows`` (src, h, u, size, ...) with the plan's columns and ``copies``."""
    out = rows.join(F.broadcast(plan) if n <= MOST_BROADCAST else plan, "src")
    budgets = {r["src"]: r["tied"] for r in plan.where("tied is not null").select("src", "tied").collect()}
    last = F.lit(0).cast("long")
    if budgets:  # rows of one hash, dealt out by their numbers
        at = out.where("tied is not null and h = below").select("src", F.col("u").alias("h"), "size")
        cuts, _ = thresholds(at, budgets)
        cut = rows.sparkSession.createDataFrame(list(cuts.items()), "src string, cut long").coalesce(1)
        out = out.join(F.broadcast(cut) if len(cuts) <= MOST_BROADCAST else cut, "src", "left")
        last = F.when((F.col("h") == F.col("below")) & (F.col("u") < F.col("cut")), 1).otherwise(0)
    part = F.when(F.col("h") < F.col("below"), 1).otherwise(last)
    return out.withColumn("copies", (F.col("whole") + F.when(F.col("whole") < most_copies, part).otherwise(0)).cast("int"))


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most_copies: float = MOST_COPIES, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Every row with ``size``, ``source_size``, ``target``, ``copies`` (how often the
    mixture holds it) and ``taken`` (its words in the mixture)."""
    sizes = _sizes(docs, id_col, text_col, source_col)
    out = _with_copies(sizes, *_plan(sizes, weights, share, most_copies), most_copies)
    out = out.withColumn("taken", (F.col("copies") * F.col("size")).cast("long"))
    return out.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", "copies", "taken")


def take(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = WEIGHTS, share: float = SHARE, most_copies: float = MOST_COPIES) -> DataFrame:
    """The mixture's rows with all their columns, each as often as it is taken.

    The thresholds are the ones of ``mix``; the rows are filtered by their own hash.  Only
    rows of a hash that is a boundary with several rows are written first, so that their
    numbers stand."""
    sizes = _sizes(docs, id_col, text_col, source_col)
    plan, n = _plan(sizes, weights, share, most_copies)
    discard(sizes)
    names = docs.columns
    text = F.col(text_col).cast("string")
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), _source_key(F.col(source_col).cast("string")).alias("src"), row_hash(F.col(id_col), text).alias("h"), F.lit(0).cast("long").alias("u"))
    ties = plan.where("tied is not null").select("src", F.col("below").alias("h"))
    out = _with_copies(keyed, plan.withColumn("tied", F.lit(None).cast("double")), n, most_copies).select("row", "copies")
    if not ties.isEmpty():
        held = keyed.join(F.broadcast(ties) if n <= MOST_BROADCAST else ties, ["src", "h"], "left_semi")
        held = held.withColumn("u", F.xxhash64(F.monotonically_increasing_id()).bitwiseAND(F.lit((1 << (LEVEL_BITS * LEVELS)) - 1)))
        held = materialise(held.withColumn("size", word_count(F.col("row")[text_col].cast("string"))), "tied_rows")
        apart = keyed.join(F.broadcast(ties) if n <= MOST_BROADCAST else ties, ["src", "h"], "left_anti")
        out = _with_copies(apart, plan.withColumn("tied", F.lit(None).cast("double")), n, most_copies).select("row", "copies")
        out = out.unionByName(_with_copies(held, plan, n, most_copies).select("row", "copies"))
    return out.select("row", F.explode(F.array_repeat(F.lit(1), F.col("copies")))).select("row.*")
