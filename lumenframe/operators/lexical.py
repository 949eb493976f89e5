"""Lexical layer: term tables, document frequencies, sparse and hybrid search, merging."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import text as T
from .ranking import reciprocal_ranks
from .spread import spread

#: Rows a lexical search looks at, and the least share of words found.
LEXICAL_DEPTH, MIN_COVERAGE, SHOWN_TEXT = 200, 0.5, 200
#: Words whose terms a worker keeps.
MOST_WORDS = 200_000


def terms(rows: DataFrame, key: str, text_col: str, only: frozenset[str] | None = None) -> DataFrame:
    """(key, term_id, tf): one row a distinct term of a text; of the terms ``only`` if given.

    A text's terms are counted in its own row and each distinct word is cut and hashed once a
    worker, so nothing is shuffled.  Only keys that stand on several rows are merged by key;
    rows without a key are texts of their own.  Null and empty texts have no terms."""

    def ids(word: str) -> tuple[int, ...]:
        return tuple(T.fnv(t) for t in T.terms_of(word) if only is None or t in only)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[int, ...]] = {}
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                found = []
                for text in part.column(1).to_pylist():
                    tf: Counter = Counter()
                    for w, n in Counter(T.words_of(text or "")).items():
                        held = known.get(w)
                        if held is None:
                            if len(known) >= MOST_WORDS:
                                known.clear()
                            held = known[w] = ids(w)
                        for x in held:
                            tf[x] += n
                    found.append(tf)
                cols = [pa.array([list(x) for x in found], pa.list_(pa.int64())), pa.array([list(x.values()) for x in found], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([part.column(0), *cols], [key, "ids", "tfs"])

    told = rows.select(key, F.col(text_col).cast("string").alias("_text"))
    kinds = StructType([told.schema[key], *StructType.fromDDL("ids array<bigint>, tfs array<bigint>").fields])
    out = spread(told).mapInArrow(run, kinds).select(key, F.explode(F.arrays_zip("ids", "tfs")).alias("x")).select(key, F.col("x.ids").alias("term_id"), F.col("x.tfs").alias("tf"))
    again = rows.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > 1).select(key)
    if again.isEmpty():
        return out
    merged = out.join(again, key, "left_semi").groupBy(key, "term_id").agg(F.sum("tf").alias("tf"))
    return out.join(again, key, "left_anti").unionByName(merged)


def document_frequency(table: DataFrame) -> DataFrame:
    """(term_id, df) of a term table that holds a term once a document."""
    return table.groupBy("term_id").agg(F.count("*").alias("df"))


def idf(df: Column, n: Column) -> Column:
    return F.log(F.lit(1.0) + (n - df + F.lit(0.5)) / (df + F.lit(0.5)))


def sparse_search(rows: DataFrame, key: str, text_col: str, query: str, limit: int, digits: int = 6) -> DataFrame:
    """(key, score): the sum of tf * idf over the query's distinct terms.

    Only the query's terms are counted in a text; document frequencies come from the same
    hits, which are dealt out by key once and read twice.
    """
    asked = frozenset(t for w in T.words_of(query) for t in T.terms_of(w))
    n = rows.agg(F.count("*").alias("n"))
    hit = terms(rows, key, text_col, asked).repartition(F.col(key))
    weight = document_frequency(hit).join(F.broadcast(n), how="cross").select("term_id", idf(F.col("df"), F.col("n")).alias("w"))
    score = hit.join(F.broadcast(weight), "term_id").groupBy(key).agg(F.round(F.sum(F.col("tf") * F.col("w")), digits).alias("score"))
    return score.orderBy(F.desc("score"), key).limit(limit)


def hybrid(dense: DataFrame, sparse: DataFrame, key: str, limit: int, prefetch: int = 100) -> DataFrame:
    """Equal-weight fusion of the first rows of a dense and a sparse ranking."""
    cut = lambda d, name: d.orderBy(F.desc("score"), key).limit(prefetch).select(key, "score", F.lit(name).alias("channel"))
    fused = reciprocal_ranks(cut(dense, "dense").unionByName(cut(sparse, "sparse")), key)
    return fused.orderBy(F.desc("fused"), key).limit(limit)


def merge_lexical(results: DataFrame, found: DataFrame, key: str, query: str, text_col: str = "ocr_text") -> DataFrame:
    """Adds lexical hits to results, or lifts those that are there.

    ``results``: (key, probability, position).  ``found``: (key, text) of the sparse hits.
    A hit needs MIN_COVERAGE of the query's words.  Lexical rows come first, by
    probability; the others keep their order.
    """
    share = F.round(T.coverage(query, F.col(text_col)), 6)
    hits = found.select(key, share.alias("lexical_coverage"), F.array_join(T.matched(query, F.col(text_col)), ", ").alias("ocr_match"), F.substring(text_col, 1, SHOWN_TEXT).alias("ocr_text"))
    hits = hits.where(F.col("lexical_coverage") >= MIN_COVERAGE)
    out = results.join(hits, key, "full_outer")
    p = F.greatest(F.coalesce("probability", F.lit(0.0)), F.coalesce("lexical_coverage", F.lit(0.0)))
    out = out.withColumn("probability", p).withColumn("lexical", F.col("lexical_coverage").isNotNull())
    order = W.orderBy(F.desc("lexical"), F.when(F.col("lexical"), -F.col("probability")), F.col("position").asc_nulls_last(), key)
    return out.withColumn("place", F.row_number().over(order))
