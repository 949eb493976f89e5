"""From raw documents to token digests: five stages, each written and read again.

Every stage reads all that its predecessor kept and works on the columns of documents;
others are left out.  Nulls, empty texts, repeated rows and
empty tables are handled as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm import mixing, queries, secrets, simhash, toxicity
from lumenframe.llm.common import discard, materialise, sweep, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted to be toxic go; repeated ids are judged by their own text."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels)
    return toxicity.keep_clean(docs.select(*COLUMNS), model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (Jaccard similarity of five-word shingles 0.8 or more)
    the document with the smallest id stays."""
    return simhash.keep_one(docs.select(*COLUMNS), shingle=5, similarity=0.8).select(*COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; secrets in its text are replaced by a mark."""
    out = secrets.redact(docs.select(*COLUMNS))
    changed = F.length("text") != F.col("n_chars")
    return out.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document stands in the result as often as the mixture takes it."""
    return mixing.take(docs.select(*COLUMNS)).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row."""
    return queries.token_digests(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("secret_scans", redact_secrets),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]
#: Learned models, XXH64 and tokenisation have no SQL form; the tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        mark = written()
        docs = materialise(stage(spark, docs, sf_dir), name)
        sweep(spark, mark, keep=(docs.written_to,))  # what the stage wrote on its way
        if before is not None:
            discard(before)
        before = docs
    return docs
