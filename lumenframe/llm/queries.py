"""The registered queries of this package and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bayes, langid, mixing, pieces, rules, secrets, simhash, topk, toxicity, urls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rules.quality_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secrets.scan(_table(spark, sf_dir, "documents"))
    spans = F.transform("secrets", lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string")))
    top = F.round(F.array_max(F.transform("secrets", lambda s: s["score"])), 6)
    return out.select("doc_id", F.col("candidates").alias("n_candidates"), F.size("secrets").cast("long").alias("n_secrets"), F.array_join(spans, ",").alias("spans"), top.alias("top_score"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(_table(spark, sf_dir, "pages"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_quality_posterior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts are the sources; a path is a source's section in one language."""
    docs = _table(spark, sf_dir, "documents")
    path = F.to_json(F.struct("source", "lang"))
    return bayes.quality_posterior(docs, _table(spark, sf_dir, "labels"), F.col("source"), path)


def token_digests(docs: DataFrame) -> DataFrame:
    """doc_id with the number of ids and digests of the ids and of the decoded text."""
    out = pieces.tokenise(docs, tokenizer_path())
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(_table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs))


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_rules, op2_secret_scans, op3_toxicity, op4_simhash, op5_topk, op6_url_filters,
        op7_mixing, op8_quality_posterior, op9_sentencepiece, op10_language_id,
    )
}

ORACLE_SQL = {
    "op5_topk": r"""
WITH v AS (
  SELECT vec_id, embedding FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c AS (
  SELECT vec_id, unnest(range(1, len(embedding) + 1)) AS at,
         unnest(list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT))) AS x
  FROM v
  UNION ALL SELECT vec_id, 0, 0 FROM v  -- a vector without components scores zero
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score
  FROM c AS q JOIN c ON q.at = c.at AND q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0 GROUP BY q.vec_id, c.vec_id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS "rank", vec_id, score FROM s
)
SELECT query_id, "rank", vec_id, score FROM r WHERE "rank" <= 5
""",
    "op6_url_filters": r"""
WITH p AS (
  SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) END AS rest FROM pages
), u AS (
  SELECT page_id, translate(coalesce(regexp_extract(rest, '^([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM p
), r(h, p, v) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), m AS (
  SELECT u.page_id, u.host, u.path, r.h || r.p AS fit, r.v,
         row_number() OVER (PARTITION BY u.page_id, u.host, u.path ORDER BY length(r.h || r.p) DESC) AS n
  FROM u JOIN r ON (u.host = r.h OR ends_with(u.host, '.' || r.h)) AND starts_with(u.path, r.p)
)
SELECT u.page_id, u.host, u.path, m.fit AS "rule", coalesce(m.v, 'allow') AS verdict
FROM u LEFT JOIN m ON m.page_id = u.page_id AND m.host = u.host AND m.path = u.path AND m.n = 1
""",
    "op7_mixing": r"""
WITH d AS (
  SELECT doc_id, source, coalesce(source, '') AS s, source IS NULL AS no_s,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || coalesce(md5(text), 'null')), 1, 15) AS BIGINT) AS h
  FROM documents
), t AS (
  SELECT s, no_s, CAST(sum(size) AS BIGINT) AS source_size,
         (CASE (row_number() OVER (ORDER BY no_s, s) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END) AS w
  FROM d GROUP BY s, no_s
), o AS (  -- sources reach their limit in the order of limit / weight
  SELECT s, no_s, source_size, w, CAST(2 * source_size AS DOUBLE) / w AS r,
         coalesce(sum(2 * source_size) OVER (ORDER BY CAST(2 * source_size AS DOUBLE) / w, no_s, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_before,
         sum(w) OVER (ORDER BY CAST(2 * source_size AS DOUBLE) / w DESC, no_s DESC, s DESC) AS w_from,
         sum(source_size) OVER () AS everything
  FROM t
), k AS (  -- the first source that stays below its limit fixes the level for those after it
  SELECT CAST(1.5 AS DOUBLE) * CAST(everything AS DOUBLE) - CAST(full_before AS DOUBLE) AS rest, CAST(w_from AS DOUBLE) AS ws, r
  FROM o WHERE (CAST(1.5 AS DOUBLE) * CAST(everything AS DOUBLE) - CAST(full_before AS DOUBLE)) * w / w_from <= 2 * source_size
  ORDER BY r, no_s, s LIMIT 1
), g AS (
  SELECT o.s, o.no_s, o.source_size,
         CASE WHEN k.r IS NULL OR o.r < k.r THEN CAST(2 * o.source_size AS DOUBLE) ELSE k.rest * o.w / k.ws END AS target
  FROM o LEFT JOIN k ON TRUE
), b AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE least(CAST(floor(target / source_size) AS INTEGER), 2) END AS whole FROM g
), c AS (
  SELECT d.doc_id, d.size, b.source_size, b.target, b.whole, b.target - b.whole * b.source_size AS budget,
         CAST(sum(d.size) OVER (PARTITION BY d.s, d.no_s ORDER BY d.h ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS run
  FROM d JOIN b ON d.s = b.s AND d.no_s = b.no_s
)
SELECT doc_id, size, source_size, target,
       CAST(size * (whole + CASE WHEN whole < 2 AND (run <= budget OR run - budget < budget - (run - size)) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM c
""",
}
