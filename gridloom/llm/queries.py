"""Queries over the synthetic text tables, one for each operator."""

from __future__ import annotations

import os

import public_tokenizers
from pyspark.sql import functions as F

from gridloom.llm import ann, decontam, html_extract, licenses, lm_score, mixing, omh_dedup, token_count, token_store, toxicity


def _read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ann(spark, sf_dir):
    vectors = _read(spark, sf_dir, "embeddings")
    return ann.search(ann.build_index(vectors), vectors.where("vec_id % 20 = 0"), k=20)


def op2_licenses(spark, sf_dir):
    found = licenses.scan(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", "paragraph", "family", F.round("probability", 6).alias("probability"), F.round("similarity", 6).alias("similarity"))


def op3_mix_sources(spark, sf_dir):
    plan = mixing.mix_plan(_read(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op4_toxicity(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents")
    model = toxicity.train(docs, _read(spark, sf_dir, "labels"))
    scored = toxicity.score(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id",
        toxicity.held_out(F.col("doc_id")).alias("held_out"),
        F.col("g_score").alias("score"),
        (F.col("g_score") >= 0.5).cast("int").alias("predicted"),
    )


def op5_decontamination(spark, sf_dir):
    found = decontam.leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "start", F.round("similarity", 6).alias("similarity"))


def op6_html(spark, sf_dir):
    return html_extract.extract(_read(spark, sf_dir, "pages"))


def op7_lm_score(spark, sf_dir):
    return lm_score.score(_read(spark, sf_dir, "documents"))


def op8_token_counts(spark, sf_dir):
    return token_count.count_tokens(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=512)


def op9_token_store(spark, sf_dir):
    return token_store.store_documents(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_near_duplicates(spark, sf_dir):
    return omh_dedup.classes(_read(spark, sf_dir, "documents")).select("doc_id", "class_id")


QUERIES = {
    "op1_ann": op1_ann,
    "op2_licenses": op2_licenses,
    "op3_mix_sources": op3_mix_sources,
    "op4_toxicity": op4_toxicity,
    "op5_decontamination": op5_decontamination,
    "op6_html": op6_html,
    "op7_lm_score": op7_lm_score,
    "op8_token_counts": op8_token_counts,
    "op9_token_store": op9_token_store,
    "op10_near_duplicates": op10_near_duplicates,
}

ORACLE_SQL = {
    "op3_mix_sources": r"""
WITH s AS (SELECT doc_id, source, CAST(len(regexp_extract_all(COALESCE(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
a AS (SELECT source, SUM(size) AS n FROM s GROUP BY source),
r AS (SELECT source, CAST(n AS DOUBLE) AS n, CAST([5, 2, 1][1 + (ROW_NUMBER() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3] AS DOUBLE) AS w FROM a),
c AS (SELECT *, ROW_NUMBER() OVER (ORDER BY 2 * n / w, source) AS k FROM r),
p AS (SELECT k, n, w, COALESCE(SUM(2 * n) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used,
  SUM(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free, SUM(n) OVER () AS total FROM c),
l AS (SELECT arg_min((1.5 * total - used) / free, k) AS level FROM p WHERE (1.5 * total - used) / free * w <= 2 * n),
t AS (SELECT c.source, c.n, LEAST(2 * c.n, l.level * c.w) AS target FROM c, l),
d AS (SELECT s.doc_id, s.size, CAST(t.n AS BIGINT) AS source_size, t.target, CASE WHEN t.n > 0 THEN t.target / t.n ELSE 0 END AS rate,
  CAST(CAST('0x' || substr(md5('mix:' || COALESCE(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS u
  FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, size * CAST(floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END AS BIGINT) AS taken FROM d
""",
}
