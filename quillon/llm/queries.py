"""Queries that apply each training-data operator to its whole table, and DuckDB SQL where that can express them."""

from __future__ import annotations

import string

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from quillon.llm.exact_dedup import exact_dedup_report
from quillon.llm.flac import media_report
from quillon.llm.langid import language_report
from quillon.llm.lexical import search_documents
from quillon.llm.lm_score import score_documents
from quillon.llm.mixing import mix_report
from quillon.llm.odd_sketch import odd_sketch_components
from quillon.llm.packing import pack_documents
from quillon.llm.shard import shard_documents
from quillon.llm.simhash import simhash_components
from quillon.llm.sstable import token_shards
from quillon.llm.url_filter import filter_urls
from quillon.llm.whitening import whiten_embeddings

#: The rules of the URL query.
URL_RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_flac_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_report(table(spark, sf_dir, "documents"))


def op2_url_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op3_token_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_shards(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), window=2048, end_id=1)


def op5_simhash_bk_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"), width=3, radius=2, seed=42)


def op6_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_documents(table(spark, sf_dir, "documents"), 40, overhead=16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))


def op8_pivotal_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(table(spark, sf_dir, "documents"), weights=(3, 1, 2), share=1.5, stop=2.0)


def op9_language_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_report(table(spark, sf_dir, "documents"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup_report(table(spark, sf_dir, "documents"), keep="largest")


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten_embeddings(table(spark, sf_dir, "embeddings"), components=16, scale=64, offset=1_000_000)


def op12_odd_sketch_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return odd_sketch_components(table(spark, sf_dir, "documents"), width=2, percent=80)


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), top=20)


QUERIES = {
    f.__name__: f
    for f in (
        op1_flac_media, op2_url_cascade, op3_token_sstable, op4_best_fit_packing, op5_simhash_bk_tree,
        op6_minimax_shards, op7_context_mixing, op8_pivotal_mix, op9_language_svm, op10_exact_dedup,
        op11_embedding_whitening, op12_odd_sketch_dedup, op13_lexical_search,
    )
}


def _fits(rule: str) -> str:
    host, _, path = rule.partition("/")
    return f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{path}')"


def _terms(column: str) -> str:
    """SQL for the list of terms of a text."""
    return f"regexp_extract_all(translate({column}, '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"


_LONGEST_FIRST = sorted(URL_RULES, key=len, reverse=True)
ORACLES = {
    "op2_url_cascade": f"""
WITH parts AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages),
ruled AS (
  SELECT *, CASE {" ".join(f"WHEN {_fits(r)} THEN '{r}'" for r in _LONGEST_FIRST)} END AS rule FROM parts)
SELECT page_id, host, path, rule,
       CASE rule {" ".join(f"WHEN '{r}' THEN '{v}'" for r, v in URL_RULES.items())} ELSE 'allow' END AS verdict
FROM ruled""",
    "op10_exact_dedup": f"""
WITH normal AS (
  SELECT doc_id, translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS t FROM documents),
groups AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM normal GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256
FROM normal JOIN groups USING (t)""",
    "op13_lexical_search": f"""
WITH asked AS (
  SELECT item_id, term, count(*) AS uses FROM (SELECT item_id, unnest({_terms("text")}) AS term FROM benchmark) GROUP BY ALL),
docs AS (SELECT row_number() OVER () AS row_no, doc_id, {_terms("text")} AS t FROM documents),
whole AS (SELECT count(*)::BIGINT AS n_docs, sum(len(t))::BIGINT AS n_terms FROM docs WHERE len(t) > 0),
uses AS (
  SELECT row_no, doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT row_no, doc_id, len(t) AS n, unnest(t) AS term FROM docs)
  WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM uses GROUP BY term), whole),
scores AS (
  SELECT item_id, row_no, doc_id, sum(asked.uses * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN uses USING (term), whole GROUP BY ALL),
placed AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM placed WHERE rank <= 20""",
}
