"""A corpus from raw documents to packed sequences, stage by stage.

Each stage takes the documents that the one before it kept, all columns, and
every stage but the last returns documents again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quillon.llm.common import materialize
from quillon.llm.exact_dedup import exact_dedup
from quillon.llm.langid import filter_languages
from quillon.llm.mixing import mix_documents
from quillon.llm.near_copies import near_copies_dedup
from quillon.llm.packing import pack_documents


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told."""
    return filter_languages(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id."""
    return exact_dedup(docs, keep="largest")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with a Jaccard similarity of 0.8 in five-word shingles the one with the smallest id."""
    return near_copies_dedup(docs, width=5, least=0.8)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mix_documents(docs, weights=(3, 1, 2), share=1.5, stop=2.0)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), window=2048, end_id=1, cache_pieces=40_000, slice_bytes=1 << 20)


STAGES = [("language_id", language), ("exact_dedup", exact), ("simhash_dedup", near), ("source_mix", mix), ("packing", pack)]
#: SQL cannot express the stages; the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written to the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
