"""The registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from chemscore.llm import (
    bpe, decontaminate, lexical_search, license_scan, near_dups, prefix_trie, quality, secret_scan, token_counts,
    token_files, topk, toxicity, url_filter,
)
from chemscore.llm.common import table
from chemscore.llm.oracles import ORACLES  # noqa: F401 - read by __spark_entry__.py

BPE_FILE = "byte_bpe_50k.json"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents", "doc_id", "text")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.scan(_documents(spark, sf_dir), table(spark, sf_dir, "benchmark", "item_id", "text"), span=10)


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages", "page_id", "url")
    rules = url_filter.mine(pages, table(spark, sf_dir, "labels", "doc_id", "quality", "toxic"))
    return url_filter.judge(pages, rules)


def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return topk.top_k(vectors, vectors.where("vec_id % 50 = 0"), k=5)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_documents(spark, sf_dir), public_tokenizers.path(BPE_FILE), limit=512)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_documents(spark, sf_dir))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(_documents(spark, sf_dir), public_tokenizers.path(BPE_FILE), end_id=2)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.find(_documents(spark, sf_dir)))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels", "doc_id", "toxic")))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.near_duplicates(_documents(spark, sf_dir)).select(
        "doc_id", "n_shingles", "component_id", "kept")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_documents(spark, sf_dir), public_tokenizers.path(BPE_FILE))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(_documents(spark, sf_dir), table(spark, sf_dir, "benchmark", "item_id", "text"), k=20)


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels", "doc_id", "quality")))


QUERIES = {f.__name__: f for f in (
    op1_decontaminate, op2_url_filter, op3_top_k, op4_token_counts, op5_license_scan, op6_token_files,
    op7_secret_scan, op8_toxicity, op9_near_duplicates, op10_bpe, op11_prefix_trie, op12_lexical_search,
    op13_quality,
)}
