"""Corpus pipeline: toxicity, near-duplicates, benchmark decontamination,
secret scans, BPE encoding.

Each stage works on all rows its predecessor kept and its decisions take
effect.  All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chemscore.llm import bpe, decontaminate, near_dups, secret_scan, toxicity
from chemscore.llm.common import small, stage, table
from chemscore.llm.queries import BPE_FILE
from chemscore.session import materialize

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """Rows of docs whose (doc_id, text) is not among the rejected (doc_id, text_key)."""
    r = small(stage(rejected.select("doc_id", "text_key").distinct(), "pipeline-rejected")).select(
        F.col("doc_id").alias("__doc"), F.col("text_key").alias("__key"))
    return docs.select(*COLUMNS).join(
        r, F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.xxhash64("text") == F.col("__key")), "left_anti")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go; the lexicon is learned from the labelled documents."""
    lexicon = toxicity.fit(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"))
    return toxicity.keep_clean(docs.select(*COLUMNS), lexicon)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays: the one with the smallest doc_id
    (of rows with its id and text, one)."""
    judged = near_dups.near_duplicates(docs).select("doc_id", "text_key", "kept")
    kept = _without(docs, judged.where("not kept"))
    repeated = stage(judged.where("kept and doc_id is not null").groupBy("doc_id", "text_key").count()
                     .where("count > 1").select("doc_id", "text_key"), "pipeline-repeated")
    if not repeated.limit(1).count():
        return kept
    r = small(repeated).select(F.col("doc_id").alias("__doc"), F.col("text_key").alias("__key"))
    same = (F.col("doc_id") == F.col("__doc")) & (F.xxhash64("text") == F.col("__key"))
    once = (kept.join(r, same, "left_semi").groupBy("doc_id", "text")
            .agg(F.min(F.struct(*COLUMNS[2:])).alias("row")).select("doc_id", "text", "row.*"))
    return kept.join(r, same, "left_anti").unionByName(once)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    items = table(spark, sf_dir, "benchmark", "item_id", "text").select(
        "item_id", decontaminate.words(F.col("text")).alias("words"))
    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_key"), decontaminate.words(F.col("text")).alias("words"))
    return _without(docs, decontaminate.find_hits(keyed, items).select("doc_id", "text_key"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by their kind in brackets; n_chars follows the text."""
    found = secret_scan.find(docs.select(*COLUMNS))
    hit = F.size("secret_spans") > 0
    masked = secret_scan.mask(F.col("text"), F.col("secret_spans"))
    return (found.withColumn("text", masked)
            .withColumn("n_chars", F.when(hit, F.length("text").cast("long")).otherwise(F.col("n_chars")))
            .select(*COLUMNS))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and ids (little-endian uint32) of every text; a null text has no ids."""
    return bpe.encode(docs, public_tokenizers.path(BPE_FILE))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("bpe", encode),
]

#: The toxicity stage scores with a fitted model, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for i, (name, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, f"llm-pipeline-{name}")
    return docs
