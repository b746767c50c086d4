"""A corpus pipeline: quality classifier, exact dedup, MinHash near-dedup, mixing to target weights, byte-level BPE.

Each stage reads what its predecessor kept; all but the last return the columns of documents. The stages are learned or
random in ways that SQL can't state, so ORACLE_SQL is None and tests/llm holds brute-force versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe_tree, common, exact_dedup, minhash, mixing, quality_fm

ORACLE_SQL = None


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    return quality_fm.accepted(docs, common.table(spark, sf_dir, "labels"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The longest original of each group of equal texts, one row of rows repeated with their doc_id. docs is read from Parquet files."""
    kept = exact_dedup.exact_dedup(spark, docs, in_files=True).filter("kept").select(F.col("locator.file").alias("__file"), F.col("locator.at").alias("__at"))
    rows = docs.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__at"))
    return rows.join(kept, ["__file", "__at"], "left_semi").select(*docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each component of near copies; of documents without one, which their text tells apart, one of a component."""
    key, text = F.coalesce(F.col("doc_id").cast("long"), F.lit(minhash.NOBODY)), F.md5(F.coalesce(F.col("text"), F.lit("")))
    kept = minhash.near_dedup(docs, key=text).filter("kept").select(key.alias("__kept_id"), F.col("key").alias("__kept_text")).distinct()
    return docs.withColumns({"__kept_id": key, "__kept_text": text}).join(kept, ["__kept_id", "__kept_text"], "left_semi").select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes it, shard by shard."""
    return mixing.mixed_rows(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document: doc_id, n_tokens, ids (unsigned 32-bit little-endian), decoded_sha256 (of the bytes decoded from them)."""
    return bpe_tree.bpe(docs).select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality classifier", good_quality), ("exact dedup", without_copies), ("minhash near-dedup", without_near_copies), ("mixing", mixed), ("bpe", encoded)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; the rows of each are written to the shared folder and read by the next."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.staged(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
