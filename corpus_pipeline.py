"""The corpus pipeline: quality rules, exact dedup, near dedup, substring dedup, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows the one before kept.  All
but the last return the columns of documents; the last returns the packed pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pluvio.llm import exact_dedup as exact
from pluvio.llm import ngram_join, packing, quality, substring
from pluvio.llm.common import load, write_table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality.quality_filter(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal normalised texts, the one with the least doc_id."""
    return exact.exact_dedup(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of texts alike in 80 % of their five-word shingles."""
    return ngram_join.near_dedup(docs, shingle_words=5, num=80, den=100)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with repeated passages cut out but for their first occurrence."""
    cut = substring.remove_repeats(docs)
    return cut.withColumn("n_chars", F.length("text").cast("long"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in windows of 2048 ids."""
    pieces = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), 2048, end_id=1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_copies),
    ("ngram_jaccard", near_copies),
    ("substring_dedup", repeated_passages),
    ("packing", packed),
]

#: SQL cannot express the stages' chunks and tokens; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's result written as Parquet and read back."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs, _ = write_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
