"""The corpus pipeline: documents through five operators, one after the other.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which the
caller may write and read again as the next one's ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import line_dedup, minhash, mixing, quality_rules, sentencepiece_codec
from millrace.llm.common import settle

DOCUMENT = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised quality rules reject go."""
    return quality_rules.filter_good(docs).select(*DOCUMENT)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines equal to or within one edit of an earlier line go; so do documents left without a line."""
    return line_dedup.dedup_documents(docs).select(*DOCUMENT)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: five words a shingle, similarity 0.8 or more."""
    return minhash.drop_near_duplicates(docs, 5, 80).select(*DOCUMENT)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed(docs).select(*DOCUMENT)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and whether decoding gives its text back."""
    import public_tokenizers

    coded = sentencepiece_codec.encoded(F.col("text"), public_tokenizers.path("piece_bpe_32k.model"))
    # settled: texts and their ids go through Python in small batches
    return settle(docs.select("doc_id", "lang", "source", coded.alias("e")).select("doc_id", "lang", "source", "e.*"), "encoded")


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("MinHash near-dedup", near),
    ("mixing sources", mix),
    ("SentencePiece", encode),
]

#: SQL cannot express the encoding stage, so the pipeline is tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to documents; what a stage returns is written to the shared folder and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = settle(docs, f"stage{k}")
    return docs
