"""From raw documents to tokens: filter, de-duplicate, mix, encode.

Every stage takes what the stage before kept, written as Parquet and read again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm import bpe, classifier, exact_dedup, mixing, near_dedup
from gleanery.llm.common import table
from gleanery.session import stored

RANKS = "byte_bpe_50k.tiktoken"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    return classifier.keep_good(docs, classifier.fit(docs))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each set of equal texts."""
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, on five-word shingles at 0.8."""
    return near_dedup.drop_near_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at weights between their own and equal ones; a document may come repeatedly."""
    return mixing.mix(docs).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids per document, and whether decoding them gave its text again."""
    path = public_tokenizers.path(RANKS)
    encoded = bpe.encode(docs.withColumn("text", F.coalesce("text", F.lit(""))), path, public_tokenizers.PATTERN, offsets=False)
    decoded = bpe.decode(encoded, path, public_tokenizers.PATTERN)
    return decoded.select(
        "doc_id", "lang", "source", F.size("ids").alias("n_tokens"), "ids", (F.col("text") == F.col("decoded_text")).alias("exact")
    )


STAGES = [("quality_classifier", quality), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mix), ("byte_bpe", tokens)]

# Models, sketches and tokens are not for SQL; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
