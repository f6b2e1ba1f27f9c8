"""From raw documents to token ids in five stages, each written as Parquet and read again."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import bpe, exact_dedup, mixing, quality_rules, simhash
from tickloom.llm.common import stored

VOCABULARY = bpe.Vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"), "ranks")

#: Compression ratios, SimHash components and merges have no SQL form.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules pass."""
    return quality_rules.keep(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of every group of equal texts."""
    return exact_dedup.kept_rows(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of every group of near duplicates, on shingles of five words."""
    return simhash.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in training order."""
    return mixing.curriculum(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row and the digest of the text they decode to."""
    ids = bpe.encode(docs, VOCABULARY, decoded=True)
    told = F.sha2("decoded", 256).alias("decoded_sha256")
    return ids.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), told, "ids")


STAGES = [
    ("quality_rules", quality),
    ("exact_dedup", exact),
    ("simhash_dedup", near),
    ("mixing", mix),
    ("byte_bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
