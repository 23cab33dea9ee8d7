"""From raw documents to packed training sequences, in five stages that each work on what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stacksight.llm import common, decontaminate, language, lsh_forest, packing, suffix_array

#: Words that a worker of the last stage remembers; workers are shared with the other stages, so fewer than where packing runs alone.
CACHE_WORDS = 150_000
#: Bytes of text that it works on at a time, fewer for the same reason.
BLOCK_BYTES = 1 << 20


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a language that the labelled ones teach; those that are rejected go."""
    return language.kept_documents(docs, language.train(docs))


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates on shingles of five words."""
    return lsh_forest.kept_documents(docs, size=5)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of strings of 200 bytes that also start elsewhere."""
    return suffix_array.shortened_documents(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in sequences of 4096 tokens."""
    return packing.pack(docs, cache_words=CACHE_WORDS, block_bytes=BLOCK_BYTES)


STAGES = [
    ("language_id", language_id),
    ("minhash_near_dedup", minhash_near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("decontamination", decontamination),
    ("packing", pack),
]

#: Learnt models, similarity groups and tokens are beyond SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.stored(docs)
    return docs
