"""From raw documents to packed training sequences: five stages, each on all that the one before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from strandex.llm import contamination, exact_dedup, near_dedup, packing, quality
from strandex.llm.common import stored


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts (score 0.7 or more). Null texts are judged as empty ones; null ids, repeated rows and further columns pass through; an empty
    table stays empty, and without labels all scores are 0.5, so none is accepted."""
    return quality.good_documents(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text: the one with the largest doc_id. Null texts count as empty ones, null ids are smaller than others; further columns pass through; an empty table stays empty."""
    return exact_dedup.distinct_documents(docs)


def far_apart(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one with the smallest doc_id (five words, similarity 0.8). Documents without words or with a null id stay; rows that share an id stay
    or go together; further columns pass through; an empty table stays empty."""
    return near_dedup.one_of_each(docs, words=5, share=(80, 100))


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a ten-word window of a benchmark item. Null and empty texts, null ids and repeated rows stay where they are clean; null items are none; an empty benchmark
    removes nothing, an empty table stays empty; further columns pass through."""
    return contamination.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens. A null or empty text is its end id alone, a null source a queue of its own, null ids stay null, repeated rows are packed one by one; further
    columns are ignored; an empty table gives no pieces."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=1, sequence=2048, cached=120_000, release=True)  # executors still hold memory of earlier stages


STAGES = [("quality", good), ("exact_dedup", distinct), ("near_dedup", far_apart), ("decontamination", uncontaminated), ("packing", packed)]

#: The classifier, the streaming state and the packing have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows are written as Parquet in the shared folder and read again. An empty table gives no pieces."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
