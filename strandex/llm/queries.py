"""The registered queries of this subpackage: each applies its operator to the whole given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, contamination, exact_dedup, filter_audit, lattice_lm, near_dedup, packing, pair_counts, quality, seekable_ids, substring_dedup, toxicity, url_filter
from .url_filter import Rule


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_lm.scored(_table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"))


def op2_pair_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair_counts.token_counts(_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"), limit=2048)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact_dedup.exact_groups(_table(spark, sf_dir, "documents"))
    return groups.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


RULES = [Rule("net", "/", "block"), Rule("example.net", "/en/", "allow"), Rule("example.com", "/de/", "block"), Rule("org", "/fr/", "allow")]


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged(_table(spark, sf_dir, "pages"), RULES).select("page_id", "host", "path", "rule", "verdict")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), end_id=1, sequence=2048)


def op7_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(_table(spark, sf_dir, "documents"), words=3, share=(85, 100))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.scored(docs, quality.fit(docs, _table(spark, sf_dir, "labels")))


def op10_seekable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seekable_ids.read_ids(seekable_ids.write_ids(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), end_id=2))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clusters(_table(spark, sf_dir, "embeddings"), k=40, rounds=5, seed="2")


def op12_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.without_repeats(_table(spark, sf_dir, "documents"), window=20)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lattice_lm": op1_lattice_lm,
    "op2_pair_counts": op2_pair_counts,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_url_filter": op4_url_filter,
    "op5_toxicity": op5_toxicity,
    "op6_packing": op6_packing,
    "op7_contamination": op7_contamination,
    "op8_near_dedup": op8_near_dedup,
    "op9_quality": op9_quality,
    "op10_seekable_ids": op10_seekable_ids,
    "op11_centroids": op11_centroids,
    "op12_recompression": op12_recompression,
    "op13_filter_audit": op13_filter_audit,
}
