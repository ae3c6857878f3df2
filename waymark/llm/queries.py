"""The registered queries opN_<name>: each reads its whole table and returns the contract's columns."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm import (
    decontamination, hard_negatives, near_duplicates, packing, quality_model, quality_rules, ranked_search, sharding, substring_dedup, token_counts, token_store,
    url_reputation, warc,
)
from waymark.llm.staging import package_on_workers, shared_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    package_on_workers(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(_table(spark, sf_dir, "documents"))


def op2_lexical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=1)


def op3_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.learn_and_score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = substring_dedup.remove_repeats(_table(spark, sf_dir, "documents"))
    digest = F.sha2(F.col("dedup.kept_text").cast("binary"), 256)
    return rows.select("doc_id", "dedup.n_words", "dedup.n_removed", digest.alias("kept_sha256"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(_table(spark, sf_dir, "documents"), width=4, percent=80)


def op6_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "warc")
    warc.archive(_table(spark, sf_dir, "pages"), path)
    return warc.read_resolved(spark, path).drop("header_digest")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 1024)


def op8_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_reputation.judge(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "labels"))


def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.store_and_read(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("version")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), top=50)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), moved.alias("label"), "embedding", (F.col("vec_id") % 100 == 0).alias("is_anchor"))
    return hard_negatives.mine(rows, positives=5, negatives=5, low=80, high=100)


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digests(_table(spark, sf_dir, "documents"), shards=24)


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_rules, op2_lexical_packing, op3_quality_model, op4_substring_dedup, op5_near_duplicates, op6_warc_revisits, op7_token_counts, op8_url_reputation,
        op9_token_store, op10_decontamination, op11_ranked_search, op12_hard_negatives, op13_sharding,
    )
}
