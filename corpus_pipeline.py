"""The training-corpus pipeline: quality rules, near-duplicates, repeated passages, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a table; all but the last return the columns of documents, whatever
others there are and however they are called. Every stage works on all that the one before it kept.

Defined results: a null text is an empty one, and the quality rules drop both as having too few words; a row without doc_id
passes the stages as a document of its own; of rows with one doc_id near-deduplication keeps one; equal documents are
one group, of which the least doc_id stays; an empty table gives an empty table at every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from waymark.llm import decontamination, near_duplicates, packing, quality_rules, substring_dedup
from waymark.llm.staging import Stage, package_on_workers


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a rule of the policy go; rows are judged one by one."""
    return quality_rules.keep(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 or more over five-word shingles, the one of least id stays;
    rows without doc_id all stay."""
    return near_duplicates.keep_one(docs, width=5, percent=80)


def substring(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 35 words or more that occur more than once are cut out of the texts; a document of which no word is
    left goes."""
    return substring_dedup.rewrite(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more lies in benchmark passages go; one without words stays."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document left, in windows of 2048 ids; equal rows are packed one by one."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=1)


STAGES = [
    ("quality_rules", quality),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring),
    ("decontamination", decontaminate),
    ("packing", pack),
]
#: Packing's windows can't be said in SQL; tests compare the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    package_on_workers(spark)
    stage = Stage(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage.write(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
