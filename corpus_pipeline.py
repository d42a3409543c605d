"""Corpus pipeline: quality rules, near-dedup, decontamination, mixing, token output, each an operator of framespark.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from framespark.llm import decontaminate, mixing, near_dups, quality, token_ids
from framespark.llm.common import stash, work_dir


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.kept_documents(docs)


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, the one with the smallest doc_id."""
    return near_dups.drop_near_duplicates(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, the last of each source cut to its words."""
    return mixing.mixed_documents(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each row, read back from the token files."""
    return token_ids.encoded_documents(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_dups", near_dup_stage),
    ("decontaminate", decontaminate_stage),
    ("mixing", mixing_stage),
    ("token_ids", token_stage),
]

#: The stages use sketches, hashes and a tokenizer, which SQL can't express; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = work_dir(spark)
    for name, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), folder, f"stage-{name}")
    return docs
