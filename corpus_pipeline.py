"""The corpus pipeline: each stage works on all that the one before it kept, written and read again in between."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quilt.llm import catalogue, common, decontam, mixing, near_copies, quality, tokenfile

#: Bytes of text that a worker encodes at once: executors are larger after the stages before than in a run of token files alone.
TOKEN_BATCH = 2 << 20


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, without their failing lines."""
    kept = quality.kept_documents(docs)
    return kept.withColumn("n_chars", F.length("text").cast("long"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the one with the smallest doc_id."""
    return near_copies.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of any benchmark item."""
    return decontam.clean_documents(docs, common.table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed_documents(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix; a row for each document read back from them."""
    path = common.new_path(spark, "tokens")
    schema = tokenfile.write(docs, path, catalogue.tokenizer_path(), batch_bytes=TOKEN_BATCH)
    return tokenfile.digests(spark, path, schema)


STAGES = [
    ("quality rules", quality_rules),
    ("near-dedup", near_dedup),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
    ("token files", token_files),
]

#: Fingerprints and tokenizer ids can't be had in SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
