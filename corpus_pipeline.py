"""The corpus pipeline: four operators of tidemark.llm one after the other over the documents of a folder of tables.

Defined results
  text null or empty            scored and compared like any other text; of several one stays, without words for the mix
  very long texts               whole in every stage
  doc_id null or repeated       each row is a document to the first and third stage; the second keeps one row of a group
  labels or benchmark empty     every document is kept by that stage
  documents empty               no rows
  more columns                  kept up to the mix, whose result has columns of its own
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import common, decontamination, mixing, quality, simhash


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    return quality.keep_good(docs, common.table(spark, sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: fingerprints within 3 bits, or within 10 and five-word shingles similar by 0.8."""
    return simhash.dedup(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of the benchmark occurs."""
    return decontamination.decontaminate(docs, common.table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document."""
    return mixing.plan(docs)


STAGES = [
    ("quality_classifier", quality_stage),
    ("simhash_near_dedup", near_dedup_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("mixing", mixing_stage),
]

#: SQL can express neither the classifier nor the groups of near copies; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage in turn; what a stage returns is written to the shared folder and read again for the next."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, common.materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        common.drop_materialized(before)  # a stage reads its predecessor alone
    return STAGES[-1][1](spark, docs, sf_dir)
