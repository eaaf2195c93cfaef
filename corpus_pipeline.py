"""The corpus pipeline: toxicity, near-duplicates, repeated passages, benchmark passages, mixing.

Each stage is one function ``(spark, docs, sf_dir) -> DataFrame``; its result is written as Parquet and read again as the
next one's ``docs``. All but the last return the columns of ``documents``; the last adds ``mix_copies``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from attesta.llm import decontamination, mixing, simhash, substrings, toxicity
from attesta.llm.common import stored, table

#: No SQL: the learnt scores and the 64-bit hashes of fingerprints and samples have no counterpart there.
ORACLE_SQL = None


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.deduplicated(docs)


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substrings.deduplicated(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("simhash_near_dedup", without_near_duplicates),
    ("substring_dedup", without_repeated_passages),
    ("benchmark_decontamination", without_benchmark),
    ("source_mixing", mixed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
