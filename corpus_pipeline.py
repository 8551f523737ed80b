"""The corpus pipeline: documents without toxic ones, near duplicates, repeated passages and secrets, packed.

STAGES are applied one after another, each to all that the one before has kept. Each takes (spark, docs, sf_dir)
and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from geoloom.llm import common, jaccard_join, mixture_packing, recompression, secret_scan, toxicity_knn


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go. A null or empty text scores as a text without a known word; repeated rows alike; without labels none go."""
    return toxicity_knn.reject(docs, common.table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays, that of the least doc_id; rows without a word all stay."""
    return jaccard_join.one_of_each(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in passages that stand elsewhere too go, and documents that are left without a word. A null text becomes an empty one and stays."""
    return recompression.without_repeats(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; every row stays, a null text as an empty one."""
    return secret_scan.redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of the documents' ids, mixed as the sources are; an empty text is the end id alone, a null source the source ''."""
    return mixture_packing.pack(docs)


STAGES = [("toxicity", toxicity), ("jaccard_join", near_duplicates), ("substring_dedup", substrings), ("secret_scan", secrets), ("packing", packing)]

#: SQL can't express the stages; the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from documents to pieces of sequences. A stage's tables go when the next one's result is written; without rows the result is empty."""
    docs, since = common.table(spark, sf_dir, "documents"), common.written()
    for name, stage in STAGES[:-1]:
        docs = common.materialise(stage(spark, docs, sf_dir), name)
        common.clean(spark, since, 1)
    return STAGES[-1][1](spark, docs, sf_dir)
