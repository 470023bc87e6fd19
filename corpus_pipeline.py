"""The corpus pipeline: each stage takes what its predecessor kept.

Toxic texts go, boilerplate lines are cut, one text of each group of near
duplicates stays, benchmark passages are cut, and sources are mixed to their
target weights. The last stage repeats a row as often as the mix takes it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from annotrail.llm import decontaminate, line_dedup, mixing, near_dup, toxicity
from annotrail.llm.common import stored, table


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the counterfactual-regularised classifier calls toxic go."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on too many pages of their source are cut; every row stays."""
    return line_dedup.dedup_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of exact and near copies stays."""
    return near_dup.dedup(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut from texts; texts that are mostly such passages go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it, none to twice."""
    return mixing.mix(docs)


STAGES = [
    ("toxicity", toxicity_filter),
    ("line dedup", line_deduplication),
    ("minhash near-dedup", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources", source_mix),
]

#: SQL can't express the classifier of the first stage; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
