"""The corpus pipeline: from documents to packed training sequences, in stages that each work on
all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; between stages the rows are
written as Parquet in the shared folder and read again. All but the last return the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sievemark.llm import mixing, near_dedup, packing, quality_rules, suffix_dedup
from sievemark.llm.shared import stored


#: Weight of each source in the mix; None: they follow from the sources' sizes.
WEIGHTS: dict | None = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy of the rules rejects go."""
    return quality_rules.filtered(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays."""
    return near_dedup.deduplicated(docs)


def suffix_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of passages of 50 words or more are cut out of the texts."""
    return suffix_dedup.deduplicated(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in an order that keeps the sources at their target weights."""
    return mixing.mixed(docs, WEIGHTS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the training sequences, with their texts, dealt in the mixed order. A table
    that is read again has no order, so the places are worked out anew: they follow from the rows."""
    return packing.sequences(docs, places=mixing.places(docs, WEIGHTS))


STAGES = [
    ("quality rules", quality_stage),
    ("near dedup", near_dedup_stage),
    ("suffix dedup", suffix_dedup_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: SQL can't express the dart signatures' classes or the packing plan: tests hold the stages
#: against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
