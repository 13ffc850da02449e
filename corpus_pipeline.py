"""The corpus pipeline: five stages, each written as Parquet and read again by the next.

Every stage takes (spark, docs, sf_dir), works on all rows it gets and, but for the last,
returns the columns of documents. Nulls, empty texts and repeated rows are treated
as the operators' docstrings say; no stage drops a row for having a null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandmill.llm import decontamination, mixing, near_dups, sharding, toxicity
from strandmill.llm.base import Scratch, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more by compression distance go; null and empty texts stay."""
    return toxicity.reject_toxic(docs, toxicity.learn(spark, docs, table(spark, sf_dir, "labels")))


def near_dups_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the smallest doc_id; rows with a null doc_id stay."""
    return near_dups.drop_near_duplicates(docs, Scratch(spark, "near-dups"), size=5)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; rows with a null doc_id, and null and empty texts, stay."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"), Scratch(spark, "decontamination"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stay by their cell's probability, decided by a hash of doc_id; repeated rows stay or go together."""
    return mixing.keep_mixed(docs, Scratch(spark, "mixing"))


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row gets a shard and a slot; null texts count as empty, repeated rows as documents of their own."""
    return sharding.shard(docs, Scratch(spark, "sharding"))


STAGES = [("toxicity", toxicity_stage), ("near_dups", near_dups_stage), ("decontamination", decontamination_stage), ("mixing", mixing_stage), ("sharding", sharding_stage)]

#: A trained model and an iterative search have no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return docs
