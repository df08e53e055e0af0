"""The corpus pipeline: quality rules, near-duplicate removal, decontamination, mixing, token store.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept. All but the last return the columns of
documents; the last returns what the files of the token store say of each document of the mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lorekeep.llm import decontaminate, jaccard_join, mixing, quality_rules, token_store
from lorekeep.llm._shared import documents, stash


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.keep(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return jaccard_join.keep_one(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mix(docs)


def stored(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token store of the mix, as its files have it."""
    return token_store.stored_digests(docs)


STAGES = [("quality rules", good), ("n-gram Jaccard join", distinct), ("benchmark decontamination", uncontaminated), ("mixing sources", mixed), ("token store", stored)]

#: Binomial bounds and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stash(docs)
    return docs
