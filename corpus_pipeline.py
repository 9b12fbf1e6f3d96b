"""The corpus pipeline: five stages from raw documents to shards, each written as a table and read back by the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from anchorgrid.llm.common import stash
from anchorgrid.llm.decontaminate import decontaminate
from anchorgrid.llm.minhash import drop_near_duplicates
from anchorgrid.llm.mixing import repeat_documents
from anchorgrid.llm.quality import fit_quality, score_quality
from anchorgrid.llm.sharding import shard_documents


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field, fitted on the labelled ones among ``docs``, does not reject."""
    field = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_quality(docs, field).where("predicted = 1").drop("score", "predicted")


def keep_one_of_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates: 80 of 100 of the word 5-shingles."""
    return drop_near_duplicates(docs, width=5)


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources by weight 1, 2, 3 takes them, at most three times."""
    return repeat_documents(docs)


def into_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard of near-equal bytes and their slot in it."""
    return shard_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality),
    ("near_duplicates", keep_one_of_near),
    ("decontamination", keep_clean),
    ("mixing", mix_sources),
    ("sharding", into_shards),
]

#: SQL can express neither the fitted field nor the sampled splitters; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
