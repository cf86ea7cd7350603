"""A corpus pipeline of five stages, each reading what the one before wrote."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import common, decontam, langid, mixing, sharding, simhash


#: Least mean posterior of a document's language: more than all other languages together.
LEAST_SCORE = 0.5


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model is surer of than of all others together; those with a letter if no model could be learned.

    Posteriors are among the learned languages only: with a single one all texts with a letter stay.
    """
    model = langid.train(docs)
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    name = "lang_pred"
    while name in docs.columns:  # a column of the documents stays as it is
        name += "_"
    return langid.predicted(docs, model, name, LEAST_SCORE).where(F.col(name) != langid.UNKNOWN).drop(name)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate group."""
    return simhash.deduplicate(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, with or without an id."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, written in order of their training positions."""
    return mixing.mixed_documents(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their shard."""
    return sharding.sharded_documents(docs)


STAGES = [
    ("language_id", known_language),
    ("simhash_near_dedup", one_of_each_group),
    ("benchmark_decontamination", without_benchmark),
    ("mixing", mixed),
    ("sharding", sharded),
]

#: The first three stages aren't SQL; the tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages from ``documents`` on; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{common.shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return docs
