"""From raw documents to packed training sequences, in five stages.

Each stage works on every row its predecessor kept, written as Parquet and read back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusmill.llm import langid, mixing, neardup, packing, toxicity
from corpusmill.storage import materialise


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; those without a letter, or between languages, go."""
    return langid.keep_identified(docs)


def civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic."""
    return toxicity.keep_civil(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near-duplicates."""
    return neardup.keep_one_of_each(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once or more, so that sources approach their target weights."""
    return mixing.mix_sources(docs, whole_rows=True)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and where they stand in the training sequences."""
    return packing.pack_documents(docs)


STAGES = [("language_id", language_id), ("toxicity", civil), ("near_duplicates", distinct),
          ("mixing", mixed), ("packing", packed)]

ORACLE_SQL = None  # trained models and tokenizers have no SQL; see tests/llm


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
