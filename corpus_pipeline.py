"""A corpus pipeline of four stages over the table ``documents``.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage
before it kept; every result is written as Parquet in the shared folder and read
again as the next stage's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabweave.llm import secret_scan, simhash, toxicity
from tabweave.llm.queries import packed
from tabweave.llm.scratch import Scratch


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on ``docs`` and the table ``labels``, does not call toxic."""
    return toxicity.clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group."""
    return simhash.without_near_copies(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked in their texts."""
    return secret_scan.redact(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the texts' token ids, dealt to training sequences."""
    return packed(docs)


STAGES = [("toxicity", without_toxic), ("simhash_near_dedup", without_near_copies), ("secret_scan", without_secrets), ("packing", packed_sequences)]

#: A trained classifier and a tokenizer are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
        if last:
            scratch.drop(last)
        last = name
    return docs
