"""A corpus pipeline of five stages, each written as Parquet and reread as the next one's input."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from stockops.llm import decontaminate, mixing, sharding, simhash, toxicity
from stockops.llm.common import read_table, shared_folder
from stockops.llm.queries import N_SHARDS


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects go.

    Null and empty texts are clean; rows of one doc_id are judged by their own texts; without labels of
    both kinds nothing goes. Other columns are kept.
    """
    return toxicity.drop_toxic(docs, toxicity.learn(docs, read_table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: that of the smallest doc_id, rows without one last.

    Null and empty texts are one group; rows that repeat a doc_id with unrelated texts all stay.
    """
    return simhash.drop_near_duplicates(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go. Null and empty texts and an empty benchmark hold none."""
    return decontaminate.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as the mix of the sources takes them, three times at most.

    Texts without words are never taken; a null source is a source of its own.
    """
    return mixing.mixed_documents(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row, as it is, gets its shard by its doc_id; rows without one share a shard."""
    return sharding.sharded_documents(docs, [1.0] * N_SHARDS)


STAGES = [
    ("toxicity", toxic),
    ("near_duplicates", near_duplicates),
    ("decontamination", benchmark),
    ("mixing", mix),
    ("sharding", shards),
]

#: The classifier, fingerprints and hashes have no SQL form; tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; stage results are kept in the shared checkpoint folder."""
    work = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{work}/{k}-{name}")
        docs = spark.read.parquet(f"{work}/{k}-{name}")
    return docs
