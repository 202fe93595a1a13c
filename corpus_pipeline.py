"""From raw documents to sharded training data, stage by stage.

Each stage's result is written as Parquet and read again as the next one's
input.  The quality classifier, SimHash near-dedup and decontamination filter
whole documents; mixing repeats or leaves out whole documents; sharding
returns one row per document taken, with its shard and slot.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from tillroll.llm import decontamination, mixing, perplexity, sharding, simhash
from tillroll.llm.batches import freed_when_left, smaller_batches, tidy_driver, tidy_executors
from tillroll.llm.queries import SHARDS, table
from tillroll.session import after_staging, release_staged, stage, staged_mark

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def tidied(function: Stage) -> Stage:
    """The stage, in a session tidied of what ran before.

    The executors are tidied at its beginning, the driver also after every table that
    is written, or its heap grows with what the jobs before left there.
    """

    @wraps(function)
    def tidy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        tidy_driver(spark)
        tidy_executors(spark)
        with smaller_batches(spark), after_staging(tidy_driver):
            return function(spark, docs, sf_dir)

    return tidy


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return perplexity.accepted(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(docs, [1.0] * SHARDS, [1.0] * (SHARDS + 1))


STAGES = [
    ("quality", tidied(quality)),
    ("near_duplicates", tidied(near_duplicates)),
    ("decontaminate", tidied(decontaminate)),
    ("mix", tidied(mix)),
    ("shard", tidied(shard)),
]

# Training a model, growing trees and fitting a latent space have no SQL;
# the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``.

    When a stage is written, the tables and broadcasts it was made from are
    freed, the stage before it included.
    """
    docs, tables = table(spark, sf_dir, "documents"), staged_mark(spark)
    for name, function in STAGES[:-1]:
        with freed_when_left(), smaller_batches(spark):
            docs = stage(function(spark, docs, sf_dir), name)
        release_staged(spark, tables, keep=1)
    return STAGES[-1][1](spark, docs, sf_dir)
