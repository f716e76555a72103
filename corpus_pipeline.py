"""Corpus cleaning pipeline: toxicity, near duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns a
DataFrame, which is written as Parquet and read again as the next stage's ``docs``. All but
the last return the columns of ``docs``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillworks.config import stage_table
from tillworks.llm import packing, repeats, simhash, toxicity

TOXIC_AT = 0.7
PASSAGE_WORDS = 50
PASSAGE = 200  # bytes; over 50 words of three bytes and more take 203


def in_small_batches(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """Tasks and their Python workers hand each other few whole texts at once; the setting stays, as the result is written after the stage returns."""

    @wraps(stage)
    def own(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(simhash.ARROW_ROWS))
        return stage(spark, docs, sf_dir)

    return own


@in_small_batches
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose toxicity score is under ``TOXIC_AT``; the model learns from all confirmed toxic documents."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(toxicity.score(F.col("text"), model) < TOXIC_AT)


@in_small_batches
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: pigeonring links of SimHash fingerprints, confirmed and completed by shingle sets, see :func:`tillworks.llm.simhash.one_of_each`."""
    return simhash.one_of_each(docs)


@in_small_batches
def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows; repeated runs of over ``PASSAGE_WORDS`` words or of 400 bytes are cut out of the text, see :func:`tillworks.llm.repeats.without_repeats`."""
    return repeats.without_repeats(docs, PASSAGE, PASSAGE_WORDS)


@in_small_batches
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, see :func:`tillworks.llm.packing.pack`."""
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("near duplicates", drop_near_duplicates), ("repeated passages", drop_repeats), ("packing", pack)]

#: SQL can express neither the trained classifier nor the greedy packing; brute-force versions are in tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``, each result staged in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES):
            docs = stage_table(docs)
    return docs
