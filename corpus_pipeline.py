"""The corpus pipeline: language ID, near dedup, suffix-array dedup, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lettermill.llm import language_id, near_dedup, packing, suffix_dedup
from lettermill.llm.common import small_batches, table, written
from lettermill.llm.queries import tokenizer


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model learned from their labelled rows."""
    small_batches(spark)
    return language_id.keep_identified(docs, language_id.learn(docs))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    small_batches(spark)
    return near_dedup.keep_first(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that also occur elsewhere."""
    small_batches(spark)
    return suffix_dedup.without_repeats(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 4096 tokens."""
    small_batches(spark)
    return packing.pack(docs, tokenizer("word_bpe_49k.json"))


STAGES = [("language_id", by_language), ("near_dedup", without_near_duplicates), ("suffix_dedup", without_repeats), ("packing", packed)]

#: The stages can't be said in SQL; tests/llm has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each writes Parquet to the shared folder, and the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
