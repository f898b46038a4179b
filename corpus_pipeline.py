"""A corpus from raw documents: quality, near-duplicates, decontamination, mixture, shards.

Every stage takes the documents its predecessor kept, written as Parquet and read
again, and hands on the columns of ``documents``; the last returns their shards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from framelake.llm import decontam, mixing, neardup, quality, sharding
from framelake.llm.common import materialise, read_table


#: Shards hold about this many bytes of text.
SHARD_BYTES = sharding.SHARD_BYTES


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the current policy rejects: null, empty and short texts among them.

    Null and repeated ids are rows like others; an empty table stays empty.
    """
    return quality.kept_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document of each class of near-duplicates (five words, similarity 0.8).

    Of rows repeated under one id one stays; rows with a null id, and texts without words,
    are compared with none and stay; an empty table stays empty.
    """
    return neardup.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold an item of ``benchmark``.

    Null texts and null items hold nothing; without items, or documents, all rows stay.
    """
    return decontam.clean_documents(docs, read_table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents so that sources meet their target weights, in the order of the schedule.

    Null sources are one source; null ids are documents of their own; an empty table stays empty.
    """
    return mixing.mixed_documents(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard, of ``SHARD_BYTES`` or less as near as cuts allow, and slot of every row, repeated rows each."""
    return sharding.sharded(docs, target_bytes=SHARD_BYTES)


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("source mixture", mixture),
    ("sharding", shards),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
