"""The corpus pipeline: quality, one of each near-duplicate group, no benchmark items, the mix, shards.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a DataFrame, which ``run`` writes
as Parquet into the shared folder and reads back.  All stages but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from strandlake.llm import decontaminate, jaccard, mixing, quality, sharding
from strandlake.llm.common import delete, scratch, shared_dir, table

#: Near duplicates of the stage: shingles of five words, Jaccard similarity of 0.8 or more.
NEAR_WORDS, NEAR_PERCENT = 5, 80
#: No stage sequence with hashing, near-duplicate search and fingerprints is SQL; tests compare run() with brute force.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.quality_filter(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each(docs, NEAR_WORDS, NEAR_PERCENT)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("source_mix", source_mix),
    ("sharding", shards),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage wrote beside its result goes with its end, its result with the next one's."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/corpus-{name}-{uuid.uuid4().hex}"
        try:
            with scratch(spark):
                stage(spark, docs, sf_dir).write.parquet(path)
        except BaseException:
            delete(spark, path)
            raise
        finally:
            if last:
                delete(spark, last)
        docs, last = spark.read.parquet(path), path
    return docs
