"""From raw documents to sharded training data: five stages, each of which takes all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fathom.llm import compression, decontam, jaccard, mixing, sharding
from fathom.llm.shared import compact, materialise, shared_dir, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents inside the compression bands."""
    return compact(compression.filter_documents(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a Jaccard similarity of 0.8."""
    return compact(jaccard.keep_one(docs, jaccard.Join(width=5, percent=80)))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by benchmark passages."""
    return compact(decontam.filter_documents(docs, table(spark, sf_dir, "benchmark")))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return compact(mixing.mixed_documents(docs, share=1.5, cap=2.0))


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard and place in it."""
    return compact(sharding.shard(docs, n_shards=16))


STAGES = [("quality rules", quality_rules), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", decontamination), ("mixing sources", source_mixing), ("sharding", shards)]

#: Compression, Newton iterations and slot maps have no SQL form; tests/llm/test_pipeline.py holds the rows against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = table(spark, sf_dir, "documents"), shared_dir(spark)
    for k, (_, stage) in enumerate(STAGES):
        docs = materialise(stage(spark, docs, sf_dir), f"{path}/stage-{k}")
    return docs
