"""The corpus pipeline: toxic documents go, near copies go, benchmark leaks go, sources are mixed, shards are cut."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sigilo.llm import decontaminate, mixing, sharding, simhash, toxicity
from sigilo.llm.common import release, scratch, settle
from sigilo.llm.queries import QUOTAS


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5; labels are learnt from the rows given."""
    return toxicity.clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies by SimHash, as op2 tells them: that of the smallest doc_id."""
    return simhash.keep_one(docs, simhash.near_classes)


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mix."""
    return mixing.in_order(docs, QUOTAS)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with shard and slot: the curve tells the shard, and within it slots go by the order of the mix, which is that of the files
    that the stage before wrote. Rows that aren't read from files have no such order, and go by the curve."""
    order = sharding.file_order(docs)
    return sharding.laid_out_in(docs, order) if order else sharding.laid_out(docs)


STAGES = [("toxicity", without_toxic), ("near copies", without_copies), ("decontamination", without_leaks), ("mixing", mixed), ("sharding", sharded)]
ORACLE_SQL = None  # scores, fingerprints and schedules are not expressible in SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over documents; each result is written to the shared folder and read again.

    What a stage wrote for itself goes when its result is written, and its input when its reader's result is.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        with scratch() as keep:
            after = keep(settle(stage(spark, docs, sf_dir)))
        release(docs)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)
