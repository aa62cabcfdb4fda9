"""Pipeline over `documents`: clean, merge near duplicates, decontaminate, mix, shard.

Each stage takes (spark, docs, sf_dir), docs being what the stage before kept,
and returns a DataFrame. All but the last return the columns of documents.
"""

from __future__ import annotations

import os
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom.llm.common import ID_BROADCAST_ROWS, table
from reviewloom.llm.decontaminate import find_leaks
from reviewloom.llm.mixing import mix
from reviewloom.llm.ngram_join import ngram_join
from reviewloom.llm.sharding import shard_documents
from reviewloom.llm.toxicity import toxicity
from reviewloom.runtime import durable, scratch_path, shared_dir

NEAR_WORDS, NEAR_PERCENT = 5, 80
SHARDS = 16


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Documents whose id is not among `gone`; rows without an id stay."""
    ids = durable(gone.where(F.col("doc_id").isNotNull()).select("doc_id").distinct())
    if ids.count() <= ID_BROADCAST_ROWS:
        ids = F.broadcast(ids)
    return docs.join(ids, "doc_id", "left_anti").select(docs.columns)


def _with_stored_order(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Documents with the number and path of their file and their row in it, which tell the order they were written in.

    A reader deals files out by size, so the order of the rows it gives tells nothing.
    """
    order = [F.regexp_extract("_metadata.file_name", r"^part-(\d+)", 1).try_cast("long").alias("_file"),
             F.col("_metadata.file_path").alias("_path"), F.col("_metadata.row_index").alias("_row")]
    try:
        return docs.select("*", *order)
    except AnalysisException:
        # Not a stored table.
        path = scratch_path(spark, "ordered")
        docs.write.parquet(path)
        return spark.read.parquet(path).select("*", *order)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator does not reject."""
    judged = toxicity(docs, table(spark, sf_dir, "labels"))
    return _without(docs, judged.where("predicted = 1"))


def merge_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group of near duplicates.

    Documents without words are linked with nothing, so they all stay.
    """
    groups = ngram_join(docs, NEAR_WORDS, NEAR_PERCENT)
    return _without(docs, groups.where("component_id <> doc_id"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return _without(docs, find_leaks(docs, table(spark, sf_dir, "benchmark")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mix: files and rows follow it, and so do the slots of the shards."""
    return mix(docs).orderBy("mix_position").select(docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of every document; slots of a shard follow the order in which the documents are stored."""
    return shard_documents(_with_stored_order(spark, docs), SHARDS, order=["_file", "_path", "_row"])


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", merge_near_duplicates),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
    ("sharding", shard),
]

# The learned lexicon of the first stage and the alignment of the third are not
# expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages, each written to the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    base = os.path.join(shared_dir(spark), f"pipeline-{uuid.uuid4().hex}")
    for k, (name, stage) in enumerate(STAGES):
        path = os.path.join(base, f"{k}-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
