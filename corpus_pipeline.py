"""From raw documents to packed training sequences: five stages, each one operator of graphloom.llm.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next one's docs. All but the last return the columns of documents.

Defined cases: a null text counts as empty, and goes with the texts without a letter in the first
stage; a null doc_id is an id like any other, but yields to others as the one that stays; of equal
or near rows one stays, and rows that share its doc_id and text stay with it where the operator says
so; very long texts are read whole; an empty table stays empty; further columns, whatever their
names, are carried to the last stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import exact_dedup, jaccard_join, language_id, mixing, packing
from graphloom.llm._shared import shared_folder


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which no language can be told go; the others have the language that is read from their text."""
    return language_id.keep_identified(docs)


def copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose texts are equal but for white space the one with the smallest doc_id stays."""
    return exact_dedup.drop_duplicates(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that near copies link (five words, 0.8) the one with the smallest doc_id stays."""
    return jaccard_join.keep_first(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents once per copy that the mix takes, in training order."""
    return mixing.training_order(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the training sequences, with their ids."""
    return packing.pack(docs, with_ids=True)


STAGES = [("language id", language), ("exact dedup", copies), ("near dedup", near_copies), ("mixing", mix), ("packing", pack)]

#: Trained networks and tokenizers have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4()}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
