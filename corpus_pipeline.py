"""A training corpus from documents: toxic documents go, then exact copies, then all but one of
each near-duplicate class; what is left is packed into training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next one's docs. All but the last return the columns of documents. Stages decide
about rows, told by doc_id and text: another text of a dropped row's id stays, equal rows of one id
or of none become one row.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from storyweft.llm import exact_dedup, packing, shingle_join, toxicity
from storyweft.llm.columns import shared_dir, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the smallest doc_id."""
    return exact_dedup.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate class, the row with the smallest doc_id."""
    return shingle_join.keep_first(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document stands in the training sequences."""
    return packing.pack(packing.lengths_of(docs, cache_bytes=48 << 20))  # workers still hold other stages' caches


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_exact_copies), ("near_duplicates", drop_near_copies), ("packing", pack_sequences)]

#: SQL expresses neither the trained model nor the packing; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline/{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}_{name}")
        docs = spark.read.parquet(f"{folder}/{k}_{name}")
    return docs
