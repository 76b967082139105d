"""From raw documents to packed training sequences.

Each stage works on the rows its predecessor kept. All but the last return the
columns of ``documents``; a document that the mix takes twice is two rows. Between
stages the rows are written as Parquet to the shared folder, so that a stage that
reads them several times, or lost executors, do not run the earlier ones again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from netsieve.llm.common import read
from netsieve.llm.mixing import mixed
from netsieve.llm.near_dedup import drop_near_duplicates
from netsieve.llm.packing import pack_documents
from netsieve.llm.quality import keep_quality
from netsieve.llm.toxicity import keep_clean
from netsieve.session import checkpoint_dir


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return keep_quality(docs, read(spark, sf_dir, "labels"))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain does not call toxic."""
    return keep_clean(docs, read(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return drop_near_duplicates(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of the sources takes them."""
    return mixed(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences."""
    return pack_documents(docs)


STAGES = [
    ("quality classifier", quality),
    ("toxicity", toxicity),
    ("minhash near-dedup", near_dedup),
    ("mixing sources", mixing),
    ("best-fit packing", packing),
]

# models and similarity joins: tested against brute force instead
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read(spark, sf_dir, "documents")
    folder = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = f"{folder}/{k}"
            docs.write.parquet(path)
            docs = spark.read.schema(docs.schema).parquet(path)
    return docs
