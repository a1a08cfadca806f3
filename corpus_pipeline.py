"""From raw documents to packed training sequences, in five stages of the library's operators.

Each stage is (name, function of (spark, docs, sf_dir)); all but the last return the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veinmap.llm import near_dup, packing, quality, suffix_dedup, toxicity
from veinmap.llm.common import cut, table
from veinmap.llm.queries import vocabulary


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the multiple-instance model doesn't call toxic."""
    return toxicity.drop_toxic(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def without_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line-first quality rules keep, without their failing lines."""
    return quality.clean(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of near-duplicates."""
    return near_dup.drop_near_duplicates(docs)


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes of strings of 200 bytes that stand elsewhere too."""
    return suffix_dedup.drop_repeats(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences along the space-filling curve."""
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [("toxicity", without_toxic), ("quality", without_poor), ("near_duplicates", without_near_copies), ("suffix_dedup", without_repeated_passages), ("packing", packed)]

#: Trained scores, similarity components and token ids have no SQL; tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs)
    return docs
