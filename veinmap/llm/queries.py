"""The registered queries of this folder: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from veinmap.llm import bpe, chat, clustering, fingerprint, license_scan, merkle, near_dup, packing, quality, simhash, suffix_dedup, token_count, toxicity
from veinmap.llm.common import table


def vocabulary(name: str) -> str:
    """Where the installed public tokenizers keep a vocabulary; operators take any other path too."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.toxicity(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(table(spark, sf_dir, "documents")).drop("kept_text")


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents")).drop("spans")


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), width=4).drop("set_hash")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.conversation_digests(table(spark, sf_dir, "conversations"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.without_line_feeds(table(spark, sf_dir, "documents"))


def op12_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster(table(spark, sf_dir, "embeddings"))


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_token_counts, op2_quality_rules, op3_toxicity, op4_suffix_dedup, op5_fingerprints, op6_packing, op7_license_scan, op8_near_duplicates, op9_bpe, op10_chat_format, op11_merkle_manifest, op12_clusters, op13_simhash)}
ORACLES: dict[str, str] = {"op2_quality_rules": quality.ORACLE, "op4_suffix_dedup": suffix_dedup.ORACLE, "op7_license_scan": license_scan.oracle(), "op8_near_duplicates": near_dup.oracle(), "op10_chat_format": chat.ORACLE, "op11_merkle_manifest": merkle.oracle(), "op12_clusters": clustering.oracle()}
