"""The corpus operators' queries over the provided tables, with the parameters meant for production."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import audit, bpe, conversations, fingerprints, language, lm, minhash, packing, repeats, sharding, topk, toxicity, vectors
from .common import table


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compared(table(spark, sf_dir, "documents"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.predictions(table(spark, sf_dir, "documents"))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.classes(table(spark, sf_dir, "documents"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.placed(table(spark, sf_dir, "documents"), shards=40)


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target is what the labels call good."""
    good = table(spark, sf_dir, "labels").where("quality = 1")
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return lm.score(table(spark, sf_dir, "documents"), good, path, public_tokenizers.PATTERN)


def op6_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return packing.packed(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.predictions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digests(table(spark, sf_dir, "documents"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.digests(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op11_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.nearest(table(spark, sf_dir, "embeddings"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_fingerprints": op1_fingerprints,
    "op2_language": op2_language,
    "op3_minhash": op3_minhash,
    "op4_sharding": op4_sharding,
    "op5_lm_score": op5_lm_score,
    "op6_vectors": op6_vectors,
    "op7_packing": op7_packing,
    "op8_toxicity": op8_toxicity,
    "op9_repeats": op9_repeats,
    "op10_bpe": op10_bpe,
    "op11_topk": op11_topk,
    "op12_filter_audit": op12_filter_audit,
    "op13_conversation_repair": op13_conversation_repair,
}
