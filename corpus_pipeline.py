"""A corpus pipeline: drop what has no language and what is toxic, keep one of each group of near copies,
cut repeated passages, and pack the rest into sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of docs.
"""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import language, minhash, packing, repeats, toxicity
from tidemark.llm.common import store, table


#: Rows that go to a Python worker at a time; texts can be long, and several stages share an executor's memory.
ROWS = 1000


def in_small_batches(stage):
    """The stage, run with batches of ROWS rows."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS)
        return stage(spark, docs, sf_dir)

    return run_stage


def free(docs: DataFrame, name: str) -> str:
    """A column name that docs does not have."""
    while name in docs.columns:
        name += "_"
    return name


@in_small_batches
def with_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in some language; those without a letter (or text) go."""
    profiles = language.learn(docs.where(~language.held_out()))
    into = free(docs, "_language")
    return language.identify(docs, profiles, into=into).where(F.col(into)["lang_pred"] != "und").drop(into)


@in_small_batches
def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below the threshold."""
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    into = free(docs, "_score")
    return toxicity.score(docs, model, into=into).where(F.col(into) < toxicity.THRESHOLD).drop(into)


@in_small_batches
def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each class of near copies, and those without a doc_id."""
    key = free(docs, "_gone")
    gone = minhash.classes(docs).where("not kept").select(F.col("doc_id").alias(key))
    return docs.join(gone, docs["doc_id"] == gone[key], "left_anti")


@in_small_batches
def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that occur before; n_chars, where there is one, follows the text, and emptied documents stay."""
    cut = repeats.without_repeats(docs)
    return (cut.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else cut).select(*docs.columns)


@in_small_batches
def into_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens with their place in packed sequences."""
    return packing.packed(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES = [
    ("language", with_language),
    ("toxicity", not_toxic),
    ("near_copies", one_of_near_copies),
    ("repeats", without_repeats),
    ("packing", into_sequences),
]

#: Learned models and suffix sorting have no SQL; the tests compare the pipeline with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the documents of a data folder. The session's settings are as before once it returns."""
    docs, before = table(spark, sf_dir, "documents"), spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for _, stage in STAGES:
            docs = store(stage(spark, docs, sf_dir))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    return docs
