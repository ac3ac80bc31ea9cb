"""Rendezvous sharding of stable record keys (operator 4).

Every (key, shard) pair has a hash; a record goes to the shard whose weighted hash is greatest. A new
shard only adds one more candidate, so the records that move all move into it. Law: `key`, which means
that doc_id and the shards alone decide.

A null doc_id is a key of its own ("null"); equal keys share a shard. Text never matters for the shard,
only for the size. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dense_rank_ids

#: Hexadecimal digits of the hash that count: 52 bits, which a double holds exactly.
DIGITS = 13


def contest(key: Column, shards: list[int], weights: list[float]) -> Column:
    """The best (score, -shard) of a key over the shards, as an array's greatest struct.

    Under equal weights the hash itself ranks the shards as -weight / ln(u) does, so the logarithm is left out.
    """
    one = F.array(*[F.struct(F.lit(s).alias("shard"), F.lit(float(w)).alias("weight")) for s, w in zip(shards, weights)])
    equal = len(set(weights)) <= 1

    def score(x: Column) -> Column:
        digits = F.substring(F.md5(F.concat(key, F.lit(":"), x["shard"].cast("string")).cast("binary")), 1, DIGITS)
        if equal:
            return F.struct(digits.alias("score"), (-x["shard"]).alias("other"))
        u = (F.conv(digits, 16, 10).cast("double") + 1) / F.lit(float(16**DIGITS + 1))
        return F.struct((-x["weight"] / F.log(u)).alias("score"), (-x["shard"]).alias("other"))

    return F.array_max(F.transform(one, score))


def shard(
    docs: DataFrame, shards: int = 40, weights: list[float] | None = None, new_weight: float = 1.0,
    key: str = "doc_id", into: str = "shard", grown: str = "grown_shard",
) -> DataFrame:
    """docs with the shard of each record, and its shard were there one shard more."""
    weights = weights or [1.0] * shards
    text = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    now = contest(text, list(range(shards)), weights)
    then = contest(text, list(range(shards + 1)), [*weights, new_weight])
    return docs.withColumn(into, (-now["other"]).cast("int")).withColumn(grown, (-then["other"]).cast("int"))


def placed(docs: DataFrame, shards: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every document.

    Slots number a shard's records from 0 in the order of doc_id.
    """
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    return dense_rank_ids(shard(rows, shards), ["shard"], ["doc_id"], "slot").select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"
    )
