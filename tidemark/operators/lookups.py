"""Point and bulk lookups in the mapping and checkpoint tables, and their maintenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S

KEY = ["entity_type", "source_id"]
#: Columns that a partial update may set.
SETTABLE = ("external_id", "target_guid", "sync_version", "last_hash", "last_synced_at", "last_sync", "status")


def find(mapping: DataFrame, entity: str, source_id: str) -> DataFrame:
    return mapping.where((F.col("entity_type") == entity) & (F.col("source_id") == source_id))


def existing(keys: DataFrame, mapping: DataFrame) -> DataFrame:
    """The keys that are mapped."""
    return keys.join(mapping.select(*KEY), KEY, "left_semi")


def external_ids(keys: DataFrame, mapping: DataFrame) -> DataFrame:
    """keys with the external id of each, NULL where there is none."""
    return keys.join(mapping.select(*KEY, "external_id"), KEY, "left")


def source_ids(targets: DataFrame, mapping: DataFrame) -> DataFrame:
    """targets (entity_type, target) with the source_id whose external id or guid that is; the least of several.

    Two equality joins and a union, because a join on either column would compare every pair of rows.
    """
    by = lambda c: mapping.select("entity_type", F.col(c).alias("target"), "source_id").where("target is not null")
    least = by("external_id").unionByName(by("target_guid")).groupBy("entity_type", "target").agg(F.min("source_id").alias("source_id"))
    return targets.join(least, ["entity_type", "target"], "left")


def duplicates(keys: DataFrame, mapping: DataFrame) -> DataFrame:
    """keys (with hash) and `is_duplicate`: mapped, synced, with this very hash."""
    known = mapping.select(*KEY, F.col("last_hash").alias("_hash"), F.col("status").alias("_status"))
    same = S.truthy("hash").isNotNull() & (F.col("_hash") == F.col("hash")) & (F.col("_status") == "synced")
    return keys.join(known, KEY, "left").withColumn("is_duplicate", F.coalesce(same, F.lit(False))).drop("_hash", "_status")


def update(mapping: DataFrame, where: Column, now: Column, **values) -> DataFrame:
    """mapping with columns set where the condition holds; without values nothing changes."""
    if unknown := set(values) - set(SETTABLE):
        raise ValueError(f"not settable: {sorted(unknown)}")
    if not values:
        return mapping
    new = {c: v if isinstance(v, Column) else F.lit(v) for c, v in values.items()} | {"last_attempt": now}
    return mapping.withColumns({c: F.when(where, v).otherwise(F.col(c)).cast(mapping.schema[c].dataType) for c, v in new.items()})


def delete(mapping: DataFrame, keys: DataFrame) -> DataFrame:
    """mapping without these keys."""
    return mapping.join(keys.select(*KEY), KEY, "left_anti")


def delete_count(mapping: DataFrame, keys: DataFrame) -> DataFrame:
    """How many rows that deletes."""
    return mapping.join(keys.select(*KEY), KEY, "left_semi").agg(F.count(F.lit(1)).alias("deleted"))


def put_checkpoints(checkpoints: DataFrame, written: DataFrame, now: Column) -> DataFrame:
    """checkpoints after written (entity_type, last_sync_at, write_order): the last write stays, even if it is older."""
    last = written.groupBy("entity_type").agg(F.max_by("last_sync_at", "write_order").alias("_new"), F.lit(True).alias("_set"))
    return checkpoints.join(last, "entity_type", "full").select(
        "entity_type", F.when(F.col("_set"), F.col("_new")).otherwise(F.col("last_sync_at")).alias("last_sync_at"),
        F.when(F.col("_set"), now).otherwise(F.col("updated_at")).alias("updated_at"),
    )


def checkpoint(checkpoints: DataFrame, entity: str) -> DataFrame:
    return checkpoints.where(F.col("entity_type") == entity).select("last_sync_at")


def clear_dead_letters(letters: DataFrame, entity: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(what stays, how many go); no entity clears all."""
    gone = F.lit(True) if not entity else F.coalesce(F.col("entity_type") == entity, F.lit(False))
    return letters.where(~gone), letters.where(gone).agg(F.count(F.lit(1)).alias("cleared"))
