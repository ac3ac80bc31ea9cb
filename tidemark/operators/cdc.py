"""Change-data capture: which fetched records are new, changed, unchanged or failed, and what that writes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from .numbering import numbered

OUTCOMES = ("created", "updated", "failed", "skipped")


def classify(fetched: DataFrame, stored: DataFrame, order: list[str | Column], entity: str | None = None) -> DataFrame:
    """fetched (entity_type, source_id, hash, ok, ...) with `outcome`, as if its records came one after another.

    A record that comes again in the same fetch meets what the one before it wrote: its hash, if the push was
    ok, and that it exists, if it was written at all (a skipped record writes nothing). ok tells whether the
    push succeeds; stored is the mapping. One shuffle by (entity_type, source_id) serves join and windows.
    """
    known = stored.select(
        "entity_type", "source_id", F.col("external_id").alias("_external"), F.col("last_hash").alias("_hash"), F.col("status").alias("_status")
    )
    earlier = Window.partitionBy("entity_type", "source_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    same = F.coalesce(F.col("hash") == F.col("_prev"), F.lit(False))
    return (
        fetched.join(known, ["entity_type", "source_id"], "left")
        .withColumn("_prev", F.coalesce(F.last(F.when(F.col("ok"), F.col("hash")), ignorenulls=True).over(earlier), F.when(F.col("_status") == "synced", S.truthy("_hash"))))
        .withColumn("_wrote", F.col("ok") & ~same)
        .withColumn("_exists", S.truthy("_external").isNotNull() | F.coalesce(F.max("_wrote").over(earlier), F.lit(False)))
        .withColumn("outcome", F.when(same, "skipped").when(~F.col("ok"), "failed").when(F.col("_exists"), "updated").otherwise("created"))
        .drop("_external", "_hash", "_status", "_prev", "_wrote", "_exists")
    )


#: The mapping, or a function that joins its columns to rows by their key, as State.looked_up does without shuffling it.
Stored = DataFrame | Callable[[DataFrame], DataFrame]


def _with_stored(rows: DataFrame, stored: Stored) -> DataFrame:
    return stored(rows) if callable(stored) else rows.join(stored, ["entity_type", "source_id"], "left")


def classify_spread(fetched: DataFrame, stored: Stored, position: str = "pos", rows: int = 1_000_000) -> DataFrame:
    """What classify gives, for fetches in which single records come millions of times.

    position, an integer that orders the whole fetch, is cut into blocks of `rows`. Within (record, block)
    windows do the work; what a block hands on, its last good hash and whether it wrote, is one row for each
    record and block, which is joined with the mapping, carried over the blocks and joined back. No task gets all rows of a record.
    """
    key = ["entity_type", "source_id"]
    block = [*key, "_block"]
    before = Window.partitionBy(*key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*block).orderBy(position).rowsBetween(Window.unboundedPreceding, -1)
    placed = fetched.withColumn("_block", F.floor(F.col(position) / rows))
    good = F.when(F.col("ok"), F.col("hash"))
    lasts = placed.groupBy(*block).agg(F.max_by(good, F.when(F.col("ok"), F.col(position))).alias("_last"))
    hashes = _with_stored(lasts, stored).select(
        *block, F.last("_last", ignorenulls=True).over(before).alias("_carried"), F.col("external_id").alias("_external"), F.when(F.col("status") == "synced", S.truthy("last_hash")).alias("_stored")
    )
    same = F.coalesce(F.col("hash") == F.col("_prev"), F.lit(False))
    written = (
        placed.join(hashes, block)
        .withColumn("_prev", F.coalesce(F.last(good, ignorenulls=True).over(earlier), "_carried", "_stored")).withColumn("_wrote", F.col("ok") & ~same)
    )
    wrote = written.groupBy(*block).agg(F.max("_wrote").alias("_any")).withColumn("_before", F.max("_any").over(before)).drop("_any")
    exists = S.truthy("_external").isNotNull() | F.coalesce("_before", F.lit(False)) | F.coalesce(F.max("_wrote").over(earlier), F.lit(False))
    return (
        written.join(wrote, block)
        .withColumn("outcome", F.when(same, "skipped").when(~F.col("ok"), "failed").when(exists, "updated").otherwise("created"))
        .drop("_block", "_carried", "_external", "_stored", "_prev", "_wrote", "_before")
    )


def _writes(outcomes: DataFrame, position: str | Column) -> DataFrame:
    """What the outcomes (with new_external_id) write: for each key how often, and the last hash and external id."""
    at = F.col(position) if isinstance(position, str) else position
    return (
        outcomes.where(F.col("outcome").isin("created", "updated")).groupBy("entity_type", "source_id")
        .agg(F.count(F.lit(1)).alias("_n"), F.max_by("hash", at).alias("_hash"), F.max_by(S.truthy("new_external_id"), F.when(S.truthy("new_external_id").isNotNull(), at)).alias("_new"))
    )


def _put(joined: DataFrame, now: Column) -> DataFrame:
    """Mapping rows joined with what is written to their keys, as they are afterwards."""
    touched = F.col("_n").isNotNull()
    external = F.when(touched, S.or_else("_new", "external_id", "source_id")).otherwise(F.col("external_id"))
    pick = lambda new, old: F.when(touched, new).otherwise(F.col(old))
    return joined.select(
        "entity_type", "source_id", external.alias("external_id"), F.when(touched, external).otherwise(F.col("target_guid")).alias("target_guid"),
        (F.coalesce("sync_version", F.lit(0)) + F.coalesce("_n", F.lit(0))).cast("int").alias("sync_version"),
        pick(F.col("_hash"), "last_hash").alias("last_hash"), pick(now, "last_synced_at").alias("last_synced_at"),
        pick(now, "last_sync").alias("last_sync"), pick(now, "last_attempt").alias("last_attempt"), pick(F.lit("synced"), "status").alias("status"),
    )


def merge_mapping(stored: DataFrame, outcomes: DataFrame, position: str | Column, now: Column) -> DataFrame:
    """The mapping after the outcomes (with new_external_id): one row for each key.

    A first write has version 1 and each later one adds 1; id, hash and times come from the last write. The
    external id is the pushed one, else the stored one, else the record's own.
    """
    return _put(stored.join(_writes(outcomes, position), ["entity_type", "source_id"], "full"), now)


def written_mapping(stored: Stored, outcomes: DataFrame, position: str | Column, now: Column) -> DataFrame:
    """Of the mapping after the outcomes the rows that they wrote, and no others."""
    return _put(_with_stored(_writes(outcomes, position), stored), now)


def unfolded(fetched: DataFrame) -> DataFrame:
    """The same rows, of which the optimizer cannot tell that they may all be of one entity.

    It would drop the constant from the keys of joins, and buckets by both columns would not fit any more.
    """
    return fetched.withColumn("entity_type", F.concat("entity_type", F.left(F.coalesce("source_id", F.lit("")), F.lit(0))))


def put_unhashed(stored: DataFrame, written: DataFrame, now: Column) -> DataFrame:
    """The mapping after writes (entity_type, source_id, new_external_id, pos) that know no hash, as older callers make them.

    Such rows keep no hash, so the next run sees them as changed and pushes them again.
    """
    outcomes = written.withColumns({"outcome": F.lit("created"), "hash": F.lit(None).cast("string")})
    return merge_mapping(stored, outcomes, "pos", now)


def history(outcomes: DataFrame, now: Column, order: list[str], first_id: int = 1) -> DataFrame:
    """A row for each record that was pushed or failed; skipped ones leave none."""
    rows = outcomes.where("outcome <> 'skipped'").select(
        "entity_type", "source_id", F.when(F.col("outcome") == "failed", F.lit(None).cast("string")).otherwise(S.or_else("new_external_id", "source_id")).alias("external_id"),
        F.when(F.col("outcome") == "failed", "failed").otherwise("synced").alias("status"),
        F.when(F.col("outcome") == "failed", S.sync_failed("entity_type", "source_id", "error")).alias("details"), *[c for c in order if c not in ("entity_type", "source_id")],
    )
    return numbered(rows, order, "id", first_id).select(
        "id", "entity_type", "source_id", "external_id", F.col("external_id").alias("target_guid"), "status", "details", now.alias("created_at")
    )


def dead_letters(outcomes: DataFrame, now: Column, order: list[str], first_id: int = 1) -> DataFrame:
    """A row for each failed record: its error cut to 1000 characters and its payload to 5000."""
    rows = outcomes.where("outcome = 'failed'").select(
        "entity_type", F.coalesce("source_id", F.lit("")).alias("source_id"),
        S.truncated(S.sync_failed("entity_type", "source_id", "error"), 1000).alias("error"),
        S.truncated(F.coalesce("payload", F.lit("")), 5000).alias("payload"), *[c for c in order if c not in ("entity_type", "source_id")],
    )
    return numbered(rows, order, "id", first_id).select("id", "entity_type", "source_id", "error", "payload", now.alias("created_at"))


def stats(outcomes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """processed and the four outcomes, counted in one aggregation."""
    return outcomes.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("processed"), *[F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES]
    )


def rollup(outcomes: DataFrame) -> DataFrame:
    """What a full sync reports: the counters of all entities, without the skipped ones."""
    return stats(outcomes).drop("skipped")


def batches(fetched: DataFrame, position: str = "pos", size: int = 100) -> DataFrame:
    """The slice of the fetch that each record belongs to; results never depend on it."""
    return fetched.withColumn("batch", F.floor(F.col(position) / size).cast("long"))
