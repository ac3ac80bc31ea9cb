"""Read-outs: dead letters, logs, backups and status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from . import jobs as J


def list_dead_letters(letters: DataFrame, entity: str | None = None, limit: int = 100) -> DataFrame:
    """The newest dead letters without their payload; no entity means all, a negative limit none."""
    rows = letters if not entity else letters.where(F.col("entity_type") == entity)
    rows = rows.select("id", "entity_type", "source_id", "error", "created_at").orderBy(F.desc("id"))
    return rows if limit < 0 else rows.limit(limit)


def log_line(timestamp: Column, level: Column, logger: Column, component: Column, message: Column, duration_ms: Column | None = None, metadata: Column | None = None, exception: Column | None = None) -> Column:
    """A log event as one JSON line; what is NULL is left out, and the logger's last part stands for a missing component."""
    part = F.coalesce(component, F.element_at(F.split(logger, r"\."), -1))
    fields = [S.stamp(timestamp).alias("timestamp"), level.alias("level"), logger.alias("logger"), part.alias("component"), message.alias("message")]
    fields += [c.alias(n) for c, n in ((duration_ms, "duration_ms"), (metadata, "metadata"), (exception, "exception")) if c is not None]
    return F.to_json(F.struct(*fields))


def log_tail(lines: DataFrame, order: str, n: int = 100) -> DataFrame:
    """The last n lines in their order. 0 is the whole log, and a negative n leaves out that many from its start."""
    if n == 0:
        return lines.orderBy(order)
    if n < 0:
        head = lines.orderBy(order).limit(-n).select(order)
        return lines.join(head, order, "left_anti").orderBy(order)
    return lines.orderBy(F.desc(order)).limit(n).orderBy(order)


def backups(files: DataFrame) -> DataFrame:
    """filename, size_bytes and created_at of files (path, length, modificationTime), the newest first."""
    return files.select(
        S.basename("path").alias("filename"), F.col("length").cast("long").alias("size_bytes"), S.stamp("modificationTime").alias("created_at")
    ).orderBy(F.desc("created_at"), "filename")


def expired_backups(files: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """Files that are more than so many days old."""
    return files.where(F.col("modificationTime") < now - F.make_interval(days=F.lit(days)))


def status(jobs: DataFrame, now: Column, source_ok: bool, target_ok: bool, running: bool, paused: bool, api_key: str | None, memory_mb: float | None = None, cpu_percent: float | None = None, machine: str | None = None, running_job: str = "Idle") -> DataFrame:
    """The system's state in one row. Resource figures that were not measured are NULL."""
    numbers = J.summary(jobs)
    return numbers.select(
        F.lit("active").alias("status"), F.lit(machine).alias("machine_name"), F.lit("1.0.0").alias("middleware_version"),
        F.struct(
            F.lit(source_ok).alias("source_status"), F.lit(target_ok).alias("target_status"),
            S.scheduler_state(F.lit(running), F.lit(paused)).alias("scheduler_status"),
            F.when(S.license_ok(F.lit(api_key).cast("string")), "valid").otherwise("invalid").alias("license_status"), F.lit(running_job).alias("running_job"),
        ).alias("system_health"),
        F.struct(*numbers.columns).alias("queue_metrics"),
        F.struct(F.lit(memory_mb).cast("double").alias("memory_usage_mb"), F.lit(cpu_percent).cast("double").alias("cpu_usage_percent")).alias("resource_metrics"),
        S.stamp(now).alias("timestamp"),
    )
