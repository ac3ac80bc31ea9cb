"""What the service offers, as functions from tables to tables: one for each of its routes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession

from .operators import jobs, lookups, reports, sinks
from .plans import backup, config
from .plans.state import State
from .plans.sync import Store, execute, sync
from .sources import files, rest, tail
from .streaming.worker import Scheduler

__all__ = [
    "clear_dead_letters", "download_log", "get_config", "list_backups", "list_dead_letters", "list_queue", "pause", "queue_metrics", "resume", "retry_failed",
    "run_job", "save_config", "start", "status", "stop", "sync_entity", "tail_logs", "test_source", "test_target", "trigger", "trigger_backup",
]


def test_source(base: str, key: str | None = None) -> bool:
    return rest.source_alive(base, key)


def test_target(base: str, key: str | None = None, kind: str | None = None) -> bool:
    return sinks.connector(kind, base, key).health_check()


def sync_entity(fetched: DataFrame, store: Store, now: Column) -> DataFrame:
    """Counters of one entity's sync; the queue is not involved."""
    return sync(fetched, store, now)


run_job = execute


def list_dead_letters(letters: DataFrame, entity: str | None = None, limit: int = 50) -> DataFrame:
    return reports.list_dead_letters(letters, entity, limit)


def clear_dead_letters(letters: DataFrame, entity: str | None = None) -> tuple[DataFrame, DataFrame]:
    return lookups.clear_dead_letters(letters, entity)


def queue_metrics(queue: DataFrame) -> DataFrame:
    return jobs.metrics(queue)


def list_queue(queue: DataFrame, limit: int = 50) -> DataFrame:
    return jobs.recent(queue, limit)


def retry_failed(queue: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(the queue after requeueing, what was requeued)."""
    return jobs.requeue_failed(queue, now), jobs.requeued(queue)


def trigger(queue: DataFrame, now: Column, entity: str | None = None, first_id: int = 1) -> DataFrame:
    """New jobs with priority, of one entity or of all."""
    spark = queue.sparkSession
    wanted = spark.createDataFrame([(entity, None)], "entity_type string, payload string") if entity else jobs.all_entities(spark)
    return jobs.enqueue(queue, wanted, now, priority=True, first_id=first_id)


status = reports.status


def get_config(spark: SparkSession, path: str) -> config.Config:
    """The stored settings, or the defaults."""
    return config.current(spark, path)


def save_config(spark: SparkSession, path: str, settings: config.Config, scheduler: Scheduler | None = None) -> config.Config:
    """Store settings; a scheduler starts with them (a running one goes on as it is), or stops where auto-sync is off."""
    config.save(spark, path, settings)
    if scheduler is not None:
        scheduler.start(settings.interval()) if settings.auto_sync_enabled else scheduler.stop()
    return settings


def start(scheduler: Scheduler, settings: config.Config) -> str:
    """Start the scheduler with the settings' interval; its state."""
    scheduler.start(settings.interval())
    return scheduler.state()


def stop(scheduler: Scheduler) -> str:
    scheduler.stop()
    return scheduler.state()


def pause(scheduler: Scheduler) -> str:
    scheduler.pause()
    return scheduler.state()


def resume(scheduler: Scheduler) -> str:
    scheduler.resume()
    return scheduler.state()


def tail_logs(spark: SparkSession, folder: str, n: int = 100) -> DataFrame:
    """The last n lines of the log's files."""
    return tail.tail(spark, folder, n)


def download_log(spark: SparkSession, folder: str) -> str | None:
    """Where the log can be fetched; None where there is none."""
    return files.log_path(spark, folder)


def trigger_backup(state: State, folder: str, now: Column, settings: config.Config | None = None) -> str:
    """Back a state and its settings up; backups of over 30 days go."""
    return backup.take(state, folder, now, settings)


def list_backups(spark: SparkSession, folder: str) -> DataFrame:
    return backup.listed(spark, folder)
