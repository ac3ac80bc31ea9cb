"""Workers and the scheduler as streaming queries over ticks: starting, stopping and pausing them is starting and stopping queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import jobs as J
from ..plans.queue import Queue


def utc_now() -> Column:
    return F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()).cast("timestamp_ntz")


def ticks(spark: SparkSession, act: Callable[[], None], every: str, checkpoint: str, name: str | None = None) -> StreamingQuery:
    """A query that acts at each tick; the next tick waits until it is done. An error ends it, as it would end any query."""
    source = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    writer = source.writeStream.foreachBatch(lambda batch, number: act()).option("checkpointLocation", checkpoint).trigger(processingTime=every)
    return (writer.queryName(name) if name else writer).start()


def work(queue: Queue, run: Callable[[DataFrame], DataFrame], now: Callable[[], Column] = utc_now, most: int = 1000) -> DataFrame | None:
    """Claim due jobs, run them all as one Spark job, and store what became of each. None where nothing was due.

    run makes results (id, ok, error, kind, code) of claimed jobs; should it raise, they all fail with its error, by the
    rules for an unknown one.
    """
    claimed = queue.claim(now(), most)
    if claimed is None or claimed.isEmpty():
        return None
    try:
        results = run(claimed).select("id", "ok", "error", "kind", F.col("code").cast("int").alias("code"))
        return queue.finish(claimed, results, now())
    except Exception as e:  # noqa: BLE001  the jobs must not stay running
        failed = claimed.select("id", F.lit(False).alias("ok"), F.lit(str(e)[:1000]).alias("error"), F.lit("other").alias("kind"), F.lit(None).cast("int").alias("code"))
        return queue.finish(claimed, failed, now())


def worker(queue: Queue, run: Callable[[DataFrame], DataFrame], checkpoint: str, every: str = "1 second", now: Callable[[], Column] = utc_now, most: int = 1000, name: str | None = None) -> StreamingQuery:
    """A worker: a query that looks for due jobs at each tick. Any number of them, in any number of applications, may share a queue."""
    return ticks(queue.state.spark, lambda: work(queue, run, now, most), every, checkpoint, name)


class Scheduler:
    """Enqueues all entities at an interval, while it is on and the settings say so."""

    def __init__(self, queue: Queue, checkpoint: str, enabled: Callable[[], bool] = lambda: True, now: Callable[[], Column] = utc_now, unit: str = "minutes"):
        self.queue, self.checkpoint, self.enabled, self.now, self.unit = queue, checkpoint, enabled, now, unit
        self.interval, self._query, self._paused = 10, None, False

    def tick(self) -> int:
        """How many jobs are new."""
        return self.queue.enqueue(J.all_entities(self.queue.state.spark), self.now()).count() if self.enabled() else 0

    def start(self, interval: int = 10) -> None:
        """Does nothing while it runs, whatever the interval."""
        if self.state() == "stopped":
            self.interval = max(1, interval)
            self._resume()

    def _resume(self) -> None:
        self._paused, self._query = False, ticks(self.queue.state.spark, self.tick, f"{self.interval} {self.unit}", self.checkpoint)

    def _halt(self) -> None:
        if self._query is not None:
            self._query.stop()
            self._query = None

    def stop(self) -> None:
        self._halt()
        self._paused = False

    def pause(self) -> None:
        if self.state() == "active":
            self._halt()
            self._paused = True

    def resume(self) -> None:
        if self.state() == "paused":
            self._resume()

    def update_interval(self, interval: int) -> None:
        """The new interval holds at once where it runs, else from the next start or resume on."""
        self.interval = max(1, interval)
        if self.state() == "active":
            self._halt()
            self._resume()

    def state(self) -> str:
        """stopped, paused or active."""
        return "paused" if self._paused else "active" if self._query is not None and self._query.isActive else "stopped"

    def trigger(self, entity: str | None = None) -> int:
        """Enqueue one entity, or all, with priority now; how many jobs are new."""
        spark = self.queue.state.spark
        wanted = spark.createDataFrame([(entity, None)], "entity_type string, payload string") if entity else J.all_entities(spark)
        return self.queue.enqueue(wanted, self.now(), priority=True).count()
