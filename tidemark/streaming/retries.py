"""Jobs that wait and are tried again, as timers of keyed state."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import jobs as J

#: What comes in: a new job has no ok, the result of a run has one; at is when it happened.
EVENTS = "id long, entity_type string, payload string, max_attempts int, ok boolean, error string, kind string, code int, at timestamp"
#: What goes out: a job's state as it changes. Running is the call to run it.
CHANGES = "id long, entity_type string, payload string, status string, attempts int, error_message string, scheduled_at timestamp, at timestamp"


class RetryProcessor(StatefulProcessor):
    """One job's life: run at once, completed, or waiting for a timer before it runs again, or failed.

    The rules (what is worth another attempt, and how long to wait) come with the rows, so that they are those of
    jobs.transition. A job that has ended is forgotten; a result of a job that is not running changes nothing, so that
    a result that comes twice counts once.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "entity_type string, payload string, status string, attempts int, max_attempts int, error_message string")

    @staticmethod
    def change(key, job: tuple, at_ms: int, due_ms: int | None = None) -> Row:
        import datetime as dt

        stamp = lambda ms: None if ms is None else dt.datetime.fromtimestamp(ms / 1000)
        return Row(id=key[0], entity_type=job[0], payload=job[1], status=job[2], attempts=job[3], error_message=job[5], scheduled_at=stamp(due_ms), at=stamp(at_ms))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        job = self.job.get() if self.job.exists() else None
        for r in sorted(rows, key=lambda r: (r["at_ms"], r["ok"] is not None)):
            now = r["at_ms"] if self.event_time else timerValues.getCurrentProcessingTimeInMs()
            if r["ok"] is None:
                if job is None:
                    job = (r["entity_type"], r["payload"], "Running", 0, r["max_attempts"], None)
                    yield self.change(key, job, now)
                continue
            if job is None or job[2] != "Running":
                continue
            attempt = job[3] + 1
            delays = r["delays"]
            delay = delays[attempt - 1] if attempt <= len(delays) else None
            if r["ok"]:
                job = (*job[:2], "Completed", job[3], job[4], None)
            elif r["again"] and delay is not None and attempt < job[4]:
                job = (*job[:2], "Waiting", attempt, job[4], (r["error"] or "")[:1000])
                self.handle.registerTimer(now + 1000 * delay)
                yield self.change(key, job, now, now + 1000 * delay)
                continue
            else:
                job = (*job[:2], "Failed", attempt, job[4], (r["error"] or "")[:1000])
            yield self.change(key, job, now)
        self._keep(job)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        job = self.job.get()
        if job is not None and job[2] == "Waiting":
            job = (*job[:2], "Running", *job[3:])
            self._keep(job)
            yield self.change(key, job, expiredTimerInfo.getExpiryTimeInMs())

    def _keep(self, job: tuple | None) -> None:
        if job is not None and job[2] in ("Running", "Waiting"):
            self.job.update(tuple(job))
        else:
            self.job.clear()

    def __init__(self, event_time: bool):
        self.event_time = event_time

    def close(self) -> None:
        pass


def job_changes(events: DataFrame, late: str | None = None, delays: tuple[int, ...] = J.BACKOFF_SECONDS) -> DataFrame:
    """The changes (CHANGES) of jobs whose events (EVENTS) stream in: each waiting job runs again when its delay is over.

    Timers go by the machine's clock. With late, they go by the events' own: a timer fires once all events come later than
    it by more than that, so that a stream that is played again gives the same. Call keyed_state.prepare() first.
    """
    rows = events.select(
        "id", "entity_type", "payload", F.coalesce("max_attempts", F.lit(J.MAX_ATTEMPTS)).alias("max_attempts"), "ok", "error",
        F.coalesce(J.retryable(F.col("kind"), F.col("code")), F.lit(False)).alias("again"), F.unix_millis("at").alias("at_ms"), F.array(*[F.lit(d) for d in delays]).alias("delays"), "at",
    )
    if late is None:
        return rows.drop("at").groupBy("id").transformWithState(RetryProcessor(False), CHANGES, "Append", "ProcessingTime")
    return rows.withWatermark("at", late).groupBy("id").transformWithState(RetryProcessor(True), CHANGES, "Append", "EventTime")
