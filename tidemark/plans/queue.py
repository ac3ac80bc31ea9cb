"""The job queue as a stored table: workers claim by changing its version, so that no job is taken twice."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import jobs as J
from ..schemas import JOBS
from ..storage import store as cut
from .state import Conflict, Keyed, State

#: How often a change starts again because another one came first.
TRIES = 50


class Queue:
    """Jobs by id, in one table of a state. Every change writes the rows that it changes, and holds only if no other came first."""

    def __init__(self, state: State):
        self.state = state

    @classmethod
    def at(cls, spark: SparkSession, path: str, buckets: int = 8) -> Queue:
        return cls(State(spark, path, {"jobs": JOBS}, {"jobs": Keyed(("id",), buckets)}))

    def read(self, version: int | None = None) -> DataFrame:
        return self.state.read("jobs", version)

    def _change(self, rows_of: Callable[[DataFrame, dict], tuple[DataFrame | None, dict]]) -> DataFrame | None:
        """Merge the rows that a function makes of the jobs and notes; again, of newer ones, where another change came first."""
        for _ in range(TRIES):
            version = self.state.current()
            rows, notes = rows_of(self.read(version), self.state.notes(version))
            if rows is None:
                return None
            rows = cut(rows)  # the same rows are written and returned
            if rows.isEmpty():
                return rows
            try:
                self.state.change(merged={"jobs": rows}, notes={**notes, "last_id": notes.get("last_id", 0)}, version=version)
            except Conflict:
                continue
            return rows
        raise Conflict(f"other changes came first {TRIES} times")

    def enqueue(self, requests: DataFrame, now: Column, priority: bool = False) -> DataFrame:
        """New jobs of requests (entity_type, payload), one for each entity without an active one; returned as they are stored."""

        def fresh(jobs: DataFrame, notes: dict) -> tuple[DataFrame, dict]:
            last = notes.get("last_id", 0)
            rows = cut(J.enqueue(jobs, requests, now, priority, last + 1))
            return rows, {"last_id": last + rows.count()}

        return self._change(fresh)

    def claim(self, now: Column, most: int = 1000) -> DataFrame:
        """Up to `most` due jobs of least id, which are running from now on; returned as they were before, but for that."""

        def running(jobs: DataFrame, notes: dict) -> tuple[DataFrame, dict]:
            due = J.eligible(jobs, now).orderBy("id").limit(most)
            return due.withColumns({"status": F.lit("Running"), "updated_at": now}), notes

        return self._change(running)

    def finish(self, claimed: DataFrame, results: DataFrame, now: Column) -> DataFrame:
        """Claimed jobs after their results (id, ok, error, kind, code): completed, waiting or failed. Only their worker changes them."""
        rows = cut(J.transition(claimed.join(results, "id"), now))
        return self._change(lambda jobs, notes: (rows, notes))

    def requeue_failed(self, now: Column) -> DataFrame:
        """The newest failed job of each entity without an active one, pending again."""
        return self._change(lambda jobs, notes: (J.requeue_failed(jobs, now).join(J.requeued(jobs).select("id"), "id", "left_semi"), notes))

    def reset_stale(self, now: Column, seconds: int) -> DataFrame:
        """Jobs that have been running for so long that their worker must be gone, pending again."""
        stale = (F.col("status") == "Running") & (F.col("updated_at") < now - F.make_interval(secs=F.lit(seconds)))
        return self._change(lambda jobs, notes: (J.reset_stale(jobs.where(stale), now, seconds), notes))
