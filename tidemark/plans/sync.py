"""One entity's sync from fetch to state, and a full sync of all."""

from __future__ import annotations

import datetime as dt
import functools
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import cdc
from ..schemas import ALIASES, DEAD_LETTERS, ENTITY_ORDER, HISTORY, MAPPING, RUNS
from ..storage import store as cut
from .state import Conflict, Keyed, State

COUNTERS = "entity_type string, processed long, created long, updated long, failed long, skipped long"
#: How often a sync starts again because another change came first.
TRIES = 10


class Store:
    """The tables that a sync reads and writes; one version covers them all."""

    def __init__(self, state: State):
        self.state = state
        self.mapping, self.history, self.dead_letters, self.runs = (state.table(name) for name in ("mapping", "history", "dead_letters", "runs"))

    @classmethod
    def at(cls, spark, path: str, buckets: int = 16) -> Store:
        """The store in a folder. New mapping rows are put into so many buckets by their key; what is there keeps its own."""
        tables = {"mapping": MAPPING, "history": HISTORY, "dead_letters": DEAD_LETTERS, "runs": RUNS}
        return cls(State(spark, path, tables, {"mapping": Keyed(("entity_type", "source_id"), buckets)}))


def sync(fetched: DataFrame, store: Store, now: Column, order: str = "pos", batch: tuple[str, int] | None = None) -> DataFrame:
    """Apply fetched records (with the outcomes of their pushes) to the store; returns the counters by entity.

    fetched must give the same rows whenever it is read: push first, write, and pass what was written. Mapping,
    history, dead letters and the run's own row (counters and milliseconds) change in one version, so a run that breaks
    off has changed nothing and is simply done again; and if another change comes first, it is classified anew against that.
    The last ids are noted with the version, so that no table is read for them.

    batch is the name of a stream and the number of its micro-batch. The version notes it, and a batch that is noted, as
    after a restart, changes nothing and gives no counters. order is an integer that orders the fetch; a record that comes
    millions of times is spread over tasks by it (cdc.classify_spread). The mapping gets the written keys' rows only.
    """
    began = time.monotonic()
    for _ in range(TRIES):
        version = store.state.current()
        notes = store.state.notes(version)
        if batch and notes.get(f"batch/{batch[0]}", -1) >= batch[1]:
            return fetched.sparkSession.createDataFrame([], COUNTERS)
        stored = functools.partial(store.state.looked_up, "mapping", version=version)
        outcomes = cut(cdc.classify_spread(cdc.unfolded(fetched), stored, order))  # written once, used for all tables
        counters = cdc.stats(outcomes, ["entity_type"]).orderBy("entity_type").collect()
        lines, letters = (notes.get(name, 0) for name in ("history", "dead_letters"))
        by = [order, "entity_type", "source_id"]
        try:
            store.state.change(
                version=version,
                merged={"mapping": cdc.written_mapping(stored, outcomes, order, now)},
                appended={
                    "history": cdc.history(outcomes, now, by, lines + 1), "dead_letters": cdc.dead_letters(outcomes, now, by, letters + 1),
                    "runs": _runs(fetched.sparkSession, counters, version + 1, began, batch),
                },
                notes={
                    "history": lines + sum(r.created + r.updated + r.failed for r in counters), "dead_letters": letters + sum(r.failed for r in counters),
                    **({f"batch/{batch[0]}": batch[1]} if batch else {}),
                },
            )
        except Conflict:
            continue
        return fetched.sparkSession.createDataFrame(counters, COUNTERS)
    raise Conflict(f"other changes came first {TRIES} times")


def _runs(spark, counters: list, version: int, began: float, batch: tuple[str, int] | None) -> DataFrame:
    """The run's rows for the table of runs: counters by entity, when it was written and how long it took until then."""
    took, at = (time.monotonic() - began) * 1000, dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    rows = [(version, batch and batch[0], batch and batch[1], *r, took, at) for r in map(tuple, counters)]
    return spark.createDataFrame(rows, RUNS)


def execute(name: str, fetch: Callable[[str], DataFrame], store: Store, now: Column) -> DataFrame:
    """Sync the entity that a job's name stands for; any other name syncs all, in order, until a fetch fails."""
    entity = ALIASES.get(name.lower())
    if entity:
        return sync(fetch(entity), store, now).drop("entity_type")
    done = None
    for each in ENTITY_ORDER:
        counters = sync(fetch(each), store, now)
        done = counters if done is None else done.unionByName(counters)
    return done.agg(*[F.sum(c).cast("long").alias(c) for c in ("processed", "created", "updated", "failed")])
