"""Continuous sync: micro-batches of records go into mapping, history and dead letters as they come."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans.sync import Store, sync
from ..storage import store as cut


def sync_stream(
    records: DataFrame, store: Store, name: str, checkpoint: str, now: Callable[[], Column], order: str = "pos",
    push: Callable[[DataFrame], DataFrame] | None = None, trigger: dict | None = None,
) -> StreamingQuery:
    """Start a query that syncs each micro-batch of records with the store.

    A batch may come again after a failure. Its number is part of the version that it makes, together with its rows of
    the mapping, the history and the dead letters, so each batch changes the store once and wholly, whatever else writes to it
    meanwhile; name tells streams of one store apart and must stay the same over restarts. push, where the records have no
    outcomes yet, adds them (ok, error, new_external_id); it may see a batch again, unless it keeps a ledger (sinks.push_once).
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        if store.state.notes().get(f"batch/{name}", -1) < batch_id:
            sync(batch if push is None else cut(push(batch)), store, now(), order, batch=(name, batch_id))

    return records.writeStream.queryName(name).foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
