"""The mapping as keyed state of an endless stream: one entry for each record's key, kept in RocksDB.

Beside micro-batches that are merged into a stored mapping (cdc_stream), a stream can hold the mapping itself. It starts from
a stored one, classifies each record as it comes, and can be read back as a table at any time from its checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

KEY = ["entity_type", "source_id"]
OUTCOMES = "entity_type string, source_id string, pos long, outcome string, external_id string, sync_version int, last_hash string"
#: Settings that keyed state needs, and that hold from a checkpoint's first batch on. Avro lets later versions add fields.
SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.encodingFormat": "avro",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def prepare(spark: SparkSession) -> None:
    """Settings for keyed state, for the queries that this session starts from now on."""
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)


class MappingProcessor(StatefulProcessor):
    """One key's mapping row (a value), and how often each outcome came for it (a map).

    The rules are those of cdc.classify: a record with the hash that was last written is skipped; one whose push failed
    leaves the row as it is; any other is created, or updated where an external id is known.
    """

    FIELDS = "external_id string, sync_version int, last_hash string, status string"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.row = handle.getValueState("mapping", self.FIELDS)
        self.counts = handle.getMapState("outcomes", "outcome string", "n long")

    def put(self, external_id, version, hash_, status, record: Row | None) -> None:
        """Keep a row; record is the one that wrote it, if any. For processors with more fields to override."""
        self.row.update((external_id, version, hash_, status))

    def handleInitialState(self, key, initialState, timerValues) -> None:  # noqa: N802, N803
        self.put(initialState["external_id"], initialState["sync_version"], initialState["last_hash"], initialState["status"], None)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        external, version, hash_, status = (self.row.get() or (None, 0, None, None))[:4]
        found: dict[str, int] = {}
        for r in sorted(rows, key=lambda r: r["pos"]):
            same = status == "synced" and bool(hash_) and hash_ == r["hash"]
            outcome = "skipped" if same else "failed" if not r["ok"] else "updated" if external else "created"
            if outcome in ("created", "updated"):
                external, version, hash_, status = r["new_external_id"] or external or key[1], (version or 0) + 1, r["hash"], "synced"
                self.put(external, version, hash_, status, r)
            found[outcome] = found.get(outcome, 0) + 1
            yield Row(entity_type=key[0], source_id=key[1], pos=r["pos"], outcome=outcome, external_id=external, sync_version=version, last_hash=hash_)
        for outcome, n in found.items():
            before = self.counts.getValue((outcome,))
            self.counts.updateValue((outcome,), ((before[0] if before else 0) + n,))

    def close(self) -> None:
        pass


def outcomes(records: DataFrame, stored: DataFrame | None = None, processor: StatefulProcessor | None = None) -> DataFrame:
    """Outcomes of a stream of records (entity_type, source_id, pos, hash, ok, new_external_id), and the mapping row after each.

    stored is the mapping that the first batch starts from; later batches go on from the checkpoint. The records of one key and
    batch are put in the order of pos, so a batch's records of one key must fit a task. Nothing expires: a key that is forgotten would
    be created again. Call prepare() first.
    """
    grouped = records.select(*KEY, "pos", "hash", "ok", "new_external_id").groupBy(*KEY)
    initial = None if stored is None else stored.select(*KEY, "external_id", "sync_version", "last_hash", "status").groupBy(*KEY)
    return grouped.transformWithState(processor or MappingProcessor(), OUTCOMES, "Append", "None", initial)


def mapping_in(spark: SparkSession, checkpoint: str, batch: int | None = None) -> DataFrame:
    """The mapping that a stream's state holds after a batch (the last one): key, external_id, sync_version, last_hash, status and more fields."""
    reader = spark.read.format("statestore").option("stateVarName", "mapping")
    state = (reader if batch is None else reader.option("batchId", batch)).load(checkpoint)
    return state.select(*[F.col(f"key.{k}").alias(k) for k in KEY], "value.*")


def outcome_counts(spark: SparkSession, checkpoint: str) -> DataFrame:
    """How often each outcome came for each key: entity_type, source_id, outcome, n."""
    state = spark.read.format("statestore").option("stateVarName", "outcomes").load(checkpoint)
    return state.select(*[F.col(f"key.{k}").alias(k) for k in KEY], F.col("user_map_key.outcome").alias("outcome"), F.col("user_map_value.n").alias("n"))
