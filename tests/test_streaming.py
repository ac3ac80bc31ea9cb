"""Batches of a stream leave the store as one batch does, whatever happens between them."""

import contextlib

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F
from test_cdc import FETCHED, fixture, now

from tidemark.operators import cdc
from tidemark.plans.state import Conflict, State
from tidemark.plans.sync import Store, sync
from tidemark.schemas import MAPPING
from tidemark.streaming import cdc_stream, events


def stream_of(spark, rows, folder):
    """The rows as a stream of four batches."""
    for i in range(4):
        rows.where(f"pos between {i * 50} and {i * 50 + 49}").coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def run(stream, store, checkpoint):
    query = cdc_stream.sync_stream(stream, store, "records", checkpoint, now)
    with contextlib.suppress(StreamingQueryException):
        query.awaitTermination(300)
    return query.exception()


def contents(store):
    """Rows of the three tables; ids follow the batches, so they count only as a set."""
    key = ["source_id", "external_id", "sync_version", "last_hash", "status"]
    rows = [sorted(map(tuple, store.mapping.read().select(key).collect()), key=str)]
    for table, columns in ((store.history, ["source_id", "external_id", "status", "details"]), (store.dead_letters, ["source_id", "error", "payload"])):
        rows.append(sorted(map(tuple, table.read().select(columns).collect()), key=str))
        ids = sorted(r.id for r in table.read().select("id").collect())
        assert ids == list(range(1, len(ids) + 1))
    return rows


class Breaking(State):
    """A state whose changes break off at the nth thing that they write, and before whose versions another writer comes."""

    breaks, intrudes, writes = None, 0, 0

    def _write(self, name, rows):
        if name in ("mapping", "history", "dead_letters", "runs") and self.schemas:
            self.writes += 1
            if self.writes == self.breaks:
                raise RuntimeError("broken off")
        return super()._write(name, rows)

    def _publish(self, version, known):
        if self.intrudes:
            self.intrudes -= 1
            State(self.spark, self.path, {}).change(notes={"other": self.intrudes})
        super()._publish(version, known)
        self.writes += 1
        if self.writes == self.breaks:
            raise RuntimeError("broken off after the version")


@pytest.fixture(scope="module")
def records(spark, tmp_path_factory):
    rows = spark.createDataFrame([tuple(r.values()) for r in fixture(3)[0]], FETCHED)
    folder = str(tmp_path_factory.mktemp("in"))
    plain = Store.at(spark, str(tmp_path_factory.mktemp("plain")))
    sync(rows, plain, now())
    return rows, stream_of(spark, rows, folder), contents(plain)


def test_same_as_one_batch(records, spark, tmp_path):
    """Also with another writer before each version."""
    _, stream, want = records
    store = Store.at(spark, str(tmp_path / "s"))
    store.state.__class__ = Breaking
    store.state.intrudes = 2
    assert run(stream, store, str(tmp_path / "c")) is None
    assert contents(store) == want and store.state.notes()["batch/records"] == 3 and store.state.notes()["other"] == 0
    runs = store.runs.read().orderBy("batch_id").collect()
    assert [r.batch_id for r in runs] == [0, 1, 2, 3] and sum(r.processed for r in runs) == 200 and all(r.duration_ms > 0 for r in runs)


@pytest.mark.parametrize("at", [3, 5])
def test_killed_between_any_two_writes(records, spark, tmp_path, at):
    """A run that breaks off at its nth write, then another writer, then the run again."""
    _, stream, want = records
    store = Store.at(spark, str(tmp_path / "s"))
    store.state.__class__ = Breaking
    store.state.breaks = at
    assert run(stream, store, str(tmp_path / "c")) is not None
    store.state.breaks = None
    store.state.change(notes={"someone": "else"})
    store.state.intrudes = 1
    assert run(stream, store, str(tmp_path / "c")) is None
    assert contents(store) == want and store.state.notes()["someone"] == "else"


def test_only_one_of_two_changes_succeeds(spark, tmp_path):
    one, two = (State(spark, str(tmp_path), {"t": "a BIGINT"}) for _ in range(2))
    rows = spark.range(3).withColumnRenamed("id", "a")
    one.change(written={"t": rows}, version=0)
    with pytest.raises(Conflict):
        two.change(written={"t": rows.limit(1)}, version=0)
    assert two.current() == 1 and two.read("t").count() == 3


def test_windowed_counts(spark, tmp_path):
    jobs = spark.range(20).select(F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,id*10)").cast("timestamp").alias("updated_at"), F.lit("Failed").alias("status"))
    jobs.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(jobs.schema).parquet(str(tmp_path / "in"))
    query = events.status_counts(stream).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert spark.table("counts").agg(F.sum("n")).first()[0] == 20


def test_written_rows_are_the_merged_ones(spark):
    """written_mapping gives those rows of merge_mapping that the outcomes touch."""
    records, _ = fixture(4)
    rows, empty = spark.createDataFrame([tuple(r.values()) for r in records], FETCHED), spark.createDataFrame([], MAPPING)
    first = cdc.merge_mapping(empty, cdc.classify(rows.where("pos < 100"), empty, ["pos"]), "pos", now())
    outcomes = cdc.classify(rows.where("pos >= 100"), first, ["pos"])
    touched = outcomes.where("outcome in ('created', 'updated')").select("entity_type", "source_id").distinct()
    want = cdc.merge_mapping(first, outcomes, "pos", now()).join(touched, ["entity_type", "source_id"], "left_semi")
    got = cdc.written_mapping(first, outcomes, "pos", now())
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.select(*got.columns).collect()), key=str)
