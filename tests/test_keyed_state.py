"""State that streams hold: the mapping, and jobs that wait."""

import contextlib
import datetime as dt
import random
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F
from test_cdc import FETCHED, fixture, now, one_by_one

from tidemark.operators import cdc, jobs
from tidemark.schemas import MAPPING
from tidemark.streaming import keyed_state, retries


@pytest.fixture(autouse=True)
def settings(spark):
    before = {k: spark.conf.get(k, None) for k in [*keyed_state.SETTINGS, "spark.sql.shuffle.partitions"]}
    keyed_state.prepare(spark)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    for k, v in before.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


class WithPlace(keyed_state.MappingProcessor):
    """A later version of the processor, which also knows where a row was written."""

    FIELDS = keyed_state.MappingProcessor.FIELDS + ", last_pos long"

    def put(self, external_id, version, hash_, status, record):
        self.row.update((external_id, version, hash_, status, record["pos"] if record else None))


def test_mapping_over_restarts(spark, tmp_path):
    """Random batches over three runs from a stored mapping, the last by a processor with another field, against the batch form and a loop."""
    records, stored = fixture(5)
    rows = spark.createDataFrame([tuple(r.values()) for r in records], FETCHED)
    mapping = spark.createDataFrame([("customer", k, v["external_id"], None, v["sync_version"], v["last_hash"], None, None, None, v["status"]) for k, v in stored.items()], MAPPING)
    rng, at, bounds = random.Random(1), 0, []
    while at < 200:
        bounds.append((at, at := min(200, at + rng.randint(20, 60))))
    source = str(tmp_path / "in")
    third = max(1, len(bounds) // 3)
    for run in range(3):
        for low, high in bounds[run * third : (run + 1) * third if run < 2 else None]:
            rows.where(f"pos >= {low} and pos < {high}").coalesce(1).write.mode("append").parquet(source)
            stream = spark.readStream.schema(rows.schema).parquet(source)
            found = keyed_state.outcomes(stream, mapping, WithPlace() if run == 2 else None)
            query = found.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
            query.awaitTermination(300)
            assert query.exception() is None
    want = [r.outcome for r in cdc.classify(rows, mapping, ["pos"]).orderBy("pos").collect()]
    assert [r.outcome for r in spark.read.parquet(str(tmp_path / "out")).orderBy("pos").collect()] == want == one_by_one(records, stored)[0]
    after = {r.source_id: r for r in keyed_state.mapping_in(spark, str(tmp_path / "c")).collect()}
    merged = {r.source_id: r for r in cdc.merge_mapping(mapping, cdc.classify(rows, mapping, ["pos"]), "pos", now()).collect()}
    assert {k: (r.external_id, r.sync_version, r.last_hash, r.status) for k, r in after.items()} == {k: (r.external_id, r.sync_version, r.last_hash, r.status) for k, r in merged.items()}
    assert any(r.last_pos is not None for r in after.values())
    counts = keyed_state.outcome_counts(spark, str(tmp_path / "c")).groupBy("outcome").agg(F.sum("n").alias("n")).collect()
    assert {r.outcome: r.n for r in counts} == {o: want.count(o) for o in set(want)}


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import the tests
START = dt.datetime(2024, 1, 1)


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


def event(i, seconds, ok=None, kind=None, code=None, most=3):
    return (i, f"e{i}", "{}", most, ok, None if ok is not False else f"error at {seconds}", kind, code, at(seconds))


def test_waits_and_runs_again(spark, tmp_path):
    """On the events' clock: 300 s after the first failure, 900 s after the second, then the end; as jobs.transition says."""
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    batches = [
        [event(1, 0), event(2, 0), event(3, 0), event(4, 1)],
        [event(1, 10, False, "timeout"), event(2, 10, True), event(3, 10, False, "http", 404), event(4, 12, False, "http", 503)],
        [event(1, 15, False, "timeout")],  # the same result again: the job waits, and it counts once
        [event(9, 320)],
        [event(1, 330, False, "http", 500), event(4, 331, True)],
        [event(9, 1215)],
        [event(9, 1240)],
        [event(1, 1250, False, "timeout")],
        [event(9, 9000)],
    ]
    for batch in batches:
        spark.createDataFrame(batch, retries.EVENTS).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(retries.EVENTS).parquet(source)
        query = retries.job_changes(stream, late="0 seconds").writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination(300)
        assert query.exception() is None
    seen = {i: [] for i in (1, 2, 3, 4)}
    for r in spark.read.parquet(out).orderBy("at").collect():
        if r.id in seen:
            seen[r.id].append((r.status, r.attempts, (r.at - START).seconds, r.scheduled_at and (r.scheduled_at - START).seconds))
    assert seen[1] == [("Running", 0, 0, None), ("Waiting", 1, 10, 310), ("Running", 1, 310, None), ("Waiting", 2, 330, 1230), ("Running", 2, 1230, None), ("Failed", 3, 1250, None)]
    assert seen[2] == [("Running", 0, 0, None), ("Completed", 0, 10, None)]
    assert seen[3] == [("Running", 0, 0, None), ("Failed", 1, 10, None)]
    assert seen[4] == [("Running", 0, 1, None), ("Waiting", 1, 12, 312), ("Running", 1, 312, None), ("Completed", 1, 331, None)]
    # each result against the batch rule
    for attempts, kind, code, when, status, due in ((0, "timeout", None, 10, "Waiting", 310), (1, "http", 500, 330, "Waiting", 1230), (2, "timeout", None, 1250, "Failed", None)):
        run = spark.createDataFrame([(1, attempts, 3, None, False, "e", kind, code)], "id long, attempts int, max_attempts int, scheduled_at timestamp_ntz, ok boolean, error string, kind string, code int")
        got = jobs.transition(run, F.lit(at(when)).cast("timestamp_ntz")).first()
        assert (got.status, got.scheduled_at and (got.scheduled_at - START).seconds) == (status, due)


def test_by_the_machines_clock(spark, tmp_path):
    """The same with delays of a second: nothing but time passes between the runs."""
    source = str(tmp_path / "in")
    spark.createDataFrame([event(1, 0), event(1, 1, False, "timeout")], retries.EVENTS).coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(retries.EVENTS).parquet(source)
    query = retries.job_changes(stream, delays=(1, 1)).writeStream.format("memory").queryName("by_clock").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="1 second").start()
    with contextlib.closing(query) if hasattr(query, "close") else contextlib.nullcontext():
        for _ in range(120):
            query.awaitTermination(1)
            found = [r.status for r in spark.table("by_clock").orderBy("at").collect()]
            if len(found) == 3:
                break
    query.stop()
    assert found == ["Running", "Waiting", "Running"]
