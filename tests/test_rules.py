"""Rule tables and edge cases of scalars, queue, reports and unwrapping."""

import datetime as dt
import json
import uuid

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidemark.functions import hashing as H
from tidemark.functions import scalars as S
from tidemark.operators import jobs, reports
from tidemark.schemas import JOBS
from tidemark.sources import entities as E


def now():
    return F.lit("2024-01-20 12:00:00").cast("timestamp_ntz")


def values(spark, xs, f, kind="string"):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], f"i int, x {kind}")
    return [r.y for r in rows.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_iso_dates(spark):
    given = ["2024-01-02T03:04:05Z", "2024-01-02T03:04:05.999+05:30", "2024-01-02", "20240102", "2024-01-02 03:04", "nonsense", "", None, "2024-13-40", "2024-W01-1"]
    want = ["2024-01-02 03:04:05", "2024-01-02 03:04:05", "2024-01-02 00:00:00", "2024-01-02 00:00:00", "2024-01-02 03:04:00", "nonsense", None, None, "2024-13-40", "2024-W01-1"]
    assert values(spark, given, S.iso_date) == want


def test_texts(spark):
    assert values(spark, ["rental_order", "ABC", "", None], S.capitalized) == ["Rental_order", "Abc", "", None]
    assert values(spark, ["http://x//", "/", "a"], S.trimmed_url) == ["http://x", "", "a"]
    assert values(spark, [None, "", "1234567", "12345678"], S.license_ok) == [True, True, False, True]
    hosts = ["box-x86_64-", "ä", ""]
    assert values(spark, hosts, S.fingerprint) == [str(uuid.uuid5(uuid.NAMESPACE_DNS, h)) for h in hosts]


def test_hashes(spark):
    a, b, c = values(spark, ['{"b": 1, "a": {"y": null, "x": "é"}}', '{"a":{"x":"é","y":null},"b":1}', '{"a":{"x":"é"},"b":1}'], H.payload_hash)
    assert a == b != c
    assert values(spark, ["no json", None], H.payload_hash) == [None, None]
    raw = '{"b": 1.0, "a": "é"}'
    want = __import__("hashlib").sha256(json.dumps(json.loads(raw), sort_keys=True, ensure_ascii=False).encode()).hexdigest()
    assert values(spark, [raw, None], H.migration_hash) == [want, None]


def test_unwrap(spark):
    rows = spark.createDataFrame([(1, '[{"id":1},{"id":2}]'), (2, '{"data":[{"id":3}]}'), (3, "[]"), (4, "{}")], "n int, body string")
    got = [(r.n, r.pos, r.i) for r in E.unwrapped(rows).select("n", "pos", F.try_variant_get("item", "$.id", "int").alias("i")).where("pos is not null").collect()]
    assert sorted(got) == [(1, 0, 1), (1, 1, 2), (2, 0, 3)]
    records = E.records(E.unwrapped(spark.createDataFrame([('[{"name":"x"}]',)], "body string")), "customer").collect()
    assert records[0].source_id == "None"
    for bad in ('{"other":1}', '{"data":null}', "nope"):
        with pytest.raises(PySparkException):
            E.unwrapped(spark.createDataFrame([(bad,)], "body string")).collect()


def test_backoff(spark):
    assert values(spark, list(range(-1, 9)), jobs.backoff_seconds, "int") == [300, 300, 300, 900, 1800, 3600, 21600, 86400, None, None]


def queue(spark, rows):
    at = dt.datetime(2024, 1, 20, 12)
    return spark.createDataFrame([(i, e, None, s, 0, 3, None, at, at, at + dt.timedelta(seconds=d)) for i, e, s, d in rows], JOBS)


def test_claim_is_inclusive_and_by_id(spark):
    q = queue(spark, [(1, "a", "Running", -5), (2, "b", "Waiting", 1), (3, "c", "Waiting", 0), (4, "d", "Pending", -9), (5, "e", "Odd", -9)])
    assert jobs.next_job(q, now()).first().id == 3
    after = jobs.claim(q, jobs.next_job(q, now()), now())
    assert {r.id: r.status for r in after.collect()}[3] == "Running"
    assert jobs.metrics(q).first().asDict() == {"Pending": 1, "Running": 1, "Retry": 0, "Completed": 0, "Failed": 0, "Waiting": 2}


def test_requeue(spark):
    q = queue(spark, [(1, "a", "Failed", 0), (2, "a", "Failed", 0), (3, "b", "Failed", 0), (4, "b", "Running", 0)])
    assert [r.id for r in jobs.requeued(q).collect()] == [2]
    after = jobs.requeue_failed(q, now())
    assert {r.id: r.status for r in after.collect()} == {1: "Failed", 2: "Pending", 3: "Failed", 4: "Running"}
    assert jobs.one_active_per_entity(after).count() == 0


def test_enqueue(spark):
    q = queue(spark, [(1, "a", "Retry", 0), (2, "b", "Completed", 0)])
    wanted = spark.createDataFrame([("a", None), ("b", "{}"), ("b", "{}"), ("c", '{"x":1}')], "entity_type string, payload string")
    got = jobs.enqueue(q, wanted, now(), priority=True, first_id=7).orderBy("id").collect()
    assert [(r.id, r.entity_type, r.payload) for r in got] == [(7, "b", None), (8, "c", '{"x":1}')]
    assert (got[0].created_at - got[0].scheduled_at).total_seconds() == 10


def test_log_tail(spark):
    lines = spark.range(10).withColumnRenamed("id", "n")
    tail = lambda n: [r.n for r in reports.log_tail(lines, "n", n).collect()]
    assert (tail(3), tail(0), tail(-4), tail(99)) == ([7, 8, 9], list(range(10)), [4, 5, 6, 7, 8, 9], list(range(10)))


def test_negative_limit_is_none(spark):
    letters = spark.range(60).select("id", F.lit("a").alias("entity_type"), F.lit("1").alias("source_id"), F.lit("e").alias("error"), now().alias("created_at"))
    assert reports.list_dead_letters(letters, limit=-1).count() == 60
    assert reports.list_dead_letters(letters, "b").count() == 0
    assert reports.list_dead_letters(letters, "", 5).count() == 5


def test_unmeasured_is_null(spark):
    row = reports.status(queue(spark, []), now(), True, True, False, False, None).first()
    assert row.resource_metrics.memory_usage_mb is None and row.system_health.license_status == "valid"


def test_queue_statistics_survive_unknown_states(spark):
    assert jobs.summary(queue(spark, [(1, "a", "Odd", 0), (2, "b", "Waiting", 0)])).first().current_queue == 1
