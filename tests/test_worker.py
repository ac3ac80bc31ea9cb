"""Workers that share a queue, and the scheduler."""

import json
import time

from pyspark.sql import functions as F
from test_cdc import now

from tidemark.plans.queue import Queue
from tidemark.streaming import worker as W


def requests(spark, n, start=0):
    return spark.range(start, start + n).select(F.concat(F.lit("e"), F.col("id").cast("string")).alias("entity_type"), F.to_json(F.struct("id")).alias("payload"))


def statuses(queue):
    return {r.status: r.n for r in queue.read().groupBy("status").agg(F.count(F.lit(1)).alias("n")).collect()}


def test_two_workers_complete_every_job_once(spark, tmp_path):
    """Both claim a few at a time from one queue; every job is run once and none is left."""
    queue = Queue.at(spark, str(tmp_path / "q"), buckets=2)
    assert queue.enqueue(requests(spark, 30), now()).count() == 30 and queue.enqueue(requests(spark, 30), now()).count() == 0
    ran = str(tmp_path / "ran")

    def run(claimed):
        claimed.select("id").write.mode("append").parquet(ran)
        return claimed.select("id", F.lit(True).alias("ok"), F.lit(None).cast("string").alias("error"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("int").alias("code"))

    queries = [W.worker(Queue.at(spark, str(tmp_path / "q")), run, str(tmp_path / f"c{i}"), now=now, most=8) for i in range(2)]
    until = time.monotonic() + 300
    while statuses(queue).get("Completed", 0) < 30 and time.monotonic() < until and all(q.isActive for q in queries):
        time.sleep(1)
    for q in queries:
        q.stop()
        assert q.exception() is None
    assert statuses(queue) == {"Completed": 30}
    assert sorted(r.id for r in spark.read.parquet(ran).collect()) == list(range(1, 31))


def test_outcomes_of_work(spark, tmp_path):
    """Claims in the order of ids, retries that wait, failures, requeueing, and a run that raises."""
    queue = Queue.at(spark, str(tmp_path / "q"), buckets=2)
    queue.enqueue(requests(spark, 4), now())

    def run(claimed):
        ok = F.col("entity_type") == "e0"
        kind = F.when(F.col("entity_type") == "e1", "timeout").otherwise("value")
        return claimed.select("id", ok.alias("ok"), F.lit("bad").alias("error"), kind.alias("kind"), F.lit(None).alias("code"))

    assert W.work(queue, run, now, most=3).count() == 3
    rows = {r.entity_type: r for r in queue.read().collect()}
    assert [rows[f"e{i}"].status for i in range(4)] == ["Completed", "Waiting", "Failed", "Pending"]
    assert (rows["e1"].scheduled_at - rows["e1"].updated_at).seconds == 300 and rows["e1"].attempts == 1 == rows["e2"].attempts
    assert queue.requeue_failed(now()).select("entity_type").first()[0] == "e2"

    def breaking(claimed):
        raise RuntimeError("no server")

    assert W.work(queue, breaking, now).count() == 2  # e2 again and e3; e1 waits
    assert statuses(queue) == {"Completed": 1, "Waiting": 1, "Failed": 2} and queue.read().where("entity_type = 'e3'").first().error_message == "no server"
    assert W.work(queue, run, now) is None
    later = lambda: F.lit("2024-01-20 00:05:00").cast("timestamp_ntz")
    assert queue.claim(later()).count() == 1 and queue.reset_stale(later(), 10).count() == 0
    assert queue.reset_stale(F.lit("2024-01-20 01:00:00").cast("timestamp_ntz"), 10).count() == 1 and statuses(queue)["Pending"] == 1


def test_scheduler(spark, tmp_path):
    queue, on = Queue.at(spark, str(tmp_path / "q"), buckets=2), [False]
    s = W.Scheduler(queue, str(tmp_path / "c"), lambda: on[0], now, unit="seconds")
    assert s.state() == "stopped" and s.tick() == 0
    s.pause()
    s.resume()
    assert s.state() == "stopped"
    s.start(0)
    assert (s.state(), s.interval) == ("active", 1)
    s.start(99)
    assert s.interval == 1
    s.pause()
    assert s.state() == "paused"
    s.update_interval(2)
    s.resume()
    assert (s.state(), s.interval) == ("active", 2)
    on[0] = True
    until = time.monotonic() + 120
    while not statuses(queue) and time.monotonic() < until:
        time.sleep(0.5)
    s.stop()
    assert s.state() == "stopped" and statuses(queue) == {"Pending": 5}
    assert s.trigger() == 0 and s.trigger("odd") == 1 and json.loads(queue.read().where("entity_type = 'odd'").toJSON().first())["id"] == 6
