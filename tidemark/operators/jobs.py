"""The job queue as tables: enqueueing without duplicates, claiming, and the transitions of a job's state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..schemas import ACTIVE_STATES, CLAIMABLE_STATES, JOB_STATES, QUEUE_NAMES
from .numbering import numbered

# Seconds to wait before each further attempt.
BACKOFF_SECONDS = (300, 900, 1800, 3600, 21600, 86400)
# Status codes that are worth another attempt, and those that never are.
RETRYABLE_CODES = (429, 500, 502, 503, 504)
FINAL_CODES = (400, 401, 403, 404, 422)
MAX_ATTEMPTS = 3


def active(jobs: DataFrame) -> DataFrame:
    return jobs.where(F.col("status").isin(*ACTIVE_STATES))


def enqueue(jobs: DataFrame, requests: DataFrame, now: Column, priority: bool = False, first_id: int = 1) -> DataFrame:
    """New jobs of requests (entity_type, payload) whose entity has no active job, one for each entity.

    Of several requests for an entity the one with the least payload stays. Priority backdates a job by ten
    seconds; as jobs are claimed by id, it does not pass others.
    """
    fresh = (
        requests.groupBy("entity_type").agg(F.min("payload").alias("payload"))
        .join(active(jobs).select("entity_type"), "entity_type", "left_anti")
    )
    at = now - F.make_interval(secs=F.lit(10)) if priority else now
    return numbered(fresh, ["entity_type"], "id", first_id).select(
        "id", "entity_type", S.truthy(F.when(F.col("payload") == "{}", None).otherwise(F.col("payload"))).alias("payload"), F.lit("Pending").alias("status"),
        F.lit(0).alias("attempts"), F.lit(MAX_ATTEMPTS).alias("max_attempts"), F.lit(None).cast("string").alias("error_message"),
        now.alias("created_at"), now.alias("updated_at"), at.cast("timestamp_ntz").alias("scheduled_at"),
    )


def scheduled(jobs: DataFrame, requests: DataFrame, now: Column, auto_sync: Column | bool, first_id: int = 1) -> DataFrame:
    """What the scheduler enqueues at a tick: nothing where auto-sync is off."""
    return enqueue(jobs, requests.where(F.lit(auto_sync)), now, first_id=first_id)


def enqueued_count(jobs: DataFrame, requests: DataFrame) -> DataFrame:
    """How many of the requested entities get a job, and how many have an active one already."""
    wanted = requests.select("entity_type").distinct()
    known = active(jobs).select("entity_type", F.lit(1).alias("_has")).distinct()
    return wanted.join(known, "entity_type", "left").agg(F.count_if(F.col("_has").isNull()).alias("enqueued"), F.count("_has").alias("duplicates"))


def all_entities(spark) -> DataFrame:
    """A request for each entity, as the scheduler and a trigger without a name make them."""
    return spark.createDataFrame([(name, None) for name in QUEUE_NAMES], "entity_type string, payload string")


def one_active_per_entity(jobs: DataFrame) -> DataFrame:
    """Entities that break the rule of one active job; must be empty after every change."""
    return active(jobs).groupBy("entity_type").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def eligible(jobs: DataFrame, now: Column) -> DataFrame:
    return jobs.where(F.col("status").isin(*CLAIMABLE_STATES) & (F.col("scheduled_at") <= now))


def next_job(jobs: DataFrame, now: Column) -> DataFrame:
    """The eligible job of least id, as it was before it is claimed."""
    return eligible(jobs, now).orderBy("id").limit(1).select("id", "entity_type", "payload", "status", "attempts", "max_attempts")


def claim(jobs: DataFrame, claimed: DataFrame, now: Column) -> DataFrame:
    """jobs with the claimed ones running."""
    ids = F.broadcast(claimed.select("id", F.lit(True).alias("_mine")).limit(1))  # one row
    return (
        jobs.join(ids, "id", "left")
        .withColumn("status", F.when(F.col("_mine"), "Running").otherwise(F.col("status")))
        .withColumn("updated_at", F.when(F.col("_mine"), now).otherwise(F.col("updated_at"))).drop("_mine")
    )


def retryable(kind: Column, code: Column) -> Column:
    """Whether an error is worth another attempt, by the first rule that holds.

    kind is an error's class: non_retryable, retryable, timeout, connection, http (with a status code or
    without), request (any other request error), os, value, other. What the HTTP rule leaves open counts as
    a system error, and so does every other request error; both are retried.
    """
    return (
        F.when(kind == "non_retryable", False).when(kind == "retryable", True)
        .when(kind.isin("timeout", "connection"), True)
        .when((kind == "http") & code.isin(*RETRYABLE_CODES), True).when((kind == "http") & code.isin(*FINAL_CODES), False)
        .when(kind.isin("http", "request", "os"), True)
        .otherwise(False)
    )


def backoff_seconds(attempt: Column) -> Column:
    """Seconds to wait before this attempt; NULL beyond the last."""
    return F.try_element_at(F.array(*[F.lit(s) for s in BACKOFF_SECONDS]), F.greatest(attempt, F.lit(1)).cast("int"))


def transition(jobs: DataFrame, now: Column) -> DataFrame:
    """jobs (with ok, error, kind, code of their run) in their next state: completed, waiting for a retry, or failed."""
    attempt = F.col("attempts") + 1
    delay = backoff_seconds(attempt)
    again = retryable(F.col("kind"), F.col("code")) & delay.isNotNull() & (attempt < F.col("max_attempts"))
    return (
        jobs.withColumn("_next", F.when(F.col("ok"), "Completed").when(again, "Waiting").otherwise("Failed"))
        .withColumn("scheduled_at", F.when(F.col("_next") == "Waiting", (now + F.make_interval(secs=delay)).cast("timestamp_ntz")).otherwise(F.col("scheduled_at")))
        .withColumn("error_message", F.when(F.col("_next") != "Completed", S.truncated("error", 1000)))
        .withColumn("attempts", F.when(F.col("_next") == "Completed", F.col("attempts")).otherwise(attempt).cast("int"))
        .withColumn("status", F.col("_next")).withColumn("updated_at", now).drop("_next", "ok", "error", "kind", "code")
    )


def requeued(jobs: DataFrame) -> DataFrame:
    """Ids of failed jobs to run again: the newest of each entity without an active job.

    Requeueing all would break the rule of one active job for each entity.
    """
    failed = jobs.where("status = 'Failed'").groupBy("entity_type").agg(F.max("id").alias("id"))
    return failed.join(active(jobs).select("entity_type"), "entity_type", "left_anti").select("id", "entity_type")


def requeue_failed(jobs: DataFrame, now: Column) -> DataFrame:
    """jobs after that: pending, no attempts, no error, due now."""
    mine = requeued(jobs).select("id", F.lit(True).alias("_mine"))
    put = {"status": F.lit("Pending"), "attempts": F.lit(0), "error_message": F.lit(None).cast("string"), "scheduled_at": now, "updated_at": now}
    return jobs.join(mine, "id", "left").withColumns({c: F.when(F.col("_mine"), v).otherwise(F.col(c)) for c, v in put.items()}).drop("_mine")


def reset_stale(jobs: DataFrame, now: Column, seconds: int) -> DataFrame:
    """jobs with those that have been running for too long pending again. Not part of any transition by itself."""
    stale = (F.col("status") == "Running") & (F.col("updated_at") < now - F.make_interval(secs=F.lit(seconds)))
    return jobs.withColumn("status", F.when(stale, "Pending").otherwise(F.col("status")))


def metrics(jobs: DataFrame) -> DataFrame:
    """One row with the number of jobs in each known state."""
    return jobs.agg(*[F.count_if(F.col("status") == s).alias(s) for s in JOB_STATES])


def summary(jobs: DataFrame) -> DataFrame:
    """The numbers that a status report shows; waiting jobs are pending, and current_queue counts finished ones too."""
    return metrics(jobs).select(
        sum((F.col(s) for s in JOB_STATES[1:]), F.col(JOB_STATES[0])).alias("current_queue"), (F.col("Pending") + F.col("Waiting")).alias("pending_jobs"),
        F.col("Running").alias("running_jobs"), F.col("Completed").alias("completed_jobs"), F.col("Failed").alias("failed_jobs"),
    )


def recent(jobs: DataFrame, limit: int = 50) -> DataFrame:
    """The newest jobs; a negative limit is none."""
    rows = jobs.select("id", "entity_type", "status", "attempts", "error_message", "created_at", "updated_at", "scheduled_at").orderBy(F.desc("id"))
    return rows if limit < 0 else rows.limit(limit)


def newest_by_entity(jobs: DataFrame) -> DataFrame:
    """The newest job of each entity."""
    order = Window.partitionBy("entity_type").orderBy(F.desc("id"))
    return jobs.withColumn("_place", F.row_number().over(order)).where("_place = 1").drop("_place")
