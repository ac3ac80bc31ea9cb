"""All queries over the provided tables, by name. Each takes (spark, sf_dir)."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import hashing as H
from .functions import scalars as S
from .operators import cdc, jobs, lookups, reports
from .operators.numbering import numbered
from .plans import backup
from .plans.queue import Queue
from .plans.sync import Store, sync
from .schemas import ALIASES, ENTITY_ORDER, JOB_STATES
from .sources import entities as E
from .sources import files, tail
from .storage import shared_dir
from .streaming import cdc_stream, worker

NOW = dt.datetime(2024, 1, 20)

def _now():
    return F.lit(NOW).cast("timestamp_ntz")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _outcomes(spark: SparkSession, sf_dir: str, entity: str) -> DataFrame:
    fetched = E.collection(spark, sf_dir, entity)
    return cdc.classify(fetched, E.stored_mapping(fetched, _now()), ["pos"])


def _all_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for entity in ENTITY_ORDER:
        one = _outcomes(spark, sf_dir, entity)
        out = one if out is None else out.unionByName(one)
    return out


def _mapping(spark: SparkSession, sf_dir: str, entity: str) -> DataFrame:
    return E.stored_mapping(E.collection(spark, sf_dir, entity), _now())


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as jobs of their users."""
    states = F.array(*[F.lit(s) for s in JOB_STATES])
    return _table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("entity_type"), F.col("props").alias("payload"),
        F.get(states, (F.col("event_id") % 6).cast("int")).alias("status"), (F.col("event_id") % 3).cast("int").alias("attempts"), F.lit(3).alias("max_attempts"),
        F.when(F.col("event_id") % 6 == 4, "boom").alias("error_message"), F.col("ts").alias("created_at"), F.col("ts").alias("updated_at"), F.col("ts").alias("scheduled_at"),
    )


def scan_customers(spark, sf_dir):
    return E.collection(spark, sf_dir, "customer").select("source_id", F.split("payload", r"\|")[0].alias("name"), "hash")


def scan_orders_by_status(spark, sf_dir):
    rows = E.with_status(_table(spark, sf_dir, "orders"), "o_orderstatus", "O")
    return rows.select("o_orderkey", "o_custkey", S.cents("o_totalprice").alias("total_cents"))


def scan_updated_after(spark, sf_dir):
    return E.updated_after(_table(spark, sf_dir, "orders"), "o_orderdate", F.lit("1998-01-01").cast("timestamp_ntz")).select("o_orderkey", "o_orderdate")


def _order_lines(spark, sf_dir):
    return E.order_lines(_table(spark, sf_dir, "orders"), _table(spark, sf_dir, "lineitem"))


def order_lines_nested(spark, sf_dir):
    """Orders with their lines as a JSON array."""
    return _order_lines(spark, sf_dir).withColumn("lines", F.to_json("lines"))


def order_lines_flat(spark, sf_dir):
    lines = F.explode("lines").alias("x")
    return _order_lines(spark, sf_dir).select("id", lines).select("id", "x.line", "x.equipment_id", "x.quantity", "x.price_cents")


def unwrap_payload(spark, sf_dir):
    bodies = _table(spark, sf_dir, "events").select("event_id", F.concat(F.lit('{"data":['), "props", F.lit("]}")).alias("body"))
    return E.unwrapped(bodies).select("event_id", F.col("pos").cast("long").alias("pos"), F.try_variant_get("item", "$.k", "long").alias("k"))


def payload_hash(spark, sf_dir):
    raw = F.concat(F.lit('{"size": '), F.col("p_size").cast("string"), F.lit(', "brand": "'), F.col("p_brand"), F.lit('"}'))
    return _table(spark, sf_dir, "part").select("p_partkey", H.payload_hash(raw).alias("hash"))


def cdc_classify(spark, sf_dir):
    return _outcomes(spark, sf_dir, "customer").select("source_id", "outcome")


def cdc_stats(spark, sf_dir):
    return cdc.stats(_all_outcomes(spark, sf_dir), ["entity_type"])


def cdc_sync_all_rollup(spark, sf_dir):
    return cdc.rollup(_all_outcomes(spark, sf_dir))


def cdc_merge_mapping(spark, sf_dir):
    fetched = E.collection(spark, sf_dir, "rental_order")
    stored = E.stored_mapping(fetched, F.lit("2024-01-01").cast("timestamp_ntz"))
    return cdc.merge_mapping(stored, cdc.classify(fetched, stored, ["pos"]), "pos", _now())


def _repeats(spark, sf_dir):
    cents = S.cents("l_extendedprice")
    return _table(spark, sf_dir, "lineitem").select(
        F.lit("line").alias("entity_type"), F.col("l_orderkey").cast("string").alias("source_id"),
        H.typed_hash(F.col("l_partkey").cast("string"), F.floor(F.col("l_quantity") / 26).cast("string")).alias("hash"), (F.col("l_suppkey") % 3 != 0).alias("ok"),
        F.struct("l_linenumber", "l_partkey", "l_suppkey", cents.alias("cents"), "l_shipdate", "l_returnflag", "l_linestatus").alias("place"),
        F.lit(None).cast("string").alias("new_external_id"),
        F.col("l_orderkey").alias("key"),
    )


def cdc_repeat_ids(spark, sf_dir):
    rows = _repeats(spark, sf_dir)
    stored = rows.select("entity_type", "source_id", "key").distinct().where("key % 4 = 0").select(
        "entity_type", "source_id", F.when(F.col("key") % 8 == 0, "").otherwise("x").alias("external_id"),
        F.sha2(F.lit("old"), 256).alias("last_hash"), F.lit("synced").alias("status"),
    )
    out = cdc.classify(rows, stored, ["place"])
    return out.groupBy("source_id").agg(F.count(F.lit(1)).alias("processed"), *[F.count_if(F.col("outcome") == o).alias(o) for o in cdc.OUTCOMES])


def cdc_hot_ids(spark, sf_dir):
    """Events as versions of a few records, each of which comes very often."""
    rows = _table(spark, sf_dir, "events").select(
        F.lit("kind").alias("entity_type"), F.col("event_type").alias("source_id"), F.col("event_id").alias("pos"),
        H.typed_hash(F.floor(F.col("value") / 40).cast("string")).alias("hash"), (F.col("event_id") % 13 != 0).alias("ok"),
    )
    stored = spark.createDataFrame([("kind", "click", "x", "old", "synced"), ("kind", "view", "", "old", "synced")], "entity_type string, source_id string, external_id string, last_hash string, status string")
    return cdc.classify_spread(rows, stored, "pos", rows=1000).select("source_id", "pos", "outcome")


def history_append(spark, sf_dir):
    return cdc.history(_outcomes(spark, sf_dir, "rental_order"), _now(), ["pos"]).select("id", "source_id", "external_id", "status", "details", "created_at")


def dead_letter_append(spark, sf_dir):
    failed = _table(spark, sf_dir, "documents").select(
        F.lit("customer").alias("entity_type"), F.col("doc_id").cast("string").alias("source_id"), F.lit("failed").alias("outcome"),
        F.col("text").alias("error"), F.col("text").alias("payload"), F.col("doc_id").alias("pos"),
    )
    return cdc.dead_letters(failed, _now(), ["pos"])


def dead_letter_list(spark, sf_dir):
    return reports.list_dead_letters(dead_letter_append(spark, sf_dir), "customer", 50)


def dead_letter_clear(spark, sf_dir):
    letters = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("entity_type"))
    return lookups.clear_dead_letters(letters, "fr")[1]


def lookup_forward(spark, sf_dir):
    keys = E.collection(spark, sf_dir, "customer").select("entity_type", "source_id")
    return lookups.external_ids(keys, _mapping(spark, sf_dir, "customer")).select("source_id", "external_id")


def lookup_reverse(spark, sf_dir):
    targets = E.collection(spark, sf_dir, "customer").select("entity_type", F.concat(F.lit("ext-"), "source_id").alias("target"))
    return lookups.source_ids(targets, _mapping(spark, sf_dir, "customer")).select("target", "source_id")


def duplicate_test(spark, sf_dir):
    keys = E.collection(spark, sf_dir, "customer")
    return lookups.duplicates(keys.select("entity_type", "source_id", "hash"), _mapping(spark, sf_dir, "customer")).select("source_id", "is_duplicate")


def mapping_exists(spark, sf_dir):
    keys = E.collection(spark, sf_dir, "customer").select("entity_type", "source_id")
    return lookups.existing(keys, _mapping(spark, sf_dir, "customer")).select("source_id")


def mapping_find(spark, sf_dir):
    return lookups.find(_mapping(spark, sf_dir, "customer"), "customer", "42")


def mapping_delete(spark, sf_dir):
    mapping = _mapping(spark, sf_dir, "customer")
    return lookups.delete(mapping, mapping.where(F.col("source_id").cast("long") % 3 == 0)).select("source_id", "external_id")


def mapping_update(spark, sf_dir):
    mapping = _mapping(spark, sf_dir, "customer")
    later = F.lit("2024-01-21").cast("timestamp_ntz")
    return lookups.update(mapping, F.col("source_id").cast("long") % 4 == 0, later, status="stale", sync_version=7).select("source_id", "status", "sync_version", "last_attempt")


def checkpoint_upsert(spark, sf_dir):
    writes = _table(spark, sf_dir, "events").select(F.col("event_type").alias("entity_type"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("last_sync_at"), F.col("event_id").alias("write_order"))
    before = spark.createDataFrame([("click", "1999-01-01 00:00:00", None), ("other", "1999-01-01 00:00:00", None)], "entity_type string, last_sync_at string, updated_at timestamp_ntz")
    return lookups.put_checkpoints(before, writes, _now())


def _fine_jobs(spark, sf_dir):
    """All events as jobs, each of an entity that four events at most share, so that some entities have no active one."""
    number = lambda x: x.cast("string")
    fine = F.concat("entity_type", F.lit("_"), number(F.floor(F.col("id") / 24)), F.lit("_"), number(F.col("id") % 8))
    return _jobs(spark, sf_dir).withColumn("entity_type", fine)


def _requests(spark, sf_dir):
    return _fine_jobs(spark, sf_dir).select("entity_type", "payload")


def enqueue_dedup(spark, sf_dir):
    requests = _requests(spark, sf_dir)
    queue = _fine_jobs(spark, sf_dir)
    return jobs.enqueue(queue, requests, _now(), priority=True, first_id=1).select("id", "entity_type", "payload", "status", "attempts", "max_attempts", "created_at", "scheduled_at")


def claim_next(spark, sf_dir):
    return jobs.next_job(_jobs(spark, sf_dir), _now())


def claim_state(spark, sf_dir):
    queue = _jobs(spark, sf_dir)
    return jobs.metrics(jobs.claim(queue, jobs.next_job(queue, _now()), _now()))


def job_transition(spark, sf_dir):
    kinds = F.array(*[F.lit(k) for k in ("timeout", "http", "value", "request", "non_retryable")])
    run = _jobs(spark, sf_dir).where("status = 'Running'").withColumns({
        "ok": F.col("id") % 4 == 1, "error": F.concat(F.lit("error "), F.col("id").cast("string")),
        "kind": F.get(kinds, (F.col("id") % 5).cast("int")), "code": F.when(F.col("id") % 2 == 0, 503).otherwise(404),
    })
    return jobs.transition(run, _now()).select("id", "status", "attempts", "error_message", "scheduled_at")


def retry_classify(spark, sf_dir):
    """Events as errors of all kinds with all codes."""
    pick = lambda xs, x: F.get(F.array(*[F.lit(v) for v in xs]), x.cast("int"))
    kind = pick(("non_retryable", "retryable", "timeout", "connection", "http", "request", "os", "value", "other"), F.col("event_id") % 9)
    code = pick((400, 401, 403, 404, 409, 422, 429, 500, 501, 502, 503, 504, None), F.floor(F.col("event_id") / 9) % 13)
    errors = _table(spark, sf_dir, "events").select("event_id", kind.alias("kind"), code.alias("code"))
    return errors.withColumn("retryable", jobs.retryable(F.col("kind"), F.col("code")))


def backoff_schedule(spark, sf_dir):
    """Events as attempts, some beyond the last."""
    n = (F.col("user_id") % 10 - 1).cast("int")
    return _table(spark, sf_dir, "events").select("event_id", n.alias("n"), jobs.backoff_seconds(n).alias("delay"))


def requeue_failed(spark, sf_dir):
    return jobs.requeued(_fine_jobs(spark, sf_dir))


def enqueue_counts(spark, sf_dir):
    return jobs.enqueued_count(_fine_jobs(spark, sf_dir), _requests(spark, sf_dir))


def scheduled_enqueue(spark, sf_dir):
    """What two ticks enqueue: one with auto-sync on, one with it off."""
    ticks = [jobs.scheduled(_fine_jobs(spark, sf_dir), _requests(spark, sf_dir), _now(), on).select(F.lit(on).alias("auto_sync"), "id", "entity_type", "scheduled_at") for on in (True, False)]
    return ticks[0].unionByName(ticks[1])


def legacy_upsert(spark, sf_dir):
    """Customers written without a hash, and what the next run makes of each."""
    fetched = E.collection(spark, sf_dir, "customer")
    stored = cdc.put_unhashed(E.stored_mapping(fetched, _now()), fetched.where("key % 2 = 0"), _now())
    return cdc.classify(fetched, stored, ["pos"]).join(stored.select("entity_type", "source_id", "last_hash", "sync_version"), ["entity_type", "source_id"], "left").select("source_id", "outcome", "last_hash", "sync_version")


def migration_hashes(spark, sf_dir):
    """Content hashes in the form that an earlier mapping holds."""
    part = _table(spark, sf_dir, "part")
    raw = F.to_json(F.struct(F.col("p_size").alias("size"), F.col("p_brand").alias("brand"), F.struct(F.col("p_type").alias("z"), F.col("p_name").alias("a")).alias("more")))
    return part.select("p_partkey", H.migration_hash(raw).alias("hash"))


def checkpoint_get(spark, sf_dir):
    return lookups.checkpoint(checkpoint_upsert(spark, sf_dir), "click")


def file_stamps(spark, sf_dir):
    return _table(spark, sf_dir, "events").select("event_id", S.file_stamp("ts").alias("stamp"))


def map_defaults(spark, sf_dir):
    """Counts of each user's events by kind, with 0 for those that a user has none of."""
    counts = _table(spark, sf_dir, "events").where("value > 50").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    maps = counts.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))
    return maps.select("user_id", S.get_or("m", "purchase").alias("purchases"), S.get_or("m", "signup", -1).alias("signups"))


def sync_run(spark, sf_dir):
    """Two runs over the customers through stored state: the first from an earlier mapping, the second over the same records."""
    store = Store.at(spark, f"{shared_dir(spark)}/sync-{uuid.uuid4().hex}")
    fetched = E.collection(spark, sf_dir, "customer")
    store.mapping.write(E.stored_mapping(fetched, _now()))
    runs = [sync(fetched, store, _now()).withColumn("run", F.lit(i)) for i in (1, 2)]
    tables = [t.read().agg(F.count(F.lit(1)).alias("rows"), F.max(key).alias("last")).select(F.lit(name).alias("name"), "rows", F.col("last").cast("long").alias("last")) for name, t, key in (("mapping", store.mapping, "sync_version"), ("history", store.history, "id"), ("dead_letters", store.dead_letters, "id"))]
    counted = runs[0].unionByName(runs[1]).select(F.concat(F.lit("run "), F.col("run").cast("string")).alias("name"), (F.col("created") + F.col("updated")).alias("rows"), F.col("failed").alias("last"))
    return counted.unionByName(tables[0]).unionByName(tables[1]).unionByName(tables[2])


def _event_records(spark, rows):
    """Events as versions of a few records, each of which comes very often."""
    return rows.select(
        F.lit("kind").alias("entity_type"), F.col("event_type").alias("source_id"), F.col("event_id").alias("pos"), H.typed_hash(F.floor(F.col("value") / 40).cast("string")).alias("hash"),
        (F.col("event_id") % 13 != 0).alias("ok"), F.lit("rejected").alias("error"), F.col("props").alias("payload"), F.lit(None).cast("string").alias("new_external_id"),
    )


def _synced(store):
    """Of each record its version and last hash in a store, and how many lines of history and dead letters it has."""
    count = lambda table, name: table.read().groupBy("source_id").agg(F.count(F.lit(1)).alias(name))
    rows = store.mapping.read().select("source_id", "sync_version", "last_hash")
    return rows.join(count(store.history, "lines"), "source_id", "left").join(count(store.dead_letters, "letters"), "source_id", "left").na.fill(0, ["lines", "letters"])


def sync_hot(spark, sf_dir):
    """A sync through stored state of records that each come very often."""
    store = Store.at(spark, f"{shared_dir(spark)}/hot-{uuid.uuid4().hex}")
    sync(_event_records(spark, _table(spark, sf_dir, "events")), store, _now())
    return _synced(store)


def sync_streamed(spark, sf_dir):
    """The same as a stream, in one version for each micro-batch."""
    at = f"{shared_dir(spark)}/streamed-{uuid.uuid4().hex}"
    store, rows = Store.at(spark, f"{at}/state"), _table(spark, sf_dir, "events")
    rows.repartitionByRange(3, "event_id").write.parquet(f"{at}/ordered")
    for file in sorted(r.f for r in spark.read.parquet(f"{at}/ordered").select(F.input_file_name().alias("f")).distinct().collect()):
        spark.read.schema(rows.schema).parquet(file).write.mode("append").parquet(f"{at}/in")
        records = _event_records(spark, spark.readStream.schema(rows.schema).parquet(f"{at}/in"))
        cdc_stream.sync_stream(records, store, "events", f"{at}/checkpoint", _now).awaitTermination()  # goes on where the last run ended
    return _synced(store)


def queue_work(spark, sf_dir):
    """All due jobs of a stored queue, claimed and done by one worker: jobs by status and attempts afterwards."""
    queue = Queue.at(spark, f"{shared_dir(spark)}/queue-{uuid.uuid4().hex}")
    queue.state.change(merged={"jobs": _jobs(spark, sf_dir)})

    def run(claimed):
        kinds = F.array(*[F.lit(k) for k in ("timeout", "http", "value", "request", "non_retryable")])
        return claimed.select("id", (F.col("id") % 4 == 1).alias("ok"), F.concat(F.lit("error "), F.col("id").cast("string")).alias("error"), F.get(kinds, (F.col("id") % 5).cast("int")).alias("kind"), F.when(F.col("id") % 2 == 0, 503).otherwise(404).alias("code"))

    worker.work(queue, run, _now, most=2**31 - 1)
    return queue.read().groupBy("status", "attempts").agg(F.count(F.lit(1)).alias("jobs"), F.max("scheduled_at").alias("last"))


def log_files_tail(spark, sf_dir):
    """The last lines of a log folder, read backwards."""
    folder = f"{shared_dir(spark)}/logs-{uuid.uuid4().hex}"
    files.append_logs_in_order(_log_rows(spark, sf_dir), "event_id", folder)
    return tail.tail(spark, folder, 100).select(F.col("text").alias("line"))


def backup_restored(spark, sf_dir):
    """Customers' mapping as a backup brings it back after later changes."""
    at = f"{shared_dir(spark)}/backup-{uuid.uuid4().hex}"
    store, fetched = Store.at(spark, f"{at}/state"), E.collection(spark, sf_dir, "customer")
    store.mapping.write(E.stored_mapping(fetched, _now()))
    path = backup.take(store.state, f"{at}/backups", _now())
    sync(fetched, store, _now())
    backup.restore(store.state, path)
    return store.mapping.read().select("source_id", "external_id", "sync_version", "last_hash")


def queue_metrics(spark, sf_dir):
    return jobs.metrics(_jobs(spark, sf_dir))


def status_metrics(spark, sf_dir):
    return jobs.summary(_jobs(spark, sf_dir))


def recent_jobs(spark, sf_dir):
    return jobs.recent(_jobs(spark, sf_dir), 50)


def active_violations(spark, sf_dir):
    return jobs.one_active_per_entity(_jobs(spark, sf_dir))


def alias_route(spark, sf_dir):
    """Events with job names of all kinds, some of them odd."""
    names = (*ALIASES, "Customers", "unknown", "", "ORDERS")
    name = F.get(F.array(*[F.lit(x) for x in names]), (F.col("event_id") % len(names)).cast("int"))
    return _table(spark, sf_dir, "events").select("event_id", name.alias("name")).withColumn("entity", S.routed("name", ALIASES))


def iso_date_format(spark, sf_dir):
    moment = F.col("o_orderdate")
    text = (
        F.when(F.col("o_orderkey") % 5 == 0, F.date_format(moment, "yyyy-MM-dd")).when(F.col("o_orderkey") % 5 == 1, F.concat(F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")))
        .when(F.col("o_orderkey") % 5 == 2, F.concat(F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss"), F.lit(".123456+05:30")))
        .when(F.col("o_orderkey") % 5 == 3, F.date_format(moment, "yyyyMMdd")).otherwise(F.lit("no date"))
    )
    return _table(spark, sf_dir, "orders").select("o_orderkey", S.iso_date(text).alias("formatted"))


def xml_envelope(spark, sf_dir):
    return _table(spark, sf_dir, "part").select("p_partkey", S.xml_envelope(F.lit("SYNC"), F.lit("equipment"), F.col("p_brand")).alias("envelope"))


def license_check(spark, sf_dir):
    key = F.left(F.col("c_mktsegment"), (F.col("c_custkey") % 11).cast("int"))
    return _table(spark, sf_dir, "customer").select("c_custkey", S.license_ok(key).alias("valid"))


def fingerprint(spark, sf_dir):
    return _table(spark, sf_dir, "supplier").select("s_suppkey", S.fingerprint("s_name").alias("fingerprint"))


def scalar_helpers(spark, sf_dir):
    url = F.concat(F.lit("http://x/"), F.col("p_brand"), F.repeat(F.lit("/"), (F.col("p_size") % 4).cast("int")))
    return _table(spark, sf_dir, "part").select(
        "p_partkey", S.trimmed_url(url).alias("url"), S.capitalized("p_type").alias("capital"), S.megabytes(F.col("p_partkey") * 1048576 / 4).alias("mb"),
        S.interval_minutes((F.col("p_size") - 25).cast("int")).alias("minutes"), S.basename(F.concat(F.lit("/a/b/"), F.col("p_brand"))).alias("base"),
        S.scheduler_state(F.col("p_size") % 2 == 0, F.col("p_size") % 3 == 0).alias("scheduler"), S.or_else(F.when(F.col("p_size") % 2 == 0, ""), "p_brand").alias("chosen"),
    )


def _log_rows(spark, sf_dir):
    return _table(spark, sf_dir, "events").select(
        "event_id",
        reports.log_line(F.col("ts"), F.lit("INFO"), F.concat(F.lit("app."), F.col("event_type")), F.when(F.col("event_id") % 2 == 0, "Queue"), F.concat(F.lit("user "), F.col("user_id").cast("string")), F.when(F.col("event_id") % 3 == 0, S.cents("value"))).alias("line"),
    )


def log_format(spark, sf_dir):
    return _log_rows(spark, sf_dir)


def log_tail(spark, sf_dir):
    return reports.log_tail(_log_rows(spark, sf_dir), "event_id", 100)


def log_scan(spark, sf_dir):
    """Log lines parsed again and counted by component."""
    parsed = _log_rows(spark, sf_dir).select(F.from_json("line", "component string, duration_ms double").alias("x"))
    return parsed.groupBy(F.col("x.component").alias("component")).agg(F.count(F.lit(1)).alias("lines"), F.count("x.duration_ms").alias("timed"))


def _files(spark, sf_dir):
    return _table(spark, sf_dir, "events").select(F.concat(F.lit("/b/state_backup_"), F.col("event_id").cast("string"), F.lit(".db")).alias("path"), F.col("user_id").alias("length"), F.col("ts").alias("modificationTime"))


def backup_list(spark, sf_dir):
    return reports.backups(_files(spark, sf_dir))


def backup_purge(spark, sf_dir):
    return reports.expired_backups(_files(spark, sf_dir), F.lit("2024-02-15").cast("timestamp_ntz"), 30).select("path")


def system_status(spark, sf_dir):
    one = reports.status(_jobs(spark, sf_dir), _now(), True, False, True, False, "12345678")
    return one.select("status", "middleware_version", "system_health.scheduler_status", "system_health.license_status", "queue_metrics.current_queue", "queue_metrics.pending_jobs", "timestamp")


def batch_slices(spark, sf_dir):
    rows = numbered(_table(spark, sf_dir, "customer").select("c_custkey"), ["c_custkey"], "pos", 0)
    return cdc.batches(rows).groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.min("c_custkey").alias("first"))


QUERIES = {
    f.__name__: f
    for f in (
        scan_customers, scan_orders_by_status, scan_updated_after, order_lines_nested, order_lines_flat, unwrap_payload, payload_hash,
        cdc_classify, cdc_stats, cdc_sync_all_rollup, cdc_merge_mapping, cdc_repeat_ids, cdc_hot_ids, history_append, dead_letter_append, dead_letter_list,
        dead_letter_clear, lookup_forward, lookup_reverse, duplicate_test, mapping_exists, mapping_find, mapping_delete, mapping_update,
        checkpoint_upsert, enqueue_dedup, claim_next, claim_state, job_transition, retry_classify, backoff_schedule, requeue_failed, enqueue_counts, scheduled_enqueue,
        legacy_upsert, migration_hashes, checkpoint_get, file_stamps, map_defaults, sync_run, sync_hot, sync_streamed, queue_work, log_files_tail, backup_restored,
        queue_metrics, status_metrics, recent_jobs, active_violations, alias_route, iso_date_format, xml_envelope, license_check, fingerprint,
        scalar_helpers, log_format, log_tail, log_scan, backup_list, backup_purge, system_status, batch_slices,
    )
}
