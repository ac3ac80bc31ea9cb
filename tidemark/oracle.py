"""DuckDB SQL of the queries in the catalog, written from the rules rather than from the plans."""

from __future__ import annotations

_NOW = "TIMESTAMP '2024-01-20 00:00:00'"


def _cents(x: str) -> str:
    return f"CAST(round({x} * 100) AS BIGINT)"


_FIELDS = {
    "customer": ("customer", "c_custkey", f"c_name, c_nationkey, {_cents('c_acctbal')}, c_mktsegment"),
    "equipment": ("part", "p_partkey", f"p_name, p_brand, p_type, p_size, {_cents('p_retailprice')}"),
    "rental_order": ("orders", "o_orderkey", f"o_custkey, o_orderstatus, {_cents('o_totalprice')}, strftime(o_orderdate, '%Y-%m-%d')"),
    "invoice": (
        f"(SELECT l_orderkey, CAST(sum({_cents('l_extendedprice')}) AS BIGINT) a, CAST(sum({_cents('l_discount')}) AS BIGINT) b, CAST(sum({_cents('l_tax')}) AS BIGINT) c FROM lineitem GROUP BY 1)",
        "l_orderkey", "a, b, c",
    ),
    "payment": ("(SELECT * FROM events WHERE event_type = 'purchase')", "event_id", f"user_id, {_cents('value')}, strftime(ts, '%Y-%m-%d %H:%M:%S')"),
}


def _fetched(entity: str) -> str:
    source, key, fields = _FIELDS[entity]
    return f"SELECT '{entity}' AS entity_type, {key} AS key, CAST({key} AS VARCHAR) AS source_id, sha256(concat_ws('|', {fields})) AS hash FROM {source} t"


def _outcome() -> str:
    """Known keys end in 0 to 6, of which 0 to 2 are stale; multiples of 13 fail."""
    return """CASE WHEN key % 10 BETWEEN 3 AND 6 THEN 'skipped' WHEN key % 13 = 0 THEN 'failed'
              WHEN key % 10 < 3 THEN 'updated' ELSE 'created' END"""


_ALL = " UNION ALL ".join(_fetched(e) for e in _FIELDS)
_COUNTS = ", ".join(f"count(*) FILTER (outcome = '{o}') AS {o}" for o in ("created", "updated", "failed"))
_STATES = "['Pending','Running','Retry','Completed','Failed','Waiting']"
_JOBS = f"""(SELECT event_id AS id, 'user_' || user_id AS entity_type, props AS payload, ({_STATES})[event_id % 6 + 1] AS status,
    CAST(event_id % 3 AS INTEGER) AS attempts, 3 AS max_attempts, CASE WHEN event_id % 6 = 4 THEN 'boom' END AS error_message,
    ts AS created_at, ts AS updated_at, ts AS scheduled_at FROM events)"""
_FINE = f"(SELECT j.* REPLACE ('user_' || user_id || '_' || CAST(floor(event_id / 24) AS BIGINT) || '_' || event_id % 8 AS entity_type) FROM {_JOBS} j JOIN events ON id = event_id)"
_ACTIVE = "('Pending', 'Running', 'Waiting', 'Retry')"
_STORED = f"(SELECT * FROM ({_fetched('customer')}) WHERE key % 10 < 7)"
_EVERY = {s: f"count(*) FILTER (status = '{s}')" for s in ("Pending", "Running", "Retry", "Completed", "Failed", "Waiting")}
_LOG = f"""SELECT event_id, '{{"timestamp":"' || strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || '","level":"INFO","logger":"app.' || event_type || '","component":"'
    || CASE WHEN event_id % 2 = 0 THEN 'Queue' ELSE event_type END || '","message":"user ' || user_id || '"'
    || CASE WHEN event_id % 3 = 0 THEN ',"duration_ms":' || {_cents('value')} ELSE '' END || '}}' AS line FROM events"""
_ENVELOPE = (
    "<ENVELOPE><HEADER><TALLYREQUEST>Import Data</TALLYREQUEST></HEADER><BODY><IMPORTDATA><REQUESTDESC><REPORTNAME>Vouchers</REPORTNAME>"
    "<STATICVARIABLES><SVCURRENTCOMPANY>Default</SVCURRENTCOMPANY></STATICVARIABLES></REQUESTDESC><REQUESTDATA>"
    '<TALLYMESSAGE xmlns:UDF="TallyUDF"><!-- SYNC equipment '
)
_HOT = """
    WITH r AS (SELECT event_type AS source_id, event_id AS pos, event_id % 13 <> 0 AS ok, CAST(floor(value / 40) AS BIGINT) AS v FROM events),
    p AS (SELECT *, last_value(CASE WHEN ok THEN v END IGNORE NULLS) OVER (PARTITION BY source_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM r),
    o AS (SELECT *, CASE WHEN v = prev THEN 'skipped' WHEN ok THEN 'written' ELSE 'failed' END AS outcome FROM p)
    SELECT source_id, CAST(count(*) FILTER (outcome = 'written') AS INTEGER) AS sync_version, sha256(CAST(arg_max(v, pos) FILTER (outcome = 'written') AS VARCHAR)) AS last_hash,
           count(*) FILTER (outcome <> 'skipped') AS lines, count(*) FILTER (outcome = 'failed') AS letters FROM o GROUP BY source_id"""

SQL = {
    "scan_customers": f"SELECT source_id, c_name AS name, hash FROM ({_fetched('customer')}) JOIN customer ON c_custkey = key",
    "scan_orders_by_status": f"SELECT o_orderkey, o_custkey, {_cents('o_totalprice')} AS total_cents FROM orders WHERE o_orderstatus = 'O'",
    "scan_updated_after": "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate > TIMESTAMP '1998-01-01'",
    "order_lines_flat": f"""SELECT CAST(o_orderkey AS VARCHAR) AS id, l_linenumber AS line, CAST(l_partkey AS VARCHAR) AS equipment_id,
        CAST(l_quantity AS INTEGER) AS quantity, {_cents('l_extendedprice')} AS price_cents FROM orders JOIN lineitem ON l_orderkey = o_orderkey""",
    "unwrap_payload": "SELECT event_id, CAST(0 AS BIGINT) AS pos, CAST(props ->> '$.k' AS BIGINT) AS k FROM events",
    "payload_hash": """SELECT p_partkey, sha256('{"brand":"' || p_brand || '","size":' || p_size || '}') AS hash FROM part""",
    "cdc_classify": f"SELECT source_id, {_outcome()} AS outcome FROM ({_fetched('customer')})",
    "cdc_stats": f"""SELECT entity_type, count(*) AS processed, {_COUNTS}, count(*) FILTER (outcome = 'skipped') AS skipped
        FROM (SELECT entity_type, {_outcome()} AS outcome FROM ({_ALL})) GROUP BY entity_type""",
    "cdc_sync_all_rollup": f"SELECT count(*) AS processed, {_COUNTS} FROM (SELECT {_outcome()} AS outcome FROM ({_ALL}))",
    "cdc_merge_mapping": f"""
        WITH o AS (SELECT *, {_outcome()} AS outcome FROM ({_fetched('rental_order')})),
        m AS (SELECT *, outcome IN ('created', 'updated') AS hit,
              CASE WHEN outcome NOT IN ('created', 'updated') THEN 'ext-' || source_id WHEN key % 5 <> 0 THEN 'x-' || source_id
                   WHEN outcome = 'updated' THEN 'ext-' || source_id ELSE source_id END AS ext
              FROM o WHERE key % 10 < 7 OR outcome = 'created')
        SELECT entity_type, source_id, ext AS external_id, CASE WHEN hit THEN ext END AS target_guid,
               CAST(CASE WHEN outcome = 'updated' THEN 2 ELSE 1 END AS INTEGER) AS sync_version,
               CASE WHEN hit OR key % 10 >= 3 THEN hash ELSE sha256('stale|' || source_id) END AS last_hash,
               CASE WHEN hit THEN {_NOW} ELSE TIMESTAMP '2024-01-01' END AS last_synced_at,
               CASE WHEN hit THEN {_NOW} ELSE TIMESTAMP '2024-01-01' END AS last_sync,
               CASE WHEN hit THEN {_NOW} ELSE TIMESTAMP '2024-01-01' END AS last_attempt, 'synced' AS status FROM m""",
    "cdc_repeat_ids": f"""
        WITH r AS (
            SELECT l_orderkey AS key, CAST(l_orderkey AS VARCHAR) AS source_id, l_suppkey % 3 <> 0 AS ok,
                   sha256(concat_ws('|', l_partkey, CAST(floor(l_quantity / 26) AS BIGINT))) AS hash,
                   row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, {_cents('l_extendedprice')}, l_shipdate, l_returnflag, l_linestatus) AS n
            FROM lineitem
        ), p AS (
            SELECT *, coalesce((SELECT arg_max(b.hash, b.n) FROM r b WHERE b.key = a.key AND b.n < a.n AND b.ok),
                               CASE WHEN key % 4 = 0 THEN sha256('old') END) AS prev FROM r a
        ), w AS (SELECT *, coalesce(hash = prev, false) AS same FROM p),
        o AS (
            SELECT *, CASE WHEN same THEN 'skipped' WHEN NOT ok THEN 'failed'
                WHEN (key % 4 = 0 AND key % 8 <> 0) OR coalesce(bool_or(ok AND NOT same) OVER (PARTITION BY key ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false)
                THEN 'updated' ELSE 'created' END AS outcome FROM w
        )
        SELECT source_id, count(*) AS processed, {_COUNTS}, count(*) FILTER (outcome = 'skipped') AS skipped FROM o GROUP BY source_id""",
    "cdc_hot_ids": """
        WITH r AS (SELECT event_type AS source_id, event_id AS pos, event_id % 13 <> 0 AS ok, CAST(floor(value / 40) AS BIGINT) AS v FROM events),
        p AS (SELECT *, last_value(CASE WHEN ok THEN v END IGNORE NULLS) OVER (PARTITION BY source_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM r),
        w AS (SELECT *, bool_or(ok AND v IS DISTINCT FROM prev) OVER (PARTITION BY source_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS wrote FROM p)
        SELECT source_id, pos, CASE WHEN v = prev THEN 'skipped' WHEN NOT ok THEN 'failed' WHEN source_id = 'click' OR wrote THEN 'updated' ELSE 'created' END AS outcome FROM w""",
    "history_append": f"""
        SELECT row_number() OVER (ORDER BY key) AS id, source_id,
               CASE WHEN outcome = 'failed' THEN NULL WHEN key % 5 <> 0 THEN 'x-' || source_id ELSE source_id END AS external_id,
               CASE WHEN outcome = 'failed' THEN 'failed' ELSE 'synced' END AS status,
               CASE WHEN outcome = 'failed' THEN 'Failed to sync rental_order ' || source_id || ': rejected' END AS details, {_NOW} AS created_at
        FROM (SELECT *, {_outcome()} AS outcome FROM ({_fetched('rental_order')})) WHERE outcome <> 'skipped'""",
    "dead_letter_append": f"""
        SELECT row_number() OVER (ORDER BY doc_id) AS id, 'customer' AS entity_type, CAST(doc_id AS VARCHAR) AS source_id,
               substr('Failed to sync customer ' || doc_id || ': ' || text, 1, 1000) AS error, substr(text, 1, 5000) AS payload, {_NOW} AS created_at FROM documents""",
    "dead_letter_list": f"""
        SELECT row_number() OVER (ORDER BY doc_id) AS id, 'customer' AS entity_type, CAST(doc_id AS VARCHAR) AS source_id,
               substr('Failed to sync customer ' || doc_id || ': ' || text, 1, 1000) AS error, {_NOW} AS created_at FROM documents ORDER BY id DESC LIMIT 50""",
    "dead_letter_clear": "SELECT count(*) AS cleared FROM documents WHERE lang = 'fr'",
    "lookup_forward": f"SELECT source_id, CASE WHEN key % 10 < 7 THEN 'ext-' || source_id END AS external_id FROM ({_fetched('customer')})",
    "lookup_reverse": f"SELECT 'ext-' || source_id AS target, CASE WHEN key % 10 < 7 THEN source_id END AS source_id FROM ({_fetched('customer')})",
    "duplicate_test": f"SELECT source_id, key % 10 BETWEEN 3 AND 6 AS is_duplicate FROM ({_fetched('customer')})",
    "mapping_exists": f"SELECT source_id FROM {_STORED}",
    "mapping_find": f"""SELECT entity_type, source_id, 'ext-' || source_id AS external_id, CAST(NULL AS VARCHAR) AS target_guid, 1 AS sync_version,
        CASE WHEN key % 10 < 3 THEN sha256('stale|' || source_id) ELSE hash END AS last_hash, {_NOW} AS last_synced_at, {_NOW} AS last_sync, {_NOW} AS last_attempt,
        'synced' AS status FROM {_STORED} WHERE source_id = '42'""",
    "mapping_delete": f"SELECT source_id, 'ext-' || source_id AS external_id FROM {_STORED} WHERE key % 3 <> 0",
    "mapping_update": f"""SELECT source_id, CASE WHEN key % 4 = 0 THEN 'stale' ELSE 'synced' END AS status, CASE WHEN key % 4 = 0 THEN 7 ELSE 1 END AS sync_version,
        CASE WHEN key % 4 = 0 THEN TIMESTAMP '2024-01-21' ELSE {_NOW} END AS last_attempt FROM {_STORED}""",
    "checkpoint_upsert": f"""SELECT event_type AS entity_type, strftime(arg_max(ts, event_id), '%Y-%m-%d %H:%M:%S') AS last_sync_at, {_NOW} AS updated_at FROM events GROUP BY 1
        UNION ALL SELECT 'other', '1999-01-01 00:00:00', NULL""",
    "enqueue_dedup": f"""
        SELECT row_number() OVER (ORDER BY entity_type) AS id, entity_type, payload, 'Pending' AS status, 0 AS attempts, 3 AS max_attempts, {_NOW} AS created_at,
               {_NOW} - INTERVAL 10 SECOND AS scheduled_at
        FROM (SELECT entity_type, min(payload) AS payload FROM {_FINE} GROUP BY 1)
        WHERE entity_type NOT IN (SELECT entity_type FROM {_FINE} WHERE status IN {_ACTIVE})""",
    "claim_next": f"""SELECT id, entity_type, payload, status, attempts, max_attempts FROM {_JOBS}
        WHERE status IN ('Pending', 'Waiting', 'Retry') AND scheduled_at <= {_NOW} ORDER BY id LIMIT 1""",
    "claim_state": f"""
        WITH c AS (SELECT min(id) AS id FROM {_JOBS} WHERE status IN ('Pending', 'Waiting', 'Retry') AND scheduled_at <= {_NOW}),
        j AS (SELECT CASE WHEN q.id = c.id THEN 'Running' ELSE status END AS status FROM {_JOBS} q LEFT JOIN c ON true)
        SELECT {', '.join(f'{x} AS "{s}"' for s, x in _EVERY.items())} FROM j""",
    "job_transition": f"""
        WITH r AS (SELECT *, (['timeout','http','value','request','non_retryable'])[id % 5 + 1] AS kind, CASE WHEN id % 2 = 0 THEN 503 ELSE 404 END AS code FROM {_JOBS} WHERE status = 'Running'),
        d AS (SELECT *, CASE WHEN id % 4 = 1 THEN 'Completed' WHEN attempts + 1 < 3 AND (kind IN ('timeout', 'request') OR (kind = 'http' AND code = 503)) THEN 'Waiting' ELSE 'Failed' END AS next FROM r)
        SELECT id, next AS status, CAST(CASE WHEN next = 'Completed' THEN attempts ELSE attempts + 1 END AS INTEGER) AS attempts,
               CASE WHEN next <> 'Completed' THEN 'error ' || id END AS error_message,
               CASE WHEN next = 'Waiting' THEN {_NOW} + CASE WHEN attempts = 0 THEN INTERVAL 300 SECOND ELSE INTERVAL 900 SECOND END ELSE scheduled_at END AS scheduled_at FROM d""",
    "retry_classify": """
        SELECT event_id, kind, code, CASE WHEN kind IN ('retryable', 'timeout', 'connection', 'request', 'os') THEN true WHEN kind <> 'http' THEN false
               WHEN code IN (400, 401, 403, 404, 422) THEN false ELSE true END AS retryable
        FROM (SELECT event_id, (['non_retryable','retryable','timeout','connection','http','request','os','value','other'])[event_id % 9 + 1] AS kind,
                     ([400,401,403,404,409,422,429,500,501,502,503,504,NULL])[CAST(floor(event_id / 9) AS BIGINT) % 13 + 1] AS code FROM events)""",
    "backoff_schedule": """SELECT event_id, CAST(user_id % 10 - 1 AS INTEGER) AS n, ([300,900,1800,3600,21600,86400])[greatest(user_id % 10 - 1, 1)] AS delay FROM events""",
    "requeue_failed": f"""WITH j AS (SELECT * FROM {_FINE})
        SELECT max(id) AS id, entity_type FROM j WHERE status = 'Failed' AND entity_type NOT IN (SELECT entity_type FROM j WHERE status IN {_ACTIVE}) GROUP BY entity_type""",
    "enqueue_counts": f"""SELECT count(*) FILTER (NOT busy) AS enqueued, count(*) FILTER (busy) AS duplicates
        FROM (SELECT entity_type, bool_or(status IN {_ACTIVE}) AS busy FROM {_FINE} GROUP BY 1)""",
    "scheduled_enqueue": f"""SELECT true AS auto_sync, row_number() OVER (ORDER BY entity_type) AS id, entity_type, {_NOW} AS scheduled_at
        FROM (SELECT entity_type FROM {_FINE} GROUP BY 1 HAVING NOT bool_or(status IN {_ACTIVE}))""",
    "legacy_upsert": f"""SELECT source_id, CASE WHEN key % 10 BETWEEN 3 AND 6 AND key % 2 = 1 THEN 'skipped' WHEN key % 13 = 0 THEN 'failed'
            WHEN key % 2 = 0 OR key % 10 < 7 THEN 'updated' ELSE 'created' END AS outcome,
        CASE WHEN key % 2 = 1 AND key % 10 < 3 THEN sha256('stale|' || source_id) WHEN key % 2 = 1 AND key % 10 < 7 THEN hash END AS last_hash,
        CAST(CASE WHEN key % 2 = 0 AND key % 10 < 7 THEN 2 WHEN key % 2 = 0 OR key % 10 < 7 THEN 1 END AS INTEGER) AS sync_version
        FROM ({_fetched('customer')})""",
    "migration_hashes": """SELECT p_partkey, sha256('{"brand": "' || p_brand || '", "more": {"a": "' || p_name || '", "z": "' || p_type || '"}, "size": ' || p_size || '}') AS hash FROM part""",
    "checkpoint_get": "SELECT strftime(arg_max(ts, event_id), '%Y-%m-%d %H:%M:%S') AS last_sync_at FROM events WHERE event_type = 'click'",
    "file_stamps": "SELECT event_id, strftime(ts, '%Y%m%d_%H%M%S') AS stamp FROM events",
    "map_defaults": """SELECT user_id, coalesce(max(n) FILTER (event_type = 'purchase'), 0) AS purchases, coalesce(max(n) FILTER (event_type = 'signup'), -1) AS signups
        FROM (SELECT user_id, event_type, count(*) AS n FROM events WHERE value > 50 GROUP BY 1, 2) GROUP BY 1""",
    "sync_hot": _HOT,
    "sync_streamed": _HOT,
    "queue_work": f"""
        WITH r AS (SELECT *, (['timeout','http','value','request','non_retryable'])[id % 5 + 1] AS kind, CASE WHEN id % 2 = 0 THEN 503 ELSE 404 END AS code,
                   status IN ('Pending', 'Waiting', 'Retry') AND scheduled_at <= {_NOW} AS due FROM {_JOBS}),
        d AS (SELECT *, CASE WHEN NOT due THEN status WHEN id % 4 = 1 THEN 'Completed' WHEN attempts + 1 < 3 AND (kind IN ('timeout', 'request') OR (kind = 'http' AND code = 503)) THEN 'Waiting' ELSE 'Failed' END AS next FROM r),
        j AS (SELECT next AS status, CAST(CASE WHEN due AND next <> 'Completed' THEN attempts + 1 ELSE attempts END AS INTEGER) AS attempts,
                     CASE WHEN due AND next = 'Waiting' THEN {_NOW} + CASE WHEN attempts = 0 THEN INTERVAL 300 SECOND ELSE INTERVAL 900 SECOND END ELSE scheduled_at END AS scheduled_at FROM d)
        SELECT status, attempts, count(*) AS jobs, max(scheduled_at) AS last FROM j GROUP BY 1, 2""",
    "log_files_tail": f"SELECT line FROM ({_LOG}) ORDER BY event_id DESC LIMIT 100",
    "backup_restored": f"""SELECT source_id, 'ext-' || source_id AS external_id, 1 AS sync_version, CASE WHEN key % 10 < 3 THEN sha256('stale|' || source_id) ELSE hash END AS last_hash FROM {_STORED}""",
    "sync_run": f"""WITH o AS (SELECT *, {_outcome()} AS outcome FROM ({_fetched('customer')})), failed AS (SELECT count(*) AS n FROM o WHERE outcome = 'failed'),
        first AS (SELECT count(*) FILTER (outcome IN ('created', 'updated')) AS n FROM o)
        SELECT 'run 1' AS name, first.n AS rows, failed.n AS last FROM first, failed UNION ALL SELECT 'run 2', 0, n FROM failed
        UNION ALL SELECT 'mapping', count(*) FILTER (key % 10 < 7 OR outcome = 'created'), 2 FROM o
        UNION ALL SELECT 'history', first.n + 2 * failed.n, first.n + 2 * failed.n FROM first, failed UNION ALL SELECT 'dead_letters', 2 * n, 2 * n FROM failed""",
    "order_lines_nested": f"""SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(o_custkey AS VARCHAR) AS customer_id, o_orderstatus AS status,
        CAST(to_json(coalesce(lines, [])) AS VARCHAR) AS lines, o_totalprice AS total_amount FROM orders LEFT JOIN (
            SELECT l_orderkey, list({{'line': l_linenumber, 'equipment_id': CAST(l_partkey AS VARCHAR), 'quantity': CAST(l_quantity AS INTEGER), 'price_cents': {_cents('l_extendedprice')}}}
                ORDER BY l_linenumber, CAST(l_partkey AS VARCHAR), CAST(l_quantity AS INTEGER), {_cents('l_extendedprice')}) AS lines FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""",
    "queue_metrics": f"""SELECT {', '.join(f'{x} AS "{s}"' for s, x in _EVERY.items())} FROM {_JOBS}""",
    "status_metrics": f"""SELECT count(*) AS current_queue, count(*) FILTER (status IN ('Pending', 'Waiting')) AS pending_jobs, {_EVERY['Running']} AS running_jobs,
        {_EVERY['Completed']} AS completed_jobs, {_EVERY['Failed']} AS failed_jobs FROM {_JOBS}""",
    "recent_jobs": f"SELECT id, entity_type, status, attempts, error_message, created_at, updated_at, scheduled_at FROM {_JOBS} ORDER BY id DESC LIMIT 50",
    "active_violations": f"SELECT entity_type, count(*) AS n FROM {_JOBS} WHERE status IN {_ACTIVE} GROUP BY 1 HAVING count(*) > 1",
    "alias_route": """SELECT event_id, name, CASE lower(name) WHEN 'customers' THEN 'customer' WHEN 'customer' THEN 'customer' WHEN 'equipment' THEN 'equipment' WHEN 'product' THEN 'equipment'
            WHEN 'rental_orders' THEN 'rental_order' WHEN 'rental_order' THEN 'rental_order' WHEN 'orders' THEN 'rental_order' WHEN 'invoices' THEN 'invoice' WHEN 'invoice' THEN 'invoice'
            WHEN 'payments' THEN 'payment' WHEN 'payment' THEN 'payment' ELSE 'all' END AS entity
        FROM (SELECT event_id, (['customers','customer','equipment','product','rental_orders','rental_order','orders','invoices','invoice','payments','payment','Customers','unknown','','ORDERS'])[event_id % 15 + 1] AS name FROM events)""",
    "iso_date_format": """SELECT o_orderkey, CASE WHEN o_orderkey % 5 IN (0, 3) THEN strftime(o_orderdate, '%Y-%m-%d 00:00:00')
        WHEN o_orderkey % 5 = 4 THEN 'no date' ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS formatted FROM orders""",
    "xml_envelope": f"""SELECT p_partkey, '{_ENVELOPE}' || p_brand || ' --></TALLYMESSAGE></REQUESTDATA></IMPORTDATA></BODY></ENVELOPE>' AS envelope FROM part""",
    "license_check": "SELECT c_custkey, least(c_custkey % 11, length(c_mktsegment)) = 0 OR least(c_custkey % 11, length(c_mktsegment)) >= 8 AS valid FROM customer",
    "fingerprint": """
        WITH d AS (SELECT s_suppkey, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(s_name)) AS h FROM supplier)
        SELECT s_suppkey, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', 1 + CAST('0x' || substr(h, 17, 1) AS INTEGER) % 4, 1) || substr(h, 18, 3)
               || '-' || substr(h, 21, 12) AS fingerprint FROM d""",
    "scalar_helpers": """SELECT p_partkey, 'http://x/' || p_brand AS url, upper(substr(p_type, 1, 1)) || lower(substr(p_type, 2)) AS capital, p_partkey / 4 AS mb,
        greatest(1, p_size - 25) AS minutes, p_brand AS base, CASE WHEN p_size % 3 = 0 THEN 'paused' WHEN p_size % 2 = 0 THEN 'active' ELSE 'stopped' END AS scheduler, p_brand AS chosen FROM part""",
    "log_format": _LOG,
    "log_tail": f"SELECT * FROM ({_LOG}) ORDER BY event_id DESC LIMIT 100",
    "log_scan": """SELECT CASE WHEN event_id % 2 = 0 THEN 'Queue' ELSE event_type END AS component, count(*) AS lines,
        count(*) FILTER (event_id % 3 = 0) AS timed FROM events GROUP BY 1""",
    "backup_list": "SELECT 'state_backup_' || event_id || '.db' AS filename, user_id AS size_bytes, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS created_at FROM events",
    "backup_purge": "SELECT '/b/state_backup_' || event_id || '.db' AS path FROM events WHERE ts < TIMESTAMP '2024-02-15' - INTERVAL 30 DAY",
    "system_status": f"""SELECT 'active' AS status, '1.0.0' AS middleware_version, 'active' AS scheduler_status, 'valid' AS license_status, count(*) AS current_queue,
        count(*) FILTER (status IN ('Pending', 'Waiting')) AS pending_jobs, '2024-01-20T00:00:00Z' AS timestamp FROM {_JOBS}""",
    "batch_slices": """SELECT CAST(floor((n - 1) / 100) AS BIGINT) AS batch, count(*) AS n, min(c_custkey) AS first
        FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS n FROM customer) GROUP BY 1""",
}
