"""Schemas of the entities, of the state tables, and of what a push returns."""

from __future__ import annotations

from pyspark.sql import types as T



LINE = "equipment_id STRING, quantity INT, unit_price DOUBLE, rental_start_date STRING, rental_end_date STRING"

#: Declared entities. They describe the payloads; nothing rejects other fields.
ENTITIES = {
    "customer": "id STRING, name STRING, phone STRING, email STRING, address STRING, gstin_tax_id STRING",
    "equipment": "id STRING, name STRING, code_sku STRING, category STRING, daily_rate DOUBLE, monthly_rate DOUBLE, stock_quantity INT",
    "rental_order": f"id STRING, order_number STRING, customer_id STRING, order_date STRING, status STRING, lines ARRAY<STRUCT<{LINE.replace(' STRING', ': STRING').replace(' INT', ': INT').replace(' DOUBLE', ': DOUBLE')}>>, total_amount DOUBLE",
    "invoice": "id STRING, invoice_number STRING, rental_order_id STRING, customer_id STRING, invoice_date STRING, due_date STRING, subtotal DOUBLE, tax_amount DOUBLE, total_amount DOUBLE",
    "payment": "id STRING, payment_number STRING, customer_id STRING, invoice_id STRING, rental_order_id STRING, payment_date STRING, amount DOUBLE, payment_type STRING, payment_mode STRING",
}

#: Values that a declared entity's missing fields take.
DEFAULTS = {
    "equipment": {"daily_rate": 0.0, "monthly_rate": 0.0, "stock_quantity": 1},
    "rental_order": {"status": "draft", "total_amount": 0.0},
    "invoice": {"subtotal": 0.0, "tax_amount": 0.0, "total_amount": 0.0},
    "payment": {"amount": 0.0, "payment_type": "rental_payment", "payment_mode": "bank"},
}

MAPPING = (
    "entity_type STRING, source_id STRING, external_id STRING, target_guid STRING, sync_version INT, last_hash STRING, "
    "last_synced_at TIMESTAMP_NTZ, last_sync TIMESTAMP_NTZ, last_attempt TIMESTAMP_NTZ, status STRING"
)
HISTORY = (
    "id BIGINT, entity_type STRING, source_id STRING, external_id STRING, target_guid STRING, status STRING, "
    "details STRING, created_at TIMESTAMP_NTZ"
)
DEAD_LETTERS = "id BIGINT, entity_type STRING, source_id STRING, error STRING, payload STRING, created_at TIMESTAMP_NTZ"
RUNS = (
    "version BIGINT, stream STRING, batch_id BIGINT, entity_type STRING, processed BIGINT, created BIGINT, updated BIGINT, failed BIGINT, skipped BIGINT, "
    "duration_ms DOUBLE, finished_at TIMESTAMP_NTZ"
)
CHECKPOINTS = "entity_type STRING, last_sync_at STRING, updated_at TIMESTAMP_NTZ"
JOBS = (
    "id BIGINT, entity_type STRING, payload STRING, status STRING, attempts INT, max_attempts INT, error_message STRING, "
    "created_at TIMESTAMP_NTZ, updated_at TIMESTAMP_NTZ, scheduled_at TIMESTAMP_NTZ"
)
PUSHED = "success BOOLEAN, external_id STRING, error STRING, data STRING"
LOG = (
    "timestamp STRING, level STRING, logger STRING, component STRING, message STRING, duration_ms DOUBLE, "
    "metadata MAP<STRING, STRING>, exception STRING"
)

# The names that jobs may use for an entity, and the order of a full sync.
ALIASES = {
    "customers": "customer", "customer": "customer",
    "equipment": "equipment", "product": "equipment",
    "rental_orders": "rental_order", "rental_order": "rental_order", "orders": "rental_order",
    "invoices": "invoice", "invoice": "invoice",
    "payments": "payment", "payment": "payment",
}
ENTITY_ORDER = ("customer", "equipment", "rental_order", "invoice", "payment")
QUEUE_NAMES = ("customers", "equipment", "rental_orders", "invoices", "payments")
ENDPOINTS = {
    "customer": "/api/customers", "equipment": "/api/equipment", "rental_order": "/api/rental-orders",
    "invoice": "/api/invoices", "payment": "/api/payments",
}

# The states of a job, and those that block another job for the entity.
JOB_STATES = ("Pending", "Running", "Retry", "Completed", "Failed", "Waiting")
ACTIVE_STATES = ("Pending", "Running", "Waiting", "Retry")
CLAIMABLE_STATES = ("Pending", "Waiting", "Retry")


def struct(ddl: str) -> T.StructType:
    """The schema of a DDL string."""
    return T.StructType.fromDDL(ddl)
