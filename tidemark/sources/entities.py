"""Entity collections as records: (entity_type, source_id, pos, hash, ok, error, payload, new_external_id)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing as H
from ..functions import scalars as S

#: Key rules of the derived fixtures: how keys map to stored rows, stale hashes, and failing pushes.
STORED, STALE, FAILING = 7, 3, 13


def unwrapped(raw: DataFrame, text: str = "body") -> DataFrame:
    """The items of response bodies, each an array or an object with an array `data`: pos and item, a variant.

    A body that is an object without data, or whose data is null, is an error, except the empty object, which
    has no items. Bodies that are no JSON are errors too.
    """
    parsed = F.try_parse_json(F.col(text))
    no_json = F.raise_error(F.lit("response is no JSON")).cast("variant")
    body = F.when(parsed.isNull() & F.col(text).isNotNull(), no_json).otherwise(parsed)
    kind = F.schema_of_variant(F.col("_body"))
    inner = F.try_variant_get(F.col("_body"), "$.data", "variant")
    is_object = kind.startswith("OBJECT")
    empty = kind == "OBJECT<>"
    items = F.when(is_object & ~empty, inner).otherwise(F.col("_body"))
    checked = raw.withColumn("_body", body).withColumn(
        "_items",
        F.when(is_object & ~empty & (inner.isNull() | F.is_variant_null(inner)), F.raise_error(F.lit("response object without data")).cast("variant"))
        .when(empty, F.parse_json(F.lit("[]"))).otherwise(items),
    )
    return checked.drop("_body").lateralJoin(
        raw.sparkSession.tvf.variant_explode(F.col("_items").outer())
    ).select(*[c for c in raw.columns if c != text], "pos", F.col("value").alias("item"))


def records(items: DataFrame, entity: str) -> DataFrame:
    """Records of unwrapped items; the hash covers every delivered field."""
    text = F.to_json("item")
    return items.select(
        F.lit(entity).alias("entity_type"), S.record_id(F.try_variant_get("item", "$.id", "string")).alias("source_id"),
        "pos", F.sha2(text, 256).alias("hash"), text.alias("payload"),
    )


def updated_after(rows: DataFrame, column: str, moment) -> DataFrame:
    """Rows changed after a checkpoint; all without one. The filter reaches the source."""
    return rows if moment is None else rows.where(F.col(column) > moment)


def with_status(rows: DataFrame, column: str, status: str | None) -> DataFrame:
    """Rows of one status; all without one."""
    return rows if not status else rows.where(F.col(column) == status)


def order_lines(orders: DataFrame, lines: DataFrame) -> DataFrame:
    """Orders with their lines nested; an order without lines has none."""
    nested = lines.groupBy(F.col("l_orderkey").alias("_key")).agg(
        F.array_sort(F.collect_list(F.struct(
            F.col("l_linenumber").alias("line"), F.col("l_partkey").cast("string").alias("equipment_id"), F.col("l_quantity").cast("int").alias("quantity"),
            S.cents("l_extendedprice").alias("price_cents"),
        ))).alias("lines")
    )
    return orders.join(nested, orders["o_orderkey"] == nested["_key"], "left").select(
        F.col("o_orderkey").cast("string").alias("id"), F.col("o_custkey").cast("string").alias("customer_id"), F.col("o_orderstatus").alias("status"),
        F.coalesce("lines", F.array().cast(nested.schema["lines"].dataType)).alias("lines"), F.col("o_totalprice").alias("total_amount"),
    )


def _of(rows: DataFrame, entity: str, key: Column, fields: list[Column]) -> DataFrame:
    source_id = S.record_id(key)
    failing = key % FAILING == 0
    return rows.select(
        F.lit(entity).alias("entity_type"), source_id.alias("source_id"), key.alias("pos"), H.typed_hash(*fields).alias("hash"),
        (~failing).alias("ok"), F.when(failing, F.lit("rejected")).alias("error"), F.concat_ws("|", *fields).alias("payload"),
        F.when(key % 5 != 0, F.concat(F.lit("x-"), source_id)).alias("new_external_id"), key.alias("key"),
    )


def collection(spark: SparkSession, sf_dir: str, entity: str) -> DataFrame:
    """One entity's collection, derived from the provided tables."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = lambda c: F.col(c).cast("string")
    if entity == "customer":
        return _of(read("customer"), entity, F.col("c_custkey"), [F.col("c_name"), text("c_nationkey"), S.cents("c_acctbal").cast("string"), F.col("c_mktsegment")])
    if entity == "equipment":
        return _of(read("part"), entity, F.col("p_partkey"), [F.col("p_name"), F.col("p_brand"), F.col("p_type"), text("p_size"), S.cents("p_retailprice").cast("string")])
    if entity == "rental_order":
        return _of(read("orders"), entity, F.col("o_orderkey"), [text("o_custkey"), F.col("o_orderstatus"), S.cents("o_totalprice").cast("string"), F.date_format("o_orderdate", "yyyy-MM-dd")])
    if entity == "invoice":
        sums = read("lineitem").groupBy("l_orderkey").agg(F.sum(S.cents("l_extendedprice")).alias("subtotal"), F.sum(S.cents("l_discount")).alias("discount"), F.sum(S.cents("l_tax")).alias("tax"))
        return _of(sums, entity, F.col("l_orderkey"), [text("subtotal"), text("discount"), text("tax")])
    if entity == "payment":
        paid = read("events").where("event_type = 'purchase'")
        return _of(paid, entity, F.col("event_id"), [text("user_id"), S.cents("value").cast("string"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss")])
    raise ValueError(f"no such entity: {entity}")


def stored_mapping(fetched: DataFrame, now: Column) -> DataFrame:
    """A mapping as an earlier run would have left it for these records: most keys are known, some with another hash."""
    stale = F.sha2(F.concat(F.lit("stale|"), F.col("source_id")), 256)
    return fetched.where(F.col("key") % 10 < STORED).select(
        "entity_type", "source_id", F.concat(F.lit("ext-"), F.col("source_id")).alias("external_id"), F.lit(None).cast("string").alias("target_guid"),
        F.lit(1).alias("sync_version"), F.when(F.col("key") % 10 < STALE, stale).otherwise(F.col("hash")).alias("last_hash"),
        now.alias("last_synced_at"), now.alias("last_sync"), now.alias("last_attempt"), F.lit("synced").alias("status"),
    )
