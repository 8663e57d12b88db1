"""E1–E7 — the event-log processor in batch form.

Events are parsed with a declared JSON schema (no inference), routed by type
with one projection, de-duplicated on their idempotency key (P11) and handed
to the posting operators as whole DataFrames.  The reference's per-event
sub-transaction and retry counter become an attempts table folded with a
group-by (E7); the streaming form lives in ``ledgerflow.streaming``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PAYLOAD_SCHEMA = T.StructType([
    T.StructField("product_id", T.StringType()),
    T.StructField("warehouse_id", T.StringType()),
    T.StructField("quantity", T.StringType()),
    T.StructField("price", T.StringType()),
    T.StructField("action_type", T.StringType()),
    T.StructField("customer_id", T.StringType()),
    T.StructField("supplier_id", T.StringType()),
    T.StructField("ref_id", T.StringType()),
    T.StructField("client_id", T.StringType()),
    T.StructField("date", T.StringType()),
    T.StructField("idempotency_key", T.StringType()),
    T.StructField("vendor_id", T.StringType()),
    T.StructField("amount", T.StringType()),
    T.StructField("invoice_date", T.StringType()),
    T.StructField("bill_date", T.StringType()),
    T.StructField("due_date", T.StringType()),
    T.StructField("status", T.StringType()),
])

# Event type → handler.
HANDLERS = {"SALE": "handle_sale", "PURCHASE": "handle_purchase", "RETURN": "handle_return",
            "RECEIVABLE": "handle_receivable", "PAYABLE": "handle_payable"}


def parse_events(event_log: DataFrame) -> DataFrame:
    """Typed payload fields (the ``->>`` + cast of the reference), bad values → NULL, never an error."""
    p = F.from_json(F.col("payload"), PAYLOAD_SCHEMA)
    e = event_log.withColumn("_p", p)
    status = F.col("event_status") if "event_status" in event_log.columns else F.lit("PENDING")
    return e.select(
        "event_id", "event_type", "created_at", "idempotency_key",
        F.col("_p.product_id").try_cast("long").alias("product_id"),
        F.col("_p.warehouse_id").try_cast("int").alias("warehouse_id"),
        F.col("_p.quantity").try_cast("int").alias("quantity"),
        F.col("_p.price").try_cast("decimal(15,2)").alias("price"),
        F.col("_p.action_type").alias("action_type"),
        F.col("_p.customer_id").try_cast("long").alias("customer_id"),
        F.col("_p.supplier_id").try_cast("long").alias("supplier_id"),
        F.col("_p.ref_id").try_cast("long").alias("ref_id"),
        F.col("_p.client_id").try_cast("int").alias("client_id"),
        F.col("_p.date").try_cast("date").alias("event_date"),
        F.coalesce(F.col("_p.idempotency_key"), F.col("idempotency_key")).alias("payload_key"),
        F.col("_p.vendor_id").try_cast("long").alias("vendor_id"),
        F.col("_p.amount").try_cast("decimal(15,2)").alias("amount"),
        F.col("_p.invoice_date").try_cast("date").alias("invoice_date"),
        F.col("_p.bill_date").try_cast("date").alias("bill_date"),
        F.col("_p.due_date").try_cast("date").alias("due_date"),
        F.col("_p.status").alias("document_status"), status.alias("event_status"))


def route_events(events: DataFrame) -> DataFrame:
    """Handler per PENDING event; unknown types are FAILED with 'Unknown event type'.

    Events in another state have been handled before and are not picked up again."""
    events = events.where(F.col("event_status") == "PENDING")
    m = F.create_map(*[x for k, v in HANDLERS.items() for x in (F.lit(k), F.lit(v))])
    h = m[F.col("event_type")]
    return events.select("*", h.alias("handler"),
                         F.when(h.isNull(), "FAILED").otherwise("ROUTED").alias("route_status"),
                         F.when(h.isNull(), F.lit("Unknown event type")).alias("route_error"))


def for_handler(routed: DataFrame, handler: str) -> DataFrame:
    return routed.where(F.col("handler") == handler)


def retry_state(attempts: DataFrame, max_attempts: int = 3) -> DataFrame:
    """Per event: failures so far and status — PROCESSED once an attempt succeeded,
    FAILED at ``max_attempts`` failures, otherwise PENDING (to be retried)."""
    g = attempts.groupBy("event_id").agg(
        F.count_if(F.col("outcome") == "FAILURE").alias("retry_count"),
        F.bool_or(F.col("outcome") == "SUCCESS").alias("_ok"),
        F.max("attempted_at").alias("last_attempt_at"))
    status = (F.when(F.col("_ok"), "PROCESSED").when(F.col("retry_count") >= max_attempts, "FAILED")
               .otherwise("PENDING"))
    return g.select("event_id", "retry_count", status.alias("status"), "last_attempt_at")
