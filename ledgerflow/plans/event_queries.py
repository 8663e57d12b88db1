"""Registered queries for the event processor (E1–E8).

The bridge event_log carries a thin payload; the processor's input is the same
events with a full payload derived from their own fields (product = payload k,
warehouse = user % 3 + 1, quantity = k % 10 + 1, price = amount, customer =
user, supplier = vendor = user % 100 + 1, client = user % 5 + 1, date = event
day, invoice and bill date = the day before, due k % 45 days after it, status
Paid for every fifth user and Pending otherwise).  Every seventh sale or purchase event is a RETURN of
document k, and every nineteenth event has been processed already.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.money import MONEY
from ..operators import costing, events, posting
from ..streaming import events as stream_events
from ..streaming import retry as stream_retry
from . import posting_queries as pq
from .registry import query


def event_input(b):
    e = b.event_log
    k = F.get_json_object("payload", "$.k")
    trade = F.when(F.col("event_type") == "SALE", "Sale").when(F.col("event_type") == "PURCHASE", "Purchase")
    back = trade.isNotNull() & (F.col("event_id") % 7 == 0)
    action = F.when(back, F.concat(trade, F.lit(" Return"))).otherwise(trade)
    day = F.col("created_at").cast("date")
    payload = F.to_json(F.struct(
        k.alias("product_id"), (F.col("user_id") % 3 + 1).cast("string").alias("warehouse_id"),
        (k.cast("long") % 10 + 1).cast("string").alias("quantity"), F.col("amount").cast("string").alias("price"),
        action.alias("action_type"), F.col("user_id").cast("string").alias("customer_id"),
        (F.col("user_id") % 100 + 1).cast("string").alias("supplier_id"),
        F.when(back, k).alias("ref_id"), (F.col("user_id") % 5 + 1).cast("string").alias("client_id"),
        day.cast("string").alias("date"), F.col("idempotency_key"), (F.col("user_id") % 100 + 1).cast("string").alias("vendor_id"),
        F.col("amount").cast("string").alias("amount"), F.date_sub(day, 1).cast("string").alias("invoice_date"),
        F.date_sub(day, 1).cast("string").alias("bill_date"),
        F.date_add(day, (k.cast("long") % 45).cast("int") - 1).cast("string").alias("due_date"),
        F.when(F.col("user_id") % 5 == 0, "Paid").otherwise("Pending").alias("status")))
    return e.select("event_id", F.when(back, "RETURN").otherwise(F.col("event_type")).alias("event_type"), "created_at", "idempotency_key",
                    "user_id", "amount", payload.alias("payload"),
                    F.when(F.col("event_id") % 19 == 0, "PROCESSED").otherwise("PENDING").alias("event_status"))


_EV_SQL = """evin AS (SELECT event_id, event_type AS trade, CASE WHEN event_type IN ('SALE', 'PURCHASE') AND event_id % 7 = 0 THEN 'RETURN'
       ELSE event_type END AS event_type, created_at, idempotency_key, user_id, amount, CAST(created_at AS DATE) AS day,
       json_extract_string(payload, '$.k') AS k FROM event_log),
parsed AS (SELECT event_id, event_type, created_at, idempotency_key,
       TRY_CAST(k AS BIGINT) AS product_id, CAST(user_id % 3 + 1 AS INT) AS warehouse_id,
       CAST(TRY_CAST(k AS BIGINT) % 10 + 1 AS INT) AS quantity, amount AS price,
       CASE trade WHEN 'SALE' THEN 'Sale' WHEN 'PURCHASE' THEN 'Purchase' END || CASE event_type WHEN 'RETURN' THEN ' Return' ELSE '' END AS action_type,
       user_id AS customer_id, user_id % 100 + 1 AS supplier_id,
       CASE event_type WHEN 'RETURN' THEN TRY_CAST(k AS BIGINT) END AS ref_id,
       CAST(user_id % 5 + 1 AS INT) AS client_id, day AS event_date,
       idempotency_key AS payload_key, user_id % 100 + 1 AS vendor_id, amount, CAST(day - 1 AS DATE) AS invoice_date,
       CAST(day - 1 AS DATE) AS bill_date, CAST(day - 1 + CAST(TRY_CAST(k AS BIGINT) % 45 AS INT) AS DATE) AS due_date,
       CASE WHEN user_id % 5 = 0 THEN 'Paid' ELSE 'Pending' END AS document_status,
       CASE WHEN event_id % 19 = 0 THEN 'PROCESSED' ELSE 'PENDING' END AS event_status FROM evin)"""


def parsed(b):
    return events.parse_events(event_input(b))


@query("parse_events", "E1", views=["event_log"], money=["price", "amount"], oracle=f"WITH {_EV_SQL}\nSELECT * FROM parsed")
def _parse_events(b):
    return parsed(b)


_ROUTE_SQL = """CASE event_type WHEN 'SALE' THEN 'handle_sale' WHEN 'PURCHASE' THEN 'handle_purchase'
     WHEN 'RETURN' THEN 'handle_return' WHEN 'RECEIVABLE' THEN 'handle_receivable' WHEN 'PAYABLE' THEN 'handle_payable' END"""


@query("route_events", "E2", views=["event_log"], money=["price", "amount"], oracle=f"""WITH {_EV_SQL}
SELECT *, {_ROUTE_SQL} AS handler, CASE WHEN {_ROUTE_SQL} IS NULL THEN 'FAILED' ELSE 'ROUTED' END AS route_status,
       CASE WHEN {_ROUTE_SQL} IS NULL THEN 'Unknown event type' END AS route_error FROM parsed WHERE event_status = 'PENDING'""")
def _route_events(b):
    return events.route_events(parsed(b))


def _fresh(b, handler: str):
    r = events.for_handler(events.route_events(parsed(b)), handler)
    req = r.withColumnRenamed("event_id", "request_id").drop("idempotency_key") \
           .withColumnRenamed("payload_key", "idempotency_key")
    d = posting.dedupe_idempotent(req, b.transactions)
    return posting.assign_ids(d["fresh"], b.transactions, "transaction_id", ["request_id"], "transaction_id")


def _fresh_sql(event_type: str) -> str:
    return f"""{_EV_SQL},
sel AS (SELECT * FROM parsed WHERE event_type = '{event_type}' AND event_status = 'PENDING'),
win AS (SELECT payload_key, MIN(event_id) AS w FROM sel GROUP BY payload_key),
fresh AS (SELECT s.* FROM sel s JOIN win ON s.payload_key = win.payload_key AND s.event_id = win.w
          WHERE NOT EXISTS (SELECT 1 FROM transactions t WHERE t.idempotency_key = s.payload_key)),
num AS (SELECT f.*, (SELECT MAX(transaction_id) FROM transactions) + row_number() OVER (ORDER BY event_id) AS transaction_id
        FROM fresh f)"""


_PURCHASE_EV_SQL = f"""SELECT transaction_id, client_id, 'PURCHASE' AS kind,
       event_date AS date, CAST(NULL AS BIGINT) AS amount, quantity * CAST(price * 100 AS BIGINT) AS net,
       CAST(FLOOR(CAST(quantity * CAST(price * 100 AS BIGINT) * {pq.VAT_BP} + 5000 AS DECIMAL(38,0)) / 10000) AS BIGINT) AS tax,
       quantity * CAST(price * 100 AS BIGINT)
         + CAST(FLOOR(CAST(quantity * CAST(price * 100 AS BIGINT) * {pq.VAT_BP} + 5000 AS DECIMAL(38,0)) / 10000) AS BIGINT) AS gross,
       CAST(NULL AS BIGINT) AS cost, CAST(NULL AS BIGINT) AS value FROM num"""


@query("handle_purchase", "E4", views=pq.COA_VIEWS + ["event_log", "transactions"], money=["amount"],
       oracle="WITH " + _fresh_sql("PURCHASE") + ",\n" + pq._legs_sql(_PURCHASE_EV_SQL)[len("WITH "):] + "\nSELECT * FROM legs")
def _handle_purchase(b):
    return purchase_legs(b, _fresh(b, "handle_purchase"))


def purchases(f):
    return f.select("transaction_id", "client_id", "product_id", "warehouse_id", "quantity",
                    (F.col("price") * 100).cast("long").alias("unit_cost_cents"), F.col("event_date").alias("date"))


def purchase_legs(b, f):
    return posting.post_purchase(purchases(f), pq.role_map(b), pq.VAT_BP)["journals"]


_SALE_TAIL = pq._SALE_SQL_BASE[pq._SALE_SQL_BASE.index("\ns AS (") + 1:]


@query("handle_sale", "E3", views=pq.COA_VIEWS + ["event_log", "transactions", "layers"], money=["amount"],
       oracle="WITH " + _fresh_sql("SALE") + """,
sales AS (SELECT transaction_id AS sale_id, product_id, client_id, event_date AS sale_date, quantity,
                 CAST(price * 100 AS BIGINT) AS unit_price_cents FROM num),
""" + _SALE_TAIL + ",\n" + pq._legs_sql(pq._SALE_EV_SQL)[len("WITH "):] + "\nSELECT * FROM legs")
def _handle_sale(b):
    return sale_legs(b, _fresh(b, "handle_sale"))


def sale_slices(f, layers):
    """What the sale events take from the layers, first in first out."""
    sold = f.select(F.col("transaction_id").alias("sale_id"), "product_id", F.col("event_date").alias("sale_date"), "quantity")
    layers = layers.join(sold.select("product_id").distinct(), "product_id", "left_semi")
    return costing.allocate_layers(sold, layers, "fifo")


def sales(f):
    return f.select("transaction_id", "client_id", "product_id", "warehouse_id", "quantity",
                    (F.col("price") * 100).cast("long").alias("unit_price_cents"), F.col("event_date").alias("date"))


def sale_legs(b, f):
    return posting.post_sale(sales(f), sale_slices(f, b.layers), pq.role_map(b), pq.VAT_BP)["journals"]


_RETURN_EV_SQL = """SELECT transaction_id, client_id,
       CASE action_type WHEN 'Sale Return' THEN 'SALE_RETURN' WHEN 'Purchase Return' THEN 'PURCHASE_RETURN' END AS kind, event_date AS date,
       CAST(NULL AS BIGINT) AS amount, CAST(NULL AS BIGINT) AS net, CAST(NULL AS BIGINT) AS tax, CAST(NULL AS BIGINT) AS gross,
       quantity * CAST(price * 100 AS BIGINT) AS cost, quantity * CAST(price * 100 AS BIGINT) AS value FROM num"""


@query("handle_return", "E5", views=pq.COA_VIEWS + ["event_log", "transactions"], money=["amount"],
       oracle="WITH " + _fresh_sql("RETURN") + ",\n" + pq._legs_sql(_RETURN_EV_SQL)[len("WITH "):] + "\nSELECT * FROM legs")
def _handle_return(b):
    return return_legs(b, _fresh(b, "handle_return"))


def returns(f):
    return f.select("transaction_id", "client_id", "action_type", "quantity",
                    (F.col("price") * 100).cast("long").alias("unit_price_cents"),
                    (F.col("price") * 100).cast("long").alias("unit_cost_cents"), F.col("event_date").alias("date"),
                    F.col("ref_id").alias("document_id"))


def return_legs(b, f):
    docs = b.ar_ext.select(F.col("transaction_id").alias("document_id"), "status")
    return posting.post_returns(returns(f), docs, pq.role_map(b))["journals"]


def _doc_events(b, handler: str, party: str):
    r = events.for_handler(events.route_events(parsed(b)), handler)
    return _doc_requests(r, party)


def _doc_requests(r, party: str):
    # the document's own fields; an event without them falls back on its date
    dated = F.coalesce("invoice_date" if party == "customer_id" else "bill_date", "event_date")
    return r.select(F.col("event_id").alias("request_id"), "client_id", F.col(party),
                    F.col("amount").cast(MONEY).alias("amount"), dated.alias("invoice_date"),
                    "due_date", F.coalesce("document_status", F.lit("Pending")).alias("status"),
                    F.col("payload_key").alias("idempotency_key"))


_DOC_EV_REQ = {
    "RECEIVABLE": "req AS (SELECT event_id AS request_id, client_id, customer_id, CAST(amount AS DECIMAL(15,2)) AS amount, "
                  "invoice_date, due_date, document_status AS status, "
                  "payload_key AS idempotency_key FROM parsed WHERE event_type = 'RECEIVABLE' AND event_status = 'PENDING')",
    "PAYABLE": "req AS (SELECT event_id AS request_id, client_id, CAST(vendor_id AS BIGINT) AS vendor_id, CAST(amount AS DECIMAL(15,2)) AS amount, "
               "bill_date AS invoice_date, due_date, document_status AS status, "
               "payload_key AS idempotency_key FROM parsed WHERE event_type = 'PAYABLE' AND event_status = 'PENDING')",
}


@query("handle_receivable", "E6", views=pq._DOC_VIEWS + ["event_log"], money=["amount"],
       oracle=pq._doc_sql("AR", _EV_SQL + ",\n" + _DOC_EV_REQ["RECEIVABLE"]) + "\nSELECT * FROM jl")
def _handle_receivable(b):
    req = _doc_events(b, "handle_receivable", "customer_id")
    return posting.post_ar(req, b.clients, b.customers, pq.role_map(b), b.transactions)["journals"]


@query("handle_payable", "E6", views=pq._DOC_VIEWS + ["event_log"], money=["amount"],
       oracle=pq._doc_sql("AP", _EV_SQL + ",\n" + _DOC_EV_REQ["PAYABLE"]) + "\nSELECT * FROM jl")
def _handle_payable(b):
    req = _doc_events(b, "handle_payable", "vendor_id")
    return posting.post_ap(req, b.clients, b.vendors, pq.role_map(b), b.transactions)["journals"]


def attempts(b):
    """Processing attempts: unknown types fail three times (one minute apart), routed events
    succeed on their first attempt."""
    r = events.route_events(parsed(b))
    n = F.when(F.col("route_status") == "FAILED", F.array(F.lit(1), F.lit(2), F.lit(3))).otherwise(F.array(F.lit(1)))
    a = r.select("event_id", "created_at", "route_status", F.explode(n).alias("attempt_no"))
    return a.select("event_id", "attempt_no",
                    F.when(F.col("route_status") == "FAILED", "FAILURE").otherwise("SUCCESS").alias("outcome"),
                    (F.col("created_at") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("attempt_no"))).alias("attempted_at"))


_RETRY_SQL = f"""WITH {_EV_SQL},
att AS (SELECT event_id, created_at, CASE WHEN {_ROUTE_SQL} IS NULL THEN 3 ELSE 1 END AS n,
               {_ROUTE_SQL} IS NULL AS failed FROM parsed WHERE event_status = 'PENDING')
SELECT event_id, CASE WHEN failed THEN n ELSE 0 END AS retry_count,
       CASE WHEN NOT failed THEN 'PROCESSED' WHEN n >= 3 THEN 'FAILED' ELSE 'PENDING' END AS status,
       created_at + INTERVAL (n) MINUTE AS last_attempt_at FROM att"""


@query("retry_state", "E7", views=["event_log"], oracle=_RETRY_SQL)
def _retry_state(b):
    return events.retry_state(attempts(b))


@query("retry_state_stream", "E7", views=["event_log"], oracle=_RETRY_SQL)
def _retry_state_stream(b):
    return stream_retry.run_retry_state_available_now(b.spark, attempts(b))


def allocate_fresh(fresh, layers):
    """The slices that the sales among routed events take from the layers."""
    return sale_slices(events.for_handler(fresh.withColumn("transaction_id", F.col("event_id")), "handle_sale"), layers)


def post_fresh(b, fresh, slices, roles):
    """Ledger legs of routed events that were not posted before; transaction_id is the event's id.

    The handlers turn their events into posting events, and one pass over the rules makes the legs of all kinds."""
    rows = fresh.withColumn("transaction_id", F.col("event_id"))
    of = lambda handler: events.for_handler(rows, handler)
    posted = [posting.purchase_events(purchases(of("handle_purchase")), pq.VAT_BP), posting.sale_events(sales(of("handle_sale")), slices, pq.VAT_BP),
              posting.return_events(returns(of("handle_return")))]
    for handler, party, post, table in (("handle_receivable", "customer_id", posting.post_ar, b.customers),
                                        ("handle_payable", "vendor_id", posting.post_ap, b.vendors)):
        # the keys have been checked, and the documents keep their events' ids
        posted.append(post(_doc_requests(of(handler), party), b.clients, table, roles, None)["events"])
    every = posting.as_events(posted[0])
    for more in posted[1:]:
        every = every.unionByName(posting.as_events(more))
    return posting.post_journals(every, roles)[0]


# the stream's key check spans all handlers: the first routed event of a key, by time, wins
_STREAM_FRESH_SQL = _EV_SQL + f""",
routed AS (SELECT * FROM parsed WHERE event_status = 'PENDING' AND {_ROUTE_SQL} IS NOT NULL),
swin AS (SELECT payload_key, event_id AS w FROM routed WHERE payload_key IS NOT NULL QUALIFY row_number() OVER (PARTITION BY payload_key ORDER BY created_at, event_id) = 1),
num AS (SELECT r.*, r.event_id AS transaction_id FROM routed r JOIN swin ON r.payload_key = swin.payload_key AND r.event_id = swin.w
        WHERE NOT EXISTS (SELECT 1 FROM transactions t WHERE t.idempotency_key = r.payload_key))"""


def _stream_part(event_type: str, middle: str, ev_sql: str) -> str:
    fresh = _STREAM_FRESH_SQL.replace("num AS (SELECT", "allnum AS (SELECT") + f",\nnum AS (SELECT * FROM allnum WHERE event_type = '{event_type}')"
    return "WITH " + fresh + ",\n" + middle + pq._legs_sql(ev_sql)[len("WITH "):] + "\nSELECT * FROM legs"


def _stream_doc_part(kind: str, event_type: str) -> str:
    fresh = _STREAM_FRESH_SQL.replace("num AS (SELECT", "allnum AS (SELECT") + f",\nparsed2 AS (SELECT * FROM allnum WHERE event_type = '{event_type}'),\n"
    req = _DOC_EV_REQ[event_type].replace("FROM parsed", "FROM parsed2")
    return (pq._doc_sql(kind, fresh + req)
            + "\nSELECT n.request_id AS transaction_id, j.leg_no, j.chart_id, j.date, j.journal, j.amount FROM jl j JOIN numbered n ON j.transaction_id = n.transaction_id")


_STREAM_SQL = "SELECT * FROM (" + "\nUNION ALL SELECT * FROM (".join(part + ")" for part in (
    _stream_part("PURCHASE", "", _PURCHASE_EV_SQL),
    _stream_part("SALE", "sales AS (SELECT transaction_id AS sale_id, product_id, client_id, event_date AS sale_date, quantity, "
                         "CAST(price * 100 AS BIGINT) AS unit_price_cents FROM num),\n" + _SALE_TAIL + ",\n", pq._SALE_EV_SQL),
    _stream_part("RETURN", "", _RETURN_EV_SQL), _stream_doc_part("AR", "RECEIVABLE"), _stream_doc_part("AP", "PAYABLE")))


@query("stream_post_events", "E8", views=pq._DOC_VIEWS + ["event_log", "layers"], money=["amount"], oracle=_STREAM_SQL)
def _stream_post_events(b):
    known = b.transactions.select(F.col("idempotency_key"), F.col("transaction_id"))
    roles = pq.role_map(b).checkpoint()  # one row per client and role, read by every batch
    return stream_events.run_available_now(b.spark, event_input(b), allocate_fresh, lambda fresh, slices: post_fresh(b, fresh, slices, roles), b.layers, known)
