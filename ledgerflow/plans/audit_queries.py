"""Registered queries for audit (A).

The audit log is the activity log derived from the event stream (one INSERT
per event into the table named by its type); customer snapshots give the
before/after pair for change audit (second version: name changed when
id % 10 = 0, row dropped when id % 17 = 0).
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import audit, snapshots, staging
from ..session import ensure_checkpoint_dir
from . import staging_queries as sq
from .registry import query

AS_OF = "2024-01-31"


def audit_log(b):
    e = b.event_log
    tx = F.get_json_object("payload", "$.k").cast("long")
    record = F.to_json(F.struct(F.col("event_id"), tx.alias("transaction_id"), F.col("idempotency_key")),
                       {"ignoreNullFields": "false"})
    return e.select(F.col("event_id").alias("audit_id"), F.lower("event_type").alias("table_name"),
                    F.lit("INSERT").alias("operation"), record.alias("record"),
                    F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("changed_by"),
                    F.col("created_at").alias("changed_at"))


_LOG_SQL = """alog AS (SELECT event_id AS audit_id, lower(event_type) AS table_name, 'INSERT' AS operation,
       to_json({'event_id': event_id, 'transaction_id': TRY_CAST(json_extract_string(payload, '$.k') AS BIGINT),
                'idempotency_key': idempotency_key}) AS record,
       'user' || CAST(user_id AS VARCHAR) AS changed_by, created_at AS changed_at FROM event_log)"""

_CHAIN_SQL = f"""WITH RECURSIVE {_LOG_SQL},
lg AS (SELECT *, row_number() OVER (PARTITION BY table_name ORDER BY audit_id) AS rn FROM alog),
chain AS (SELECT lg.*, CAST(NULL AS VARCHAR) AS prev_hash, md5(table_name || operation || record) AS row_hash FROM lg WHERE rn = 1
          UNION ALL
          SELECT lg.*, c.row_hash AS prev_hash, md5(c.row_hash || lg.table_name || lg.operation || lg.record) AS row_hash
          FROM lg JOIN chain c ON lg.table_name = c.table_name AND lg.rn = c.rn + 1)"""


@query("hash_chain", "A1", views=["event_log"], oracle=_CHAIN_SQL + "\nSELECT * EXCLUDE (rn) FROM chain")
def _hash_chain(b):
    return audit.hash_chain(audit_log(b), "table_name", ["audit_id"])


@query("verify_hash_chain", "A2", views=["event_log"], oracle=_CHAIN_SQL + """,
v AS (SELECT *, lag(row_hash) OVER (PARTITION BY table_name ORDER BY audit_id) AS expected FROM chain)
SELECT table_name, audit_id, prev_hash, row_hash,
       CASE WHEN row_hash <> md5(COALESCE(prev_hash, '') || table_name || operation || record) THEN 'ALTERED_ROW'
            ELSE 'BROKEN_LINK' END AS problem
FROM v WHERE prev_hash IS DISTINCT FROM expected OR row_hash <> md5(COALESCE(prev_hash, '') || table_name || operation || record)""")
def _verify_hash_chain(b):
    return audit.verify_hash_chain(audit.hash_chain(audit_log(b), "table_name", ["audit_id"]))


# the same log after tampering: records and hashes blanked, rows changed, and the last row of each chain cut off
_TAMPERED_SQL = _CHAIN_SQL + """,
tails AS (SELECT table_name, max_by(row_hash, audit_id) AS tail_hash, MAX(audit_id) AS last_id FROM chain GROUP BY table_name),
tam AS (SELECT c.table_name, c.audit_id, c.operation, CASE WHEN c.audit_id % 53 = 0 THEN NULL ELSE CAST(c.record AS VARCHAR) END AS record, c.prev_hash,
               CASE WHEN c.audit_id % 59 = 0 THEN NULL WHEN c.audit_id % 61 = 0 THEN md5('x') ELSE c.row_hash END AS row_hash
        FROM chain c JOIN tails t ON c.table_name = t.table_name WHERE c.audit_id < t.last_id),
v AS (SELECT *, lag(row_hash) OVER (PARTITION BY table_name ORDER BY audit_id) AS expected,
             md5(COALESCE(prev_hash, '') || table_name || operation || COALESCE(record, '')) AS again FROM tam)
SELECT table_name, audit_id, prev_hash, row_hash, CASE WHEN row_hash IS DISTINCT FROM again THEN 'ALTERED_ROW' ELSE 'BROKEN_LINK' END AS problem
FROM v WHERE prev_hash IS DISTINCT FROM expected OR row_hash IS DISTINCT FROM again
UNION ALL
SELECT t.table_name, l.audit_id, NULL, l.row_hash, 'MISSING_TAIL' FROM tails t
LEFT JOIN (SELECT table_name, MAX(audit_id) AS audit_id, max_by(row_hash, audit_id) AS any_hash, arg_max_null(row_hash, audit_id) AS row_hash
           FROM tam GROUP BY table_name) l ON l.table_name = t.table_name
WHERE l.row_hash IS DISTINCT FROM t.tail_hash"""


@query("verify_hash_chain_tampered", "A2", views=["event_log"], oracle=_TAMPERED_SQL)
def _verify_hash_chain_tampered(b):
    log = audit.hash_chain(audit_log(b), "table_name", ["audit_id"])
    tails = log.groupBy("table_name").agg(F.max_by("row_hash", "audit_id").alias("tail_hash"), F.max("audit_id").alias("_last"))
    i = F.col("audit_id")
    tampered = (log.join(tails.select("table_name", "_last"), "table_name").where(i < F.col("_last")).drop("_last")
                .withColumn("record", F.when(i % 53 != 0, F.col("record")))
                .withColumn("row_hash", F.when(i % 59 == 0, F.lit(None)).when(i % 61 == 0, F.md5(F.lit("x"))).otherwise(F.col("row_hash"))))
    return audit.verify_hash_chain(tampered, tails=tails.select("table_name", "tail_hash"))


# ---- two-level chain: segments per table, day and block of ids, and anchors over their last hashes ----

SEGMENT_IDS = 256

_SEG_SQL = f"""WITH RECURSIVE {_LOG_SQL},
seg AS (SELECT *, (CAST(date_diff('day', DATE '1970-01-01', CAST(changed_at AS DATE)) AS BIGINT) + 1) * 4294967296 + audit_id // {SEGMENT_IDS} AS segment_no FROM alog),
lg AS (SELECT *, table_name || '|' || CAST(segment_no AS VARCHAR) AS segment, row_number() OVER (PARTITION BY table_name, segment_no ORDER BY audit_id) AS rn FROM seg),
chain AS (SELECT lg.*, CAST(NULL AS VARCHAR) AS prev_hash, md5(table_name || operation || record) AS row_hash FROM lg WHERE rn = 1
          UNION ALL
          SELECT lg.*, c.row_hash AS prev_hash, md5(c.row_hash || lg.table_name || lg.operation || lg.record) AS row_hash
          FROM lg JOIN chain c ON lg.segment = c.segment AND lg.rn = c.rn + 1),
heads AS (SELECT table_name, segment_no, segment, COUNT(*) AS n_rows, MAX(audit_id) AS last_id, max_by(row_hash, audit_id) AS head_hash,
                 row_number() OVER (PARTITION BY table_name ORDER BY segment_no) AS rn FROM chain GROUP BY table_name, segment_no, segment),
anchors AS (SELECT heads.*, CAST(NULL AS VARCHAR) AS prev_hash, md5(segment || CAST(n_rows AS VARCHAR) || head_hash) AS row_hash FROM heads WHERE rn = 1
            UNION ALL
            SELECT h.*, a.row_hash AS prev_hash, md5(a.row_hash || h.segment || CAST(h.n_rows AS VARCHAR) || h.head_hash) AS row_hash
            FROM heads h JOIN anchors a ON h.table_name = a.table_name AND h.rn = a.rn + 1)"""


def _segments(b):
    return audit.segment_chain(audit_log(b), segment_ids=SEGMENT_IDS)


@query("hash_chain_segments", "A1", views=["event_log"], oracle=_SEG_SQL + "\nSELECT * EXCLUDE (rn) FROM chain")
def _hash_chain_segments(b):
    return _segments(b)


@query("hash_chain_anchors", "A1", views=["event_log"], oracle=_SEG_SQL + "\nSELECT * EXCLUDE (rn) FROM anchors")
def _hash_chain_anchors(b):
    return audit.anchor_chain(_segments(b))


@query("hash_chain_global", "A1", views=["event_log"], oracle=f"""WITH {_LOG_SQL},
folded AS (SELECT list_reduce(list_concat([['']], list([table_name || operation || record] ORDER BY audit_id)),
                              lambda a, x: list_append(a, md5(a[len(a)] || x[1]))) AS h FROM alog),
lg AS (SELECT *, row_number() OVER (ORDER BY audit_id) AS rn FROM alog)
SELECT lg.* EXCLUDE (rn), 'audit_log' AS log_name, CASE WHEN rn > 1 THEN h[rn] END AS prev_hash, h[rn + 1] AS row_hash FROM lg, folded""")
def _hash_chain_global(b):
    """The one chain over all tables that the base schema keeps: inherently one fold, streamed in constant memory."""
    return audit.hash_chain(audit_log(b).withColumn("log_name", F.lit("audit_log")), "log_name", ["audit_id"])


# one row in 97 altered, the last row of every seventh segment cut off, every eleventh anchor's count forged
_SEG_TAMPERED_SQL = _SEG_SQL + """,
tam AS (SELECT c.* REPLACE (CASE WHEN c.audit_id % 97 = 0 THEN '{}' ELSE CAST(c.record AS VARCHAR) END AS record)
        FROM chain c JOIN heads h ON h.segment = c.segment WHERE NOT (h.segment_no % 7 = 0 AND c.audit_id = h.last_id)),
forged AS (SELECT * REPLACE (CASE WHEN segment_no % 11 = 0 THEN n_rows + 1 ELSE n_rows END AS n_rows) FROM anchors),
v AS (SELECT *, lag(row_hash) OVER (PARTITION BY segment ORDER BY audit_id) AS expected, md5(COALESCE(prev_hash, '') || table_name || operation || record) AS again FROM tam),
ends AS (SELECT segment, MAX(audit_id) AS last_id, max_by(row_hash, audit_id) AS row_hash, COUNT(*) AS n FROM tam GROUP BY segment)
SELECT segment, audit_id, CASE WHEN row_hash <> again THEN 'ALTERED_ROW' ELSE 'BROKEN_LINK' END AS problem FROM v
WHERE prev_hash IS DISTINCT FROM expected OR row_hash <> again
UNION ALL
SELECT f.segment, e.last_id, 'MISSING_TAIL' FROM forged f LEFT JOIN ends e ON e.segment = f.segment WHERE e.row_hash IS DISTINCT FROM f.head_hash
UNION ALL
SELECT e.segment, e.last_id, 'WRONG_COUNT' FROM ends e JOIN forged f ON f.segment = e.segment WHERE e.n <> f.n_rows
UNION ALL
SELECT segment, last_id, 'ANCHOR_ALTERED_ROW' FROM forged
WHERE row_hash <> md5(COALESCE(prev_hash, '') || segment || CAST(n_rows AS VARCHAR) || head_hash)"""


@query("verify_segments_tampered", "A1", views=["event_log"], oracle=_SEG_TAMPERED_SQL)
def _verify_segments_tampered(b):
    log = _segments(b)
    anchors = audit.anchor_chain(log)
    i, cut = F.col("audit_id"), F.col("segment_no") % 7 == 0
    tampered = (log.join(anchors.where(cut).select("segment", F.col("last_id").alias("_last")), "segment", "left")
                .where(F.col("_last").isNull() | (i != F.col("_last"))).drop("_last")
                .withColumn("record", F.when(i % 97 == 0, F.lit("{}")).otherwise(F.col("record"))))
    forged = anchors.withColumn("n_rows", F.when(F.col("segment_no") % 11 == 0, F.col("n_rows") + 1).otherwise(F.col("n_rows")))
    return audit.verify_segments(tampered, forged)


def cust_before(b):
    return b.customers.select("customer_id", "client_id", "customer_name",
                              F.concat(F.lit("note-"), F.col("customer_id").cast("string")).alias("internal_notes"))


def cust_after(b):
    c = cust_before(b).where(F.col("customer_id") % 17 != 0)
    return c.withColumn("customer_name", F.when(F.col("customer_id") % 10 == 0,
                                                F.concat(F.col("customer_name"), F.lit(" (renamed)")))
                        .otherwise(F.col("customer_name")))


_SNAP_SQL = """cb AS (SELECT customer_id, client_id, customer_name, 'note-' || CAST(customer_id AS VARCHAR) AS internal_notes FROM customers),
ca AS (SELECT customer_id, client_id,
              CASE WHEN customer_id % 10 = 0 THEN customer_name || ' (renamed)' ELSE customer_name END AS customer_name, internal_notes
       FROM cb WHERE customer_id % 17 <> 0)"""


@query("change_audit", "A3", views=["customers"], oracle=f"""WITH {_SNAP_SQL}
SELECT 'customers' AS table_name, o.customer_id AS record_id, 'DELETE' AS operation, '*ROW*' AS field_name,
       CAST(to_json({{'customer_id': o.customer_id, 'client_id': o.client_id, 'customer_name': o.customer_name,
                'internal_notes': o.internal_notes}}) AS VARCHAR) AS old_value, CAST(NULL AS VARCHAR) AS new_value
FROM cb o WHERE NOT EXISTS (SELECT 1 FROM ca n WHERE n.customer_id = o.customer_id)
UNION ALL
SELECT 'customers', o.customer_id, 'UPDATE', 'customer_name', o.customer_name, n.customer_name
FROM cb o JOIN ca n ON o.customer_id = n.customer_id WHERE o.customer_name IS DISTINCT FROM n.customer_name""")
def _change_audit(b):
    return audit.change_audit(cust_before(b), cust_after(b), "customer_id", "customers")


@query("change_audit_json", "A4", views=["customers"], oracle=f"""WITH {_SNAP_SQL}
SELECT 'customers' AS table_name, 'DELETE' AS operation, o.customer_id AS record_id,
       to_json({{'customer_id': o.customer_id, 'client_id': o.client_id, 'customer_name': o.customer_name,
                'internal_notes': o.internal_notes}}) AS old_values, CAST(NULL AS VARCHAR) AS new_values,
       CAST([] AS VARCHAR[]) AS fields_changed, o.client_id
FROM cb o WHERE NOT EXISTS (SELECT 1 FROM ca n WHERE n.customer_id = o.customer_id)
UNION ALL
SELECT 'customers', 'UPDATE', o.customer_id,
       to_json({{'customer_id': o.customer_id, 'client_id': o.client_id, 'customer_name': o.customer_name,
                'internal_notes': o.internal_notes}}),
       to_json({{'customer_id': n.customer_id, 'client_id': n.client_id, 'customer_name': n.customer_name,
                'internal_notes': n.internal_notes}}),
       ['customer_name'], n.client_id
FROM cb o JOIN ca n ON o.customer_id = n.customer_id WHERE o.customer_name IS DISTINCT FROM n.customer_name""")
def _change_audit_json(b):
    return audit.change_audit_json(cust_before(b), cust_after(b), "customer_id", "customers")


# written snapshots: every hundredth name changed, some rows dropped and some added, so that most buckets are equal
def _snapshot_pair(b):
    base = ensure_checkpoint_dir(b.spark).rstrip("/") + f"/snapshots/{uuid.uuid4().hex}"
    old = cust_before(b)
    k = F.col("customer_id")
    new = old.where(k % 170 != 3).withColumn("customer_name", F.when(k % 100 == 0, F.concat("customer_name", F.lit(" (renamed)"))).otherwise(F.col("customer_name")))
    new = new.unionByName(old.where(k % 300 == 7).withColumn("customer_id", k + 1_000_000))
    before = snapshots.Snapshot(b.spark, f"{base}/before").write(old, "customer_id")
    after = snapshots.Snapshot(b.spark, f"{base}/after").write(new, "customer_id")
    schema = "customer_id long, client_id int, customer_name string, internal_notes string"
    return before, after, schema


_PAIR_SQL = _SNAP_SQL.split(",\nca AS")[0] + """,
ca AS (SELECT customer_id, client_id, CASE WHEN customer_id % 100 = 0 THEN customer_name || ' (renamed)' ELSE customer_name END AS customer_name, internal_notes
       FROM cb WHERE customer_id % 170 <> 3
       UNION ALL SELECT customer_id + 1000000, client_id, customer_name, internal_notes FROM cb WHERE customer_id % 300 = 7)"""


def _whole_row(kind: str, old: str, new: str) -> str:
    row = "CAST(to_json({'customer_id': x.customer_id, 'client_id': x.client_id, 'customer_name': x.customer_name, 'internal_notes': x.internal_notes}) AS VARCHAR)"
    pick = (row, "CAST(NULL AS VARCHAR)") if kind == "DELETE" else ("CAST(NULL AS VARCHAR)", row)
    return (f"SELECT 'customers' AS table_name, x.customer_id AS record_id, '{kind}' AS operation, '*ROW*' AS field_name, {pick[0]} AS old_value, {pick[1]} AS new_value "
            f"FROM {old} x WHERE NOT EXISTS (SELECT 1 FROM {new} n WHERE n.customer_id = x.customer_id)")


@query("change_audit_buckets", "A3", views=["customers"], oracle=f"""WITH {_PAIR_SQL}
{_whole_row("DELETE", "cb", "ca")}
UNION ALL {_whole_row("INSERT", "ca", "cb")}
UNION ALL SELECT 'customers', o.customer_id, 'UPDATE', 'customer_name', o.customer_name, n.customer_name
FROM cb o JOIN ca n ON o.customer_id = n.customer_id WHERE o.customer_name IS DISTINCT FROM n.customer_name""")
def _change_audit_buckets(b):
    before, after, schema = _snapshot_pair(b)
    return audit.change_audit(*snapshots.changed_rows(before, after, schema), "customer_id", "customers")


@query("change_audit_json_buckets", "A4", views=["customers"], oracle=f"""WITH {_PAIR_SQL},
j AS (SELECT 'cb' AS side, customer_id, client_id, customer_name, CAST(to_json({{'customer_id': customer_id, 'client_id': client_id, 'customer_name': customer_name,
             'internal_notes': internal_notes}}) AS VARCHAR) AS js FROM cb
      UNION ALL SELECT 'ca', customer_id, client_id, customer_name, CAST(to_json({{'customer_id': customer_id, 'client_id': client_id, 'customer_name': customer_name,
             'internal_notes': internal_notes}}) AS VARCHAR) FROM ca),
o AS (SELECT * FROM j WHERE side = 'cb'), n AS (SELECT * FROM j WHERE side = 'ca')
SELECT 'customers' AS table_name, CASE WHEN o.side IS NULL THEN 'INSERT' WHEN n.side IS NULL THEN 'DELETE' ELSE 'UPDATE' END AS operation,
       COALESCE(n.customer_id, o.customer_id) AS record_id, o.js AS old_values, n.js AS new_values,
       CASE WHEN o.side IS NOT NULL AND n.side IS NOT NULL THEN ['customer_name'] ELSE CAST([] AS VARCHAR[]) END AS fields_changed,
       COALESCE(n.client_id, o.client_id) AS client_id
FROM o FULL JOIN n ON o.customer_id = n.customer_id WHERE o.js IS DISTINCT FROM n.js""")
def _change_audit_json_buckets(b):
    before, after, schema = _snapshot_pair(b)
    return audit.change_audit_json(*snapshots.changed_rows(before, after, schema), "customer_id", "customers")


@query("append_only_buckets", "A13", views=["customers"], oracle=f"""WITH {_PAIR_SQL}
SELECT o.customer_id, CASE WHEN n.customer_id IS NULL THEN 'DELETE' ELSE 'UPDATE' END AS violation
FROM cb o LEFT JOIN ca n ON o.customer_id = n.customer_id
WHERE n.customer_id IS NULL OR o.customer_name IS DISTINCT FROM n.customer_name""")
def _append_only_buckets(b):
    before, after, schema = _snapshot_pair(b)
    return audit.append_only_violations(*snapshots.changed_rows(before, after, schema), "customer_id")


@query("redacted_audit", "A5", views=["customers"], oracle=f"""WITH {_SNAP_SQL},
d AS (SELECT o.customer_id AS record_id, 'DELETE' AS operation,
             to_json({{'customer_id': o.customer_id, 'client_id': o.client_id, 'customer_name': o.customer_name}}) AS old_values,
             CAST(NULL AS VARCHAR) AS new_values
      FROM cb o WHERE NOT EXISTS (SELECT 1 FROM ca n WHERE n.customer_id = o.customer_id)
      UNION ALL
      SELECT o.customer_id, 'UPDATE',
             to_json({{'customer_id': o.customer_id, 'client_id': o.client_id, 'customer_name': o.customer_name}}),
             to_json({{'customer_id': n.customer_id, 'client_id': n.client_id, 'customer_name': n.customer_name}})
      FROM cb o JOIN ca n ON o.customer_id = n.customer_id WHERE o.customer_name IS DISTINCT FROM n.customer_name)
SELECT 'customers' AS table_name, record_id, operation, COALESCE(new_values, old_values) AS rec_transact,
       md5(old_values) AS prev_hash, md5(new_values) AS row_hash FROM d""")
def _redacted_audit(b):
    return audit.redacted_audit(cust_before(b), cust_after(b), "customer_id", "customers")


@query("user_audit_trail", "A6", views=["event_log"], oracle=f"""WITH {_LOG_SQL}
SELECT * FROM alog WHERE changed_by = 'user7' AND changed_at >= TIMESTAMP '{AS_OF}' - INTERVAL 10 DAY
  AND changed_at <= TIMESTAMP '{AS_OF}' ORDER BY changed_at DESC, audit_id DESC""")
def _user_audit_trail(b):
    return audit.user_audit_trail(audit_log(b), "user7", 10, AS_OF)


@query("change_summary", "A11", views=["event_log"], oracle=f"""WITH {_LOG_SQL}
SELECT changed_by, operation, table_name, COUNT(*) AS change_count, MAX(changed_at) AS last_change
FROM alog GROUP BY changed_by, operation, table_name""")
def _change_summary(b):
    return audit.change_summary(audit_log(b))


@query("recent_events", "A12", views=["event_log"], oracle=f"""WITH {_LOG_SQL}
SELECT * FROM alog ORDER BY changed_at DESC, audit_id DESC LIMIT 20""")
def _recent_events(b):
    return audit.recent_events(audit_log(b), 20)


def lifecycle(b):
    t = b.transactions
    ts = F.col("date").cast("timestamp")
    return t.select((F.col("transaction_id") * 10).alias("lifecycle_id"), "transaction_id", "client_id",
                    F.lit(None).cast("string").alias("previous_state"), F.lit("DRAFT").alias("new_state"),
                    ts.alias("changed_at"), F.lit("system").alias("changed_by"), F.lit("created").alias("reason"))


def state_changes(b):
    t = b.transactions
    ts = F.col("date").cast("timestamp")
    steps = F.array(
        F.struct(F.lit(1).alias("n"), F.lit("POSTED").alias("state"), F.lit(1).alias("days")),
        F.when(F.col("st") == "F", F.struct(F.lit(2).alias("n"), F.lit("PAID").alias("state"), F.lit(30).alias("days")))
         .when(F.col("st") == "P", F.struct(F.lit(2).alias("n"), F.lit("PENDING_PAYMENT").alias("state"),
                                           F.lit(15).alias("days"))))
    x = t.select("transaction_id", "client_id", ts.alias("ts"), F.inline(F.array_compact(steps)))
    return x.select((F.col("transaction_id") * 10 + F.col("n")).alias("lifecycle_id"), "transaction_id", "client_id",
                    F.col("state").alias("new_state"), (F.col("ts") + F.make_dt_interval(F.col("days"))).alias("changed_at"),
                    F.lit("system").alias("changed_by"), F.lit("workflow").alias("reason"))


_LIFE_SQL = """life0 AS (SELECT transaction_id * 10 AS lifecycle_id, transaction_id, client_id, CAST(NULL AS VARCHAR) AS previous_state,
                  'DRAFT' AS new_state, CAST(date AS TIMESTAMP) AS changed_at, 'system' AS changed_by, 'created' AS reason FROM transactions),
chg AS (SELECT transaction_id * 10 + 1 AS lifecycle_id, transaction_id, client_id, 'POSTED' AS new_state,
               CAST(date AS TIMESTAMP) + INTERVAL 1 DAY AS changed_at, 'system' AS changed_by, 'workflow' AS reason FROM transactions
        UNION ALL
        SELECT transaction_id * 10 + 2, transaction_id, client_id, CASE st WHEN 'F' THEN 'PAID' ELSE 'PENDING_PAYMENT' END,
               CAST(date AS TIMESTAMP) + CASE st WHEN 'F' THEN INTERVAL 30 DAY ELSE INTERVAL 15 DAY END, 'system', 'workflow'
        FROM transactions WHERE st IN ('F', 'P')),
life1 AS (SELECT c.lifecycle_id, c.transaction_id, c.client_id,
                 COALESCE(lag(c.new_state) OVER (PARTITION BY c.transaction_id ORDER BY c.changed_at, c.lifecycle_id), s.seed) AS previous_state,
                 c.new_state, c.changed_at, c.changed_by, c.reason
          FROM chg c LEFT JOIN (SELECT transaction_id, arg_max(new_state, (changed_at, lifecycle_id)) AS seed FROM life0
                                GROUP BY transaction_id) s ON c.transaction_id = s.transaction_id)"""


@query("record_state_change", "A8", views=["transactions"], oracle=f"WITH {_LIFE_SQL}\nSELECT * FROM life1")
def _record_state_change(b):
    return audit.record_state_change(lifecycle(b), state_changes(b))


@query("state_history", "A12", views=["transactions"], oracle=f"""WITH {_LIFE_SQL}
SELECT * FROM (SELECT * FROM life0 UNION ALL SELECT * FROM life1) x ORDER BY transaction_id, changed_at, lifecycle_id""")
def _state_history(b):
    return audit.state_history(lifecycle(b).unionByName(audit.record_state_change(lifecycle(b), state_changes(b))))


def decisions(b):
    _wf, approvals = sq.approved(b)
    inv = sq.stg(b).select(F.col("id").alias("staging_record_id"), F.col("invoice_date").try_cast("timestamp").alias("_t"))
    rows = None
    for a in approvals:
        r = a.join(inv, "staging_record_id").select(
            (F.col("staging_record_id") * 10 + F.col("approval_level")).alias("approval_id"),
            F.col("staging_record_id").alias("transaction_id"), "approval_level", "approver", "decision",
            (F.col("_t") + F.make_dt_interval(F.col("approval_level"))).alias("decided_at"),
            F.lit(None).cast("string").alias("comments"))
        rows = r if rows is None else rows.unionByName(r)
    rej = staging.reject(sq.workflows(b), 1997).where(F.col("new_state") == "REJECT").join(inv, "staging_record_id").select(
        (F.col("staging_record_id") * 10).alias("approval_id"), F.col("staging_record_id").alias("transaction_id"),
        F.lit(1).alias("approval_level"), F.lit("approver1").alias("approver"), F.lit("REJECTED").alias("decision"),
        (F.col("_t") + F.make_dt_interval(F.lit(1))).alias("decided_at"), F.col("notes").alias("comments"))
    return rows.unionByName(rej)


_DECISIONS_SQL = sq._APPROVE_SQL[len("WITH "):] + """,
dec AS (SELECT staging_record_id * 10 + 1 AS approval_id, staging_record_id AS transaction_id, 1 AS approval_level,
               'approver1' AS approver, 'APPROVED' AS decision, TRY_CAST(s.invoice_date AS TIMESTAMP) + INTERVAL 1 DAY AS decided_at,
               CAST(NULL AS VARCHAR) AS comments FROM wf2 JOIN stg s ON s.id = wf2.staging_record_id WHERE wf2.new_state = 'VALID'
        UNION ALL
        SELECT staging_record_id * 10 + 2, staging_record_id, 2, 'approver2', 'APPROVED', TRY_CAST(s.invoice_date AS TIMESTAMP) + INTERVAL 2 DAY,
               NULL FROM l1 JOIN stg s ON s.id = l1.staging_record_id WHERE l1.new_state = 'APPROVE_L1'
        UNION ALL
        SELECT staging_record_id * 10 + 3, staging_record_id, 3, 'approver3', 'APPROVED', TRY_CAST(s.invoice_date AS TIMESTAMP) + INTERVAL 3 DAY,
               NULL FROM l2 JOIN stg s ON s.id = l2.staging_record_id WHERE l2.new_state = 'APPROVE_L2'
        UNION ALL
        SELECT staging_record_id * 10, staging_record_id, 1, 'approver1', 'REJECTED', TRY_CAST(s.invoice_date AS TIMESTAMP) + INTERVAL 1 DAY,
               'REJECTED' FROM wf JOIN stg s ON s.id = wf.staging_record_id
        WHERE wf.session_id = 1997 AND ((wf.new_state = 'DRAFT' AND wf.previous_state IS NULL)
                                        OR (wf.new_state = 'PENDING' AND wf.previous_state = 'DRAFT')))"""


@query("record_approval", "A9", views=sq.STG_VIEWS, oracle=f"""WITH {_DECISIONS_SQL}
SELECT approval_id, transaction_id, approval_level, approver, decision, decided_at,
       CASE WHEN decision = 'APPROVED' THEN decided_at END AS approved_at, comments FROM dec""")
def _record_approval(b):
    return audit.record_approval(decisions(b))


def detailed_events(b):
    e = b.event_log
    return e.select("event_id", "event_type", F.lit("BUSINESS").alias("event_category"), F.lit("INFO").alias("severity"),
                    F.concat(F.lit("Event "), F.col("event_id").cast("string")).alias("description"), "payload",
                    F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("triggered_by"),
                    F.col("created_at").alias("triggered_at"),
                    F.get_json_object("payload", "$.k").cast("long").alias("transaction_id"),
                    F.lit(None).cast("int").alias("client_id"))


@query("log_events", "A10", views=["event_log"], oracle="""
SELECT event_id, event_type, 'BUSINESS' AS event_category, 'INFO' AS severity, 'Event ' || CAST(event_id AS VARCHAR) AS description,
       payload, 'user' || CAST(user_id AS VARCHAR) AS triggered_by, created_at AS triggered_at,
       TRY_CAST(json_extract_string(payload, '$.k') AS BIGINT) AS transaction_id, CAST(NULL AS INT) AS client_id,
       md5(event_type || '::' || CAST(TRY_CAST(json_extract_string(payload, '$.k') AS BIGINT) AS VARCHAR) || '::'
           || strftime(created_at, '%Y-%m-%d %H:%M:%S.%f')) AS idempotency_key, 'LOGGED' AS status
FROM event_log""")
def _log_events(b):
    return audit.log_events(detailed_events(b))


@query("transaction_audit", "A7", views=sq.STG_VIEWS + ["transactions", "event_log"], oracle=f"""WITH {_LIFE_SQL}, {_LOG_SQL},
{_DECISIONS_SQL}
SELECT transaction_id, 'STATE_CHANGE' AS event_kind, changed_at AS event_time,
       concat_ws(' -> ', COALESCE(previous_state, 'NONE'), new_state) AS detail FROM (SELECT * FROM life0 UNION ALL SELECT * FROM life1) l
UNION ALL
SELECT transaction_id, 'APPROVAL', decided_at, concat_ws(' ', 'L' || CAST(approval_level AS VARCHAR), decision, 'by', approver) FROM dec
UNION ALL
SELECT CAST(json_extract_string(record, '$.transaction_id') AS BIGINT), 'AUDIT_LOG', changed_at, concat_ws(' ', operation, table_name)
FROM alog WHERE json_extract_string(record, '$.transaction_id') IS NOT NULL""")
def _transaction_audit(b):
    life = lifecycle(b).unionByName(audit.record_state_change(lifecycle(b), state_changes(b)))
    return audit.transaction_audit(life, audit.record_approval(decisions(b)), audit_log(b))


@query("append_only_violations", "A13", views=["customers"], oracle=f"""WITH {_SNAP_SQL}
SELECT o.customer_id, CASE WHEN n.customer_id IS NULL THEN 'DELETE' ELSE 'UPDATE' END AS violation
FROM cb o LEFT JOIN ca n ON o.customer_id = n.customer_id
WHERE n.customer_id IS NULL OR o.customer_name IS DISTINCT FROM n.customer_name OR o.client_id IS DISTINCT FROM n.client_id
   OR o.internal_notes IS DISTINCT FROM n.internal_notes""")
def _append_only_violations(b):
    return audit.append_only_violations(cust_before(b), cust_after(b), "customer_id")
