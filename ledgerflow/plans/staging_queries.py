"""Registered queries for the staged import (G).

One import session per invoice year of the staged AR rows; ``row_number`` is the
staging id.  The DuckDB oracle rebuilds each step from the same staged rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import validators as V
from ..operators import staging
from ..session import ensure_checkpoint_dir
from .registry import query

AS_OF = "1999-01-01"

_INT_RE = r"^\s*[+-]?\d+\s*$"
_DEC_RE = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def _pint(col: str) -> str:
    return f"(CASE WHEN regexp_matches({col}, '{_INT_RE}') THEN TRY_CAST(trim({col}) AS INTEGER) END)"


def _pdec(col: str) -> str:
    return f"(CASE WHEN regexp_matches({col}, '{_DEC_RE}') THEN TRY_CAST(trim({col}) AS DECIMAL(38,10)) END)"


_STATUS_LIST = ", ".join(f"'{s}'" for s in V.AR_STATUSES)

# staged rows → sanitized rows → workflows, as DuckDB CTEs (the body continues the WITH list)
STG_SQL = f"""WITH stg AS (SELECT *, CAST(year(CAST(invoice_date AS DATE)) AS INT) AS session_id FROM stg_ar_imports),
san0 AS (
  SELECT s.*, concat_ws('; ',
      CASE WHEN c.customer_id IS NULL THEN 'Customer not found' END,
      CASE WHEN k.client_id IS NULL THEN 'Client not found' END,
      CASE WHEN NOT regexp_matches(s.amount, '{V.AMOUNT_PATTERN}') THEN 'Invalid amount format' END,
      CASE WHEN NOT regexp_matches(s.invoice_date, '{V.DATE_PATTERN}') THEN 'Invalid Date' END,
      CASE WHEN NOT regexp_matches(s.due_date, '{V.DATE_PATTERN}') THEN 'Invalid Date' END,
      CASE WHEN s.status NOT IN ({_STATUS_LIST}) THEN 'INVALID Status' END) AS errs
  FROM stg s LEFT JOIN customers c ON {_pint('s.customer_code')} = c.customer_id
             LEFT JOIN clients k ON {_pint('s.client_code')} = k.client_id),
san AS (SELECT id, customer_code, client_code, amount, invoice_date, due_date, status, session_id,
               CASE WHEN errs = '' THEN 'VALID' ELSE 'INVALID' END AS validation_status,
               NULLIF(errs, '') AS validation_errors FROM san0),
wf AS (SELECT session_id, id AS staging_record_id,
              CASE WHEN validation_status = 'VALID' THEN 'DRAFT' END AS previous_state,
              CASE WHEN validation_status = 'VALID' THEN 'PENDING' ELSE 'DRAFT' END AS new_state,
              CASE WHEN validation_status = 'VALID' THEN 'PENDING FOR VALIDATION' END AS notes FROM san),
pend AS (SELECT s.*, c.customer_id IS NOT NULL AS cust_ok, {_pdec('s.amount')} AS amt,
                TRY_CAST(s.invoice_date AS DATE) AS inv, TRY_CAST(s.due_date AS DATE) AS due
         FROM stg s JOIN wf w ON s.session_id = w.session_id AND s.id = w.staging_record_id AND w.new_state = 'PENDING'
         LEFT JOIN customers c ON {_pint('s.customer_code')} = c.customer_id),
fails AS (SELECT *,
   COALESCE((amount IS NOT NULL AND amt IS NULL) OR amt <= 0, FALSE) AS f1,
   COALESCE(inv IS NULL OR due IS NULL OR inv > due, FALSE) AS f2,
   NOT cust_ok AS f3,
   COALESCE(status NOT IN ({_STATUS_LIST}), FALSE) AS f4 FROM pend),
vlog AS (
  SELECT session_id, id AS row_number, 1 AS rule_id, 'amount' AS field_name,
         CASE WHEN f1 THEN 'INVALID: Check Amount Value!' ELSE 'Valid: Amount!' END AS validation_rule,
         amount AS actual_value, NOT f1 AS is_valid, CASE WHEN f1 THEN 'ERROR' ELSE 'INFO' END AS severity, client_code FROM fails
  UNION ALL SELECT session_id, id, 2, 'invoice_date', CASE WHEN f2 THEN 'INVALID: Check Invoice Value!' ELSE 'VALID: Invoice Date!' END,
         invoice_date, NOT f2, CASE WHEN f2 THEN 'ERROR' ELSE 'INFO' END, client_code FROM fails
  UNION ALL SELECT session_id, id, 3, 'customer_code', CASE WHEN f3 THEN 'INVALID: Customer not exists!' ELSE 'VALID: Customer!' END,
         customer_code, NOT f3, CASE WHEN f3 THEN 'ERROR' ELSE 'INFO' END, client_code FROM fails
  UNION ALL SELECT session_id, id, 4, 'status', CASE WHEN f4 THEN 'INVALID: Status Check!' ELSE 'Valid: Status!' END,
         status, NOT f4, CASE WHEN f4 THEN 'ERROR' ELSE 'INFO' END, client_code FROM fails),
wf2 AS (SELECT w.session_id, w.staging_record_id,
               CASE WHEN a.ok THEN w.new_state ELSE w.previous_state END AS previous_state,
               CASE WHEN a.ok THEN 'VALID' ELSE w.new_state END AS new_state,
               CASE WHEN a.ok THEN 'VALIDATED' ELSE w.notes END AS notes
        FROM wf w LEFT JOIN (SELECT session_id, row_number, bool_and(is_valid) AS ok FROM vlog GROUP BY session_id, row_number) a
          ON w.session_id = a.session_id AND w.staging_record_id = a.row_number),
details AS (SELECT session_id, id AS row_number, 'stg_ar_imports' AS table_name,
                   to_json({{'customer_code': customer_code, 'client_code': client_code, 'amount': amount,
                             'invoice_date': invoice_date, 'due_date': due_date, 'status': status}}) AS record_data,
                   CASE WHEN validation_status = 'VALID' THEN 'SUCCESS' ELSE 'FAILED' END AS status,
                   validation_errors AS error_message,
                   CASE WHEN validation_status = 'VALID' THEN id END AS created_record_id,
                   TRY_CAST(invoice_date AS TIMESTAMP) AS created_at FROM san),
sessions AS (SELECT session_id, 1 AS client_id, 'ar' AS import_type, 'importer' AS imported_by,
                    MIN(created_at) AS started_at, MAX(created_at) AS completed_at,
                    CASE WHEN count_if(status = 'FAILED') = 0 THEN 'SUCCESS' WHEN count_if(status = 'SUCCESS') = 0 THEN 'FAILED'
                         ELSE 'PARTIAL_SUCCESS' END AS status,
                    COUNT(*) AS total_records, count_if(status = 'SUCCESS') AS successful_records,
                    count_if(status = 'FAILED') AS failed_records,
                    CASE WHEN count_if(status = 'FAILED') > 0 THEN CAST(count_if(status = 'FAILED') AS VARCHAR) || ' records failed' END AS error_summary
             FROM details GROUP BY session_id)"""

STG_VIEWS = ["stg_ar_imports", "customers", "clients"]


def stg(b):
    return b.stg_ar_imports.withColumn("session_id", F.year(F.col("invoice_date").cast("date")).cast("int"))


def sanitized(b):
    return staging.sanitize_ar(stg(b), b.customers, b.clients)


def workflows(b):
    return staging.workflows_after_sanitize(sanitized(b))


def validated(b):
    return staging.validate_ar(stg(b), workflows(b), b.customers)


def details(b):
    return staging.log_import_records(sanitized(b))


def sessions(b):
    return staging.complete_sessions(details(b))


@query("import_csv", "G1", views=["stg_ar_imports"], oracle="""
SELECT customer_code, client_code, amount, invoice_date, due_date, status, CAST(NULL AS VARCHAR) AS _corrupt_record,
       row_number() OVER (ORDER BY id) AS row_number, 1 AS session_id, 'DRAFT' AS validation_status,
       CAST(NULL AS VARCHAR) AS validation_errors
FROM stg_ar_imports""")
def _import_csv(b):
    # the staged rows are exported as header CSV (sorted by id, so file order = id order) and imported back
    base = ensure_checkpoint_dir(b.spark).rstrip("/")
    path = f"{base}/import_csv/{uuid.uuid4().hex}"
    # the file's own column order and an extra column: binding is by name
    order = ("client_code", "customer_code", "due_date", "invoice_date", "amount", "status")
    b.stg_ar_imports.orderBy("id").select(F.col("id").alias("line"), *order).write.option("header", True).csv(path)
    return staging.import_csv(b.spark, path)


@query("sanitize_ar", "G4", views=STG_VIEWS, oracle=STG_SQL + "\nSELECT * FROM san")
def _sanitize_ar(b):
    return sanitized(b)


@query("validate_ar_log", "G5", views=STG_VIEWS, oracle=STG_SQL + """
SELECT session_id, row_number, rule_id, field_name, validation_rule, actual_value, is_valid, severity FROM vlog""")
def _validate_ar_log(b):
    return validated(b)["log"]


@query("validate_ar_compliance", "G5", views=STG_VIEWS, oracle=STG_SQL + f"""
SELECT {_pint('client_code')} AS client_id, rule_id, session_id, row_number AS staging_record_id,
       CAST(NULL AS BIGINT) AS production_record_id, 'stg_ar_imports' AS table_name,
       CASE WHEN is_valid THEN 'PASS' ELSE 'FAIL' END AS status,
       CASE WHEN is_valid THEN 'RESOLVED' ELSE 'UNRESOLVED' END AS resolution_status FROM vlog""")
def _validate_ar_compliance(b):
    return validated(b)["compliance"]


@query("validate_ar_workflows", "G5", views=STG_VIEWS, oracle=STG_SQL + "\nSELECT * FROM wf2")
def _validate_ar_workflows(b):
    return validated(b)["workflows"]


def approved(b):
    wf = validated(b)["workflows"]
    approvals = []
    for level in (1, 2, 3):
        step = staging.approve(wf, level, f"approver{level}")
        wf = step["workflows"]
        approvals.append(step["approvals"])
    return wf, approvals


_APPROVE_SQL = STG_SQL + """,
l1 AS (SELECT session_id, staging_record_id,
              CASE WHEN new_state = 'VALID' THEN new_state ELSE previous_state END AS previous_state,
              CASE WHEN new_state = 'VALID' THEN 'APPROVE_L1' ELSE new_state END AS new_state,
              CASE WHEN new_state = 'VALID' THEN 'APPROVED L1 BY approver1' ELSE notes END AS notes FROM wf2),
l2 AS (SELECT session_id, staging_record_id,
              CASE WHEN new_state = 'APPROVE_L1' THEN new_state ELSE previous_state END AS previous_state,
              CASE WHEN new_state = 'APPROVE_L1' THEN 'APPROVE_L2' ELSE new_state END AS new_state,
              CASE WHEN new_state = 'APPROVE_L1' THEN 'APPROVED L2 BY approver2' ELSE notes END AS notes FROM l1),
l3 AS (SELECT session_id, staging_record_id,
              CASE WHEN new_state = 'APPROVE_L2' THEN new_state ELSE previous_state END AS previous_state,
              CASE WHEN new_state = 'APPROVE_L2' THEN 'APPROVE_L3' ELSE new_state END AS new_state,
              CASE WHEN new_state = 'APPROVE_L2' THEN 'APPROVED L3 BY approver3' ELSE notes END AS notes FROM l2)"""


@query("approve", "G6", views=STG_VIEWS, oracle=_APPROVE_SQL + "\nSELECT * FROM l3")
def _approve(b):
    return approved(b)[0]


@query("reject", "G7", views=STG_VIEWS, oracle=STG_SQL + """
SELECT session_id, staging_record_id,
       CASE WHEN hit THEN new_state ELSE previous_state END AS previous_state,
       CASE WHEN hit THEN 'REJECT' ELSE new_state END AS new_state,
       CASE WHEN hit THEN 'REJECTED' ELSE notes END AS notes
FROM (SELECT *, session_id = 1997 AND ((new_state = 'DRAFT' AND previous_state IS NULL)
                                       OR (new_state = 'PENDING' AND previous_state = 'DRAFT')) AS hit FROM wf) x""")
def _reject(b):
    return staging.reject(workflows(b), 1997)


@query("log_import_records", "G3", views=STG_VIEWS, oracle=STG_SQL + "\nSELECT * FROM details")
def _log_import_records(b):
    return details(b)


@query("complete_sessions", "G2", views=STG_VIEWS, oracle=STG_SQL + "\nSELECT * FROM sessions")
def _complete_sessions(b):
    return sessions(b)


@query("import_history", "G9", views=STG_VIEWS, oracle=STG_SQL + """
SELECT session_id, import_type, imported_by, started_at, completed_at, status, total_records, successful_records,
       failed_records, CAST(CASE WHEN total_records > 0 THEN ROUND(CAST(successful_records AS DECIMAL(20,0)) * 100 / total_records, 2)
                                 ELSE 0 END AS DECIMAL(10,2)) AS success_rate
FROM sessions WHERE client_id = 1 ORDER BY started_at DESC NULLS LAST, session_id DESC LIMIT 5""",
       money=["success_rate"])
def _import_history(b):
    return staging.import_history(sessions(b), 1, 5)


@query("failed_imports", "G10", views=STG_VIEWS, oracle=STG_SQL + """
SELECT d.session_id, s.import_type, d.row_number, d.table_name, d.error_message, d.created_at AS failed_at
FROM details d JOIN sessions s ON d.session_id = s.session_id
WHERE s.client_id = 1 AND d.status = 'FAILED'
ORDER BY d.created_at DESC NULLS LAST, d.row_number DESC LIMIT 50""")
def _failed_imports(b):
    return staging.failed_imports(details(b), sessions(b), 1, 50)


@query("record_lineage", "G11", views=STG_VIEWS, oracle=STG_SQL + f"""
SELECT 'account_receivables' AS table_name, id AS record_id, {_pint('client_code')} AS client_id,
       'CSV_IMPORT' AS source_type, 'ar_import.csv' AS source_file, session_id, id AS source_row_number
FROM san WHERE validation_status = 'VALID'""")
def _record_lineage(b):
    s = sanitized(b).where(F.col("validation_status") == "VALID").select(
        F.col("id").alias("record_id"), V.parse_int("client_code").alias("client_id"), "session_id",
        F.col("id").alias("source_row_number"))
    return staging.record_lineage(s, "account_receivables", "CSV_IMPORT", "ar_import.csv")


@query("route_session", "G12", views=STG_VIEWS, oracle=STG_SQL + """
SELECT session_id, import_type,
       CASE lower(import_type) WHEN 'ar' THEN 'stg_ar_imports' WHEN 'ap' THEN 'stg_ap_imports'
            WHEN 'inventory' THEN 'stg_inventory_imports' WHEN 'transactions' THEN 'stg_transaction_imports' END AS staging_table,
       CAST(NULL AS VARCHAR) AS error
FROM sessions""")
def _route_session(b):
    return staging.route_session(sessions(b))
