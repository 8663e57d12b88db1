"""Registered queries for data quality and compliance (Q)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import validators as V
from ..operators import quality
from . import staging_queries as sq
from .registry import query

AS_OF = "1999-01-01"
_AR = ", ".join(f"'{s}'" for s in V.AR_STATUSES)
_AP = ", ".join(f"'{s}'" for s in V.AP_STATUSES)
_ACT = ", ".join(f"'{s}'" for s in V.ACTION_TYPES)


@query("check_domains", "Q1", views=["movements", "ar_ext"], oracle=f"""
SELECT 'inventory_audits' AS table_name, CAST(management_id AS VARCHAR) AS record_id, 'quantity_type(quantity)' AS rule,
       CAST(quantity AS VARCHAR) AS value FROM movements WHERE NOT (quantity > 0)
UNION ALL SELECT 'inventory_audits', CAST(management_id AS VARCHAR), 'action_typing(action_type)', action_type
FROM movements WHERE NOT (action_type IN ({_ACT}))
UNION ALL SELECT 'ar_ext', CAST(receivable_id AS VARCHAR), 'amount_type(amount)', CAST(amount AS VARCHAR) FROM ar_ext WHERE NOT (amount >= 0)
UNION ALL SELECT 'ar_ext', CAST(receivable_id AS VARCHAR), 'status_typing(status)', status FROM ar_ext WHERE NOT (status IN ({_AR}))""")
def _check_domains(b):
    m = quality.check_domains(b.movements, "inventory_audits", "management_id",
                              {"quantity": "quantity_type", "action_type": "action_typing"})
    a = quality.check_domains(b.ar_ext, "ar_ext", "receivable_id", {"amount": "amount_type", "status": "status_typing"})
    return m.unionByName(a)


def _transfers(b):
    m = b.movements.where(F.col("action_type") == "Sale Return")
    to = F.when(F.col("transaction_id") % 13 == 0, F.col("warehouse_id")).otherwise(F.col("warehouse_id") % 3 + 1)
    return m.select(F.col("management_id").alias("transfer_id"), "product_id",
                    F.col("warehouse_id").alias("from_warehouse_id"), to.cast("int").alias("to_warehouse_id"), "quantity")


@query("check_constraints", "Q2", views=["movements", "ar_ext"], oracle=f"""
SELECT 'ar_ext' AS table_name, CAST(receivable_id AS VARCHAR) AS record_id, r.rule, CAST(NULL AS VARCHAR) AS value
FROM ar_ext, (VALUES ('chk_ar_amount_nonnegative', 1), ('chk_ar_invoice_before_due', 2), ('chk_ar_status', 3)) r(rule, n)
WHERE (n = 1 AND NOT (amount >= 0)) OR (n = 2 AND NOT (invoice_date <= due_date)) OR (n = 3 AND NOT (status IN ({_AR})))
UNION ALL
SELECT 'inventory_transfers', CAST(management_id AS VARCHAR), 'chk_transfer_locations_differ', CAST(NULL AS VARCHAR)
FROM movements WHERE action_type = 'Sale Return' AND transaction_id % 13 = 0
UNION ALL
SELECT 'inventory_transfers', CAST(management_id AS VARCHAR), 'chk_transfer_quantity_positive', CAST(NULL AS VARCHAR)
FROM movements WHERE action_type = 'Sale Return' AND NOT (quantity > 0)""")
def _check_constraints(b):
    a = quality.check_constraints(b.ar_ext, "ar_ext", "receivable_id")
    t = quality.check_constraints(_transfers(b), "inventory_transfers", "transfer_id")
    return a.unionByName(t)


# every declared constraint over tables with spoiled rows: each rule is broken by its own residue of the id
_SPOILED = {
    "journals": ("journal_id", {"date_not_null": 101, "amount_not_null": 103, "positive_journal_amount": 107}, "journals"),
    "charts": ("chart_id", {"chk_chart_type": 7}, "charts"),
    "customers": ("customer_id", {"customer_name_not_null": 11, "email_not_null": 13, "chk_customer_email": 17}, "customers"),
    "vendors": ("vendor_id", {"vendor_name_not_null": 2, "email_not_null": 3, "chk_vendor_email": 5}, "vendors"),
    "ap_ext": ("payable_id", {"chk_ap_amount_nonnegative": 13, "chk_ap_invoice_before_due": 17, "chk_ap_status": 19}, "ap_ext"),
    "inventory_audits": ("management_id", {"chk_quantity_positive": 31, "chk_action_type": 37}, "movements"),
    "returns": ("management_id", {"chk_return_quantity_positive": 29}, "movements"),
    "operations": ("operation_id", {"chk_cost_nonnegative": 41, "chk_price_nonnegative": 43, "chk_layer_quantity_nonnegative": 53}, "layers"),
}


def _spoiled(b, table: str):
    key, rules, view = _SPOILED[table]
    t = getattr(b, view)
    breaks = {r: F.col(key) % n == 0 for r, n in rules.items()}
    if table == "journals":
        return t.withColumns({"date": F.when(~breaks["date_not_null"], F.col("date")),
                              "amount": F.when(breaks["amount_not_null"], F.lit(None)).when(breaks["positive_journal_amount"], -F.col("amount") - 1).otherwise(F.col("amount"))})
    if table == "charts":
        return t.withColumn("type", F.when(breaks["chk_chart_type"], F.lit("Nothing")).otherwise(F.col("type")))
    if table in ("customers", "vendors"):
        name = f"{table[:-1]}_name"
        return t.withColumns({name: F.when(~breaks[f"{name}_not_null"], F.col(name)),
                              "email": F.when(breaks["email_not_null"], F.lit(None)).when(breaks[f"chk_{table[:-1]}_email"], "none").otherwise("a@mail.com")})
    if table == "ap_ext":
        return t.withColumns({"amount": F.when(breaks["chk_ap_amount_nonnegative"], F.lit(-1)).otherwise(F.col("amount")),
                              "due_date": F.when(breaks["chk_ap_invoice_before_due"], F.date_sub("invoice_date", 1)).otherwise(F.greatest("due_date", "invoice_date")),
                              "status": F.when(breaks["chk_ap_status"], F.lit("Lost")).otherwise(F.lit("Paid"))})
    if table == "operations":
        cost, price = F.col("unit_cost_cents"), F.col("unit_cost_cents") + 1
        low = breaks["chk_cost_nonnegative"] | breaks["chk_price_nonnegative"]
        return t.select(key, F.when(breaks["chk_layer_quantity_nonnegative"], F.lit(-1)).otherwise(F.abs("quantity")).alias("quantity"),
                        F.when(low, F.lit(-9)).otherwise(cost).alias("product_cost"),
                        F.when(breaks["chk_price_nonnegative"], F.lit(-2)).otherwise(price).alias("product_price"))
    if table == "returns":
        return t.where(F.col("action_type").like("% Return")).withColumn("quantity", F.when(breaks["chk_return_quantity_positive"], F.lit(0)).otherwise(F.abs("quantity") + 1))
    return t.withColumns({"quantity": F.when(breaks["chk_quantity_positive"], F.lit(0)).otherwise(F.abs("quantity") + 1),
                          "action_type": F.when(breaks["chk_action_type"], F.lit("Lost")).otherwise(F.lit("Sale"))})


def _spoiled_sql() -> str:
    parts = []
    for table, (key, rules, view) in _SPOILED.items():
        for rule, n in rules.items():
            where = f"{key} % {n} = 0"
            if table == "returns":
                where += " AND action_type LIKE '% Return'"
            if rule == "positive_journal_amount":
                where += f" AND {key} % 103 <> 0"
            if rule.startswith("chk_") and rule.endswith("_email"):
                where += f" AND {key} % {rules['email_not_null']} <> 0"
            if rule == "chk_cost_nonnegative":
                where = f"({key} % 41 = 0 OR {key} % 43 = 0)"
            parts.append(f"SELECT '{table}' AS table_name, CAST({key} AS VARCHAR) AS record_id, '{rule}' AS rule, CAST(NULL AS VARCHAR) AS value FROM {view} WHERE {where}")
    return "\nUNION ALL ".join(parts)


@query("check_constraints_all", "Q2", views=["journals", "charts", "customers", "vendors", "ap_ext", "movements", "layers"], oracle=_spoiled_sql())
def _check_constraints_all(b):
    out = None
    for table, (key, _rules, _view) in _SPOILED.items():
        v = quality.check_constraints(_spoiled(b, table), table, key)
        out = v if out is None else out.unionByName(v)
    return out


@query("check_domains_spoiled", "Q1", views=["movements", "ap_ext"], oracle="""
SELECT 'inventory_audits' AS table_name, CAST(management_id AS VARCHAR) AS record_id, 'quantity_type(quantity)' AS rule, '0' AS value
FROM movements WHERE management_id % 31 = 0
UNION ALL SELECT 'inventory_audits', CAST(management_id AS VARCHAR), 'action_typing(action_type)', 'Lost' FROM movements WHERE management_id % 37 = 0
UNION ALL SELECT 'ap_ext', CAST(payable_id AS VARCHAR), 'amount_type(amount)', '-1.00' FROM ap_ext WHERE payable_id % 13 = 0
UNION ALL SELECT 'ap_ext', CAST(payable_id AS VARCHAR), 'status_typing(status)', 'Lost' FROM ap_ext WHERE payable_id % 19 = 0""")
def _check_domains_spoiled(b):
    m = quality.check_domains(_spoiled(b, "inventory_audits"), "inventory_audits", "management_id", {"quantity": "quantity_type", "action_type": "action_typing"})
    a = _spoiled(b, "ap_ext").withColumn("amount", F.col("amount").cast("decimal(15,2)"))
    return m.unionByName(quality.check_domains(a, "ap_ext", "payable_id", {"amount": "amount_type", "status": "status_typing"}))


@query("check_unique", "Q3", views=["event_log"], oracle="""
SELECT idempotency_key, COUNT(*) AS duplicate_count FROM event_log GROUP BY idempotency_key HAVING COUNT(*) > 1""")
def _check_unique(b):
    return quality.check_unique(b.event_log, ["idempotency_key"])


@query("check_foreign_keys", "Q4", views=["event_log", "customers"], money=["amount"], oracle="""
SELECT * FROM event_log e WHERE e.user_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM customers c WHERE c.customer_id = e.user_id)""")
def _check_foreign_keys(b):
    return quality.check_foreign_keys(b.event_log, b.customers, "user_id", "customer_id")


@query("check_foreign_keys_orphans", "Q4", views=["movements", "products"], oracle="""
SELECT management_id, CASE WHEN management_id % 23 = 0 THEN -management_id ELSE product_id END AS product_id FROM movements WHERE management_id % 23 = 0""")
def _check_foreign_keys_orphans(b):
    # every 23rd movement refers to a product that does not exist, every 29th to none (a null reference is no violation)
    m = F.col("management_id")
    child = b.movements.select("management_id", F.when(m % 23 == 0, -m).when(m % 29 != 0, F.col("product_id")).alias("product_id"))
    return quality.check_foreign_keys(child, b.products, "product_id", "product_id")


def _contacts(b):
    c = b.customers
    email = F.concat(F.lower(F.regexp_replace("customer_name", "#", "")),
                     F.when(F.col("customer_id") % 7 == 0, F.lit("@mail")).otherwise(F.lit("@mail.com")))
    phone = F.when(F.col("customer_id") % 5 == 0, F.lit("")).otherwise((F.col("customer_id") * 7919).cast("string"))
    return c.select("customer_id", email.alias("email"), phone.alias("phone"))


_CONTACTS_SQL = """contacts AS (SELECT customer_id,
    lower(replace(customer_name, '#', '')) || CASE WHEN customer_id % 7 = 0 THEN '@mail' ELSE '@mail.com' END AS email,
    CASE WHEN customer_id % 5 = 0 THEN '' ELSE CAST(customer_id * 7919 AS VARCHAR) END AS phone FROM customers)"""


@query("validate_email", "Q5", views=["customers"], oracle=f"""WITH {_CONTACTS_SQL}
SELECT customer_id, email,
       CASE WHEN email IS NULL OR email = '' OR NOT regexp_matches(email, '{V.EMAIL_PATTERN}') THEN FALSE ELSE TRUE END AS is_valid,
       CASE WHEN email IS NULL OR email = '' THEN 'Email cannot be empty'
            WHEN NOT regexp_matches(email, '{V.EMAIL_PATTERN}') THEN 'Invalid email format' ELSE '' END AS error_msg
FROM contacts""")
def _validate_email(b):
    c = _contacts(b)
    return c.select("customer_id", "email", V.validate_email("email").alias("r")).select("customer_id", "email", "r.*")


@query("validate_phone", "Q6", views=["customers"], oracle=f"""WITH {_CONTACTS_SQL}
SELECT customer_id, phone,
       CASE WHEN phone IS NULL OR phone = '' THEN TRUE WHEN NOT regexp_matches(phone, '{V.PHONE_PATTERN}') THEN FALSE ELSE TRUE END AS is_valid,
       CASE WHEN phone IS NULL OR phone = '' THEN '' WHEN NOT regexp_matches(phone, '{V.PHONE_PATTERN}') THEN 'Invalid phone format'
            ELSE '' END AS error_msg
FROM contacts""")
def _validate_phone(b):
    c = _contacts(b)
    return c.select("customer_id", "phone", V.validate_phone("phone").alias("r")).select("customer_id", "phone", "r.*")


@query("validate_decimal_amount", "Q7", views=["stg_ar_imports"], money=["parsed_value"], oracle=f"""
SELECT id, amount, NOT (v IS NULL OR v < 0) AS is_valid,
       CASE WHEN v IS NULL THEN 'Invalid decimal format: ' || amount WHEN v < 0 THEN 'Amount cannot be negative' ELSE '' END AS error_msg,
       CASE WHEN v IS NULL OR v < 0 THEN NULL ELSE v END AS parsed_value
FROM (SELECT id, amount, {sq._pdec('amount')} AS v FROM stg_ar_imports) x""")
def _validate_decimal_amount(b):
    s = b.stg_ar_imports
    return s.select("id", "amount", V.validate_decimal_amount("amount").alias("r")).select("id", "amount", "r.*")


@query("validate_integer_quantity", "Q8", views=["stg_ar_imports"], oracle=f"""
SELECT id, customer_code, NOT (v IS NULL OR v <= 0) AS is_valid,
       CASE WHEN v IS NULL THEN 'Invalid integer format: ' || customer_code WHEN v <= 0 THEN 'Quantity must be greater than 0'
            ELSE '' END AS error_msg,
       CASE WHEN v IS NULL OR v <= 0 THEN NULL ELSE v END AS parsed_value
FROM (SELECT id, customer_code, {sq._pint('customer_code')} AS v FROM stg_ar_imports) x""")
def _validate_integer_quantity(b):
    s = b.stg_ar_imports
    return s.select("id", "customer_code", V.validate_integer_quantity("customer_code").alias("r")) \
            .select("id", "customer_code", "r.*")


@query("validate_date", "Q9", views=["stg_ar_imports"], oracle=f"""
SELECT id, due_date, NOT (v IS NULL OR v > DATE '{AS_OF}') AS is_valid,
       CASE WHEN v IS NULL THEN 'Invalid date format: ' || due_date WHEN v > DATE '{AS_OF}' THEN 'Date cannot be in the future'
            ELSE '' END AS error_msg,
       CASE WHEN v IS NULL OR v > DATE '{AS_OF}' THEN NULL ELSE v END AS parsed_value
FROM (SELECT id, due_date, TRY_CAST(due_date AS DATE) AS v FROM stg_ar_imports) x""")
def _validate_date(b):
    s = b.stg_ar_imports
    return s.select("id", "due_date", V.validate_date("due_date", AS_OF).alias("r")).select("id", "due_date", "r.*")


@query("validate_exists", "Q10", views=["event_log", "customers"], oracle="""
SELECT k.user_id, c.customer_id IS NOT NULL AS is_valid,
       CASE WHEN c.customer_id IS NOT NULL THEN '' ELSE 'Customer ID does not exist: ' || CAST(k.user_id AS VARCHAR) END AS error_msg
FROM (SELECT DISTINCT user_id FROM event_log) k LEFT JOIN (SELECT DISTINCT customer_id FROM customers) c ON k.user_id = c.customer_id""")
def _validate_exists(b):
    return quality.validate_exists(b.event_log, "user_id", b.customers, "customer_id", "customer")


def _register_exists(kind: str, view: str, key: str, message: str, active: str):
    # keys of the table and as many that do not exist
    sql = f"""WITH keys AS (SELECT {key} AS k FROM {view} UNION SELECT -{key} FROM {view} WHERE {key} > 0)
SELECT k.k AS key, p.{key} IS NOT NULL AS is_valid, CASE WHEN p.{key} IS NOT NULL THEN '' ELSE '{message}' || CAST(k.k AS VARCHAR) END AS error_msg
FROM keys k LEFT JOIN (SELECT DISTINCT {key} FROM {view} WHERE {active}) p ON k.k = p.{key}"""

    @query(f"validate_exists_{kind}", "Q10", views=[view], oracle=sql)
    def _exists(b):
        parent = getattr(b, view)
        keys = parent.select(F.col(key).alias("key")).unionByName(parent.select((-F.col(key)).alias("key")))
        return quality.validate_exists(keys, "key", parent, key, kind)


_register_exists("vendor", "vendors", "vendor_id", "Vendor ID does not exist: ", "TRUE")
_register_exists("product", "products", "product_id", "Product ID does not exist: ", "TRUE")
_register_exists("warehouse", "movements", "warehouse_id", "Warehouse ID does not exist: ", "TRUE")
_register_exists("account", "charts", "chart_id", "Account ID does not exist or is inactive: ", "is_active")


@query("validate_invoice_due_dates", "Q11", views=["stg_ar_imports"], oracle="""
SELECT id, NOT COALESCE(TRY_CAST(invoice_date AS DATE) > TRY_CAST(due_date AS DATE), FALSE) AS is_valid,
       CASE WHEN COALESCE(TRY_CAST(invoice_date AS DATE) > TRY_CAST(due_date AS DATE), FALSE)
            THEN 'Invoice date cannot be after due date' ELSE '' END AS error_msg
FROM stg_ar_imports""")
def _validate_invoice_due_dates(b):
    s = b.stg_ar_imports
    r = V.validate_invoice_due_dates(F.col("invoice_date").try_cast("date"), F.col("due_date").try_cast("date"))
    return s.select("id", r.alias("r")).select("id", "r.*")


@query("is_overdue", "Q12", views=["ar_ext"], oracle=f"""
SELECT receivable_id, due_date < DATE '{AS_OF}' AS is_overdue FROM ar_ext""")
def _is_overdue(b):
    return b.ar_ext.select("receivable_id", V.is_overdue("due_date", AS_OF).alias("is_overdue"))


@query("is_overdue_by_id", "Q12", views=["ar_ext", "ap_ext"], oracle=f"""
SELECT 'AR' AS kind, e.k AS document_id, a.due_date < DATE '{AS_OF}' AS is_overdue
FROM (SELECT receivable_id AS k FROM ar_ext UNION ALL SELECT -receivable_id FROM ar_ext) e LEFT JOIN ar_ext a ON a.receivable_id = e.k
UNION ALL
SELECT 'AP', e.k, a.due_date < DATE '{AS_OF}'
FROM (SELECT payable_id AS k FROM ap_ext UNION ALL SELECT -payable_id FROM ap_ext) e LEFT JOIN ap_ext a ON a.payable_id = e.k""")
def _is_overdue_by_id(b):
    out = []
    for kind, table, key in (("AR", b.ar_ext, "receivable_id"), ("AP", b.ap_ext, "payable_id")):
        ids = table.select(F.col(key).alias("document_id")).unionByName(table.select((-F.col(key)).alias("document_id")))
        out.append(quality.is_overdue_by_id(ids, table, key, AS_OF).select(F.lit(kind).alias("kind"), "document_id", "is_overdue"))
    return out[0].unionByName(out[1])


@query("validate_transaction_import", "Q13", views=["journals", "charts", "transactions"], money=["amount"], oracle=f"""
SELECT j.* EXCLUDE (e), (e = '') AS is_valid, e AS errors FROM (
  SELECT j.*, concat_ws('; ', CASE WHEN j.amount < 0 THEN 'Amount cannot be negative' END,
                        CASE WHEN j.date > DATE '{AS_OF}' THEN 'Transaction date cannot be in the future' END,
                        CASE WHEN c.chart_id IS NULL THEN 'Invalid chart/account ID' END,
                        CASE WHEN t.transaction_id IS NULL THEN 'Transaction ID does not exist' END) AS e
  FROM journals j LEFT JOIN (SELECT DISTINCT chart_id FROM charts WHERE is_active) c ON j.chart_id = c.chart_id
  LEFT JOIN (SELECT DISTINCT transaction_id FROM transactions) t ON j.transaction_id = t.transaction_id) j""")
def _validate_transaction_import(b):
    return quality.validate_transaction_import(b.journals, b.charts, b.transactions, AS_OF)


@query("validate_ar_import", "Q14", views=["ar_ext", "customers"], money=["amount"], oracle=f"""
SELECT a.*, CASE WHEN a.amount <= 0 THEN 'AR amount must be positive' END AS amount_error,
       CASE WHEN a.invoice_date > a.due_date THEN 'Invoice date cannot be after due date' END AS invoice_error,
       CASE WHEN c.customer_id IS NULL THEN 'Customer ID does not exist' END AS customer_error,
       CASE WHEN NOT (a.status IN ({_AR})) THEN 'Invalid AR status' END AS status_error
FROM ar_ext a LEFT JOIN (SELECT DISTINCT customer_id FROM customers) c ON a.customer_id = c.customer_id""")
def _validate_ar_import(b):
    return quality.validate_ar_import(b.ar_ext, b.customers)


@query("validate_ap_import", "Q15", views=["ap_ext", "vendors"], money=["amount"], oracle=f"""
SELECT a.* EXCLUDE (e), (e = '') AS is_valid, e AS errors FROM (
  SELECT a.*, concat_ws('; ', CASE WHEN a.amount <= 0 THEN 'AP amount must be positive' END,
                        CASE WHEN a.invoice_date > a.due_date THEN 'Invoice date cannot be after due date' END,
                        CASE WHEN v.vendor_id IS NULL THEN 'Vendor ID does not exist' END,
                        CASE WHEN NOT (a.status IN ({_AP})) THEN 'Invalid AP status' END) AS e
  FROM ap_ext a LEFT JOIN (SELECT DISTINCT vendor_id FROM vendors) v ON a.vendor_id = v.vendor_id) a""")
def _validate_ap_import(b):
    return quality.validate_ap_import(b.ap_ext, b.vendors)


def _warehouses(b):
    return b.raw("supplier").select((F.col("s_suppkey") % 3 + 1).cast("int").alias("warehouse_id")).distinct()


@query("validate_inventory_import", "Q16", views=["movements", "products", "transactions"], oracle=f"""
SELECT m.* EXCLUDE (e), (e = '') AS is_valid, e AS errors FROM (
  SELECT m.*, concat_ws('; ', CASE WHEN m.quantity <= 0 THEN 'Quantity must be greater than 0' END,
                        CASE WHEN p.product_id IS NULL THEN 'Product ID does not exist' END,
                        CASE WHEN w.warehouse_id IS NULL THEN 'Warehouse ID does not exist' END,
                        CASE WHEN NOT (m.action_type IN ({_ACT})) THEN 'Invalid inventory action type' END,
                        CASE WHEN t.transaction_id IS NULL THEN 'Transaction ID does not exist' END) AS e
  FROM movements m LEFT JOIN (SELECT DISTINCT product_id FROM products) p ON m.product_id = p.product_id
  LEFT JOIN (SELECT DISTINCT CAST(s_suppkey % 3 + 1 AS INT) AS warehouse_id FROM supplier) w ON m.warehouse_id = w.warehouse_id
  LEFT JOIN (SELECT DISTINCT transaction_id FROM transactions) t ON m.transaction_id = t.transaction_id) m""")
def _validate_inventory_import(b):
    return quality.validate_inventory_import(b.movements, b.products, _warehouses(b), b.transactions)


@query("validate_journal_rows", "Q17", views=["journals", "charts", "transactions"], money=["amount"], oracle="""
SELECT j.* EXCLUDE (r), r IS NULL AS is_valid, r AS rejection_reason FROM (
  SELECT j.*, CASE WHEN c.chart_id IS NULL THEN 'Chart account is inactive or does not exist'
                   WHEN t.transaction_id IS NULL THEN 'Transaction does not exist' END AS r
  FROM journals j LEFT JOIN (SELECT DISTINCT chart_id FROM charts WHERE is_active) c ON j.chart_id = c.chart_id
  LEFT JOIN (SELECT DISTINCT transaction_id FROM transactions) t ON j.transaction_id = t.transaction_id) j""")
def _validate_journal_rows(b):
    return quality.validate_journal_rows(b.journals, b.charts, b.transactions)


@query("validation_summary", "Q18", views=sq.STG_VIEWS, money=["validation_pass_rate"], oracle=sq.STG_SQL + """
SELECT session_id, COUNT(*) AS total_rows, count_if(is_valid) AS valid_rows, count_if(NOT is_valid) AS invalid_rows,
       count_if(severity = 'WARNING') AS warning_rows,
       CAST(ROUND(CAST(count_if(is_valid) AS DECIMAL(20,0)) * 100 / COUNT(*), 2) AS DECIMAL(10,2)) AS validation_pass_rate
FROM vlog GROUP BY session_id""")
def _validation_summary(b):
    return quality.validation_summary(sq.validated(b)["log"])


def _compliance_logs(b):
    v = sq.validated(b)
    log = v["log"].select("session_id", "row_number", "rule_id", F.col("validation_rule").alias("details"))
    c = v["compliance"].join(log, (F.col("staging_record_id") == F.col("row_number"))
                             & (v["compliance"]["session_id"] == log["session_id"])
                             & (v["compliance"]["rule_id"] == log["rule_id"]))
    stg = sq.stg(b).select(F.col("id").alias("_sid"), F.col("invoice_date").try_cast("timestamp").alias("checked_at"))
    c = c.join(stg, F.col("staging_record_id") == F.col("_sid"))
    return c.select((F.col("staging_record_id") * 10 + v["compliance"]["rule_id"]).alias("compliance_id"),
                    "client_id", v["compliance"]["rule_id"], v["compliance"]["session_id"], "staging_record_id",
                    "production_record_id", "table_name", "status", "resolution_status", "details", "checked_at")


# Compliance rules (rule_id, rule_name, check_type).
COMPLIANCE_RULES = [
    (1, "Positive Amount Rule", "AMOUNT_CHECK"),
    (2, "Valid Date Range", "DATE_CHECK"),
    (3, "Customer Existence", "CUSTOMER_CHECK"),
    (4, "Status Existence", "STATUS_CHECK"),
]

_COMPLIANCE_SQL = sq.STG_SQL + f""",
clogs AS (SELECT v.row_number * 10 + v.rule_id AS compliance_id, {sq._pint('v.client_code')} AS client_id, v.rule_id,
                 v.session_id, v.row_number AS staging_record_id, CAST(NULL AS BIGINT) AS production_record_id,
                 'stg_ar_imports' AS table_name, CASE WHEN v.is_valid THEN 'PASS' ELSE 'FAIL' END AS status,
                 CASE WHEN v.is_valid THEN 'RESOLVED' ELSE 'UNRESOLVED' END AS resolution_status,
                 v.validation_rule AS details, TRY_CAST(s.invoice_date AS TIMESTAMP) AS checked_at
          FROM vlog v JOIN stg s ON s.id = v.row_number),
rules AS (SELECT * FROM (VALUES (1, 'Positive Amount Rule', 'AMOUNT_CHECK'), (2, 'Valid Date Range', 'DATE_CHECK'),
                 (3, 'Customer Existence', 'CUSTOMER_CHECK'), (4, 'Status Existence', 'STATUS_CHECK')) t(rule_id, rule_name, check_type))"""


@query("log_compliance_checks", "Q19", views=sq.STG_VIEWS, oracle=_COMPLIANCE_SQL + """
SELECT client_id, rule_id, session_id, staging_record_id, production_record_id, table_name, upper(status) AS status,
       COALESCE(resolution_status, 'UNRESOLVED') AS resolution_status, checked_at,
       (staging_record_id IS NOT NULL OR production_record_id IS NOT NULL) AS is_linked FROM clogs""")
def _log_compliance_checks(b):
    return quality.log_compliance_checks(_compliance_logs(b))


@query("compliance_violations", "Q20", views=sq.STG_VIEWS, oracle=_COMPLIANCE_SQL + f"""
SELECT l.compliance_id, r.rule_name, r.check_type, l.status, l.details, l.checked_at,
       COALESCE(l.resolution_status, 'UNRESOLVED') AS resolution_status
FROM clogs l LEFT JOIN rules r ON l.rule_id = r.rule_id
WHERE l.client_id = 1 AND l.status <> 'PASS' AND l.checked_at >= TIMESTAMP '{AS_OF}' - INTERVAL 365 DAY
  AND l.checked_at <= TIMESTAMP '{AS_OF}' ORDER BY l.checked_at DESC, l.compliance_id DESC""")
def _compliance_violations(b):
    rules = b.spark.createDataFrame(COMPLIANCE_RULES, "rule_id int, rule_name string, check_type string")
    return quality.compliance_violations(_compliance_logs(b), rules, 1, 365, AS_OF)


@query("overdue_receivables", "Q21", views=["ar_ext"], money=["amount"], oracle=f"""
SELECT receivable_id, amount, due_date, CAST(DATE '{AS_OF}' - due_date AS INT) AS days_overdue
FROM ar_ext WHERE due_date < DATE '{AS_OF}' AND status <> 'Paid'""")
def _overdue_receivables(b):
    return quality.overdue_receivables(b.ar_ext, AS_OF, paid_status="Paid")


_BUCKETS = ["current", "days_1_30", "days_31_60", "days_61_90", "days_over_90", "total_outstanding"]


@query("aging_report", "Q22", views=["ar_ext"], money=_BUCKETS, oracle=f"""
WITH a AS (SELECT customer_id, amount, DATE '{AS_OF}' - due_date AS d FROM ar_ext WHERE status <> 'Paid')
SELECT customer_id,
  CAST(SUM(CASE WHEN d <= 0 THEN amount ELSE 0 END) AS DECIMAL(18,2)) AS current,
  CAST(SUM(CASE WHEN d > 0 AND d <= 30 THEN amount ELSE 0 END) AS DECIMAL(18,2)) AS days_1_30,
  CAST(SUM(CASE WHEN d > 30 AND d <= 60 THEN amount ELSE 0 END) AS DECIMAL(18,2)) AS days_31_60,
  CAST(SUM(CASE WHEN d > 60 AND d <= 90 THEN amount ELSE 0 END) AS DECIMAL(18,2)) AS days_61_90,
  CAST(SUM(CASE WHEN d > 90 THEN amount ELSE 0 END) AS DECIMAL(18,2)) AS days_over_90,
  CAST(SUM(amount) AS DECIMAL(18,2)) AS total_outstanding
FROM a GROUP BY customer_id""")
def _aging_report(b):
    return quality.aging_report(b.ar_ext, "customer_id", AS_OF)
