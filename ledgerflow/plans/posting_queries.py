"""Registered queries for the posting engine (P) and chart-of-accounts set-up."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import validators as V
from ..functions.money import MONEY
from ..operators import costing, posting
from ..operators.key_index import KeyIndex
from ..session import ensure_checkpoint_dir, landed
from ..sources.bridge import ROLE_PREFIXES
from . import staging_queries as sq
from .registry import query

COA_VIEWS = ["clients", "charts", "coa_template", "new_charts", "all_charts", "new_roles", "role_map"]
VAT_BP = 1200


# ---- chart of accounts ---------------------------------------------------------------

def all_charts(b):
    new = posting.apply_coa_template(b.coa_template, b.charts, b.client_templates)
    return b.charts.select("chart_id", "client_id", "account", "account_code", "type", "is_active").unionByName(new)


def all_roles(b):
    base = posting.roles_of(b.charts)
    return base.unionByName(posting.assign_account_roles(all_charts(b), base, ROLE_PREFIXES))


def role_map(b):
    """(client, role) → chart; one row per tenant and role, so it is cached once per bridge."""
    cached = getattr(b, "_role_map", None)
    if cached is None:
        cached = posting.resolve_account_role(all_charts(b), all_roles(b)).cache()
        b._role_map = cached
    return cached


@query("apply_coa_template", "P12", views=COA_VIEWS, oracle="SELECT * FROM new_charts")
def _apply_coa_template(b):
    return posting.apply_coa_template(b.coa_template, b.charts, b.client_templates)


@query("assign_account_role", "P13", views=COA_VIEWS, oracle="SELECT * FROM new_roles")
def _assign_account_role(b):
    return posting.assign_account_roles(all_charts(b), posting.roles_of(b.charts), ROLE_PREFIXES)


@query("resolve_account_role", "P1", views=COA_VIEWS, oracle="SELECT * FROM role_map")
def _resolve_account_role(b):
    return role_map(b)


# ---- generic leg expansion -----------------------------------------------------------

_KIND_SQL = """CASE action_type WHEN 'Purchase' THEN 'PURCHASE' WHEN 'Sale' THEN 'SALE' WHEN 'Sale Return' THEN 'SALE_RETURN'
     WHEN 'Purchase Return' THEN 'PURCHASE_RETURN' WHEN 'Transfer' THEN 'TRANSFER' END"""


def _movement_events(b):
    m = b.movements.join(b.products.select("product_id", "client_id", "product_price"), "product_id")
    kind = (F.when(F.col("action_type") == "Purchase", "PURCHASE").when(F.col("action_type") == "Sale", "SALE")
             .when(F.col("action_type") == "Sale Return", "SALE_RETURN")
             .when(F.col("action_type") == "Purchase Return", "PURCHASE_RETURN")
             .when(F.col("action_type") == "Transfer", "TRANSFER"))
    net = F.col("quantity") * F.col("unit_cost_cents")
    tax = posting._tax_cents(net, VAT_BP)
    return m.select(F.col("management_id").alias("transaction_id"), "client_id", kind.alias("kind"),
                    F.col("movement_date").alias("date"), net.alias("net"), tax.alias("tax"), (net + tax).alias("gross"),
                    net.alias("cost"), (F.col("quantity") * (F.col("product_price") * 100).cast("long")).alias("value"))


# The oracle's own statement of the posting rules (kind, leg, role, debit, amount), written out so that a wrong
# side or role in the operator's table does not repeat here.
_RULES_SQL = """
('AR', 0, 'cash_account_ar', FALSE, 'amount'), ('AR', 1, 'ar_account', TRUE, 'amount'),
('AP', 0, 'cash_account_ap', TRUE, 'amount'), ('AP', 1, 'ap_account', FALSE, 'amount'),
('EXPENSE', 0, 'cash_account_ar', TRUE, 'amount'), ('EXPENSE', 1, 'expense_account', FALSE, 'amount'),
('REVENUE', 0, 'cash_account_ar', FALSE, 'amount'), ('REVENUE', 1, 'revenue_account', TRUE, 'amount'),
('PURCHASE', 0, 'inventory_account', TRUE, 'net'), ('PURCHASE', 1, 'input_vat_receivable', TRUE, 'tax'), ('PURCHASE', 2, 'ap_account', FALSE, 'gross'),
('SALE', 0, 'ar_account', TRUE, 'gross'), ('SALE', 1, 'revenue_account', FALSE, 'net'), ('SALE', 2, 'output_vat_payable', FALSE, 'tax'),
('SALE', 3, 'COGS', TRUE, 'cost'), ('SALE', 4, 'inventory_account', FALSE, 'cost'),
('SALE_RETURN', 0, 'SR&Allowances', FALSE, 'value'), ('SALE_RETURN', 1, 'ar_account', TRUE, 'value'),
('SALE_RETURN', 2, 'inventory_account', FALSE, 'cost'), ('SALE_RETURN', 3, 'COGS', TRUE, 'cost'),
('PURCHASE_RETURN', 0, 'ap_account', TRUE, 'cost'), ('PURCHASE_RETURN', 1, 'inventory_account', FALSE, 'cost'), ('PURCHASE_RETURN', 2, 'PR&Allowances', FALSE, 'cost'),
('TRANSFER', 0, 'inventory_account', TRUE, 'cost'), ('TRANSFER', 1, 'inventory_account', FALSE, 'cost'),
('PAYROLL', 0, 'salary_expense', TRUE, 'amount'), ('PAYROLL', 1, 'salary_payable', FALSE, 'amount')"""

# documents: (label of the description, roles named in the account check, legs as (role, debit))
_DOC_SQL = {
    ("AR", False): ("Account Receivable", "cash_account_ar/ar_account", [("cash_account_ar", False), ("ar_account", True)]),
    ("AP", False): ("Account Payable", "cash_account_ap/ap_account", [("cash_account_ap", True), ("ap_account", False)]),
    ("EXPENSE", False): ("", "cash/expense", [("cash_account_ar", True), ("expense_account", False)]),
    ("EXPENSE", True): ("", "cash/expense", [("expense_account", True), ("cash_account_ar", False)]),
    ("REVENUE", False): ("", "cash/revenue", [("cash_account_ar", False), ("revenue_account", True)]),
    ("REVENUE", True): ("", "cash/revenue", [("cash_account_ar", True), ("revenue_account", False)]),
}


def _legs_sql(events_cte: str) -> str:
    return f"""WITH ev AS ({events_cte}),
rules AS (SELECT * FROM (VALUES {_RULES_SQL}) AS t(kind, leg_no, role_name, is_debit, field)),
nlegs AS (SELECT kind, COUNT(*) AS n FROM rules GROUP BY kind),
complete AS (SELECT m.client_id, r.kind FROM rules r JOIN role_map m ON r.role_name = m.role_name
             GROUP BY m.client_id, r.kind HAVING COUNT(*) = (SELECT n FROM nlegs WHERE nlegs.kind = r.kind)),
legs AS (SELECT e.transaction_id, r.leg_no, m.chart_id, e.date, r.is_debit AS journal,
                CAST(CAST(CASE r.field WHEN 'amount' THEN e.amount WHEN 'net' THEN e.net WHEN 'tax' THEN e.tax
                     WHEN 'gross' THEN e.gross WHEN 'cost' THEN e.cost WHEN 'value' THEN e.value END AS DECIMAL(20,0)) / 100
                     AS DECIMAL(15,2)) AS amount
         FROM ev e JOIN complete c ON e.client_id = c.client_id AND e.kind = c.kind
         JOIN rules r ON r.kind = e.kind JOIN role_map m ON m.client_id = e.client_id AND m.role_name = r.role_name)"""


_MOVEMENT_EVENTS_SQL = f"""SELECT m.management_id AS transaction_id, p.client_id, {_KIND_SQL} AS kind, m.movement_date AS date,
       CAST(NULL AS BIGINT) AS amount, m.quantity * m.unit_cost_cents AS net,
       CAST(FLOOR(CAST(m.quantity * m.unit_cost_cents * {VAT_BP} + 5000 AS DECIMAL(38,0)) / 10000) AS BIGINT) AS tax,
       m.quantity * m.unit_cost_cents + CAST(FLOOR(CAST(m.quantity * m.unit_cost_cents * {VAT_BP} + 5000 AS DECIMAL(38,0)) / 10000) AS BIGINT) AS gross,
       m.quantity * m.unit_cost_cents AS cost, m.quantity * CAST(p.product_price * 100 AS BIGINT) AS value
FROM movements m JOIN products p ON m.product_id = p.product_id"""


@query("post_journals", "P2", views=COA_VIEWS + ["movements", "products"], money=["amount"],
       oracle=_legs_sql(_MOVEMENT_EVENTS_SQL) + "\nSELECT * FROM legs")
def _post_journals(b):
    legs, _rej = posting.post_journals(_movement_events(b), role_map(b))
    return legs


# ---- documents ---------------------------------------------------------------------

def ar_requests(b):
    wf, _ = sq.approved(b)
    ready = wf.where(F.col("new_state") == "APPROVE_L3").select("session_id", F.col("staging_record_id").alias("id"))
    s = sq.stg(b).join(ready, ["session_id", "id"], "left_semi")
    return s.select(
        F.col("id").alias("request_id"), V.parse_int("client_code").alias("client_id"),
        V.parse_int("customer_code").cast("long").alias("customer_id"),
        V.parse_decimal("amount").cast(MONEY).alias("amount"),
        F.col("invoice_date").try_cast("date").alias("invoice_date"), F.col("due_date").try_cast("date").alias("due_date"),
        "status", F.concat(F.lit("AR-IMPORT-"), F.col("customer_code"), F.lit("-"), F.col("invoice_date")).alias("idempotency_key"))


_AR_REQ_SQL = sq._APPROVE_SQL[len("WITH "):] + f""",
req AS (SELECT s.id AS request_id, {sq._pint('s.client_code')} AS client_id, CAST({sq._pint('s.customer_code')} AS BIGINT) AS customer_id,
               CAST({sq._pdec('s.amount')} AS DECIMAL(15,2)) AS amount, TRY_CAST(s.invoice_date AS DATE) AS invoice_date,
               TRY_CAST(s.due_date AS DATE) AS due_date, s.status,
               'AR-IMPORT-' || s.customer_code || '-' || s.invoice_date AS idempotency_key
        FROM stg s JOIN l3 ON s.session_id = l3.session_id AND s.id = l3.staging_record_id AND l3.new_state = 'APPROVE_L3')"""


def ap_requests(b):
    a = b.ap_ext.join(b.vendors.select("vendor_id", "client_id"), "vendor_id")
    return a.select(F.col("payable_id").alias("request_id"), "client_id", "vendor_id", "amount", "invoice_date",
                    "due_date", "status", F.concat(F.lit("AP-"), F.col("payable_id").cast("string")).alias("idempotency_key"))


_AP_REQ_SQL = """req AS (SELECT a.payable_id AS request_id, v.client_id, a.vendor_id, a.amount, a.invoice_date, a.due_date, a.status,
                      'AP-' || CAST(a.payable_id AS VARCHAR) AS idempotency_key FROM ap_ext a JOIN vendors v ON a.vendor_id = v.vendor_id)"""


def expense_requests(b):
    t = b.tax_entries.where(F.col("tax_type") == "VAT_INPUT").groupBy("transaction_id").agg(F.sum("tax_cents").alias("c"))
    t = t.join(b.transactions.select("transaction_id", "client_id", "date"), "transaction_id")
    return t.select(F.col("transaction_id").alias("request_id"), "client_id",
                    (F.col("c").cast("decimal(20,0)") / 100).cast(MONEY).alias("amount"), "date",
                    F.concat(F.lit("Input VAT for order "), F.col("transaction_id").cast("string")).alias("description"),
                    F.concat(F.lit("EXP-"), F.col("transaction_id").cast("string")).alias("idempotency_key"))


_EXP_REQ_SQL = """req AS (SELECT t.transaction_id AS request_id, x.client_id, CAST(CAST(t.c AS DECIMAL(20,0)) / 100 AS DECIMAL(15,2)) AS amount,
                       x.date, 'Input VAT for order ' || CAST(t.transaction_id AS VARCHAR) AS description,
                       'EXP-' || CAST(t.transaction_id AS VARCHAR) AS idempotency_key
                FROM (SELECT transaction_id, SUM(tax_cents) AS c FROM tax_entries WHERE tax_type = 'VAT_INPUT' GROUP BY transaction_id) t
                JOIN transactions x ON t.transaction_id = x.transaction_id)"""


def revenue_requests(b):
    a = b.ar_ext.where(F.col("status") == "Paid").join(b.customers.select("customer_id", "client_id"), "customer_id")
    return a.select(F.col("receivable_id").alias("request_id"), "client_id", "amount", F.col("invoice_date").alias("date"),
                    F.concat(F.lit("Receipt for receivable "), F.col("receivable_id").cast("string")).alias("description"),
                    F.concat(F.lit("REV-"), F.col("receivable_id").cast("string")).alias("idempotency_key"))


_REV_REQ_SQL = """req AS (SELECT a.receivable_id AS request_id, c.client_id, a.amount, a.invoice_date AS date,
                       'Receipt for receivable ' || CAST(a.receivable_id AS VARCHAR) AS description,
                       'REV-' || CAST(a.receivable_id AS VARCHAR) AS idempotency_key
                FROM ar_ext a JOIN customers c ON a.customer_id = c.customer_id WHERE a.status = 'Paid')"""


def _doc_sql(kind: str, req_sql: str, standard: bool = False) -> str:
    """DuckDB form of ``posting.post_document``; the body ends with CTEs numbered, tx, jl, comp."""
    label, roles_txt, legs = _DOC_SQL[kind, standard]
    need = sorted({r for r, _d in legs})
    is_doc = kind in ("AR", "AP")
    party = {"AR": ("customer_id", "customers", "Customer"), "AP": ("vendor_id", "vendors", "Vendor")}.get(kind)
    party_join = (f"LEFT JOIN (SELECT DISTINCT {party[0]} AS pid FROM {party[1]}) p ON r.{party[0]} = p.pid"
                  if party else "")
    party_ok = "p.pid IS NOT NULL" if party else "TRUE"
    date_col = "invoice_date" if is_doc else "date"
    dates_bad = "COALESCE(invoice_date > due_date, FALSE)" if is_doc else "FALSE"
    cname = party[2] if party else ""
    if is_doc:
        desc = (f"'{label} With Amount of ' || CAST(amount AS VARCHAR) || ' Due Date on ' || CAST(due_date AS VARCHAR)"
                " || ' Status ' || status")
    else:
        desc = "description"
    leg_sel = " UNION ALL ".join(
        f"SELECT n.transaction_id, {i} AS leg_no, m.chart_id, n.{date_col} AS date, {str(d).upper()} AS journal, "
        f"CAST(n.amount AS DECIMAL(15,2)) AS amount FROM numbered n JOIN role_map m ON m.client_id = n.client_id "
        f"AND m.role_name = '{r}'" for i, (r, d) in enumerate(legs))
    comp = [f"""SELECT request_id, client_id, 'Client Rules' AS compliance_rule, 'Client not found!' AS description,
       'CLIENT_CHECK' AS check_type, 'FAIL' AS status, 'Client ID not found in database' AS details FROM rs WHERE NOT client_ok"""]
    if party:
        comp.append(f"""SELECT request_id, client_id, '{cname} Rules', '{cname} not found!', '{cname.upper()}_CHECK', 'FAIL',
       '{cname} ID not found in database' FROM rs WHERE client_ok AND NOT party_ok""")
    comp.append("""SELECT request_id, client_id, 'Amounts Rule', 'Positive Amount Only!', 'AMOUNT_CHECK', 'FAIL',
       'Amount is ' || COALESCE(CAST(amount AS VARCHAR), 'NULL') FROM rs
       WHERE reason IN ('Invalid Amount: Must be positive', 'Invalid Amount: Must not be null')""")
    if is_doc:
        comp.append("""SELECT request_id, client_id, 'Dates Rule', 'Due date must be after invoice date', 'DATE_CHECK', 'FAIL',
       'Invoice: ' || CAST(invoice_date AS VARCHAR) || ', Due: ' || CAST(due_date AS VARCHAR) FROM rs
       WHERE reason = 'Due Date must be after Invoice Date'""")
    comp.append("""SELECT request_id, client_id, 'Duplicate Rules', 'Duplicate Transaction Detected', 'DUPLICATE_CHECK', 'FAIL',
       CASE WHEN existing IS NOT NULL THEN 'Duplicate Transaction ID: ' || CAST(existing AS VARCHAR)
            ELSE 'Duplicate Request ID: ' || CAST(win AS VARCHAR) END FROM tagged WHERE request_id <> win OR existing IS NOT NULL""")
    need_list = ", ".join(f"'{r}'" for r in need)
    return f"""WITH {req_sql},
chk AS (SELECT r.*, k.client_id IS NOT NULL AS client_ok, {party_ok} AS party_ok, COALESCE(n.nr, 0) = {len(need)} AS acc_ok
        FROM req r LEFT JOIN (SELECT DISTINCT client_id FROM clients) k ON r.client_id = k.client_id {party_join}
        LEFT JOIN (SELECT client_id, COUNT(DISTINCT role_name) AS nr FROM role_map WHERE role_name IN ({need_list})
                   GROUP BY client_id) n ON r.client_id = n.client_id),
rs AS (SELECT *, CASE WHEN NOT client_ok THEN 'Client not found!' WHEN NOT party_ok THEN '{cname} not found!'
                      WHEN NOT acc_ok THEN 'Required accounts ({roles_txt}) not found for client ' || CAST(client_id AS VARCHAR)
                      WHEN amount IS NULL THEN 'Invalid Amount: Must not be null'
                      WHEN amount < 0 THEN 'Invalid Amount: Must be positive'
                      WHEN {dates_bad} THEN 'Due Date must be after Invoice Date' END AS reason FROM chk),
passed AS (SELECT * EXCLUDE (client_ok, party_ok, acc_ok, reason) FROM rs WHERE reason IS NULL AND idempotency_key IS NOT NULL),
tagged AS (SELECT p.*, MIN(p.request_id) OVER (PARTITION BY p.idempotency_key) AS win, e.transaction_id AS existing
           FROM passed p LEFT JOIN transactions e ON e.idempotency_key = p.idempotency_key),
fresh AS (SELECT * EXCLUDE (win, existing) FROM tagged WHERE request_id = win AND existing IS NULL),
numbered AS (SELECT f.*, (SELECT MAX(transaction_id) FROM transactions) + row_number() OVER (ORDER BY request_id) AS transaction_id
             FROM fresh f),
tx AS (SELECT transaction_id, client_id, idempotency_key, {desc} AS description, {date_col} AS date, request_id FROM numbered),
jl AS ({leg_sel}),
comp AS ({' UNION ALL '.join(comp)})"""


_DOC_VIEWS = COA_VIEWS + ["transactions", "customers", "vendors"]
_AR_SQL = _doc_sql("AR", _AR_REQ_SQL)
_AP_SQL = _doc_sql("AP", _AP_REQ_SQL)


def _ar(b, checks_only: bool = False):
    return posting.post_ar(ar_requests(b), b.clients, b.customers, role_map(b), b.transactions, checks_only)


@query("post_ar_transactions", "P3", views=_DOC_VIEWS + sq.STG_VIEWS, oracle=_AR_SQL + "\nSELECT * FROM tx")
def _post_ar_transactions(b):
    return _ar(b)["transactions"]


@query("post_ar_journals", "P3", views=_DOC_VIEWS + sq.STG_VIEWS, money=["amount"], oracle=_AR_SQL + "\nSELECT * FROM jl")
def _post_ar_journals(b):
    return _ar(b)["journals"]


@query("post_ar_compliance", "P3", views=_DOC_VIEWS + sq.STG_VIEWS, oracle=_AR_SQL + "\nSELECT * FROM comp")
def _post_ar_compliance(b):
    return _ar(b, checks_only=True)["compliance"]


@query("post_ar_rejected", "P3", views=_DOC_VIEWS + sq.STG_VIEWS, oracle=_AR_SQL + """
SELECT request_id, reason AS error FROM rs WHERE reason IS NOT NULL
UNION ALL SELECT request_id, 'Duplicate Transaction Detected' FROM tagged WHERE request_id <> win OR existing IS NOT NULL
UNION ALL SELECT request_id, 'Idempotency key is required' FROM rs WHERE reason IS NULL AND idempotency_key IS NULL""")
def _post_ar_rejected(b):
    return _ar(b, checks_only=True)["rejected"]


@query("post_ar_extensions", "P3", views=_DOC_VIEWS + sq.STG_VIEWS, money=["amount"], oracle=_AR_SQL + """
SELECT transaction_id AS receivable_id, amount, due_date, invoice_date, status FROM numbered""")
def _post_ar_extensions(b):
    return _ar(b)["extensions"]


def _ap(b):
    return posting.post_ap(ap_requests(b), b.clients, b.vendors, role_map(b), b.transactions)


@query("post_ap_transactions", "P4", views=_DOC_VIEWS + ["ap_ext"], oracle=_AP_SQL + "\nSELECT * FROM tx")
def _post_ap_transactions(b):
    return _ap(b)["transactions"]


@query("post_ap_journals", "P4", views=_DOC_VIEWS + ["ap_ext"], money=["amount"], oracle=_AP_SQL + "\nSELECT * FROM jl")
def _post_ap_journals(b):
    return _ap(b)["journals"]


@query("post_expense", "P5", views=_DOC_VIEWS + ["tax_entries"], money=["amount"],
       oracle=_doc_sql("EXPENSE", _EXP_REQ_SQL) + "\nSELECT * FROM jl")
def _post_expense(b):
    return posting.post_expense(expense_requests(b), b.clients, role_map(b), b.transactions)["journals"]


@query("post_expense_standard", "P5", views=_DOC_VIEWS + ["tax_entries"], money=["amount"],
       oracle=_doc_sql("EXPENSE", _EXP_REQ_SQL, standard=True) + "\nSELECT * FROM jl")
def _post_expense_standard(b):
    return posting.post_expense(expense_requests(b), b.clients, role_map(b), b.transactions, standard=True)["journals"]


@query("post_revenue", "P6", views=_DOC_VIEWS + ["ar_ext"], money=["amount"],
       oracle=_doc_sql("REVENUE", _REV_REQ_SQL) + "\nSELECT * FROM jl")
def _post_revenue(b):
    return posting.post_revenue(revenue_requests(b), b.clients, role_map(b), b.transactions)["journals"]


# ---- inventory postings ---------------------------------------------------------------

def _purchases(b):
    m = b.movements.where(F.col("action_type") == "Purchase").join(b.products.select("product_id", "client_id"), "product_id")
    return m.select(F.col("management_id").alias("transaction_id"), "client_id", "product_id", "warehouse_id",
                    "quantity", "unit_cost_cents", F.col("movement_date").alias("date"))


_PURCHASE_EV_SQL = f"""SELECT m.management_id AS transaction_id, p.client_id, 'PURCHASE' AS kind, m.movement_date AS date,
       CAST(NULL AS BIGINT) AS amount, m.quantity * m.unit_cost_cents AS net,
       CAST(FLOOR(CAST(m.quantity * m.unit_cost_cents * {VAT_BP} + 5000 AS DECIMAL(38,0)) / 10000) AS BIGINT) AS tax,
       m.quantity * m.unit_cost_cents + CAST(FLOOR(CAST(m.quantity * m.unit_cost_cents * {VAT_BP} + 5000 AS DECIMAL(38,0)) / 10000) AS BIGINT) AS gross,
       CAST(NULL AS BIGINT) AS cost, CAST(NULL AS BIGINT) AS value
FROM movements m JOIN products p ON m.product_id = p.product_id WHERE m.action_type = 'Purchase'"""


@query("post_purchase", "P7", views=COA_VIEWS + ["movements", "products"], money=["amount"],
       oracle=_legs_sql(_PURCHASE_EV_SQL) + "\nSELECT * FROM legs")
def _post_purchase(b):
    return posting.post_purchase(_purchases(b), role_map(b), VAT_BP)["journals"]


@query("post_purchase_payables", "P7", views=["movements"], money=["amount"], oracle=f"""
SELECT management_id AS payable_id, management_id AS transaction_id,
       CAST(CAST(quantity * unit_cost_cents + CAST(FLOOR(CAST(quantity * unit_cost_cents * {VAT_BP} + 5000 AS DECIMAL(38,0)) / 10000) AS BIGINT)
            AS DECIMAL(20,0)) / 100 AS DECIMAL(15,2)) AS amount,
       movement_date AS invoice_date, CAST(movement_date + INTERVAL 30 DAY AS DATE) AS due_date, 'Pending' AS status
FROM movements WHERE action_type = 'Purchase'""")
def _post_purchase_payables(b):
    return posting.post_purchase(_purchases(b), role_map(b), VAT_BP)["payables"]


# client 3 has lost its accounts: its purchases and sales are rejected whole
def _roles_but_3(b):
    return role_map(b).where(F.col("client_id") != 3)


@query("post_purchase_roleless", "P7", views=["movements", "products"], oracle="""
WITH p AS (SELECT m.management_id AS transaction_id, p.client_id FROM movements m JOIN products p ON m.product_id = p.product_id WHERE m.action_type = 'Purchase')
SELECT transaction_id, client_id <> 3 AS moved, client_id <> 3 AS layered, client_id <> 3 AS payable,
       CASE WHEN client_id = 3 THEN 'Account role inventory_account not found for client 3' END AS error FROM p""")
def _post_purchase_roleless(b):
    out = posting.post_purchase(_purchases(b), _roles_but_3(b), VAT_BP)
    found = _purchases(b).select("transaction_id")
    for kind, key, name in (("movements", "transaction_id", "moved"), ("layers", "operation_id", "layered"), ("payables", "transaction_id", "payable")):
        found = found.join(out[kind].select(F.col(key).alias("transaction_id"), F.lit(True).alias(name)), "transaction_id", "left")
        found = found.withColumn(name, F.coalesce(name, F.lit(False)))
    return found.join(out["rejected"], "transaction_id", "left")


def _sales(b):
    m = b.movements.where(F.col("action_type") == "Sale").join(b.products.select("product_id", "client_id"), "product_id")
    return m.select(F.col("management_id").alias("transaction_id"), "client_id", "product_id", "warehouse_id", "quantity",
                    F.col("unit_cost_cents").alias("unit_price_cents"), F.col("movement_date").alias("date"))


def _sales_and_slices(b):
    """The sales and their layer slices, each worked out once: every side of a posting reads them again."""
    s = landed(_sales(b), "post_sale/sales")
    slices = costing.allocate_layers(
        s.select(F.col("transaction_id").alias("sale_id"), "product_id", F.col("date").alias("sale_date"), "quantity"),
        b.layers, "fifo")
    return s, landed(slices, "post_sale/slices")


def _sale_post(b):
    s, slices = _sales_and_slices(b)
    return posting.post_sale(s, slices, role_map(b), VAT_BP)


_SALE_SQL_BASE = """sales AS (SELECT m.management_id AS sale_id, m.product_id, p.client_id, m.movement_date AS sale_date, m.quantity,
                         m.unit_cost_cents AS unit_price_cents
                  FROM movements m JOIN products p ON m.product_id = p.product_id WHERE m.action_type = 'Sale'),
s AS (SELECT sale_id, product_id, quantity,
             SUM(quantity) OVER (PARTITION BY product_id ORDER BY sale_date, sale_id ROWS UNBOUNDED PRECEDING) AS d_hi
      FROM sales WHERE quantity > 0),
l AS (SELECT operation_id, product_id, unit_cost_cents, quantity,
             SUM(quantity) OVER (PARTITION BY product_id ORDER BY purchase_date, operation_id ROWS UNBOUNDED PRECEDING) AS s_hi
      FROM layers WHERE quantity > 0),
alloc AS (SELECT s.sale_id, l.operation_id, CAST(LEAST(s.d_hi, l.s_hi) - GREATEST(s.d_hi - s.quantity, l.s_hi - l.quantity) AS BIGINT) AS units,
                 l.unit_cost_cents
          FROM s JOIN l ON s.product_id = l.product_id AND l.s_hi - l.quantity < s.d_hi AND s.d_hi - s.quantity < l.s_hi),
full_sales AS (SELECT x.* FROM sales x JOIN (SELECT sale_id, SUM(units) AS u FROM alloc GROUP BY sale_id) a
               ON x.sale_id = a.sale_id AND a.u >= x.quantity)"""


_SALE_EV_SQL = f"""SELECT a.sale_id AS transaction_id, f.client_id, 'SALE' AS kind, f.sale_date AS date, CAST(NULL AS BIGINT) AS amount,
       a.units * f.unit_price_cents AS net,
       CAST(FLOOR(CAST(a.units * f.unit_price_cents * {VAT_BP} + 5000 AS DECIMAL(38,0)) / 10000) AS BIGINT) AS tax,
       a.units * f.unit_price_cents + CAST(FLOOR(CAST(a.units * f.unit_price_cents * {VAT_BP} + 5000 AS DECIMAL(38,0)) / 10000) AS BIGINT) AS gross,
       a.units * a.unit_cost_cents AS cost, CAST(NULL AS BIGINT) AS value
FROM alloc a JOIN full_sales f ON a.sale_id = f.sale_id"""


@query("post_sale", "P8", views=COA_VIEWS + ["movements", "products", "layers"], money=["amount"],
       oracle="WITH " + _SALE_SQL_BASE + ",\n" + _legs_sql(_SALE_EV_SQL)[len("WITH "):] + "\nSELECT * FROM legs")
def _post_sale(b):
    return _sale_post(b)["journals"]


@query("post_sale_roleless", "P8", views=["movements", "products", "layers"],
       oracle="WITH " + _SALE_SQL_BASE + """
SELECT s.sale_id AS transaction_id, f.sale_id IS NOT NULL AND s.client_id <> 3 AS moved, f.sale_id IS NOT NULL AND s.client_id <> 3 AS receivable,
       f.sale_id IS NULL AS short, f.sale_id IS NOT NULL AND s.client_id = 3 AS roleless FROM sales s LEFT JOIN full_sales f ON f.sale_id = s.sale_id""")
def _post_sale_roleless(b):
    s, slices = _sales_and_slices(b)
    out = posting.post_sale(s, slices, _roles_but_3(b), VAT_BP)
    out["rejected"] = landed(out["rejected"], "post_sale/rejected")
    found = s.select("transaction_id")
    error = F.col("error").startswith("Insufficient quantity")
    sides = (("moved", out["movements"]), ("receivable", out["receivables"]), ("short", out["rejected"].where(error)), ("roleless", out["rejected"].where(~error)))
    for name, rows in sides:
        found = found.join(rows.select("transaction_id", F.lit(True).alias(name)), "transaction_id", "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return found


@query("post_sale_receivables", "P8", views=COA_VIEWS + ["movements", "products", "layers"], money=["amount"],
       oracle="WITH " + _SALE_SQL_BASE + f""",
g AS (SELECT a.sale_id, SUM(a.units * f.unit_price_cents
                           + CAST(FLOOR(CAST(a.units * f.unit_price_cents * {VAT_BP} + 5000 AS DECIMAL(38,0)) / 10000) AS BIGINT)) AS gross,
             MIN(f.sale_date) AS invoice_date FROM alloc a JOIN full_sales f ON a.sale_id = f.sale_id GROUP BY a.sale_id)
SELECT sale_id AS receivable_id, sale_id AS transaction_id, CAST(CAST(gross AS DECIMAL(20,0)) / 100 AS DECIMAL(15,2)) AS amount,
       invoice_date, CAST(invoice_date + INTERVAL 30 DAY AS DATE) AS due_date, 'Pending' AS status FROM g""")
def _post_sale_receivables(b):
    return _sale_post(b)["receivables"]


def _returns(b):
    m = b.movements.where(F.col("action_type").isin("Sale Return", "Purchase Return")).join(
        b.products.select("product_id", "client_id", "product_price"), "product_id")
    return m.select(F.col("management_id").alias("transaction_id"), "client_id", "action_type", "quantity",
                    (F.col("product_price") * 100).cast("long").alias("unit_price_cents"), "unit_cost_cents",
                    F.col("movement_date").alias("date"), F.col("transaction_id").alias("document_id"))


_RETURN_EV_SQL = """SELECT m.management_id AS transaction_id, p.client_id,
       CASE m.action_type WHEN 'Sale Return' THEN 'SALE_RETURN' ELSE 'PURCHASE_RETURN' END AS kind, m.movement_date AS date,
       CAST(NULL AS BIGINT) AS amount, CAST(NULL AS BIGINT) AS net, CAST(NULL AS BIGINT) AS tax, CAST(NULL AS BIGINT) AS gross,
       m.quantity * m.unit_cost_cents AS cost, m.quantity * CAST(p.product_price * 100 AS BIGINT) AS value
FROM movements m JOIN products p ON m.product_id = p.product_id WHERE m.action_type IN ('Sale Return', 'Purchase Return')"""


@query("post_returns", "P9", views=COA_VIEWS + ["movements", "products"], money=["amount"],
       oracle=_legs_sql(_RETURN_EV_SQL) + "\nSELECT * FROM legs")
def _post_returns(b):
    docs = b.ar_ext.select(F.col("transaction_id").alias("document_id"), "status")
    return posting.post_returns(_returns(b), docs, role_map(b))["journals"]


@query("post_returns_documents", "P9", views=["movements", "ar_ext"], oracle="""
SELECT a.transaction_id AS document_id,
       CASE WHEN r.document_id IS NOT NULL THEN 'Returned' ELSE a.status END AS status
FROM ar_ext a LEFT JOIN (SELECT DISTINCT transaction_id AS document_id FROM movements
                         WHERE action_type IN ('Sale Return', 'Purchase Return')) r ON a.transaction_id = r.document_id""")
def _post_returns_documents(b):
    docs = b.ar_ext.select(F.col("transaction_id").alias("document_id"), "status")
    m = b.movements.where(F.col("action_type").isin("Sale Return", "Purchase Return")).select(
        F.col("management_id").alias("transaction_id"), F.lit(0).alias("client_id"), "action_type", "quantity",
        F.lit(0).cast("long").alias("unit_price_cents"), "unit_cost_cents", F.col("movement_date").alias("date"),
        F.col("transaction_id").alias("document_id"))
    return posting.post_returns(m, docs, b.spark.createDataFrame([], "client_id int, role_name string, chart_id int"))["documents"]


_TRANSFER_EV_SQL = """SELECT m.management_id AS transaction_id, p.client_id, 'TRANSFER' AS kind, m.movement_date AS date,
       CAST(NULL AS BIGINT) AS amount, CAST(NULL AS BIGINT) AS net, CAST(NULL AS BIGINT) AS tax, CAST(NULL AS BIGINT) AS gross,
       m.quantity * m.unit_cost_cents AS cost, CAST(NULL AS BIGINT) AS value
FROM movements m JOIN products p ON m.product_id = p.product_id
WHERE m.action_type = 'Sale Return' AND m.transaction_id % 13 <> 0"""


def _transfer(b):
    # the transfers of the inventory queries: Sale Return rows moved to the next warehouse, some of them to their own
    m = b.movements.where(F.col("action_type") == "Sale Return").join(b.products.select("product_id", "client_id"), "product_id")
    to = F.when(F.col("transaction_id") % 13 == 0, F.col("warehouse_id")).otherwise(F.col("warehouse_id") % 3 + 1)
    t = m.select(F.col("management_id").alias("transaction_id"), "client_id", F.col("warehouse_id").alias("from_warehouse_id"),
                 to.cast("int").alias("to_warehouse_id"), "quantity", "unit_cost_cents", F.col("movement_date").alias("date"))
    return posting.post_transfer(t, role_map(b))


@query("post_transfer", "P10", views=COA_VIEWS + ["movements", "products"], money=["amount"],
       oracle=_legs_sql(_TRANSFER_EV_SQL) + "\nSELECT * FROM legs")
def _post_transfer(b):
    return _transfer(b)[0]


@query("post_transfer_rejected", "P10", views=["movements", "products"], oracle="""
SELECT m.management_id AS transaction_id, 'Source and destination must differ' AS error FROM movements m JOIN products p ON m.product_id = p.product_id
WHERE m.action_type = 'Sale Return' AND m.transaction_id % 13 = 0""")
def _post_transfer_rejected(b):
    return _transfer(b)[1]


@query("dedupe_idempotent", "P11", views=["event_log", "transactions", "customers"], money=["amount"], oracle="""
SELECT e.event_id AS request_id, e.event_type, e.created_at, e.idempotency_key, e.user_id, e.amount, e.payload,
       CASE WHEN x.transaction_id IS NOT NULL THEN 'EXISTING' ELSE 'BATCH' END AS duplicate_source,
       COALESCE(x.transaction_id, w.win) AS duplicate_of
FROM event_log e JOIN (SELECT idempotency_key, MIN(event_id) AS win FROM event_log GROUP BY idempotency_key) w
  ON e.idempotency_key = w.idempotency_key
LEFT JOIN transactions x ON x.idempotency_key = e.idempotency_key
WHERE e.event_id <> w.win OR x.transaction_id IS NOT NULL""")
def _dedupe_idempotent(b):
    req = b.event_log.withColumnRenamed("event_id", "request_id")
    return posting.dedupe_idempotent(req, b.transactions)["duplicates"]


_KEYED_SQL = """WITH req AS (SELECT event_id AS request_id, event_type, created_at,
       CASE WHEN event_id % 11 = 0 THEN NULL ELSE idempotency_key END AS idempotency_key, user_id, amount, payload FROM event_log),
win AS (SELECT idempotency_key, MIN(request_id) AS w FROM req WHERE idempotency_key IS NOT NULL GROUP BY idempotency_key)
"""


def _some_without_key(b):
    r = b.event_log.withColumnRenamed("event_id", "request_id")
    return r.withColumn("idempotency_key", F.when(F.col("request_id") % 11 != 0, F.col("idempotency_key")))


@query("dedupe_fresh", "P11", views=["event_log", "transactions", "customers"], money=["amount"], oracle=_KEYED_SQL + """
SELECT r.* FROM req r JOIN win ON r.idempotency_key = win.idempotency_key AND r.request_id = win.w
WHERE NOT EXISTS (SELECT 1 FROM transactions t WHERE t.idempotency_key = r.idempotency_key)""")
def _dedupe_fresh(b):
    return posting.dedupe_idempotent(_some_without_key(b), b.transactions)["fresh"]


@query("dedupe_rejected", "P11", views=["event_log"], money=["amount"], oracle=_KEYED_SQL + """
SELECT *, 'Idempotency key is required' AS error FROM req WHERE idempotency_key IS NULL""")
def _dedupe_rejected(b):
    return posting.dedupe_idempotent(_some_without_key(b), b.transactions)["rejected"]


# a ledger that holds every third key twice: a request still gets one answer, the first id
@query("dedupe_twice_held", "P11", views=["event_log", "transactions", "customers"], money=["amount"], oracle="""
WITH ledger AS (SELECT idempotency_key, event_id + 1000000 AS transaction_id FROM event_log WHERE event_id % 5 = 0
                UNION ALL SELECT idempotency_key, event_id + 2000000 FROM event_log WHERE event_id % 15 = 0),
x AS (SELECT idempotency_key, MIN(transaction_id) AS transaction_id FROM ledger GROUP BY idempotency_key)
SELECT e.event_id AS request_id, e.event_type, e.created_at, e.idempotency_key, e.user_id, e.amount, e.payload,
       CASE WHEN x.transaction_id IS NOT NULL THEN 'EXISTING' ELSE 'BATCH' END AS duplicate_source,
       COALESCE(x.transaction_id, w.win) AS duplicate_of
FROM event_log e JOIN (SELECT idempotency_key, MIN(event_id) AS win FROM event_log GROUP BY idempotency_key) w
  ON e.idempotency_key = w.idempotency_key
LEFT JOIN x ON x.idempotency_key = e.idempotency_key
WHERE e.event_id <> w.win OR x.transaction_id IS NOT NULL""")
def _dedupe_twice_held(b):
    own = b.event_log.select("idempotency_key", "event_id")
    held = lambda n, add: own.where(F.col("event_id") % n == 0).select("idempotency_key", (F.col("event_id") + add).alias("transaction_id"))
    req = b.event_log.withColumnRenamed("event_id", "request_id")
    return posting.dedupe_idempotent(req, held(5, 1_000_000).unionByName(held(15, 2_000_000)))["duplicates"]


@query("dedupe_indexed", "P11", views=["event_log", "transactions", "customers"], money=["amount"], oracle=_KEYED_SQL + """,
ledger AS (SELECT idempotency_key FROM transactions UNION ALL SELECT idempotency_key FROM event_log WHERE event_id % 4 = 0 AND created_at < TIMESTAMP '2024-01-16')
SELECT r.* FROM req r JOIN win ON r.idempotency_key = win.idempotency_key AND r.request_id = win.w
WHERE NOT EXISTS (SELECT 1 FROM ledger t WHERE t.idempotency_key = r.idempotency_key)""")
def _dedupe_indexed(b):
    # the ledger's keys by year, and a day's worth of posted events per part; requests open only parts that may hold them
    index = KeyIndex(b.spark, ensure_checkpoint_dir(b.spark).rstrip("/") + f"/dedupe_indexed/{uuid.uuid4().hex}")
    parts = []
    years = b.transactions.select(F.year("date").alias("y")).distinct()
    for y in sorted(r["y"] for r in years.collect()):  # a few parts
        index.add(f"y{y}", b.transactions.where(F.year("date") == y))
        parts.append(f"y{y}")
    posted = b.event_log.where((F.col("event_id") % 4 == 0) & (F.col("created_at") < F.lit("2024-01-16").cast("timestamp_ntz")))
    index.add("posted", posted.select("idempotency_key", F.col("event_id").alias("transaction_id")))
    req = _some_without_key(b)
    return posting.dedupe_idempotent(req, index.lookup(req, [*parts, "posted"]))["fresh"]


# ---- recurring, amendments, master data, staged posting --------------------------------

EXEC_DATE = "2001-12-01"


def recurring_templates(b):
    c = b.raw("customer").select("c_custkey", "c_name", "c_acctbal").join(
        b.customers.select("customer_id", "client_id"), F.col("c_custkey") == F.col("customer_id"))
    cents = F.round(F.col("c_acctbal") * 100).cast("long")
    t = c.select(F.col("customer_id").alias("template_id"), "client_id",
                 F.concat(F.lit("Monthly service fee for "), F.col("c_name")).alias("template_name"),
                 (F.col("c_acctbal") > 0).alias("is_active"), cents.alias("_cents"))
    fee = (F.floor((F.col("_cents") + 5) / 10).cast("decimal(20,0)") / 100).cast(MONEY)
    legs = F.array(F.struct((F.col("client_id") * 100 + 3).cast("int").alias("chart_id"), F.lit(True).alias("is_debit")),
                   F.struct((F.col("client_id") * 100 + 5).cast("int").alias("chart_id"), F.lit(False).alias("is_debit")))
    d = t.where(F.col("_cents") > 100000).select("template_id", fee.alias("amount"), F.inline(legs))
    return t.drop("_cents"), d


_REC_SQL = f"""tpl AS (SELECT c.c_custkey AS template_id, k.client_id, 'Monthly service fee for ' || c.c_name AS template_name,
                c.c_acctbal > 0 AS is_active, CAST(ROUND(c.c_acctbal * 100) AS BIGINT) AS cents
         FROM customer c JOIN customers k ON c.c_custkey = k.customer_id),
det AS (SELECT template_id, CAST(CAST(FLOOR((cents + 5) / 10) AS DECIMAL(20,0)) / 100 AS DECIMAL(15,2)) AS amount,
               CAST(client_id * 100 + 3 AS INT) AS chart_id, TRUE AS is_debit FROM tpl WHERE cents > 100000
        UNION ALL
        SELECT template_id, CAST(CAST(FLOOR((cents + 5) / 10) AS DECIMAL(20,0)) / 100 AS DECIMAL(15,2)),
               CAST(client_id * 100 + 5 AS INT), FALSE FROM tpl WHERE cents > 100000),
act AS (SELECT t.*, EXISTS (SELECT 1 FROM det d WHERE d.template_id = t.template_id) AS has,
               'REC-' || CAST(t.template_id AS VARCHAR) || '-' || '{EXEC_DATE}' AS idempotency_key
        FROM tpl t WHERE t.is_active),
num AS (SELECT a.*, (SELECT MAX(transaction_id) FROM transactions) + row_number() OVER (ORDER BY template_id) AS transaction_id
        FROM act a WHERE has AND NOT EXISTS (SELECT 1 FROM transactions x WHERE x.idempotency_key = a.idempotency_key))"""


def _recurring(b):
    t, d = recurring_templates(b)
    return posting.process_recurring(t, d, EXEC_DATE, b.transactions)


@query("process_recurring", "P14", views=["customers", "transactions"], oracle=f"""WITH {_REC_SQL}
SELECT a.template_id, a.client_id, DATE '{EXEC_DATE}' AS scheduled_date,
       CASE WHEN n.transaction_id IS NOT NULL THEN 'EXECUTED' WHEN NOT a.has THEN 'FAILED' ELSE 'SKIPPED' END AS status,
       n.transaction_id, CASE WHEN NOT a.has THEN 'No recurring details for template' END AS error_message
FROM act a LEFT JOIN num n ON a.template_id = n.template_id""")
def _process_recurring(b):
    return _recurring(b)["executions"]


@query("process_recurring_journals", "P14", views=["customers", "transactions"], money=["amount"], oracle=f"""WITH {_REC_SQL}
SELECT n.transaction_id, d.chart_id, DATE '{EXEC_DATE}' AS date, d.is_debit AS journal, d.amount
FROM det d JOIN num n ON d.template_id = n.template_id""")
def _process_recurring_journals(b):
    return _recurring(b)["journals"]


@query("process_recurring_summary", "P14", views=["customers", "transactions"], oracle=f"""WITH {_REC_SQL},
ex AS (SELECT a.client_id, CASE WHEN n.transaction_id IS NOT NULL THEN 'EXECUTED' WHEN NOT a.has THEN 'FAILED' ELSE 'SKIPPED' END AS status
       FROM act a LEFT JOIN num n ON a.template_id = n.template_id)
SELECT client_id, count_if(status = 'EXECUTED') AS executed_count, count_if(status = 'FAILED') AS failed_count,
       'Processed ' || CAST(count_if(status = 'EXECUTED') AS VARCHAR) || ' recurring transactions, '
         || CAST(count_if(status = 'FAILED') AS VARCHAR) || ' failed' AS message FROM ex GROUP BY client_id""")
def _process_recurring_summary(b):
    return _recurring(b)["summary"]


def ar_corrections(b):
    a = b.ar_ext.where(F.col("status") == "Partially Paid")
    cents = (F.col("amount") * 100).cast("long")
    return a.select("receivable_id", "transaction_id", F.when(F.col("receivable_id") % 3 == 0, F.col("customer_id") + 1).alias("customer_id"),
                    "invoice_date", F.date_add("due_date", 15).alias("due_date"),
                    (F.floor(cents * 9 / 10).cast("decimal(20,0)") / 100).cast(MONEY).alias("amount"),
                    F.when(F.col("receivable_id") % 2 == 0, "Paid").otherwise("Partially Paid").alias("status"))


_ARC_SQL = """corr AS (SELECT receivable_id, transaction_id, CASE WHEN receivable_id % 3 = 0 THEN customer_id + 1 END AS customer_id,
        invoice_date, CAST(due_date + INTERVAL 15 DAY AS DATE) AS due_date,
        CAST(CAST(FLOOR(CAST(amount * 100 AS BIGINT) * 9 / 10) AS DECIMAL(20,0)) / 100 AS DECIMAL(15,2)) AS amount,
        CASE WHEN receivable_id % 2 = 0 THEN 'Paid' ELSE 'Partially Paid' END AS status FROM ar_ext WHERE status = 'Partially Paid'),
good AS (SELECT * FROM corr WHERE status IN ('Pending', 'Paid', 'Overdue'))"""


def ap_corrections(b):
    a = b.ap_ext.where(F.col("status") == "Paid")
    return a.select("payable_id", "transaction_id", (F.col("vendor_id") + 1).alias("vendor_id"), "invoice_date",
                    F.date_add("due_date", 10).alias("due_date"), (F.col("amount") + 1).cast(MONEY).alias("amount"),
                    F.when(F.col("payable_id") % 4 == 0, F.lit("")).otherwise(F.lit("Overdue")).alias("status"))


_APC_SQL = """corr AS (SELECT payable_id, transaction_id, vendor_id + 1 AS vendor_id, invoice_date, CAST(due_date + INTERVAL 10 DAY AS DATE) AS due_date,
        CAST(amount + 1 AS DECIMAL(15,2)) AS amount, CASE WHEN payable_id % 4 = 0 THEN '' ELSE 'Overdue' END AS status FROM ap_ext WHERE status = 'Paid'),
good AS (SELECT * FROM corr WHERE status IN ('Pending', 'Paid', 'Overdue'))"""


def _amend_sql(doc: str, party: str, table: str) -> str:
    return f"""SELECT e.{doc}, e.transaction_id, COALESCE(g.{party}, e.{party}) AS {party},
       CASE WHEN g.{doc} IS NULL THEN e.amount ELSE g.amount END AS amount,
       CASE WHEN g.{doc} IS NULL THEN e.invoice_date ELSE g.invoice_date END AS invoice_date,
       CASE WHEN g.{doc} IS NULL THEN e.due_date ELSE g.due_date END AS due_date,
       CASE WHEN g.{doc} IS NULL THEN e.status ELSE g.status END AS status, g.{doc} IS NOT NULL AS amended
FROM {table} e LEFT JOIN good g ON e.{doc} = g.{doc}"""


def _amend_legs_sql(cash: str, control: str) -> str:
    return f"""rc AS (SELECT chart_id, bool_or(role_name = '{cash}') AS cash, MIN(client_id) AS client FROM role_map WHERE role_name IN ('{cash}', '{control}') GROUP BY chart_id),
nl AS (SELECT j.journal_id, j.transaction_id, j.chart_id, g.transaction_id IS NOT NULL AS amended,
       CASE WHEN rc.chart_id IS NOT NULL AND g.transaction_id IS NOT NULL THEN g.invoice_date ELSE j.date END AS date, j.journal,
       CAST(CASE WHEN rc.chart_id IS NOT NULL AND g.transaction_id IS NOT NULL THEN g.amount ELSE j.amount END AS DECIMAL(15,2)) AS amount, rc.cash, rc.client
FROM journals j LEFT JOIN good g ON j.transaction_id = g.transaction_id LEFT JOIN rc ON j.chart_id = rc.chart_id),
bal AS (SELECT chart_id, SUM(CASE WHEN journal THEN amount ELSE -amount END) AS balance FROM nl WHERE cash GROUP BY chart_id)"""


def _warn_sql(doc: str, cash: str) -> str:
    return f"""SELECT DISTINCT g.{doc}, m.chart_id, g.amount, CAST(bal.balance AS DECIMAL(18,2)) AS cash_balance, 'Insufficient Funds' AS warning
FROM nl JOIN good g ON nl.transaction_id = g.transaction_id JOIN role_map m ON m.client_id = nl.client AND m.role_name = '{cash}'
JOIN bal ON bal.chart_id = m.chart_id WHERE g.amount < bal.balance"""


def _amend_ar(b):
    return posting.amend_document("AR", ar_corrections(b), b.ar_ext, b.journals, role_map(b))


def _amend_ap_all(b):
    return posting.amend_document("AP", ap_corrections(b), b.ap_ext, b.journals, role_map(b))


_AR_LEGS = _amend_legs_sql("cash_account_ar", "ar_account")
_AP_LEGS = _amend_legs_sql("cash_account_ap", "ap_account")


@query("amend_ar", "P15", views=["ar_ext"], money=["amount"], oracle=f"WITH {_ARC_SQL}\n" + _amend_sql("receivable_id", "customer_id", "ar_ext"))
def _amend_ar_q(b):
    return _amend_ar(b)["extensions"]


@query("amend_ar_journals", "P15", views=COA_VIEWS + ["ar_ext", "journals"], money=["amount"],
       oracle=f"WITH {_ARC_SQL},\n{_AR_LEGS}\nSELECT * EXCLUDE (cash, client) FROM nl")
def _amend_ar_journals(b):
    return _amend_ar(b)["journals"]


@query("amend_ar_warnings", "P15", views=COA_VIEWS + ["ar_ext", "journals"], money=["amount", "cash_balance"],
       oracle=f"WITH {_ARC_SQL},\n{_AR_LEGS}\n" + _warn_sql("receivable_id", "cash_account_ar"))
def _amend_ar_warnings(b):
    return _amend_ar(b)["warnings"]


@query("amend_ar_rejected", "P15", views=["ar_ext"], oracle=f"""WITH {_ARC_SQL}
SELECT receivable_id, 'Invalid Status' AS error FROM corr WHERE status NOT IN ('Pending', 'Paid', 'Overdue')""")
def _amend_ar_rejected(b):
    return _amend_ar(b)["rejected"]


@query("amend_ap", "P16", views=COA_VIEWS + ["ap_ext", "journals"], money=["amount"],
       oracle=f"WITH {_APC_SQL},\n{_AP_LEGS}\nSELECT * EXCLUDE (cash, client) FROM nl")
def _amend_ap(b):
    return _amend_ap_all(b)["journals"]


@query("amend_ap_extensions", "P16", views=["ap_ext"], money=["amount"], oracle=f"WITH {_APC_SQL}\n" + _amend_sql("payable_id", "vendor_id", "ap_ext"))
def _amend_ap_extensions(b):
    return _amend_ap_all(b)["extensions"]


@query("amend_ap_warnings", "P16", views=COA_VIEWS + ["ap_ext", "journals"], money=["amount", "cash_balance"],
       oracle=f"WITH {_APC_SQL},\n{_AP_LEGS}\n" + _warn_sql("payable_id", "cash_account_ap"))
def _amend_ap_warnings(b):
    return _amend_ap_all(b)["warnings"]


@query("amend_ap_rejected", "P16", views=["ap_ext"], oracle=f"""WITH {_APC_SQL}
SELECT payable_id, 'Invalid Status' AS error FROM corr WHERE status = ''""")
def _amend_ap_rejected(b):
    return _amend_ap_all(b)["rejected"]


def _amend_inv(b):
    corr = b.movements.where(F.col("action_type") == "Purchase Return").select(
        "management_id", (F.col("quantity") + 1).alias("quantity"), F.date_add("movement_date", 1).alias("movement_date"),
        F.lit(None).cast("int").alias("warehouse_id"))
    prices = b.products.select("product_id", "client_id", (F.col("product_price") * 100).cast("long").alias("unit_price_cents"))
    return posting.amend_inventory(corr, b.movements, prices, role_map(b), VAT_BP)


@query("amend_inventory", "P17", views=["movements", "products"], money=["amount"], oracle="""
SELECT m.management_id, m.transaction_id, m.action_type,
       CAST(CAST((m.quantity + 1) * m.unit_cost_cents AS DECIMAL(20,0)) / 100 AS DECIMAL(15,2)) AS amount,
       CAST(m.movement_date + INTERVAL 31 DAY AS DATE) AS due_date
FROM movements m JOIN products p ON m.product_id = p.product_id WHERE m.action_type = 'Purchase Return'""")
def _amend_inventory(b):
    return _amend_inv(b)["documents"]


@query("amend_inventory_journals", "P17", views=COA_VIEWS + ["movements", "products"], money=["amount"],
       oracle=_legs_sql("""SELECT m.management_id AS transaction_id, p.client_id, 'PURCHASE_RETURN' AS kind,
       CAST(m.movement_date + INTERVAL 1 DAY AS DATE) AS date, CAST(NULL AS BIGINT) AS amount, CAST(NULL AS BIGINT) AS net,
       CAST(NULL AS BIGINT) AS tax, CAST(NULL AS BIGINT) AS gross, (m.quantity + 1) * m.unit_cost_cents AS cost,
       CAST(NULL AS BIGINT) AS value
FROM movements m JOIN products p ON m.product_id = p.product_id WHERE m.action_type = 'Purchase Return'""") + "\nSELECT * FROM legs")
def _amend_inventory_journals(b):
    return _amend_inv(b)["journals"]


def _master(b):
    c = b.raw("customer").select(F.col("c_custkey").alias("customer_id"), "c_mktsegment")
    base = b.customers.select("customer_id", "client_id", "customer_name",
                              F.concat(F.lower(F.regexp_replace("customer_name", "#", "")), F.lit("@mail.com")).alias("email"))
    corr = c.where(F.col("c_mktsegment").isin("BUILDING", "AUTOMOBILE")).select(
        "customer_id",
        F.when(F.col("c_mktsegment") == "BUILDING", F.concat(F.lit("Renamed "), F.col("customer_id").cast("string")))
         .alias("customer_name"),
        F.when(F.col("c_mktsegment") == "AUTOMOBILE", F.lit("not-an-email")).alias("email"))
    return posting.update_master("customer", base, corr, "customer_id")


_MASTER_SQL = """base AS (SELECT customer_id, client_id, customer_name, lower(replace(customer_name, '#', '')) || '@mail.com' AS email
                FROM customers),
corr AS (SELECT c_custkey AS customer_id,
                CASE WHEN c_mktsegment = 'BUILDING' THEN 'Renamed ' || CAST(c_custkey AS VARCHAR) END AS customer_name,
                CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN 'not-an-email' END AS email
         FROM customer WHERE c_mktsegment IN ('BUILDING', 'AUTOMOBILE')),
cand AS (SELECT b.customer_id, b.client_id, COALESCE(c.customer_name, b.customer_name) AS customer_name,
                COALESCE(c.email, b.email) AS email, c.customer_id IS NOT NULL AS corrected FROM base b LEFT JOIN corr c
         ON b.customer_id = c.customer_id),
chk AS (SELECT *, CASE WHEN corrected THEN CASE WHEN customer_name IS NULL OR trim(customer_name) = '' THEN 'customer_name cannot be empty'
                                             WHEN email IS NOT NULL AND NOT regexp_matches(email, '^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Z|a-z]{2,}$')
                                             THEN 'Invalid email format' END END AS reason FROM cand)"""


@query("update_master", "P18", views=["customers"], oracle=f"""WITH {_MASTER_SQL}
SELECT customer_id, client_id, customer_name, email FROM chk WHERE reason IS NULL
UNION ALL SELECT b.customer_id, b.client_id, b.customer_name, b.email FROM base b JOIN chk ON b.customer_id = chk.customer_id
WHERE chk.reason IS NOT NULL""")
def _update_master(b):
    return _master(b)["table"]


@query("update_master_rejected", "P18", views=["customers"], oracle=f"""WITH {_MASTER_SQL}
SELECT customer_id, reason AS error FROM chk WHERE reason IS NOT NULL""")
def _update_master_rejected(b):
    return _master(b)["rejected"]


# corrections that repeat a key and that name an unknown one: every row is applied once or reported
_FATES_SQL = """base AS (SELECT vendor_id, client_id, vendor_name FROM vendors),
corr AS (SELECT vendor_id, 'First ' || CAST(vendor_id AS VARCHAR) AS vendor_name, 1 AS n FROM vendors WHERE vendor_id % 2 = 0
         UNION ALL SELECT vendor_id, 'Second ' || CAST(vendor_id AS VARCHAR), 2 FROM vendors WHERE vendor_id % 4 = 0
         UNION ALL SELECT vendor_id, ' ', 3 FROM vendors WHERE vendor_id % 8 = 0
         UNION ALL SELECT vendor_id + 10000000, 'Nobody', 1 FROM vendors WHERE vendor_id % 16 = 0
         UNION ALL SELECT NULL, 'No key', 1 FROM vendors WHERE vendor_id % 32 = 0),
last AS (SELECT * FROM corr WHERE vendor_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY vendor_id ORDER BY n DESC) = 1)"""


def _fates(b):
    v = b.vendors
    k = F.col("vendor_id")
    row = lambda step, key, name, n: v.where(k % step == 0).select(key.alias("vendor_id"), name.alias("vendor_name"), F.lit(n).alias("n"))
    corr = row(2, k, F.concat(F.lit("First "), k.cast("string")), 1)
    for more in (row(4, k, F.concat(F.lit("Second "), k.cast("string")), 2), row(8, k, F.lit(" "), 3), row(16, k + 10_000_000, F.lit("Nobody"), 1),
                 row(32, F.lit(None).cast("long"), F.lit("No key"), 1)):
        corr = corr.unionByName(more)
    table = v.select("vendor_id", "client_id", "vendor_name").withColumn("email", F.lit(None).cast("string"))
    return posting.update_master("vendor", table, corr, "vendor_id", order="n")


@query("update_master_repeated", "P18", views=["vendors"], oracle=f"""WITH {_FATES_SQL}
SELECT b.vendor_id, b.client_id, CASE WHEN trim(l.vendor_name) <> '' THEN l.vendor_name ELSE b.vendor_name END AS vendor_name, NULL AS email
FROM base b LEFT JOIN last l ON l.vendor_id = b.vendor_id""")
def _update_master_repeated(b):
    return _fates(b)["table"]


@query("update_master_repeated_rejected", "P18", views=["vendors"], oracle=f"""WITH {_FATES_SQL}
SELECT c.vendor_id, CASE WHEN c.vendor_id IS NULL THEN 'vendor_id is required' WHEN c.n <> l.n THEN 'Superseded by a later correction'
                         WHEN b.vendor_id IS NULL THEN 'vendor_id not found' ELSE 'vendor_name cannot be empty' END AS error
FROM corr c LEFT JOIN last l ON l.vendor_id = c.vendor_id LEFT JOIN base b ON b.vendor_id = c.vendor_id
WHERE c.vendor_id IS NULL OR c.n <> l.n OR b.vendor_id IS NULL OR trim(c.vendor_name) = ''""")
def _update_master_repeated_rejected(b):
    return _fates(b)["rejected"]


def _twice_amended(b):
    once = ap_corrections(b).withColumn("n", F.lit(1))
    again = once.where(F.col("payable_id") % 8 == 1).withColumns({"amount": (F.col("amount") + 5).cast(MONEY), "n": F.lit(2)})
    lost = once.where(F.col("payable_id") % 8 == 3).withColumns({"payable_id": F.col("payable_id") + 100_000_000, "n": F.lit(1)})
    return posting.amend_document("AP", once.unionByName(again).unionByName(lost), b.ap_ext, b.journals, role_map(b), order="n")


_TWICE_SQL = _APC_SQL.replace("good AS (", "once AS (") + """,
valid AS (SELECT *, 1 AS n FROM once UNION ALL SELECT * REPLACE (CAST(amount + 5 AS DECIMAL(15,2)) AS amount), 2 FROM once WHERE payable_id % 8 = 1
          UNION ALL SELECT * REPLACE (payable_id + 100000000 AS payable_id), 1 FROM once WHERE payable_id % 8 = 3),
good AS (SELECT v.* EXCLUDE (n) FROM valid v WHERE payable_id < 100000000 AND n = (SELECT MAX(n) FROM valid w WHERE w.payable_id = v.payable_id))"""


@query("amend_ap_repeated", "P16", views=["ap_ext"], money=["amount"], oracle=f"WITH {_TWICE_SQL}\n" + _amend_sql("payable_id", "vendor_id", "ap_ext"))
def _amend_ap_repeated(b):
    return _twice_amended(b)["extensions"]


@query("amend_ap_repeated_rejected", "P16", views=["ap_ext"], oracle=f"""WITH {_TWICE_SQL}
SELECT payable_id, 'Invalid Status' AS error FROM corr WHERE status = ''
UNION ALL SELECT payable_id + 100000000, 'Invalid Status' FROM corr WHERE status = '' AND payable_id % 8 = 3
UNION ALL SELECT payable_id, 'Invalid Status' FROM corr WHERE status = '' AND payable_id % 8 = 1
UNION ALL SELECT payable_id, 'Account Payable not found' FROM valid WHERE payable_id > 100000000
UNION ALL SELECT payable_id, 'Superseded by a later correction' FROM valid WHERE n = 1 AND payable_id < 100000000 AND payable_id % 8 = 1""")
def _amend_ap_repeated_rejected(b):
    return _twice_amended(b)["rejected"]


def _posted(b):
    return _ar(b)["transactions"]


@query("post_staged", "G8", views=_DOC_VIEWS + sq.STG_VIEWS, oracle=_AR_SQL + """
SELECT l3.session_id, l3.staging_record_id,
       CASE WHEN tx.request_id IS NOT NULL THEN l3.new_state ELSE l3.previous_state END AS previous_state,
       CASE WHEN tx.request_id IS NOT NULL THEN 'POSTED' ELSE l3.new_state END AS new_state,
       CASE WHEN tx.request_id IS NOT NULL THEN 'POSTED AS TRANSACTION ' || CAST(tx.transaction_id AS VARCHAR) ELSE l3.notes END AS notes
FROM l3 LEFT JOIN tx ON l3.staging_record_id = tx.request_id""")
def _post_staged(b):
    wf, _ = sq.approved(b)
    tx = _posted(b).select(F.col("request_id").alias("staging_record_id"), "transaction_id")
    j = wf.join(tx, "staging_record_id", "left")
    hit = F.col("transaction_id").isNotNull()
    return j.select("session_id", "staging_record_id",
                    F.when(hit, F.col("new_state")).otherwise(F.col("previous_state")).alias("previous_state"),
                    F.when(hit, F.lit("POSTED")).otherwise(F.col("new_state")).alias("new_state"),
                    F.when(hit, F.concat(F.lit("POSTED AS TRANSACTION "), F.col("transaction_id").cast("string")))
                     .otherwise(F.col("notes")).alias("notes"))


@query("post_staged_lineage", "G8", views=_DOC_VIEWS + sq.STG_VIEWS, oracle="WITH RECURSIVE " + _AR_SQL[len("WITH "):] + """,
lin AS (SELECT 'account_receivables' AS table_name, tx.transaction_id AS record_id, tx.client_id, 'CSV_IMPORT' AS source_type, 'ar_import.csv' AS source_file,
               l3.session_id, tx.request_id AS source_row_number, 'INSERT' AS operation,
               CAST(to_json({'record_id': tx.transaction_id, 'session_id': l3.session_id, 'source_row_number': tx.request_id}) AS VARCHAR) AS record,
               row_number() OVER (PARTITION BY l3.session_id ORDER BY tx.request_id) AS rn
        FROM tx JOIN l3 ON l3.staging_record_id = tx.request_id),
chain AS (SELECT lin.*, CAST(NULL AS VARCHAR) AS prev_hash, md5(table_name || operation || record) AS row_hash FROM lin WHERE rn = 1
          UNION ALL
          SELECT lin.*, c.row_hash AS prev_hash, md5(c.row_hash || lin.table_name || lin.operation || lin.record) AS row_hash
          FROM lin JOIN chain c ON lin.session_id = c.session_id AND lin.rn = c.rn + 1)
SELECT * EXCLUDE (rn) FROM chain""")
def _post_staged_lineage(b):
    from ..operators import audit, staging
    tx = _posted(b)
    src = sq.stg(b).select(F.col("id").alias("request_id"), "session_id")
    rec = tx.join(src, "request_id").select(F.col("transaction_id").alias("record_id"), "client_id", "session_id",
                                            F.col("request_id").alias("source_row_number"))
    lin = staging.record_lineage(rec, "account_receivables", "CSV_IMPORT", "ar_import.csv")
    lin = lin.select("*", F.col("table_name").alias("chain_table"), F.lit("INSERT").alias("operation"),
                     F.to_json(F.struct("record_id", "session_id", "source_row_number")).alias("record"))
    return audit.hash_chain(lin, "session_id", ["source_row_number"], table_col="chain_table").drop("chain_table")


# ---- the other kinds of master data: each correction renames every third row and spoils every fifth ----

def _master_kind(b, kind: str):
    if kind == "vendor":
        t, key, name = b.vendors, "vendor_id", "vendor_name"
        t = t.withColumn("email", F.concat(F.lit("v"), F.col(key).cast("string"), F.lit("@mail.com")))
        bad = ("email", F.lit("nobody"))
    elif kind == "product":
        t, key, name = b.products, "product_id", "product_name"
        bad = ("product_price", F.lit("-1.00").cast(MONEY))
    elif kind == "chart":
        t, key, name = b.charts.select("chart_id", "client_id", "account", "type"), "chart_id", "account"
        bad = ("type", F.lit("Nothing"))
    else:
        t = b.movements.select("warehouse_id").distinct().withColumn("warehouse_name", F.concat(F.lit("Warehouse "), F.col("warehouse_id").cast("string")))
        key, name = "warehouse_id", "warehouse_name"
        bad = None
    k = F.col(key)
    new_name = F.when(k % 3 == 0, F.concat(F.lit("New "), k.cast("string")))
    if bad is None:
        new_name = F.when(k % 2 == 0, F.lit(" ")).otherwise(new_name)
    corr = t.select(key, new_name.alias(name), *([F.when(k % 5 == 0, bad[1]).alias(bad[0])] if bad else []))
    return posting.update_master(kind, t, corr, key)


def _master_kind_sql(base: str, key: str, name: str, bad: tuple[str, str, str] | None) -> str:
    spoiled = f"{key} % 5 = 0" if bad else f"{key} % 2 = 0"
    new = f"CASE WHEN {key} % 3 = 0 THEN 'New ' || CAST({key} AS VARCHAR) ELSE {name} END"
    ok = f"SELECT * REPLACE (CASE WHEN {spoiled} THEN {name} ELSE {new} END AS {name}) FROM ({base}) t"
    return ok


_MASTER_KINDS = {
    "vendor": ("SELECT *, 'v' || CAST(vendor_id AS VARCHAR) || '@mail.com' AS email FROM vendors", "vendor_id", "vendor_name", ("email", "Invalid email format", "vendors")),
    "product": ("SELECT * FROM products", "product_id", "product_name", ("product_price", "Price cannot be negative", "products")),
    "chart": ("SELECT chart_id, client_id, account, type FROM charts", "chart_id", "account", ("type", "Invalid account type", "charts")),
    "warehouse": ("SELECT DISTINCT warehouse_id, 'Warehouse ' || CAST(warehouse_id AS VARCHAR) AS warehouse_name FROM movements", "warehouse_id", "warehouse_name", None),
}


def _register_master(kind: str):
    base, key, name, bad = _MASTER_KINDS[kind]
    views = [bad[2]] if bad else ["movements"]
    money = ["product_price"] if kind == "product" else []
    query(f"update_master_{kind}", "P18", views=views, money=money, oracle=_master_kind_sql(base, key, name, bad))(
        lambda b: _master_kind(b, kind)["table"])
    spoiled = f"{key} % 5 = 0" if bad else f"{key} % 2 = 0"
    message = bad[1] if bad else "warehouse_name cannot be empty"
    query(f"update_master_{kind}_rejected", "P18", views=views, oracle=f"SELECT {key}, '{message}' AS error FROM ({base}) t WHERE {spoiled}")(
        lambda b: _master_kind(b, kind)["rejected"])


for _kind in _MASTER_KINDS:
    _register_master(_kind)
