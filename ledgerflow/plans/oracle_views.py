"""DuckDB text of the bridge views, prepended as CTEs to every oracle query.

These statements are the independent definition the Spark bridge
(``ledgerflow.sources.bridge``) is checked against.  Only the views a query
needs (plus their dependencies) are emitted.
"""

from __future__ import annotations

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "clients": ((), "SELECT CAST(r_regionkey + 1 AS INT) AS client_id, r_name AS client_name FROM region"),
    "customers": ((), "SELECT c_custkey AS customer_id, CAST(n_regionkey + 1 AS INT) AS client_id, c_name AS customer_name "
                      "FROM customer JOIN nation ON c_nationkey = n_nationkey"),
    "vendors": ((), "SELECT s_suppkey AS vendor_id, CAST(n_regionkey + 1 AS INT) AS client_id, s_name AS vendor_name "
                    "FROM supplier JOIN nation ON s_nationkey = n_nationkey"),
    "products": ((), "SELECT p_partkey AS product_id, CAST(p_partkey % 5 + 1 AS INT) AS client_id, p_name AS product_name, "
                     "CAST(p_retailprice AS DECIMAL(15,2)) AS product_price FROM part"),
    "accounts": ((), "SELECT * FROM (VALUES (1,'Cash on Hand','Asset','cash_account_ar'),(2,'Cash in Bank','Asset','cash_account_ap'),"
                     "(3,'Accounts Receivable','Asset','ar_account'),(4,'Accounts Payable','Liability','ap_account'),"
                     "(5,'Sales Revenue','Revenue','revenue_account'),(6,'Cost of Goods Sold','Expense','COGS'),"
                     "(7,'Inventory','Asset','inventory_account'),(8,'Output Tax Payable','Liability','output_vat_payable'),"
                     "(9,'Inventory Expense','Expense','expense_account'),(10,'Owner Capital','Equity',NULL)) AS t(k, account, type, role_name)"),
    "charts": (("clients", "accounts"),
               "SELECT CAST(client_id * 100 + k AS INT) AS chart_id, client_id, account, CAST(1000 + k AS INT) AS account_code, "
               "type, role_name, TRUE AS is_active FROM clients CROSS JOIN accounts"),
    "coa_template": (("accounts",), "SELECT 1 AS template_id, CAST(1000 + k AS INT) AS account_code, account AS account_name, type AS account_type FROM accounts "
                     "UNION ALL SELECT * FROM (VALUES (1, 1011, 'Input Tax Receivable', 'Asset'), (1, 1012, 'Sales Returns and Allowances', 'Contra Revenue'), "
                     "(1, 1013, 'Purchase Returns and Allowances', 'Contra Expense'), (1, 1014, 'Salary Expense', 'Expense'), "
                     "(1, 1015, 'Salary Payable', 'Liability')) AS t(template_id, account_code, account_name, account_type)"),
    "new_charts": (("clients", "coa_template", "charts"),
                   "SELECT CAST((SELECT MAX(chart_id) FROM charts) + row_number() OVER (ORDER BY c.client_id, t.account_code) AS INT) AS chart_id, c.client_id, t.account_name AS account, "
                   "t.account_code, t.account_type AS type, TRUE AS is_active FROM clients c JOIN coa_template t ON t.template_id = 1 "
                   "WHERE NOT EXISTS (SELECT 1 FROM charts x WHERE x.client_id = c.client_id AND x.account_code = t.account_code)"),
    "all_charts": (("charts", "new_charts"),
                   "SELECT chart_id, client_id, account, account_code, type, is_active FROM charts UNION ALL SELECT * FROM new_charts"),
    "new_roles": (("all_charts", "charts"),
                  "SELECT a.chart_id, r.role_name FROM all_charts a JOIN (VALUES ('Input Tax', 'input_vat_receivable'), "
                  "('Sales Returns', 'SR&Allowances'), ('Purchase Returns', 'PR&Allowances'), ('Salary Expense', 'salary_expense'), "
                  "('Salary Payable', 'salary_payable')) AS r(prefix, role_name) ON a.account LIKE r.prefix || '%' "
                  "WHERE NOT EXISTS (SELECT 1 FROM charts x WHERE x.chart_id = a.chart_id AND x.role_name = r.role_name)"),
    "role_map": (("all_charts", "charts", "new_roles"),
                 "SELECT a.client_id, r.role_name, MIN(a.chart_id) AS chart_id FROM (SELECT chart_id, role_name FROM charts "
                 "WHERE role_name IS NOT NULL UNION ALL SELECT chart_id, role_name FROM new_roles) r JOIN all_charts a "
                 "ON r.chart_id = a.chart_id WHERE a.is_active GROUP BY a.client_id, r.role_name"),
    "transactions": (("customers",),
                     "SELECT o_orderkey AS transaction_id, client_id, concat('ORD-', CAST(o_orderkey AS VARCHAR)) AS idempotency_key, "
                     "CASE WHEN o_orderkey % 89 = 0 THEN NULL ELSE concat('Order ', CAST(o_orderkey AS VARCHAR)) END AS description, "
                     "CAST(o_orderdate AS DATE) AS date, o_orderstatus AS st, CAST(o_totalprice AS DECIMAL(15,2)) AS total "
                     "FROM orders JOIN customers ON o_custkey = customer_id"),
    "legs": ((), "SELECT * FROM (VALUES (0,'O',3,TRUE),(1,'O',5,FALSE),(2,'F',3,TRUE),(3,'F',5,FALSE),(4,'F',1,TRUE),"
                 "(5,'F',3,FALSE),(6,'P',9,TRUE),(7,'P',4,FALSE)) AS t(leg, st, k, journal)"),
    "journals": (("transactions", "legs"),
                 "SELECT t.transaction_id * 8 + l.leg AS journal_id, t.transaction_id, CAST(t.client_id * 100 + l.k AS INT) AS chart_id, "
                 "t.date, l.journal, CAST(t.total + CASE WHEN NOT l.journal AND t.transaction_id % 97 = 0 THEN 1 ELSE 0 END AS DECIMAL(15,2)) AS amount "
                 "FROM transactions t JOIN legs l ON t.st = l.st"),
    "ar_ext": ((), "SELECT o_orderkey AS receivable_id, o_orderkey AS transaction_id, o_custkey AS customer_id, "
                   "CAST(o_totalprice + CASE WHEN o_orderkey % 101 = 0 THEN 5 ELSE 0 END AS DECIMAL(15,2)) AS amount, "
                   "CAST(o_orderdate AS DATE) AS invoice_date, CAST(CAST(o_orderdate AS DATE) + INTERVAL '30' DAY AS DATE) AS due_date, "
                   "CASE WHEN o_orderstatus = 'F' THEN 'Paid' WHEN o_orderkey % 3 = 0 THEN 'Partially Paid' ELSE 'Pending' END AS status "
                   "FROM orders WHERE o_orderstatus IN ('O','F')"),
    "ap_ext": ((), "SELECT o_orderkey AS payable_id, o_orderkey AS transaction_id, MIN(l_suppkey) AS vendor_id, "
                   "CAST(MIN(o_totalprice) + CASE WHEN o_orderkey % 103 = 0 THEN 5 ELSE 0 END AS DECIMAL(15,2)) AS amount, "
                   "CAST(MIN(o_orderdate) AS DATE) AS invoice_date, CAST(CAST(MIN(o_orderdate) AS DATE) + INTERVAL '30' DAY AS DATE) AS due_date, "
                   "CASE WHEN o_orderkey % 4 = 0 THEN 'Paid' ELSE 'Pending' END AS status "
                   "FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'P' GROUP BY o_orderkey"),
    "movements": ((), "SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate) AS management_id, "
                      "l_partkey AS product_id, CAST(l_suppkey % 3 + 1 AS INT) AS warehouse_id, l_orderkey AS transaction_id, "
                      "CASE WHEN l_returnflag = 'A' THEN 'Purchase' WHEN l_returnflag = 'N' THEN 'Sale' WHEN l_linestatus = 'F' THEN 'Sale Return' "
                      "ELSE 'Purchase Return' END AS action_type, CAST(l_quantity AS BIGINT) AS quantity, CAST(l_shipdate AS DATE) AS movement_date, "
                      "CAST(FLOOR(l_extendedprice * 100 / l_quantity) AS BIGINT) AS unit_cost_cents FROM lineitem"),
    "layers": (("movements",),
               "SELECT management_id AS operation_id, product_id, quantity, unit_cost_cents, movement_date AS purchase_date "
               "FROM movements WHERE action_type = 'Purchase'"),
    "tax_entries": ((), "SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate) AS tax_entry_id, "
                        "l_orderkey AS transaction_id, CASE WHEN l_linestatus = 'F' THEN 'VAT_OUTPUT' ELSE 'VAT_INPUT' END AS tax_type, "
                        "CAST(FLOOR(l_extendedprice * l_tax * 100) AS BIGINT) AS tax_cents FROM lineitem"),
    "tax_legs": (("tax_entries",),
                 "SELECT transaction_id, CAST(SUM(tax_cents) + CASE WHEN transaction_id % 83 = 0 THEN 1 ELSE 0 END AS BIGINT) AS amount_cents, "
                 "'Output Tax Payable' AS account FROM tax_entries GROUP BY transaction_id"),
    "bank_tx": ((), "SELECT o_orderkey AS bank_trans_id, CAST(o_orderkey // 8 % 5 + 1 AS INT) AS account_id, "
                    "CAST(CAST(o_orderdate AS DATE) + INTERVAL '2' DAY AS DATE) AS transaction_date, "
                    "CASE WHEN o_orderkey % 5 = 0 THEN 'DEBIT' ELSE 'CREDIT' END AS transaction_type, "
                    "CAST(o_totalprice AS DECIMAL(15,2)) AS amount FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 7 <> 0"),
    "bank_accounts": ((), "SELECT * FROM (VALUES (1, 'ACCT-0001', 'Bank One', 101), (2, 'ACCT-0002', 'Bank Two', 201), "
                          "(3, 'ACCT-0003', 'Bank Three', 301), (4, 'ACCT-0004', 'Bank Four', 401), (5, 'ACCT-0005', 'Bank Five', 501)) "
                          "AS t(account_id, account_number, bank_name, chart_id)"),
    "statements": (("bank_tx",),
                   "SELECT CAST(account_id AS VARCHAR) || '-' || strftime(statement_date, '%Y%m') AS statement_id, account_id, statement_date, "
                   "CAST(SUM(net) OVER (PARTITION BY account_id ORDER BY statement_date ROWS UNBOUNDED PRECEDING) - net AS DECIMAL(18,2)) AS opening_balance, "
                   "CAST(SUM(net) OVER (PARTITION BY account_id ORDER BY statement_date ROWS UNBOUNDED PRECEDING) AS DECIMAL(18,2)) AS closing_balance "
                   "FROM (SELECT account_id, last_day(transaction_date) AS statement_date, "
                   "SUM(CASE WHEN transaction_type = 'CREDIT' THEN amount ELSE -amount END) AS net FROM bank_tx GROUP BY 1, 2) m"),
    "event_log": ((), "SELECT event_id, CASE event_type WHEN 'purchase' THEN 'PURCHASE' WHEN 'click' THEN 'SALE' WHEN 'view' THEN 'RECEIVABLE' "
                      "WHEN 'signup' THEN 'PAYABLE' ELSE 'UNKNOWN' END AS event_type, ts AS created_at, "
                      "concat('ev-', CAST(user_id AS VARCHAR), '-', props) AS idempotency_key, user_id, "
                      "CAST(value AS DECIMAL(15,2)) AS amount, props AS payload FROM events"),
    "stg_ar_imports": ((), "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 61 = 0 THEN 'x' ELSE CAST(o_custkey AS VARCHAR) END AS customer_code, "
                           "CASE WHEN o_orderkey % 67 = 0 THEN '99' ELSE '1' END AS client_code, "
                           "CASE WHEN o_orderkey % 53 = 0 THEN '12,5' WHEN o_orderkey % 71 = 0 THEN NULL "
                           "ELSE CAST(CAST(o_totalprice AS DECIMAL(15,2)) AS VARCHAR) END AS amount, "
                           "CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS invoice_date, "
                           "CASE WHEN o_orderkey % 59 = 0 THEN '2026-02-30' WHEN o_orderkey % 73 = 0 THEN '1990-01-01' "
                           "ELSE CAST(CAST(CAST(o_orderdate AS DATE) + INTERVAL '30' DAY AS DATE) AS VARCHAR) END AS due_date, "
                           "CASE WHEN o_orderkey % 79 = 0 THEN 'Open' WHEN o_orderstatus = 'F' THEN 'Paid' ELSE 'Pending' END AS status FROM orders"),
    "metrics": ((), "SELECT event_id AS metric_id, ts AS metric_timestamp, event_type AS metric_name, "
                    "CAST(value AS DECIMAL(15,2)) AS metric_value, "
                    "CASE WHEN value > 200 THEN 'ALERT' WHEN value > 100 THEN 'WARNING' ELSE 'HEALTHY' END AS status FROM events"),
    "access_log": ((), "SELECT event_id AS access_id, concat('user', CAST(user_id AS VARCHAR)) AS user_name, ts AS login_time, "
                       "CASE WHEN event_type = 'error' THEN 'FAILED' ELSE 'SUCCESS' END AS status FROM events"),
    "components": ((), "SELECT * FROM (VALUES (1,'Basic Salary','SALARY'),(2,'Rice Allowance','ALLOWANCE'),(3,'Annual Bonus','BONUS'),"
                       "(4,'Loan Deduction','DEDUCTION'),(5,'Withholding Tax','TAX'),(6,'Statutory Contribution','STATUTORY'),"
                       "(7,'Employee Assistance','BENEFIT')) AS t(component_id, component_name, component_type)"),
    "salary_details": (("components",),
                       "SELECT s_suppkey AS employee_id, component_id, CAST(CASE WHEN component_id = 1 THEN 20000 + s_suppkey % 50 * 100 "
                       "ELSE 100 * component_id + s_suppkey % 10 END AS DECIMAL(15,2)) AS amount, DATE '1995-01-01' AS effective_date, "
                       "CASE WHEN (s_suppkey + component_id) % 11 = 0 THEN DATE '2024-12-31' ELSE NULL END AS end_date "
                       "FROM supplier CROSS JOIN components"),
}


def _closure(names) -> list[str]:
    out: list[str] = []

    def visit(n):
        if n in out:
            return
        for d in VIEWS[n][0]:
            visit(d)
        out.append(n)

    for n in names:
        visit(n)
    return out


def with_views(names, body: str) -> str:
    """``WITH <views...> <body>`` for DuckDB; ``names`` lists the views the body reads."""
    ordered = _closure(names)
    if not ordered:
        return body
    ctes = ",\n".join(f"{n} AS ({VIEWS[n][1]})" for n in ordered)
    stripped = body.lstrip()
    if stripped[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {ctes},\n{stripped[15:]}"
    if stripped[:5].upper() == "WITH ":
        # the body has its own CTEs: continue the same WITH list
        return f"WITH {ctes},\n{stripped[5:]}"
    return f"WITH {ctes}\n{body}"
