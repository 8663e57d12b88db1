"""Registered queries for ledger reports (L) and reconciliation checks (R)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.money import cents_to_money
from ..operators import recon, reports
from .registry import query

START, END = "1995-01-01", "2001-12-31"
MID_START, MID_END = "1997-01-01", "1999-12-31"

_DEBIT = "CASE WHEN j.journal THEN j.amount ELSE 0 END"
_CREDIT = "CASE WHEN NOT j.journal THEN j.amount ELSE 0 END"


@query("general_journal", "L1", views=["transactions", "journals", "charts"], money=["debit", "credit"], oracle=f"""
SELECT t.transaction_id, j.date, t.description, c.account, {_DEBIT} AS debit, {_CREDIT} AS credit
FROM transactions t JOIN journals j ON t.transaction_id = j.transaction_id JOIN charts c ON j.chart_id = c.chart_id
WHERE j.date BETWEEN DATE '{MID_START}' AND DATE '{MID_END}'
ORDER BY j.date, t.transaction_id""")
def _general_journal(b):
    return reports.general_journal(b.transactions, b.journals, b.charts, MID_START, MID_END)


@query("general_ledger", "L2", views=["transactions", "journals", "charts"], money=["debit", "credit"], oracle=f"""
SELECT c.account, j.date, t.description, t.transaction_id, {_DEBIT} AS debit, {_CREDIT} AS credit
FROM charts c JOIN journals j ON c.chart_id = j.chart_id JOIN transactions t ON j.transaction_id = t.transaction_id
WHERE j.date BETWEEN DATE '{START}' AND DATE '{END}'
ORDER BY c.account, j.date, t.transaction_id""")
def _general_ledger(b):
    return reports.general_ledger(b.charts, b.journals, b.transactions, START, END)


@query("trial_balance", "L3", views=["transactions", "journals", "charts"], money=["total_debit", "total_credit"], oracle=f"""
SELECT c.account, c.type, CAST(SUM({_DEBIT}) AS DECIMAL(18,2)) AS total_debit, CAST(SUM({_CREDIT}) AS DECIMAL(18,2)) AS total_credit
FROM transactions t JOIN journals j ON j.transaction_id = t.transaction_id JOIN charts c ON j.chart_id = c.chart_id
WHERE j.date BETWEEN DATE '{START}' AND DATE '{END}'
GROUP BY c.account, c.type ORDER BY c.type, c.account""")
def _trial_balance(b):
    return reports.trial_balance(b.transactions, b.journals, b.charts, START, END)


@query("income_statement", "L4", views=["transactions", "journals", "charts"], money=["net_amount"], oracle=f"""
SELECT c.type, c.account, CAST(SUM({_DEBIT}) - SUM({_CREDIT}) AS DECIMAL(18,2)) AS net_amount
FROM charts c JOIN journals j ON c.chart_id = j.chart_id JOIN transactions t ON t.transaction_id = j.transaction_id
WHERE c.type IN ('Revenue','Expense','Cost of Goods Sold') AND j.date BETWEEN DATE '{START}' AND DATE '{END}'
GROUP BY c.type, c.account ORDER BY c.type, c.account""")
def _income_statement(b):
    return reports.income_statement(b.charts, b.journals, b.transactions, START, END)


@query("balance_sheet", "L5", views=["transactions", "journals", "charts"], money=["balance"], oracle=f"""
SELECT c.type, c.account, CAST(SUM({_DEBIT}) - SUM({_CREDIT}) AS DECIMAL(18,2)) AS balance
FROM charts c JOIN journals j ON c.chart_id = j.chart_id JOIN transactions t ON t.transaction_id = j.transaction_id
WHERE c.type IN ('Asset','Liability','Equity') AND j.date BETWEEN DATE '{MID_START}' AND DATE '{MID_END}'
GROUP BY c.type, c.account ORDER BY c.type, c.account""")
def _balance_sheet(b):
    return reports.balance_sheet(b.charts, b.journals, b.transactions, MID_START, MID_END)


@query("cash_balance", "L6", views=["journals", "charts"], money=["cash_balance"], oracle=f"""
SELECT CAST(COALESCE(SUM(CASE WHEN c.account = 'Cash on Hand' AND j.journal THEN j.amount ELSE 0 END), 0)
          - COALESCE(SUM(CASE WHEN c.account = 'Cash on Hand' AND NOT j.journal THEN j.amount ELSE 0 END), 0) AS DECIMAL(18,2)) AS cash_balance
FROM journals j JOIN charts c ON j.chart_id = c.chart_id
WHERE j.date BETWEEN DATE '{START}' AND DATE '{END}'""")
def _cash_balance(b):
    return reports.cash_balance(b.journals, b.charts, "Cash on Hand", START, END)


@query("profit_summary", "L7", views=["journals", "charts"], money=["total_revenue", "total_expense", "net_income"], oracle=f"""
SELECT CAST(COALESCE(SUM(CASE WHEN c.type = 'Revenue' THEN j.amount ELSE 0 END), 0) AS DECIMAL(18,2)) AS total_revenue,
       CAST(COALESCE(SUM(CASE WHEN c.type = 'Expense' THEN j.amount ELSE 0 END), 0) AS DECIMAL(18,2)) AS total_expense,
       CAST(COALESCE(SUM(CASE WHEN c.type = 'Revenue' THEN j.amount ELSE 0 END), 0)
          - COALESCE(SUM(CASE WHEN c.type = 'Expense' THEN j.amount ELSE 0 END), 0) AS DECIMAL(18,2)) AS net_income
FROM journals j JOIN charts c ON j.chart_id = c.chart_id
WHERE j.date BETWEEN DATE '{START}' AND DATE '{END}' AND c.type IN ('Revenue', 'Expense')""")
def _profit_summary(b):
    return reports.profit_summary(b.journals, b.charts, START, END)


@query("account_balance", "L8", views=["journals"], money=["balance"], oracle="""
SELECT chart_id, CAST(SUM(CASE WHEN journal THEN amount ELSE -amount END) AS DECIMAL(18,2)) AS balance
FROM journals GROUP BY chart_id""")
def _account_balance(b):
    return reports.account_balance(b.journals)


_TX_TOTALS = f"""SELECT j.transaction_id, CAST(SUM({_DEBIT}) AS DECIMAL(18,2)) AS total_debit,
       CAST(SUM({_CREDIT}) AS DECIMAL(18,2)) AS total_credit FROM journals j GROUP BY j.transaction_id"""


@query("journal_balance_check", "R1", views=["journals"], money=["total_debit", "total_credit"], oracle=f"""
SELECT * FROM ({_TX_TOTALS}) s WHERE total_debit <> total_credit""")
def _journal_balance_check(b):
    return recon.journal_balance_check(b.journals)


@query("check_journal_balance", "R2", views=["journals"], money=["total_debit", "total_credit", "difference"], oracle=f"""
SELECT *, CAST(total_debit - total_credit AS DECIMAL(18,2)) AS difference FROM ({_TX_TOTALS}) s WHERE total_debit <> total_credit""")
def _check_journal_balance(b):
    return recon.check_journal_balance(b.journals)


@query("ledger_balance_check", "R3", views=["journals"], money=["total_debits", "total_credits", "difference"], oracle=f"""
SELECT 'DOUBLE_ENTRY_BALANCE' AS rule_id,
       ABS(COALESCE(SUM({_DEBIT}), 0) - COALESCE(SUM({_CREDIT}), 0)) > 0.01 AS violation_detected,
       CAST(COALESCE(SUM({_DEBIT}), 0) AS DECIMAL(18,2)) AS total_debits,
       CAST(COALESCE(SUM({_CREDIT}), 0) AS DECIMAL(18,2)) AS total_credits,
       CAST(ABS(COALESCE(SUM({_DEBIT}), 0) - COALESCE(SUM({_CREDIT}), 0)) AS DECIMAL(18,2)) AS difference
FROM journals j""")
def _ledger_balance_check(b):
    return recon.ledger_balance_check(b.journals)


@query("validate_transaction_balance", "R4", views=["transactions", "journals"],
       money=["debit_total", "credit_total"], oracle=f"""
SELECT t.transaction_id, COALESCE(s.total_debit, 0) = COALESCE(s.total_credit, 0) AS is_valid,
       CASE WHEN COALESCE(s.total_debit, 0) = COALESCE(s.total_credit, 0) THEN ''
            ELSE 'Debit/Credit imbalance. Debit: ' || CAST(CAST(COALESCE(s.total_debit, 0) AS DECIMAL(18,2)) AS VARCHAR)
                 || ' Credit: ' || CAST(CAST(COALESCE(s.total_credit, 0) AS DECIMAL(18,2)) AS VARCHAR) END AS error_msg,
       CAST(COALESCE(s.total_debit, 0) AS DECIMAL(18,2)) AS debit_total, CAST(COALESCE(s.total_credit, 0) AS DECIMAL(18,2)) AS credit_total
FROM transactions t LEFT JOIN ({_TX_TOTALS}) s ON t.transaction_id = s.transaction_id""")
def _validate_transaction_balance(b):
    return recon.validate_transaction_balance(b.journals, b.transactions)


@query("validate_transaction_balance_tol", "R5", views=["transactions", "journals"],
       money=["total_debits", "total_credits", "difference"], oracle=f"""
SELECT t.transaction_id, ABS(s.total_debit - s.total_credit) < 0.01 AS is_balanced,
       s.total_debit AS total_debits, s.total_credit AS total_credits,
       CAST(ABS(s.total_debit - s.total_credit) AS DECIMAL(18,2)) AS difference,
       CASE WHEN ABS(s.total_debit - s.total_credit) > 0.01
            THEN 'Transaction is out of balance: ' || CAST(CAST(ABS(s.total_debit - s.total_credit) AS DECIMAL(18,2)) AS VARCHAR)
            ELSE 'Transaction is balanced' END AS error_message
FROM transactions t LEFT JOIN ({_TX_TOTALS}) s ON t.transaction_id = s.transaction_id""")
def _validate_transaction_balance_tol(b):
    return recon.validate_transaction_balance_tol(b.journals, b.transactions)


@query("unbalanced_transactions", "R6", views=["transactions", "journals"],
       money=["total_debits", "total_credits", "difference"], oracle=f"""
SELECT t.transaction_id, t.description, s.total_debit AS total_debits, s.total_credit AS total_credits,
       CAST(ABS(s.total_debit - s.total_credit) AS DECIMAL(18,2)) AS difference
FROM transactions t JOIN ({_TX_TOTALS}) s ON t.transaction_id = s.transaction_id
WHERE NOT (ABS(s.total_debit - s.total_credit) < 0.01)""")
def _unbalanced_transactions(b):
    return recon.unbalanced_transactions(b.transactions, b.journals)


def _doc_sql(doc: str, account: str, side: str) -> str:
    return f"""
SELECT d.transaction_id, CAST(d.amount AS DECIMAL(18,2)) AS amount,
       CAST(SUM(CASE WHEN c.account = '{account}' AND {side} THEN j.amount ELSE 0 END) AS DECIMAL(18,2)) AS ledger_amount,
       CAST(d.amount - SUM(CASE WHEN c.account = '{account}' AND {side} THEN j.amount ELSE 0 END) AS DECIMAL(18,2)) AS difference
FROM {doc} d JOIN journals j ON d.transaction_id = j.transaction_id JOIN charts c ON j.chart_id = c.chart_id
GROUP BY d.transaction_id, d.amount
HAVING d.amount <> SUM(CASE WHEN c.account = '{account}' AND {side} THEN j.amount ELSE 0 END)"""


@query("reconcile_ar", "R7", views=["ar_ext", "journals", "charts"], money=["amount", "ledger_amount", "difference"],
       oracle=_doc_sql("ar_ext", "Accounts Receivable", "j.journal"))
def _reconcile_ar(b):
    return recon.reconcile_ar(b.ar_ext, b.journals, b.charts)


@query("reconcile_ap", "R8", views=["ap_ext", "journals", "charts"], money=["amount", "ledger_amount", "difference"],
       oracle=_doc_sql("ap_ext", "Accounts Payable", "NOT j.journal"))
def _reconcile_ap(b):
    return recon.reconcile_ap(b.ap_ext, b.journals, b.charts)


@query("reconcile_inventory", "R9", views=["movements"], oracle="""
SELECT product_id,
       CAST(SUM(CASE WHEN action_type IN ('Purchase','Sale Return') THEN quantity ELSE 0 END) AS BIGINT) AS quantity_in,
       CAST(SUM(CASE WHEN action_type IN ('Sale','Purchase Return') THEN quantity ELSE 0 END) AS BIGINT) AS quantity_out,
       CAST(SUM(CASE WHEN action_type IN ('Purchase','Sale Return') THEN quantity ELSE 0 END)
          - SUM(CASE WHEN action_type IN ('Sale','Purchase Return') THEN quantity ELSE 0 END) AS BIGINT) AS net_quantity
FROM movements GROUP BY product_id""")
def _reconcile_inventory(b):
    return recon.reconcile_inventory(b.movements)


@query("stock_on_hand", "R10", views=["movements"], oracle="""
SELECT product_id, CAST(SUM(CASE WHEN action_type IN ('Purchase','Sale Return') THEN quantity
                                 WHEN action_type IN ('Sale','Purchase Return') THEN -quantity ELSE 0 END) AS BIGINT) AS calculated_stock
FROM movements GROUP BY product_id""")
def _stock_on_hand(b):
    return recon.stock_on_hand(b.movements)


def _tax_inputs(b):
    te = b.tax_entries.select("transaction_id", "tax_type", cents_to_money("tax_cents").alias("tax_amount"))
    tl = b.tax_legs.select("transaction_id", "account", cents_to_money("amount_cents").alias("amount"))
    return te, tl


_TAX_ORACLE = """
SELECT t.transaction_id, CAST(SUM(t.tax_cents) / 100.0 AS DECIMAL(18,2)) AS tax_total,
       CAST(SUM(CASE WHEN l.account ILIKE '%tax%' THEN l.amount_cents ELSE 0 END) / 100.0 AS DECIMAL(18,2)) AS ledger_total,
       CAST((SUM(t.tax_cents) - SUM(CASE WHEN l.account ILIKE '%tax%' THEN l.amount_cents ELSE 0 END)) / 100.0 AS DECIMAL(18,2)) AS difference
FROM tax_entries t JOIN tax_legs l ON t.transaction_id = l.transaction_id
GROUP BY t.transaction_id
HAVING SUM(t.tax_cents) <> SUM(CASE WHEN l.account ILIKE '%tax%' THEN l.amount_cents ELSE 0 END)"""


@query("reconcile_tax_literal", "R11", views=["tax_entries", "tax_legs"],
       money=["tax_total", "ledger_total", "difference"], oracle=_TAX_ORACLE)
def _reconcile_tax_literal(b):
    te, tl = _tax_inputs(b)
    return recon.reconcile_tax(te, tl, literal=True)


@query("reconcile_tax", "R11", views=["tax_entries", "tax_legs"], money=["tax_total", "ledger_total", "difference"], oracle="""
SELECT t.transaction_id, CAST(t.s / 100.0 AS DECIMAL(18,2)) AS tax_total, CAST(l.s / 100.0 AS DECIMAL(18,2)) AS ledger_total,
       CAST((t.s - l.s) / 100.0 AS DECIMAL(18,2)) AS difference
FROM (SELECT transaction_id, SUM(tax_cents) AS s FROM tax_entries GROUP BY transaction_id) t
JOIN (SELECT transaction_id, SUM(CASE WHEN account ILIKE '%tax%' THEN amount_cents ELSE 0 END) AS s FROM tax_legs GROUP BY transaction_id) l
  ON t.transaction_id = l.transaction_id
WHERE t.s <> l.s""")
def _reconcile_tax(b):
    te, tl = _tax_inputs(b)
    return recon.reconcile_tax(te, tl, literal=False)


@query("vat_summary", "R12", views=["tax_entries", "transactions"], money=["total_tax"], oracle="""
SELECT tax_type, CAST(SUM(tax_cents) / 100.0 AS DECIMAL(18,2)) AS total_tax FROM tax_entries
WHERE transaction_id IN (SELECT transaction_id FROM transactions WHERE description IS NOT NULL)
GROUP BY tax_type""")
def _vat_summary(b):
    te, _ = _tax_inputs(b)
    return recon.vat_summary(te, b.transactions)


@query("reconciliation_summary", "R13",
       views=["journals", "ar_ext", "ap_ext", "charts", "tax_entries", "tax_legs"], oracle=f"""
SELECT 'Journal Balance' AS check_name, COUNT(*) AS issue_count FROM ({_TX_TOTALS}) s WHERE total_debit <> total_credit
UNION ALL SELECT 'AR Mismatch', COUNT(*) FROM ({_doc_sql("ar_ext", "Accounts Receivable", "j.journal")}) a
UNION ALL SELECT 'AP Mismatch', COUNT(*) FROM ({_doc_sql("ap_ext", "Accounts Payable", "NOT j.journal")}) p
UNION ALL SELECT 'Tax Mismatch', COUNT(*) FROM (
  SELECT t.transaction_id FROM (SELECT transaction_id, SUM(tax_cents) AS s FROM tax_entries GROUP BY transaction_id) t
  JOIN (SELECT transaction_id, SUM(CASE WHEN account ILIKE '%tax%' THEN amount_cents ELSE 0 END) AS s FROM tax_legs GROUP BY transaction_id) l
  ON t.transaction_id = l.transaction_id WHERE t.s <> l.s) x""")
def _reconciliation_summary(b):
    te, tl = _tax_inputs(b)
    return recon.reconciliation_summary(
        recon.check_journal_balance(b.journals), recon.reconcile_ar(b.ar_ext, b.journals, b.charts),
        recon.reconcile_ap(b.ap_ext, b.journals, b.charts), recon.reconcile_tax(te, tl, literal=False))


def _order_tax(b):
    """Every order's input tax posted to its client's first account whose name holds 'tax', next to the order's own legs."""
    t = b.tax_entries.where(F.col("tax_type") == "VAT_INPUT").groupBy("transaction_id").agg(F.sum("tax_cents").alias("c"))
    charts = b.charts.where(F.col("account").ilike("%tax%")).groupBy("client_id").agg(F.min("chart_id").alias("chart_id"))
    # every ninth order posts one cent too much
    cents = F.col("c") + F.when(F.col("transaction_id") % 9 == 0, 1).otherwise(0)
    legs = (t.join(b.transactions.select("transaction_id", "client_id"), "transaction_id").join(charts, "client_id")
            .select("transaction_id", "chart_id", (cents.cast("decimal(20,0)") / 100).cast("decimal(15,2)").alias("amount")))
    return b.journals.select("transaction_id", "chart_id", "amount").unionByName(legs)


_ORDER_TAX_SQL = """te AS (SELECT transaction_id, CAST(CAST(tax_cents AS DECIMAL(20,0)) / 100 AS DECIMAL(15,2)) AS tax_amount FROM tax_entries WHERE tax_type = 'VAT_INPUT'),
tx AS (SELECT client_id, MIN(chart_id) AS chart_id FROM charts WHERE account ILIKE '%tax%' GROUP BY client_id),
led AS (SELECT transaction_id, chart_id, amount FROM journals UNION ALL
        SELECT t.transaction_id, x.chart_id, CAST(SUM(t.tax_amount) + CASE WHEN t.transaction_id % 9 = 0 THEN 0.01 ELSE 0 END AS DECIMAL(15,2))
        FROM te t JOIN transactions o ON o.transaction_id = t.transaction_id JOIN tx x ON x.client_id = o.client_id GROUP BY t.transaction_id, x.chart_id)"""


@query("reconcile_tax_journals", "R11", views=["tax_entries", "journals", "charts", "transactions"], money=["tax_total", "ledger_total", "difference"], oracle=f"""
WITH {_ORDER_TAX_SQL},
a AS (SELECT transaction_id, SUM(tax_amount) AS tax_total FROM te GROUP BY transaction_id),
l AS (SELECT j.transaction_id, SUM(CASE WHEN c.account ILIKE '%tax%' THEN j.amount ELSE 0 END) AS ledger_total
      FROM led j JOIN charts c ON c.chart_id = j.chart_id GROUP BY j.transaction_id)
SELECT a.transaction_id, CAST(tax_total AS DECIMAL(18,2)) AS tax_total, CAST(ledger_total AS DECIMAL(18,2)) AS ledger_total,
       CAST(tax_total - ledger_total AS DECIMAL(18,2)) AS difference
FROM a JOIN l ON a.transaction_id = l.transaction_id WHERE tax_total <> ledger_total""")
def _reconcile_tax_journals(b):
    te = b.tax_entries.where(F.col("tax_type") == "VAT_INPUT").select("transaction_id", (F.col("tax_cents").cast("decimal(20,0)") / 100).cast("decimal(15,2)").alias("tax_amount"))
    return recon.reconcile_tax(te, recon.ledger_legs(_order_tax(b), b.charts), literal=False)
