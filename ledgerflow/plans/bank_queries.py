"""Registered queries for bank reconciliation (B) and the reconciliation report (R14)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import balances, bank, recon
from ..session import ensure_checkpoint_dir
from .registry import query

_B = ["bank_accounts", "statements", "bank_tx", "journals"]
_MONEY = ["statement_balance", "book_balance", "outstanding_checks", "deposits_in_transit", "reconciled_balance",
          "difference"]

_B1_SQL = """WITH r0 AS (
  SELECT s.account_id, a.account_number, a.bank_name, s.statement_date, s.opening_balance, s.closing_balance AS statement_balance,
    CAST(COALESCE((SELECT SUM(CASE WHEN j.journal THEN j.amount ELSE -j.amount END) FROM journals j
                   WHERE j.chart_id = a.chart_id AND j.date <= s.statement_date), 0) AS DECIMAL(18,2)) AS book_balance,
    CAST(COALESCE((SELECT SUM(b.amount) FROM bank_tx b WHERE b.account_id = s.account_id AND b.transaction_date > s.statement_date
                   AND b.transaction_type = 'DEBIT'), 0) AS DECIMAL(18,2)) AS outstanding_checks,
    CAST(COALESCE((SELECT SUM(b.amount) FROM bank_tx b WHERE b.account_id = s.account_id AND b.transaction_date > s.statement_date
                   AND b.transaction_type = 'CREDIT'), 0) AS DECIMAL(18,2)) AS deposits_in_transit
  FROM statements s LEFT JOIN bank_accounts a ON s.account_id = a.account_id),
r1 AS (SELECT *, CAST(book_balance - outstanding_checks + deposits_in_transit AS DECIMAL(18,2)) AS reconciled_balance FROM r0),
r2 AS (SELECT *, CAST(statement_balance - reconciled_balance AS DECIMAL(18,2)) AS difference FROM r1),
b1 AS (SELECT account_id, account_number, bank_name, statement_date, statement_balance, book_balance, outstanding_checks,
              deposits_in_transit, reconciled_balance, difference,
              CASE WHEN difference = 0 THEN 'RECONCILED' WHEN ABS(difference) < 100 THEN 'VARIANCE (Minor)'
                   ELSE 'VARIANCE (Major)' END AS status, opening_balance FROM r2)"""


def _b1(b):
    st = bank.monthly_statements(b.bank_tx)
    return bank.bank_reconciliation(b.bank_accounts, st, b.journals, b.bank_tx), st


@query("bank_reconciliation", "B1", views=_B, money=_MONEY, oracle=_B1_SQL + "\nSELECT * EXCLUDE (opening_balance) FROM b1")
def _bank_reconciliation(b):
    return _b1(b)[0]


@query("bank_reconciliation_detail", "B2", views=_B + ["transactions"], money=["bank_amount", "book_amount"], oracle="""
SELECT s.account_id, s.statement_date, 1 AS section_no, 'BANK STATEMENT' AS section, 'Opening Balance' AS item_description,
       CAST(NULL AS DECIMAL(18,2)) AS bank_amount, CAST(s.opening_balance AS DECIMAL(18,2)) AS book_amount, 'STATEMENT' AS status,
       'Beginning balance from bank' AS reconciliation_notes, s.statement_date AS item_date FROM statements s
UNION ALL
SELECT b.account_id, last_day(b.transaction_date), 2, 'BANK TRANSACTION', 'Bank transaction ' || CAST(b.bank_trans_id AS VARCHAR),
       CAST(CASE WHEN b.transaction_type = 'CREDIT' THEN b.amount ELSE -b.amount END AS DECIMAL(18,2)), NULL, 'BANK',
       'From bank statement: ' || CAST(b.bank_trans_id AS VARCHAR), b.transaction_date FROM bank_tx b
UNION ALL
SELECT a.account_id, s.statement_date, 3, 'JOURNAL ENTRY', t.description, NULL,
       CAST(CASE WHEN j.journal THEN j.amount ELSE -j.amount END AS DECIMAL(18,2)), 'MATCHED', 'Matched to GL', j.date
FROM journals j JOIN bank_accounts a ON a.chart_id = j.chart_id JOIN statements s ON s.account_id = a.account_id
LEFT JOIN transactions t ON t.transaction_id = j.transaction_id WHERE j.date <= s.statement_date""")
def _bank_reconciliation_detail(b):
    st = bank.monthly_statements(b.bank_tx)
    return bank.bank_reconciliation_detail(b.bank_accounts, st, b.bank_tx, b.journals, b.transactions)


@query("bank_reconciliation_detail_keys", "B2", views=_B + ["transactions"], money=["bank_amount", "book_amount"], oracle="""
WITH k AS (SELECT account_id, MAX(statement_date) AS statement_date FROM statements GROUP BY account_id)
SELECT s.account_id, s.statement_date, 1 AS section_no, 'BANK STATEMENT' AS section, 'Opening Balance' AS item_description,
       CAST(NULL AS DECIMAL(18,2)) AS bank_amount, CAST(s.opening_balance AS DECIMAL(18,2)) AS book_amount, 'STATEMENT' AS status,
       'Beginning balance from bank' AS reconciliation_notes, s.statement_date AS item_date
FROM statements s JOIN k ON s.account_id = k.account_id AND s.statement_date = k.statement_date
UNION ALL
SELECT b.account_id, last_day(b.transaction_date), 2, 'BANK TRANSACTION', 'Bank transaction ' || CAST(b.bank_trans_id AS VARCHAR),
       CAST(CASE WHEN b.transaction_type = 'CREDIT' THEN b.amount ELSE -b.amount END AS DECIMAL(18,2)), NULL, 'BANK',
       'From bank statement: ' || CAST(b.bank_trans_id AS VARCHAR), b.transaction_date
FROM bank_tx b JOIN k ON b.account_id = k.account_id AND last_day(b.transaction_date) = k.statement_date
UNION ALL
SELECT a.account_id, k.statement_date, 3, 'JOURNAL ENTRY', t.description, NULL,
       CAST(CASE WHEN j.journal THEN j.amount ELSE -j.amount END AS DECIMAL(18,2)), 'MATCHED', 'Matched to GL', j.date
FROM journals j JOIN bank_accounts a ON a.chart_id = j.chart_id JOIN k ON k.account_id = a.account_id
LEFT JOIN transactions t ON t.transaction_id = j.transaction_id WHERE j.date <= k.statement_date""")
def _bank_reconciliation_detail_keys(b):
    # the last statement of each account
    st = bank.monthly_statements(b.bank_tx)
    keys = st.groupBy("account_id").agg(F.max("statement_date").alias("statement_date"))
    return bank.bank_reconciliation_detail(b.bank_accounts, st, b.bank_tx, b.journals, b.transactions, keys)


def _tier_sql(n: int, shift: int) -> str:
    """One tier by ranks over rows: bank rows and legs that the tiers before left over."""
    left_b = "".join(f" AND NOT EXISTS (SELECT 1 FROM m{i} WHERE m{i}.bank_trans_id = b.bank_trans_id)" for i in range(n))
    left_l = "".join(f" AND NOT EXISTS (SELECT 1 FROM m{i} WHERE m{i}.journal_id = l.journal_id)" for i in range(n))
    order = f"PARTITION BY account_id, amt ORDER BY statement_date, transaction_date, bank_trans_id"
    return f"""l{n} AS (SELECT l.*, row_number() OVER (PARTITION BY account_id, amt ORDER BY date, journal_id) AS r FROM lg l WHERE TRUE{left_l}),
p{n} AS (SELECT b.*, row_number() OVER ({order}) AS i,
                (SELECT COUNT(*) FROM l{n} x WHERE x.account_id = b.account_id AND x.amt = b.amt + {shift} AND x.date <= b.statement_date) AS p
         FROM br b WHERE TRUE{left_b}),
k{n} AS (SELECT *, i + LEAST(0, MIN(p - i) OVER ({order} ROWS UNBOUNDED PRECEDING)) AS k FROM p{n}),
j{n} AS (SELECT *, COALESCE(lag(k) OVER ({order}), 0) AS k0 FROM k{n}),
m{n} AS (SELECT j.bank_trans_id, l.journal_id, CAST(CAST(j.amt AS DECIMAL(20,0)) / 100 AS DECIMAL(15,2)) AS matched_amount
        FROM j{n} j JOIN l{n} l ON l.account_id = j.account_id AND l.amt = j.amt + {shift} AND l.r = j.k WHERE j.k > j.k0)"""


_MATCH_SQL = """WITH br AS (SELECT bank_trans_id, account_id, last_day(transaction_date) AS statement_date, transaction_date,
       CAST(CASE WHEN transaction_type = 'CREDIT' THEN amount ELSE -amount END * 100 AS BIGINT) AS amt FROM bank_tx),
lg AS (SELECT j.journal_id, a.account_id, j.date, CAST(CASE WHEN j.journal THEN j.amount ELSE -j.amount END * 100 AS BIGINT) AS amt
       FROM journals j JOIN bank_accounts a ON a.chart_id = j.chart_id),
""" + ",\n".join(_tier_sql(n, shift) for n, shift in enumerate((0, -1, 1))) + """,
matches AS (SELECT * FROM m0 UNION ALL SELECT * FROM m1 UNION ALL SELECT * FROM m2)"""


def _auto_match(b):
    return bank.auto_match_bank(b.bank_tx, b.journals, b.bank_accounts, bank.monthly_statements(b.bank_tx))


@query("auto_match_exact", "B3", views=["bank_tx", "journals", "bank_accounts"], money=["matched_amount"], oracle=_MATCH_SQL + "\nSELECT * FROM m0")
def _auto_match_exact(b):
    return bank.match_tier(*bank.match_inputs(b.bank_tx, b.journals, b.bank_accounts))


@query("auto_match_bank", "B3", views=["bank_tx", "journals", "bank_accounts"], money=["matched_amount"], oracle=_MATCH_SQL + "\nSELECT * FROM matches")
def _auto_match_bank(b):
    return _auto_match(b)["matches"]


@query("bank_reconciliation_legs", "B2", views=_B + ["transactions"], money=["book_amount"], oracle="""
SELECT a.account_id, j.journal_id, t.description, CAST(CASE WHEN j.journal THEN j.amount ELSE -j.amount END AS DECIMAL(18,2)) AS book_amount, j.date AS item_date,
       (SELECT MIN(s.statement_date) FROM statements s WHERE s.account_id = a.account_id AND s.statement_date >= j.date) AS first_statement_date
FROM journals j JOIN bank_accounts a ON a.chart_id = j.chart_id LEFT JOIN transactions t ON t.transaction_id = j.transaction_id""")
def _bank_reconciliation_legs(b):
    return bank.leg_statements(b.bank_accounts, bank.monthly_statements(b.bank_tx), b.journals, b.transactions)


@query("book_balance_as_of", "B1", views=["bank_tx", "journals", "bank_accounts", "statements"], oracle="""
SELECT s.account_id, s.statement_date, COALESCE(SUM(CAST(CASE WHEN j.journal THEN j.amount ELSE -j.amount END * 100 AS BIGINT)), 0)::BIGINT AS balance_cents
FROM statements s JOIN bank_accounts a ON a.account_id = s.account_id LEFT JOIN journals j ON j.chart_id = a.chart_id AND j.date <= s.statement_date
GROUP BY s.account_id, s.statement_date""")
def _book_balance_as_of(b):
    # the ledger posted in four batches, two of them folded into the base; the last holds legs of all months
    store = balances.BalanceStore(b.spark, ensure_checkpoint_dir(b.spark).rstrip("/") + f"/balances/{uuid.uuid4().hex}")
    late = F.col("transaction_id") % 10 == 0
    year = F.year("date")
    parts = [b.journals.where(~late & (year < 1994)), b.journals.where(~late & (year >= 1994) & (year < 1997)), b.journals.where(~late & (year >= 1997)), b.journals.where(late)]
    for i, legs in enumerate(parts, 1):
        store.post(i, legs)
        if i in (1, 3):
            store.fold(i)
    points = bank.monthly_statements(b.bank_tx).select("account_id", "statement_date").join(b.bank_accounts.select("account_id", "chart_id"), "account_id")
    found = store.as_of(points.select("chart_id", F.col("statement_date").alias("date")), len(parts))
    return (points.join(found.withColumnRenamed("date", "statement_date"), ["chart_id", "statement_date"])
            .select("account_id", "statement_date", "balance_cents"))


def _greedy_sql(cents: int) -> str:
    """Pairs of rows in one order (distance, below before above, then the dates and ids), taken in rounds of mutual first choice."""
    return f"""WITH RECURSIVE br AS (SELECT bank_trans_id, account_id, last_day(transaction_date) AS statement_date, transaction_date,
       CAST(CASE WHEN transaction_type = 'CREDIT' THEN amount ELSE -amount END * 100 AS BIGINT) AS amt FROM bank_tx),
lg AS (SELECT j.journal_id, a.account_id, j.date, CAST(CASE WHEN j.journal THEN j.amount ELSE -j.amount END * 100 AS BIGINT) AS amt
       FROM journals j JOIN bank_accounts a ON a.chart_id = j.chart_id),
pairs AS (SELECT bank_trans_id, journal_id, br.amt, row_number() OVER (ORDER BY abs(lg.amt - br.amt), lg.amt > br.amt, br.statement_date,
                 br.transaction_date, bank_trans_id, lg.date, journal_id) AS place
          FROM br JOIN lg ON br.account_id = lg.account_id AND lg.amt BETWEEN br.amt - {cents} AND br.amt + {cents} AND lg.date <= br.statement_date),
rounds AS (SELECT *, FALSE AS won FROM pairs
           UNION ALL
           SELECT bank_trans_id, journal_id, amt, place, win FROM (
             SELECT *, bool_or(win) OVER (PARTITION BY bank_trans_id) AS bank_won, bool_or(win) OVER (PARTITION BY journal_id) AS leg_won FROM (
               SELECT *, place = MIN(place) OVER (PARTITION BY bank_trans_id) AND place = MIN(place) OVER (PARTITION BY journal_id) AS win
               FROM rounds WHERE NOT won) a) c
           WHERE win OR NOT (bank_won OR leg_won))
SELECT bank_trans_id, journal_id, CAST(CAST(amt AS DECIMAL(20,0)) / 100 AS DECIMAL(15,2)) AS matched_amount FROM rounds WHERE won"""


def _register_tolerance(name: str, tolerance: float):
    query(name, "B3", views=["bank_tx", "journals", "bank_accounts"], money=["matched_amount"], oracle=_greedy_sql(round(tolerance * 100)))(
        lambda b: bank.auto_match_bank(b.bank_tx, b.journals, b.bank_accounts, bank.monthly_statements(b.bank_tx), tolerance)["matches"])


_register_tolerance("auto_match_within_1", 1.00)
_register_tolerance("auto_match_within_50", 50.00)


@query("auto_match_headers", "B3", views=_B, money=["statement_balance", "book_balance"], oracle=_MATCH_SQL + ",\n" + _B1_SQL[len("WITH "):] + """,
c AS (SELECT br.account_id, br.statement_date, COUNT(m.bank_trans_id) AS matched_count, COUNT(*) - COUNT(m.bank_trans_id) AS unmatched_count
      FROM br LEFT JOIN matches m ON br.bank_trans_id = m.bank_trans_id GROUP BY 1, 2)
SELECT b1.account_id, b1.statement_date AS reconciliation_date, b1.statement_balance, b1.book_balance, 'IN_PROGRESS' AS status,
       COALESCE(c.matched_count, 0) AS matched_count, COALESCE(c.unmatched_count, 0) AS unmatched_count
FROM b1 LEFT JOIN c ON b1.account_id = c.account_id AND b1.statement_date = c.statement_date""")
def _auto_match_headers(b):
    return _auto_match(b)["headers"]


@query("outstanding_items", "B4", views=["bank_tx", "journals", "bank_accounts"], money=["amount"], oracle=_MATCH_SQL + """
SELECT t.bank_trans_id, t.account_id, t.transaction_date, t.amount, CASE WHEN t.transaction_type = 'DEBIT' THEN 'CHECK' ELSE 'DEPOSIT' END AS item_type,
       'OUTSTANDING' AS status FROM bank_tx t WHERE NOT EXISTS (SELECT 1 FROM matches m WHERE m.bank_trans_id = t.bank_trans_id)""")
def _outstanding_items(b):
    return bank.outstanding_items(b.bank_tx, _auto_match(b)["matches"])


def tracking(b):
    """Reconciliation tracking rows: one per bank statement, from the bank reconciliation."""
    r, st = _b1(b)
    return (r.join(st.select("account_id", "statement_date", "opening_balance"), ["account_id", "statement_date"])
            .join(b.bank_accounts.select("account_id", "chart_id"), "account_id")
            .select((F.col("account_id") * 1000000 + F.date_format("statement_date", "yyyyMM").cast("int")).alias("reconciliation_id"),
                    F.col("account_id").cast("int").alias("client_id"), "chart_id",
                    F.col("statement_date").alias("reconciliation_date"),
                    F.when(F.col("difference") == 0, "RECONCILED").otherwise("DISCREPANCY_FOUND").alias("status"),
                    "opening_balance", F.col("statement_balance").alias("closing_balance"),
                    F.col("reconciled_balance").alias("expected_balance"), F.col("difference").alias("discrepancy_amount")))


@query("reconciliation_report", "R14", views=_B + ["charts", "clients", "accounts"],
       money=["opening_balance", "closing_balance", "expected_balance", "discrepancy_amount"], oracle=_B1_SQL + """,
trk AS (SELECT b1.account_id * 1000000 + CAST(strftime(b1.statement_date, '%Y%m') AS INT) AS reconciliation_id,
               CAST(b1.account_id AS INT) AS client_id, a.chart_id, b1.statement_date AS reconciliation_date,
               CASE WHEN b1.difference = 0 THEN 'RECONCILED' ELSE 'DISCREPANCY_FOUND' END AS status,
               b1.opening_balance, b1.statement_balance AS closing_balance, b1.reconciled_balance AS expected_balance,
               b1.difference AS discrepancy_amount
        FROM b1 JOIN bank_accounts a ON b1.account_id = a.account_id)
SELECT t.*, c.account AS account_name FROM trk t LEFT JOIN charts c ON t.chart_id = c.chart_id
WHERE t.client_id = 1 AND t.reconciliation_date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31'
ORDER BY t.reconciliation_date DESC, t.reconciliation_id DESC""")
def _reconciliation_report(b):
    return recon.reconciliation_report(tracking(b), b.charts, 1, "1996-01-01", "1999-12-31")
