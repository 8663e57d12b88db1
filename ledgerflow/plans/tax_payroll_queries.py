"""Registered queries for tax (X7–X12) and payroll (X1–X6, X13–X15).

Employees are the suppliers (client from their nation's region); salary lines
come from the bridge's salary_details; time records are the supplier's
shipments (hours = quantity / 5); pay periods are calendar months.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.money import MONEY
from ..operators import payroll, posting, tax
from . import posting_queries as pq
from .registry import query

PAY_START, PAY_END = "2025-01-01", "2025-01-31"
HOURLY_START, HOURLY_END = "1998-03-01", "1998-03-31"
PERIOD_ID = 202501

# VAT / sales-tax rate history (rate_id, tax_type, rate %, effective, expiry).
TAX_RATES = [(1, "VAT", "10.00", "1990-01-01", "1998-01-01"), (2, "VAT", "12.00", "1998-01-01", None),
             (3, "SALES_TAX", "10.00", "1990-01-01", None)]

_TT_SQL = """tt AS (SELECT c.client_id * 100 + t.n AS tax_type_id, c.client_id, t.tax_name, t.tax_code,
                   CAST(t.tax_rate AS DECIMAL(5,2)) AS tax_rate, t.is_active
            FROM clients c, (VALUES (1, 'Withholding Tax', 'WHT', '12.00', TRUE), (2, 'Annual Income Tax', 'AIT', '15.00', TRUE),
                 (3, 'Value Added Tax', 'VAT', '12.00', TRUE), (4, 'Sales Tax', 'SALES_TAX', '10.00', TRUE),
                 (5, 'SSS Contribution', 'SSS', '11.00', TRUE), (6, 'PhilHealth Premium', 'PHILHEALTH', '2.75', TRUE),
                 (7, 'Pag-IBIG Contribution', 'PAG_IBIG', '1.00', TRUE), (8, 'Municipal Tax', 'MUNICIPAL_TAX', '0.50', TRUE),
                 (9, 'Business Permit Tax', 'BIZ_PERMIT', '2.00', TRUE)) AS t(n, tax_name, tax_code, tax_rate, is_active))"""


def _tax_sql(base: str, rate: str) -> str:
    return (f"CAST(CAST(FLOOR(CAST(CAST({base} * 100 AS BIGINT) * CAST({rate} * 100 AS BIGINT) + 5000 AS DECIMAL(38,0)) / 10000) "
            f"AS BIGINT) AS DECIMAL(20,0)) / 100")


def tax_types(b):
    return tax.tax_types_for(b.clients)


@query("tax_calculations", "X7", views=["transactions", "clients"], money=["base_amount", "tax_rate", "tax_amount"], oracle=f"""
WITH {_TT_SQL}
SELECT t.transaction_id, t.client_id, tt.tax_type_id, t.total AS base_amount, tt.tax_rate,
       CAST({_tax_sql('t.total', 'tt.tax_rate')} AS DECIMAL(15,2)) AS tax_amount, TRUE AS is_payable,
       CAST(t.date + INTERVAL 30 DAY AS DATE) AS due_date, 'PENDING' AS status
FROM transactions t JOIN tt ON t.client_id = tt.client_id
WHERE tt.tax_code IN ('VAT', 'WHT') AND tt.is_active
  AND NOT (t.st = 'F' AND tt.tax_type_id = t.client_id * 100 + 3)""")
def _tax_calculations(b):
    t = b.transactions.select("transaction_id", "client_id", "date", F.col("total").alias("base_amount"))
    existing = b.transactions.where(F.col("st") == "F").select(
        "transaction_id", (F.col("client_id") * 100 + 3).alias("tax_type_id"))
    return tax.tax_calculations(t, tax_types(b), ["VAT", "WHT"], existing)


def _liability_base(b):
    t = b.transactions
    return t.groupBy("client_id", F.trunc("date", "month").alias("period_start"),
                     F.last_day("date").alias("period_end")).agg(F.sum("total").cast("decimal(18,2)").alias("total_taxable_amount"))


def liabilities(b):
    base = _liability_base(b)
    existing = base.where(F.col("period_start") < F.lit("1996-01-01").cast("date")).join(
        tax_types(b).select("client_id", "tax_type_id"), "client_id")
    return tax.tax_liabilities(base, tax_types(b), existing)


_LIAB_SQL = f"""{_TT_SQL},
base AS (SELECT client_id, CAST(date_trunc('month', date) AS DATE) AS period_start, last_day(date) AS period_end,
                CAST(SUM(total) AS DECIMAL(18,2)) AS total_taxable_amount FROM transactions GROUP BY 1, 2, 3),
liab AS (SELECT b.client_id, tt.tax_type_id, b.period_start, b.period_end, b.total_taxable_amount,
                CAST({_tax_sql('b.total_taxable_amount', 'tt.tax_rate')} AS DECIMAL(15,2)) AS total_tax_owed,
                CAST(0 AS DECIMAL(15,2)) AS total_tax_paid,
                CAST({_tax_sql('b.total_taxable_amount', 'tt.tax_rate')} AS DECIMAL(15,2)) AS balance_due,
                CAST(b.period_end + INTERVAL 15 DAY AS DATE) AS due_date, 'OPEN' AS status
         FROM base b JOIN tt ON b.client_id = tt.client_id WHERE tt.is_active AND b.period_start >= DATE '1996-01-01')"""

_LIAB_MONEY = ["total_taxable_amount", "total_tax_owed", "total_tax_paid", "balance_due"]


@query("tax_liabilities", "X8", views=["transactions", "clients"], money=_LIAB_MONEY,
       oracle=f"WITH {_LIAB_SQL}\nSELECT * FROM liab")
def _tax_liabilities(b):
    return liabilities(b)


@query("settle_tax", "X9", views=["transactions", "clients"], money=_LIAB_MONEY, oracle=f"""WITH {_LIAB_SQL}
SELECT l.client_id, l.tax_type_id, l.period_start, l.period_end, l.total_taxable_amount, l.total_tax_owed,
       CASE WHEN hit THEN l.total_tax_owed ELSE l.total_tax_paid END AS total_tax_paid,
       CASE WHEN hit THEN CAST(0 AS DECIMAL(15,2)) ELSE l.balance_due END AS balance_due, l.due_date,
       CASE WHEN hit THEN 'PAID' ELSE l.status END AS status
FROM (SELECT l.*, (tt.tax_code = 'VAT' AND l.period_end = DATE '1998-12-31') AS hit
      FROM liab l JOIN tt ON l.tax_type_id = tt.tax_type_id) l""")
def _settle_tax(b):
    return tax.settle_tax(liabilities(b), tax_types(b), "VAT", "1998-12-31")


@query("tax_liability_from_ledger", "X10", views=pq.COA_VIEWS + ["movements", "products"], money=["tax_liability"],
       oracle=pq._legs_sql(pq._MOVEMENT_EVENTS_SQL) + """
SELECT m.client_id, CAST(SUM(CASE WHEN NOT l.journal THEN l.amount ELSE -l.amount END) AS DECIMAL(18,2)) AS tax_liability,
       'VAT' AS tax_code
FROM legs l JOIN role_map m ON l.chart_id = m.chart_id AND m.role_name = 'output_vat_payable' GROUP BY m.client_id""")
def _tax_liability_from_ledger(b):
    legs, _ = posting.post_journals(pq._movement_events(b), pq.role_map(b))
    return tax.tax_liability_from_ledger(legs, pq.role_map(b), "VAT")


@query("tax_liability_all_codes", "X10", views=pq.COA_VIEWS + ["movements", "products"], money=["tax_liability"],
       oracle=pq._legs_sql(pq._MOVEMENT_EVENTS_SQL) + """
SELECT m.client_id, x.tax_code, CAST(SUM(CASE WHEN NOT l.journal THEN l.amount ELSE -l.amount END) AS DECIMAL(18,2)) AS tax_liability
FROM legs l JOIN role_map m ON l.chart_id = m.chart_id
JOIN (VALUES ('VAT', 'output_vat_payable'), ('SALES_TAX', 'output_vat_payable'), ('WHT', 'input_vat_receivable')) x(tax_code, role_name)
  ON m.role_name = x.role_name GROUP BY m.client_id, x.tax_code""")
def _tax_liability_all_codes(b):
    legs, _ = posting.post_journals(pq._movement_events(b), pq.role_map(b))
    mapping = b.spark.createDataFrame([("VAT", "output_vat_payable"), ("SALES_TAX", "output_vat_payable"), ("WHT", "input_vat_receivable"),
                                       ("SSS", "no such role")], "tax_code string, role_name string")
    return tax.tax_liability_from_ledger(legs, pq.role_map(b), mapping=mapping)


@query("applicable_tax_rules", "X11", views=["transactions", "clients"], oracle=f"""WITH {_TT_SQL},
rules AS (SELECT tax_type_id, CASE tax_code WHEN 'WHT' THEN 'SALES' WHEN 'AIT' THEN 'ALL' WHEN 'VAT' THEN 'SALES'
                 WHEN 'SALES_TAX' THEN 'SALES' WHEN 'SSS' THEN 'EXPENSES' WHEN 'PHILHEALTH' THEN 'EXPENSES'
                 WHEN 'PAG_IBIG' THEN 'EXPENSES' ELSE 'ALL' END AS applies_to, client_id, tax_code FROM tt),
tx AS (SELECT transaction_id, client_id, CASE WHEN st = 'P' THEN 'EXPENSES' ELSE 'SALES' END AS scope, total AS amount
       FROM transactions)
SELECT tx.transaction_id, r.tax_type_id, r.tax_code, r.applies_to FROM tx JOIN rules r ON tx.client_id = r.client_id
WHERE (r.applies_to = tx.scope OR r.applies_to = 'ALL') AND tx.amount >= 0 AND tx.amount <= 999999999.99""")
def _applicable_tax_rules(b):
    t = b.transactions.select("transaction_id", "client_id",
                              F.when(F.col("st") == "P", "EXPENSES").otherwise("SALES").alias("scope"),
                              F.col("total").alias("amount"))
    tt = tax_types(b)
    return tax.applicable_tax_rules(t, tt, tax.tax_rules_for(tt))


@query("effective_tax_rate", "X12", views=["transactions"], money=["rate_percentage"], oracle="""
WITH r AS (SELECT * FROM (VALUES (1, 'VAT', CAST('10.00' AS DECIMAL(5,2)), DATE '1990-01-01', DATE '1998-01-01'),
                                 (2, 'VAT', CAST('12.00' AS DECIMAL(5,2)), DATE '1998-01-01', NULL),
                                 (3, 'SALES_TAX', CAST('10.00' AS DECIMAL(5,2)), DATE '1990-01-01', NULL))
           AS t(rate_id, tax_type, rate_percentage, effective_date, expiry_date)),
c AS (SELECT t.transaction_id, t.date, r.rate_id, r.rate_percentage,
             row_number() OVER (PARTITION BY t.transaction_id ORDER BY r.effective_date DESC, r.rate_id DESC) AS rn
      FROM transactions t JOIN r ON r.tax_type = 'VAT' AND t.date >= r.effective_date
                                  AND (r.expiry_date IS NULL OR t.date < r.expiry_date))
SELECT t.transaction_id, t.date, c.rate_id, c.rate_percentage
FROM transactions t LEFT JOIN c ON t.transaction_id = c.transaction_id AND c.rn = 1""")
def _effective_tax_rate(b):
    rates = b.spark.createDataFrame(
        [(i, ty, r, e, x) for i, ty, r, e, x in TAX_RATES],
        "rate_id int, tax_type string, rate_percentage string, effective_date string, expiry_date string").select(
        "rate_id", "tax_type", F.col("rate_percentage").cast("decimal(5,2)").alias("rate_percentage"),
        F.col("effective_date").cast("date").alias("effective_date"), F.col("expiry_date").cast("date").alias("expiry_date"))
    return tax.effective_tax_rate(b.transactions.select("transaction_id", "date"), rates, "VAT")


@query("effective_tax_rate_history", "X12", views=["transactions"], money=["rate_percentage"], oracle="""
WITH r AS (SELECT l_orderkey * 16 + l_linenumber AS rate_id, CAST(l_partkey % 2500 / 100 AS DECIMAL(5,2)) AS rate_percentage,
                  CAST(l_shipdate AS DATE) AS effective_date,
                  CASE WHEN l_suppkey % 97 <> 0 THEN CAST(CAST(l_shipdate AS DATE) + CAST(l_quantity % 9 AS INT) AS DATE) END AS expiry_date FROM lineitem),
d AS (SELECT DISTINCT date FROM transactions),
c AS (SELECT d.date, max_by(struct_pack(a := rate_id, b := rate_percentage), struct_pack(x := effective_date, y := rate_id, z := rate_percentage)) AS best
      FROM d JOIN r ON d.date >= r.effective_date AND (r.expiry_date IS NULL OR d.date < r.expiry_date) GROUP BY d.date)
SELECT t.transaction_id, t.date, c.best.a AS rate_id, c.best.b AS rate_percentage FROM transactions t LEFT JOIN c ON t.date = c.date""")
def _effective_tax_rate_history(b):
    # one rate per order line: tens of thousands of overlapping rates of one type, some of them open-ended
    ship = F.col("l_shipdate").cast("date")
    rates = b.raw("lineitem").select(
        (F.col("l_orderkey") * 16 + F.col("l_linenumber")).alias("rate_id"), F.lit("VAT").alias("tax_type"),
        (F.col("l_partkey") % 2500 / 100).cast("decimal(5,2)").alias("rate_percentage"), ship.alias("effective_date"),
        F.when(F.col("l_suppkey") % 97 != 0, F.date_add(ship, (F.col("l_quantity") % 9).cast("int"))).alias("expiry_date"))
    return tax.effective_tax_rate(b.transactions.select("transaction_id", "date"), rates, "VAT")


# ---- payroll -------------------------------------------------------------------------

def employees(b):
    return b.vendors.select(F.col("vendor_id").alias("employee_id"), "client_id",
                            F.col("vendor_name").alias("employee_name"))


def run(b):
    return payroll.payroll_run(employees(b), b.salary_details, b.components, PERIOD_ID, PAY_START, PAY_END)


_PAY_SQL = f"""lines AS (SELECT d.employee_id, d.component_id, d.amount, c.component_name, c.component_type
          FROM salary_details d JOIN components c ON d.component_id = c.component_id
          WHERE d.effective_date <= DATE '{PAY_END}' AND (d.end_date IS NULL OR d.end_date >= DATE '{PAY_START}')),
pay AS (SELECT employee_id,
               CAST(SUM(CASE WHEN component_type IN ('SALARY','ALLOWANCE','BONUS','BENEFIT') THEN amount ELSE 0 END) AS DECIMAL(18,2)) AS gross_amount,
               CAST(SUM(CASE WHEN component_type IN ('DEDUCTION','TAX','STATUTORY') THEN amount ELSE 0 END) AS DECIMAL(18,2)) AS total_deductions,
               string_agg(component_name || ': $' || CAST(amount AS VARCHAR) || chr(10), '' ORDER BY component_id) AS component_details
        FROM lines GROUP BY employee_id),
emp AS (SELECT vendor_id AS employee_id, client_id, vendor_name AS employee_name FROM vendors),
slips AS (SELECT '{PERIOD_ID}-' || CAST(e.employee_id AS VARCHAR) AS payslip_id, '{PERIOD_ID}-' || CAST(e.client_id AS VARCHAR) AS run_id, e.employee_id,
                 e.client_id, COALESCE(p.gross_amount, 0) AS gross_amount, COALESCE(p.total_deductions, 0) AS total_deductions,
                 CAST(COALESCE(p.gross_amount - p.total_deductions, 0) AS DECIMAL(18,2)) AS net_amount,
                 COALESCE(p.component_details, '') AS component_details
          FROM emp e LEFT JOIN pay p ON e.employee_id = p.employee_id),
runs AS (SELECT run_id, client_id, {PERIOD_ID} AS period_id, DATE '{PAY_START}' AS period_start, DATE '{PAY_END}' AS period_end,
                CAST(SUM(gross_amount) AS DECIMAL(18,2)) AS total_gross, CAST(SUM(total_deductions) AS DECIMAL(18,2)) AS total_deductions,
                CAST(SUM(net_amount) AS DECIMAL(18,2)) AS total_net, COUNT(*) AS employee_count, 'CALCULATED' AS status
         FROM slips GROUP BY run_id, client_id)"""

_PAY_VIEWS = ["salary_details", "components", "vendors"]


@query("employee_payroll", "X1", views=_PAY_VIEWS, money=["gross_amount", "total_deductions", "net_amount"], oracle=f"""
WITH {_PAY_SQL}
SELECT employee_id, gross_amount, total_deductions, component_details,
       CAST(gross_amount - total_deductions AS DECIMAL(18,2)) AS net_amount FROM pay""")
def _employee_payroll(b):
    return payroll.employee_payroll(b.salary_details, b.components, PAY_START, PAY_END)


@query("payroll_payslips", "X2", views=_PAY_VIEWS, money=["gross_amount", "total_deductions", "net_amount"],
       oracle=f"WITH {_PAY_SQL}\nSELECT * FROM slips")
def _payroll_payslips(b):
    return run(b)["payslips"]


@query("payroll_runs", "X2", views=_PAY_VIEWS, money=["total_gross", "total_deductions", "total_net"],
       oracle=f"WITH {_PAY_SQL}\nSELECT * FROM runs")
def _payroll_runs(b):
    return run(b)["runs"]


def payroll_postings(b):
    runs = run(b)["runs"]
    ids = posting.assign_ids(runs, b.transactions, "transaction_id", ["run_id"], "transaction_id")
    ev = ids.select("transaction_id", "client_id", F.lit("PAYROLL").alias("kind"), F.col("period_end").alias("date"),
                    (F.col("total_net") * 100).cast("long").alias("amount"), "run_id")
    legs, _rej = posting.post_journals(ev, pq.role_map(b))
    return ids, legs


_POST_PAY_SQL = f"""{_PAY_SQL},
rid AS (SELECT r.*, (SELECT MAX(transaction_id) FROM transactions) + row_number() OVER (ORDER BY run_id) AS transaction_id FROM runs r),
plegs AS (SELECT r.transaction_id, 0 AS leg_no, m.chart_id, r.period_end AS date, TRUE AS journal,
                 CAST(r.total_net AS DECIMAL(15,2)) AS amount
          FROM rid r JOIN role_map m ON m.client_id = r.client_id AND m.role_name = 'salary_expense'
          UNION ALL
          SELECT r.transaction_id, 1, m.chart_id, r.period_end, FALSE, CAST(r.total_net AS DECIMAL(15,2))
          FROM rid r JOIN role_map m ON m.client_id = r.client_id AND m.role_name = 'salary_payable')"""


@query("post_payroll", "X3", views=_PAY_VIEWS + pq.COA_VIEWS + ["transactions"], money=["amount"],
       oracle=f"WITH {_POST_PAY_SQL}\nSELECT * FROM plegs")
def _post_payroll(b):
    return payroll_postings(b)[1]


@query("payroll_taxes", "X4", views=_PAY_VIEWS + ["clients"], money=["tax_rate", "tax_amount"], oracle=f"""
WITH {_PAY_SQL}, {_TT_SQL}
SELECT s.payslip_id, s.employee_id, tt.tax_type_id, tt.tax_rate,
       CAST({_tax_sql('s.gross_amount', 'tt.tax_rate')} AS DECIMAL(15,2)) AS tax_amount
FROM slips s JOIN tt ON s.client_id = tt.client_id WHERE tt.is_active AND tt.tax_name LIKE '%Income%'""")
def _payroll_taxes(b):
    return payroll.payroll_taxes(run(b)["payslips"], tax_types(b))


@query("payslip_view", "X5", views=_PAY_VIEWS, money=["amount", "gross_amount", "total_deductions", "net_amount"], oracle=f"""
WITH {_PAY_SQL}
SELECT r.run_id, r.period_start, r.period_end, s.payslip_id, s.employee_id, e.employee_name, c.component_name, c.component_type,
       CAST(d.amount AS DECIMAL(15,2)) AS amount, s.gross_amount, s.total_deductions, s.net_amount, r.status
FROM salary_details d JOIN slips s ON d.employee_id = s.employee_id JOIN runs r ON s.run_id = r.run_id
JOIN emp e ON e.employee_id = s.employee_id JOIN components c ON c.component_id = d.component_id
WHERE d.effective_date <= DATE '{PAY_END}' AND (d.end_date IS NULL OR d.end_date >= DATE '{PAY_START}')""")
def _payslip_view(b):
    r = run(b)
    return payroll.payslip_view(r["runs"], r["payslips"], employees(b), r["lines"], b.components)


def hourly_rates(b):
    s = b.raw("supplier")
    base = (F.lit(100) + F.col("s_suppkey") % 50).cast(MONEY)
    arr = F.array(F.struct(F.lit("1995-01-01").cast("date").alias("effective_date"), base.alias("hourly_rate")),
                  F.struct(F.lit("1998-02-15").cast("date").alias("effective_date"), (base + 10).cast(MONEY).alias("hourly_rate")))
    return s.select(F.col("s_suppkey").alias("employee_id"), F.inline(arr))


def time_records(b):
    li = b.raw("lineitem")
    return li.select(F.col("l_suppkey").alias("employee_id"), F.col("l_shipdate").cast("date").alias("work_date"),
                     (F.col("l_quantity").cast("decimal(10,2)") / 5).cast("decimal(10,2)").alias("hours"))


_HOURS_SQL = """rates AS (SELECT s_suppkey AS employee_id, DATE '1995-01-01' AS effective_date,
                       CAST(100 + s_suppkey % 50 AS DECIMAL(15,2)) AS hourly_rate FROM supplier
               UNION ALL SELECT s_suppkey, DATE '1998-02-15', CAST(110 + s_suppkey % 50 AS DECIMAL(15,2)) FROM supplier),
tr AS (SELECT l_suppkey AS employee_id, CAST(l_shipdate AS DATE) AS work_date,
              CAST(CAST(l_quantity AS DECIMAL(10,2)) / 5 AS DECIMAL(10,2)) AS hours FROM lineitem)"""


@query("hourly_payslip", "X6", views=["salary_details", "components"], money=["hourly_rate", "amount"], oracle=f"""
WITH {_HOURS_SQL},
rate AS (SELECT employee_id, hourly_rate FROM (SELECT *, row_number() OVER (PARTITION BY employee_id ORDER BY effective_date DESC) AS rn
                                              FROM rates WHERE effective_date <= DATE '{HOURLY_END}') x WHERE rn = 1),
worked AS (SELECT employee_id, SUM(hours) AS hours FROM tr WHERE work_date BETWEEN DATE '{HOURLY_START}' AND DATE '{HOURLY_END}'
           GROUP BY employee_id)
SELECT d.employee_id, d.component_id, c.component_name, r.hourly_rate, w.hours,
       CAST(CASE WHEN c.component_name = 'Basic Salary' THEN r.hourly_rate * w.hours
                 WHEN c.component_name IN ('Rice Allowance', 'Transportation Allowance', 'Communication Allowance', 'SSS Contribution',
                   'PhilHealth Premium', 'Pag-IBIG Contribution', 'Withholding Tax', 'Personal Loan Deduction') THEN c.component_id * 100
                 ELSE 0 END AS DECIMAL(18,2)) AS amount
FROM salary_details d JOIN components c ON d.component_id = c.component_id
JOIN rate r ON r.employee_id = d.employee_id
JOIN (SELECT e.employee_id, COALESCE(MAX(w.hours), 0) AS hours FROM rate e LEFT JOIN worked w ON w.employee_id = e.employee_id GROUP BY e.employee_id) w
  ON w.employee_id = d.employee_id
WHERE d.effective_date <= DATE '{HOURLY_END}' AND (d.end_date IS NULL OR d.end_date >= DATE '{HOURLY_START}')""")
def _hourly_payslip(b):
    rated = b.components.withColumn("component_rate", (F.col("component_id") * 100).cast("decimal(15,2)"))
    return payroll.hourly_payslip(hourly_rates(b), time_records(b), b.salary_details, rated,
                                  HOURLY_START, HOURLY_END)


def pay_periods(b):
    t = time_records(b)
    return t.select((F.year("work_date") * 100 + F.month("work_date")).alias("period_id"),
                    F.trunc("work_date", "month").alias("period_start"), F.last_day("work_date").alias("period_end")).distinct()


@query("period_hours", "X15", views=[], oracle=f"""
WITH {_HOURS_SQL},
daily AS (SELECT employee_id, work_date, SUM(hours) AS h FROM tr GROUP BY 1, 2)
SELECT employee_id, CAST(year(work_date) * 100 + month(work_date) AS INT) AS period_id,
       CAST(SUM(h) AS DECIMAL(18,2)) AS total_hours, CAST(SUM(GREATEST(h - 8.0, 0)) AS DECIMAL(18,2)) AS overtime_hours
FROM daily GROUP BY 1, 2""", money=["total_hours", "overtime_hours"])
def _period_hours(b):
    return payroll.period_hours(time_records(b), pay_periods(b))


def half_month_periods(b):
    """Two periods a month: days 1-15 and 16 to the end, numbered 1 and 2 within the month's first day."""
    m = time_records(b).select(F.trunc("work_date", "month").alias("m")).distinct()
    half = F.array(F.struct(F.lit(1).alias("n"), F.col("m").alias("s"), F.date_add("m", 14).alias("e")),
                   F.struct(F.lit(2).alias("n"), F.date_add("m", 15).alias("s"), F.last_day("m").alias("e")))
    h = m.select("m", F.inline(half))
    return h.select(F.concat_ws("/", F.col("m").cast("string"), F.col("n").cast("string")).alias("period_id"),
                    F.col("s").alias("period_start"), F.col("e").alias("period_end"))


@query("period_hours_half_month", "X15", views=[], oracle=f"""
WITH {_HOURS_SQL},
daily AS (SELECT employee_id, work_date, SUM(hours) AS h FROM tr GROUP BY 1, 2)
SELECT employee_id, CAST(CAST(date_trunc('month', work_date) AS DATE) AS VARCHAR) || '/' || CASE WHEN day(work_date) <= 15 THEN '1' ELSE '2' END AS period_id,
       CAST(SUM(h) AS DECIMAL(18,2)) AS total_hours, CAST(SUM(GREATEST(h - 8.0, 0)) AS DECIMAL(18,2)) AS overtime_hours
FROM daily GROUP BY 1, 2""", money=["total_hours", "overtime_hours"])
def _period_hours_half_month(b):
    return payroll.period_hours(time_records(b), half_month_periods(b))


@query("payroll_batch_totals", "X13", views=_PAY_VIEWS + pq.COA_VIEWS + ["transactions"],
       money=["total_debit", "total_credit"], oracle=f"""WITH {_POST_PAY_SQL}
SELECT r.run_id AS batch_id, r.transaction_id,
       CAST(SUM(CASE WHEN l.journal THEN l.amount ELSE 0 END) AS DECIMAL(18,2)) AS total_debit,
       CAST(SUM(CASE WHEN NOT l.journal THEN l.amount ELSE 0 END) AS DECIMAL(18,2)) AS total_credit,
       COUNT(l.journal) AS entry_count
FROM rid r LEFT JOIN plegs l ON r.transaction_id = l.transaction_id GROUP BY r.run_id, r.transaction_id""")
def _payroll_batch_totals(b):
    ids, legs = payroll_postings(b)
    batches = ids.select(F.col("run_id").alias("batch_id"), "transaction_id")
    return payroll.payroll_batch_totals(batches, legs)


@query("statutory_remittances", "X14", views=_PAY_VIEWS,
       money=["total_employee_share", "total_employer_share", "total_amount"], oracle=f"""
WITH {_PAY_SQL},
det AS (SELECT s.run_id AS remittance_id, l.amount AS employee_share, l.amount AS employer_share
        FROM lines l JOIN slips s ON l.employee_id = s.employee_id WHERE l.component_type = 'STATUTORY')
SELECT r.run_id AS remittance_id, r.client_id, 'SSS' AS agency, r.period_end,
       CAST(SUM(d.employee_share) AS DECIMAL(18,2)) AS total_employee_share,
       CAST(SUM(d.employer_share) AS DECIMAL(18,2)) AS total_employer_share, COUNT(d.remittance_id) AS employee_count,
       CAST(COALESCE(SUM(d.employee_share), 0) + COALESCE(SUM(d.employer_share), 0) AS DECIMAL(18,2)) AS total_amount
FROM runs r LEFT JOIN det d ON r.run_id = d.remittance_id GROUP BY r.run_id, r.client_id, r.period_end""")
def _statutory_remittances(b):
    r = run(b)
    rem = r["runs"].select(F.col("run_id").alias("remittance_id"), "client_id", F.lit("SSS").alias("agency"), "period_end")
    stat = r["lines"].join(b.components.select("component_id", "component_type"), "component_id").where(
        F.col("component_type") == "STATUTORY").join(r["payslips"].select("payslip_id", "run_id"), "payslip_id")
    det = stat.select(F.col("run_id").alias("remittance_id"), F.col("amount").alias("employee_share"),
                      F.col("amount").alias("employer_share"))
    return payroll.statutory_remittances(rem, det)
