"""X1–X6, X13–X15 — payroll.

A payroll period is a set computation: salary lines whose effective interval
overlaps the period are summed per employee with conditional aggregates; an
employee's component list is short (bounded by the component catalogue), so
the breakdown text is a sorted ``collect_list`` of at most that many items.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.money import MONEY

EARNINGS = ("SALARY", "ALLOWANCE", "BONUS", "BENEFIT")
DEDUCTIONS = ("DEDUCTION", "TAX", "STATUTORY")
TOTAL = "decimal(18,2)"

# Components of the hourly payslip, paid by hours or at their catalogue rate.
BASIC = "Basic Salary"
RATED = ("Rice Allowance", "Transportation Allowance", "Communication Allowance", "SSS Contribution", "PhilHealth Premium",
         "Pag-IBIG Contribution", "Withholding Tax", "Personal Loan Deduction")


def _d(x) -> F.Column:
    return F.lit(str(x)).cast("date")


def employee_payroll(details: DataFrame, components: DataFrame, start, end) -> DataFrame:
    """Per employee: gross, deductions, net and the 'name: $amount' breakdown (component order)."""
    lines = (details.where((F.col("effective_date") <= _d(end))
                           & (F.col("end_date").isNull() | (F.col("end_date") >= _d(start))))
             .join(components.select("component_id", "component_name", "component_type"), "component_id"))
    t = F.col("component_type")
    text = F.concat(F.col("component_name"), F.lit(": $"), F.col("amount").cast("string"), F.lit("\n"))
    return lines.groupBy("employee_id").agg(
        F.sum(F.when(t.isin(*EARNINGS), F.col("amount")).otherwise(0)).cast(TOTAL).alias("gross_amount"),
        F.sum(F.when(t.isin(*DEDUCTIONS), F.col("amount")).otherwise(0)).cast(TOTAL).alias("total_deductions"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("component_id", text.alias("t")))),
                                 lambda x: x["t"]), "").alias("component_details"),
    ).withColumn("net_amount", (F.col("gross_amount") - F.col("total_deductions")).cast(TOTAL))


def payroll_run(employees: DataFrame, details: DataFrame, components: DataFrame, period_id: int,
                start, end) -> dict[str, DataFrame]:
    """Payslip per employee (employees without lines get zeros) and one run header per client.

    Ids are the text ``<period>-<employee>`` and ``<period>-<client>``: distinct for any id."""
    pay = employee_payroll(details, components, start, end)
    slips = employees.select("employee_id", "client_id").join(pay, "employee_id", "left").select(
        F.concat(F.lit(f"{period_id}-"), F.col("employee_id").cast("string")).alias("payslip_id"),
        F.concat(F.lit(f"{period_id}-"), F.col("client_id").cast("string")).alias("run_id"), "employee_id", "client_id",
        F.coalesce("gross_amount", F.lit(0).cast(TOTAL)).alias("gross_amount"),
        F.coalesce("total_deductions", F.lit(0).cast(TOTAL)).alias("total_deductions"),
        F.coalesce("net_amount", F.lit(0).cast(TOTAL)).alias("net_amount"),
        F.coalesce("component_details", F.lit("")).alias("component_details"))
    runs = slips.groupBy("run_id", "client_id").agg(
        F.sum("gross_amount").cast(TOTAL).alias("total_gross"),
        F.sum("total_deductions").cast(TOTAL).alias("total_deductions"),
        F.sum("net_amount").cast(TOTAL).alias("total_net"),
        F.count(F.lit(1)).alias("employee_count")).select(
        "run_id", "client_id", F.lit(period_id).alias("period_id"), _d(start).alias("period_start"),
        _d(end).alias("period_end"), "total_gross", "total_deductions", "total_net", "employee_count",
        F.lit("CALCULATED").alias("status"))
    lines = (details.where((F.col("effective_date") <= _d(end))
                           & (F.col("end_date").isNull() | (F.col("end_date") >= _d(start))))
             .join(slips.select("payslip_id", "employee_id"), "employee_id")
             .select("payslip_id", "employee_id", "component_id", F.col("amount").cast(MONEY).alias("amount")))
    return {"payslips": slips, "runs": runs, "lines": lines}


def payroll_taxes(payslips: DataFrame, tax_types: DataFrame, name_pattern: str = "%Income%") -> DataFrame:
    """gross × rate / 100 per payslip for the client's active types whose name matches."""
    from .tax import tax_cents
    tt = tax_types.where(F.col("is_active") & F.col("tax_name").like(name_pattern)).select(
        "client_id", "tax_type_id", "tax_rate")
    j = payslips.select("payslip_id", "employee_id", "client_id", "gross_amount").join(tt, "client_id")
    return j.select("payslip_id", "employee_id", "tax_type_id", "tax_rate",
                    (tax_cents(F.col("gross_amount"), F.col("tax_rate")).cast("decimal(20,0)") / 100)
                    .cast(MONEY).alias("tax_amount"))


def payslip_view(runs: DataFrame, payslips: DataFrame, employees: DataFrame, lines: DataFrame,
                 components: DataFrame) -> DataFrame:
    """Flattened payslip: run and period, employee, each component line."""
    return (lines.join(payslips.select("payslip_id", "run_id", "gross_amount", "total_deductions", "net_amount"),
                       "payslip_id")
            .join(runs.select("run_id", "period_start", "period_end", "status"), "run_id")
            .join(employees.select("employee_id", "employee_name"), "employee_id")
            .join(components.select("component_id", "component_name", "component_type"), "component_id")
            .select("run_id", "period_start", "period_end", "payslip_id", "employee_id", "employee_name",
                    "component_name", "component_type", "amount", "gross_amount", "total_deductions", "net_amount",
                    "status"))


def hourly_payslip(rates: DataFrame, hours: DataFrame, details: DataFrame, components: DataFrame,
                   start, end) -> DataFrame:
    """Per employee and component: basic = hourly rate in force at period end × hours worked
    (0 without hours); the other named components take the catalogue's ``component_rate``, any
    other component 0.  The rate is an as-of pick (latest effective ≤ end, then the highest)."""
    rate = (rates.where(F.col("effective_date") <= _d(end)).groupBy("employee_id")
            .agg(F.max(F.struct("effective_date", "hourly_rate")).alias("_r")).select("employee_id", F.col("_r.hourly_rate").alias("hourly_rate")))
    worked = (hours.where(F.col("work_date").between(_d(start), _d(end)))
              .groupBy("employee_id").agg(F.sum("hours").alias("hours")))
    base = rate.join(worked, "employee_id", "left").withColumn("hours", F.coalesce("hours", F.lit(0)))
    lines = (details.where((F.col("effective_date") <= _d(end))
                           & (F.col("end_date").isNull() | (F.col("end_date") >= _d(start))))
             .join(components.select("component_id", "component_name", "component_rate"), "component_id")
             .join(base, "employee_id"))
    amount = (F.when(F.col("component_name") == BASIC, F.col("hourly_rate") * F.col("hours"))
              .when(F.col("component_name").isin(*RATED), F.col("component_rate")).otherwise(F.lit(0)))
    return lines.select("employee_id", "component_id", "component_name", "hourly_rate", "hours",
                        amount.cast(TOTAL).alias("amount"))


def period_hours(time_records: DataFrame, periods: DataFrame, daily_limit: float = 8.0) -> DataFrame:
    """Total and overtime hours per employee and pay period (overtime = hours above the daily
    limit).  Periods are any date ranges: each is spelled out into its days, so the match is an
    equi join on the day and a day that lies in several periods counts in each."""
    daily = time_records.groupBy("employee_id", "work_date").agg(F.sum("hours").alias("h"))
    days = (periods.where(F.col("period_start") <= F.col("period_end"))
            .select("period_id", F.explode(F.sequence("period_start", "period_end")).alias("work_date")))
    j = daily.join(days, "work_date")
    return j.groupBy("employee_id", "period_id").agg(
        F.sum("h").cast("decimal(18,2)").alias("total_hours"),
        F.sum(F.greatest(F.col("h") - F.lit(daily_limit), F.lit(0))).cast("decimal(18,2)").alias("overtime_hours"))


def payroll_batch_totals(batches: DataFrame, journals: DataFrame) -> DataFrame:
    """Batch totals from the linked ledger entry: Σ debit, Σ credit, leg count."""
    j = batches.select("batch_id", "transaction_id").join(journals, "transaction_id", "left")
    return j.groupBy("batch_id", "transaction_id").agg(
        F.sum(F.when(F.col("journal"), F.col("amount")).otherwise(0)).cast(TOTAL).alias("total_debit"),
        F.sum(F.when(~F.col("journal"), F.col("amount")).otherwise(0)).cast(TOTAL).alias("total_credit"),
        F.count("journal").alias("entry_count"))


def statutory_remittances(remittances: DataFrame, details: DataFrame) -> DataFrame:
    """Remittance total = Σ employee + employer contributions of its detail rows."""
    t = details.groupBy("remittance_id").agg(
        F.sum("employee_share").cast(TOTAL).alias("total_employee_share"),
        F.sum("employer_share").cast(TOTAL).alias("total_employer_share"),
        F.count(F.lit(1)).alias("employee_count"))
    return (remittances.join(t, "remittance_id", "left")
            .withColumn("employee_count", F.coalesce("employee_count", F.lit(0)))
            .withColumn("total_amount", (F.coalesce("total_employee_share", F.lit(0))
                                         + F.coalesce("total_employer_share", F.lit(0))).cast(TOTAL)))
