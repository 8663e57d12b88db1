"""L — ledger reports over transactions, journal legs and the chart of accounts.

Shape of every report: scan → equi joins on transaction_id / chart_id → date
filter (pushed to the scan) → conditional aggregation → sort.  The chart of
accounts is tenants × accounts, small next to the legs, and AQE turns its join
into a broadcast at runtime when it fits the threshold.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.money import credit, debit, total, zero

DateLike = str | _dt.date

INCOME_TYPES = ("Revenue", "Expense", "Cost of Goods Sold")
BALANCE_TYPES = ("Asset", "Liability", "Equity")


def _lit_date(d: DateLike) -> F.Column:
    return F.lit(str(d)).cast("date")


def _legs_in_range(journals: DataFrame, start: DateLike, end: DateLike) -> DataFrame:
    return journals.where(F.col("date").between(_lit_date(start), _lit_date(end)))


def _joined(transactions: DataFrame, journals: DataFrame, charts: DataFrame, start, end) -> DataFrame:
    j = _legs_in_range(journals, start, end)
    t = transactions.select("transaction_id", "description")
    c = charts.select("chart_id", "account", "type")
    return j.join(t, "transaction_id").join(c, "chart_id")


def general_journal(transactions: DataFrame, journals: DataFrame, charts: DataFrame,
                    start: DateLike, end: DateLike) -> DataFrame:
    """One row per leg in the inclusive date range, ordered by date, transaction."""
    return (_joined(transactions, journals, charts, start, end)
            .select("transaction_id", "date", "description", "account",
                    debit().alias("debit"), credit().alias("credit"))
            .orderBy("date", "transaction_id"))


def general_ledger(charts: DataFrame, journals: DataFrame, transactions: DataFrame,
                   start: DateLike, end: DateLike) -> DataFrame:
    """Same legs keyed and ordered by account, date, transaction."""
    return (_joined(transactions, journals, charts, start, end)
            .select("account", "date", "description", "transaction_id",
                    debit().alias("debit"), credit().alias("credit"))
            .orderBy("account", "date", "transaction_id"))


def trial_balance(transactions: DataFrame, journals: DataFrame, charts: DataFrame,
                  start: DateLike, end: DateLike) -> DataFrame:
    """Total debit and credit per (account, type) in the range."""
    # the transactions join only filters legs to known transactions; keep it a semi join
    j = _legs_in_range(journals, start, end).join(transactions.select("transaction_id"), "transaction_id", "left_semi")
    return (j.join(charts.select("chart_id", "account", "type"), "chart_id")
            .groupBy("account", "type")
            .agg(total(debit()).alias("total_debit"), total(credit()).alias("total_credit"))
            .orderBy("type", "account"))


def _net_by_type(transactions, journals, charts, start, end, types, name) -> DataFrame:
    j = _legs_in_range(journals, start, end).join(transactions.select("transaction_id"), "transaction_id", "left_semi")
    c = charts.where(F.col("type").isin(*types)).select("chart_id", "account", "type")
    return (j.join(c, "chart_id")
            .groupBy("type", "account")
            .agg((total(debit()) - total(credit())).cast("decimal(18,2)").alias(name))
            .orderBy("type", "account"))


def income_statement(charts: DataFrame, journals: DataFrame, transactions: DataFrame,
                     start: DateLike, end: DateLike) -> DataFrame:
    """debit − credit per (type, account) for Revenue / Expense / COGS (debit-positive)."""
    return _net_by_type(transactions, journals, charts, start, end, INCOME_TYPES, "net_amount")


def balance_sheet(charts: DataFrame, journals: DataFrame, transactions: DataFrame,
                  start: DateLike, end: DateLike) -> DataFrame:
    """debit − credit per (type, account) for Asset / Liability / Equity; range on the leg date."""
    return _net_by_type(transactions, journals, charts, start, end, BALANCE_TYPES, "balance")


def cash_balance(journals: DataFrame, charts: DataFrame, account: str,
                 start: DateLike, end: DateLike) -> DataFrame:
    """Net debit of one named cash account (one row)."""
    j = _legs_in_range(journals, start, end)
    c = charts.where(F.col("account") == account).select("chart_id")
    legs = j.join(c, "chart_id")
    return legs.agg((F.coalesce(total(debit()), zero()) - F.coalesce(total(credit()), zero()))
                    .cast("decimal(18,2)").alias("cash_balance"))


def profit_summary(journals: DataFrame, charts: DataFrame, start: DateLike, end: DateLike) -> DataFrame:
    """Total revenue, total expense and net, summing amount irrespective of side."""
    j = _legs_in_range(journals, start, end)
    c = charts.where(F.col("type").isin("Revenue", "Expense")).select("chart_id", "type")
    legs = j.join(c, "chart_id")
    rev = F.coalesce(total(F.when(F.col("type") == "Revenue", F.col("amount")).otherwise(zero())), zero())
    exp = F.coalesce(total(F.when(F.col("type") == "Expense", F.col("amount")).otherwise(zero())), zero())
    return legs.agg(rev.alias("total_revenue"), exp.alias("total_expense"),
                    (rev - exp).cast("decimal(18,2)").alias("net_income"))


def account_balance(journals: DataFrame, chart_id: int | None = None) -> DataFrame:
    """Σ amount if debit, −amount if credit, per chart (optionally one chart)."""
    j = journals if chart_id is None else journals.where(F.col("chart_id") == chart_id)
    return j.groupBy("chart_id").agg(
        total(F.when(F.col("journal"), F.col("amount")).otherwise(-F.col("amount"))).alias("balance"))
