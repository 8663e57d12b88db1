"""R — reconciliation checks.

All checks are one hash aggregation per side (partial aggregation before the
shuffle), joined on the transaction key.  Where the reference joins detail rows
to detail rows before grouping (and so multiplies sums), the literal result is
rebuilt exactly from per-side sums and row counts instead of materialising the
fan-out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.money import TOTAL, credit, debit, total, zero

IN_TYPES = ("Purchase", "Sale Return")
OUT_TYPES = ("Sale", "Purchase Return")


def _tx_totals(journals: DataFrame) -> DataFrame:
    return journals.groupBy("transaction_id").agg(
        total(debit()).alias("total_debit"), total(credit()).alias("total_credit"))


def journal_balance_check(journals: DataFrame) -> DataFrame:
    """Transactions whose debit total differs from the credit total."""
    return _tx_totals(journals).where(F.col("total_debit") != F.col("total_credit"))


def check_journal_balance(journals: DataFrame) -> DataFrame:
    """R1 plus the signed difference."""
    return journal_balance_check(journals).withColumn(
        "difference", (F.col("total_debit") - F.col("total_credit")).cast(TOTAL))


def ledger_balance_check(journals: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """One row: rule id, violation flag (abs diff > tolerance), totals, abs diff."""
    d = F.coalesce(total(debit()), zero()).cast(TOTAL)
    c = F.coalesce(total(credit()), zero()).cast(TOTAL)
    diff = F.abs(d - c).cast(TOTAL)
    return journals.agg(
        F.lit("DOUBLE_ENTRY_BALANCE").alias("rule_id"),
        (diff > F.lit(tolerance).cast("decimal(10,4)")).alias("violation_detected"),
        d.alias("total_debits"), c.alias("total_credits"), diff.alias("difference"))


def validate_transaction_balance(journals: DataFrame, ids: DataFrame) -> DataFrame:
    """Exact equality per requested transaction id; a missing id counts as 0 = 0 (valid)."""
    t = _tx_totals(journals)
    r = ids.select("transaction_id").join(t, "transaction_id", "left")
    d = F.coalesce(F.col("total_debit"), zero()).cast(TOTAL)
    c = F.coalesce(F.col("total_credit"), zero()).cast(TOTAL)
    ok = d == c
    return r.select(
        "transaction_id", ok.alias("is_valid"),
        F.when(ok, F.lit("")).otherwise(F.concat(
            F.lit("Debit/Credit imbalance. Debit: "), d.cast("string"), F.lit(" Credit: "), c.cast("string"))
        ).alias("error_msg"),
        d.alias("debit_total"), c.alias("credit_total"))


def validate_transaction_balance_tol(journals: DataFrame, ids: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Balanced when abs diff < tolerance; totals stay NULL for a missing id (no COALESCE)."""
    t = _tx_totals(journals)
    r = ids.select("transaction_id").join(t, "transaction_id", "left")
    diff = F.abs(F.col("total_debit") - F.col("total_credit")).cast(TOTAL)
    tol = F.lit(tolerance).cast("decimal(10,4)")
    return r.select(
        "transaction_id", (diff < tol).alias("is_balanced"),
        F.col("total_debit").alias("total_debits"), F.col("total_credit").alias("total_credits"),
        diff.alias("difference"),
        F.when(diff > tol, F.concat(F.lit("Transaction is out of balance: "), diff.cast("string")))
         .otherwise(F.lit("Transaction is balanced")).alias("error_message"))


def unbalanced_transactions(transactions: DataFrame, journals: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Transactions failing the tolerance check (the per-row lateral call as one aggregate + join)."""
    v = validate_transaction_balance_tol(journals, transactions.select("transaction_id"), tolerance)
    return (transactions.select("transaction_id", "description")
            .join(v.where(~F.col("is_balanced")), "transaction_id")
            .select("transaction_id", "description", "total_debits", "total_credits", "difference"))


def _reconcile_document(docs: DataFrame, journals: DataFrame, charts: DataFrame,
                        account: str, side_debit: bool) -> DataFrame:
    # literal: docs ⋈ legs grouped by (tx, amount); rebuilt as n_docs × Σ matching legs per tx
    leg = journals.join(charts.select("chart_id", "account"), "chart_id")
    on_side = F.col("journal") if side_debit else ~F.col("journal")
    per_tx = leg.groupBy("transaction_id").agg(
        F.sum(F.when((F.col("account") == account) & on_side, F.col("amount")).otherwise(zero())).alias("leg_sum"))
    d = docs.groupBy("transaction_id", "amount").agg(F.count(F.lit(1)).alias("n_docs"))
    j = d.join(per_tx, "transaction_id")
    ledger = (F.col("leg_sum") * F.col("n_docs")).cast(TOTAL)
    return (j.where(F.col("amount") != ledger)
             .select("transaction_id", F.col("amount").cast(TOTAL).alias("amount"),
                     ledger.alias("ledger_amount"), (F.col("amount") - ledger).cast(TOTAL).alias("difference")))


def reconcile_ar(ar_ext: DataFrame, journals: DataFrame, charts: DataFrame) -> DataFrame:
    """AR amount vs Σ debit legs on the receivable account; mismatches with difference."""
    return _reconcile_document(ar_ext, journals, charts, "Accounts Receivable", True)


def reconcile_ap(ap_ext: DataFrame, journals: DataFrame, charts: DataFrame) -> DataFrame:
    """AP amount vs Σ credit legs on the payable account."""
    return _reconcile_document(ap_ext, journals, charts, "Accounts Payable", False)


def reconcile_inventory(movements: DataFrame) -> DataFrame:
    """Per product: units in, units out, net."""
    q = F.col("quantity")
    a = F.col("action_type")
    qin = F.sum(F.when(a.isin(*IN_TYPES), q).otherwise(0)).cast("long")
    qout = F.sum(F.when(a.isin(*OUT_TYPES), q).otherwise(0)).cast("long")
    return movements.groupBy("product_id").agg(
        qin.alias("quantity_in"), qout.alias("quantity_out"), (qin - qout).alias("net_quantity"))


def stock_on_hand(movements: DataFrame) -> DataFrame:
    """Net quantity per product; transfers and unknown actions count 0."""
    q = F.col("quantity")
    a = F.col("action_type")
    return movements.groupBy("product_id").agg(
        F.sum(F.when(a.isin(*IN_TYPES), q).when(a.isin(*OUT_TYPES), -q).otherwise(0))
        .cast("long").alias("calculated_stock"))


def reconcile_tax(tax_entries: DataFrame, tax_legs: DataFrame, literal: bool = True) -> DataFrame:
    """Σ tax vs Σ ledger legs on accounts matching '%tax%' (case-insensitive), mismatches only.

    ``tax_entries``: transaction_id, tax_amount.  ``tax_legs``: transaction_id, account, amount.
    The literal form joins entries to legs before summing, so each side is multiplied by
    the other side's row count; it is reproduced from per-side sums and counts.
    ``literal=False`` compares the plain per-side sums.
    """
    te = tax_entries.groupBy("transaction_id").agg(
        F.sum("tax_amount").alias("tax_sum"), F.count(F.lit(1)).alias("n_tax"))
    tl = tax_legs.groupBy("transaction_id").agg(
        F.sum(F.when(F.col("account").ilike("%tax%"), F.col("amount")).otherwise(0)).alias("leg_sum"),
        F.count(F.lit(1)).alias("n_leg"))
    j = te.join(tl, "transaction_id")
    if literal:
        tax_total = (F.col("tax_sum") * F.col("n_leg")).cast(TOTAL)
        ledger_total = (F.col("leg_sum") * F.col("n_tax")).cast(TOTAL)
    else:
        tax_total = F.col("tax_sum").cast(TOTAL)
        ledger_total = F.col("leg_sum").cast(TOTAL)
    return (j.select("transaction_id", tax_total.alias("tax_total"), ledger_total.alias("ledger_total"))
             .where(F.col("tax_total") != F.col("ledger_total"))
             .withColumn("difference", (F.col("tax_total") - F.col("ledger_total")).cast(TOTAL)))


def ledger_legs(journals: DataFrame, charts: DataFrame) -> DataFrame:
    """Journal legs with the name of their account, the ledger side of ``reconcile_tax``."""
    return journals.select("transaction_id", "chart_id", "amount").join(charts.select("chart_id", "account"), "chart_id")


def vat_summary(tax_entries: DataFrame, transactions: DataFrame) -> DataFrame:
    """Σ tax by type for transactions whose description is not null."""
    keep = transactions.where(F.col("description").isNotNull()).select("transaction_id")
    return (tax_entries.join(keep, "transaction_id", "left_semi")
            .groupBy("tax_type").agg(F.sum("tax_amount").cast(TOTAL).alias("total_tax")))


def reconciliation_summary(journal_issues: DataFrame, ar_issues: DataFrame,
                           ap_issues: DataFrame, tax_issues: DataFrame) -> DataFrame:
    """Issue counts of the four checks, one row each."""
    parts = [("Journal Balance", journal_issues), ("AR Mismatch", ar_issues),
             ("AP Mismatch", ap_issues), ("Tax Mismatch", tax_issues)]
    out = None
    for name, df in parts:
        c = df.agg(F.lit(name).alias("check_name"), F.count(F.lit(1)).alias("issue_count"))
        out = c if out is None else out.unionByName(c)
    return out


def reconciliation_report(tracking: DataFrame, charts: DataFrame, client_id: int,
                          date_from, date_to) -> DataFrame:
    """Tracking rows of one client in the date range, with the account name, newest first."""
    t = tracking.where((F.col("client_id") == client_id)
                       & F.col("reconciliation_date").between(F.lit(str(date_from)).cast("date"),
                                                              F.lit(str(date_to)).cast("date")))
    return (t.join(charts.select("chart_id", F.col("account").alias("account_name")), "chart_id", "left")
             .orderBy(F.col("reconciliation_date").desc(), F.col("reconciliation_id").desc()))
