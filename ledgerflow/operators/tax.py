"""X7–X12 — tax calculation, liabilities, settlement and rules.

Tax types are per tenant, so "every transaction × every applicable type" is an
equi join on client_id with a handful of rows per client, never a cross join.
Money is exact: tax = round-half-up(base × rate / 100) in integer cents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.intervals import as_of
from ..functions.money import MONEY

# Tax types of every tenant (tax_name, tax_code, tax_rate %, is_active).
TAX_TYPES = [
    ("Withholding Tax", "WHT", "12.00", True),
    ("Annual Income Tax", "AIT", "15.00", True),
    ("Value Added Tax", "VAT", "12.00", True),
    ("Sales Tax", "SALES_TAX", "10.00", True),
    ("SSS Contribution", "SSS", "11.00", True),
    ("PhilHealth Premium", "PHILHEALTH", "2.75", True),
    ("Pag-IBIG Contribution", "PAG_IBIG", "1.00", True),
    ("Municipal Tax", "MUNICIPAL_TAX", "0.50", True),
    ("Business Permit Tax", "BIZ_PERMIT", "2.00", True),
]

# Scope each tax code applies to.
TAX_SCOPES = {"WHT": "SALES", "AIT": "ALL", "VAT": "SALES", "SALES_TAX": "SALES", "SSS": "EXPENSES",
              "PHILHEALTH": "EXPENSES", "PAG_IBIG": "EXPENSES", "MUNICIPAL_TAX": "ALL", "BIZ_PERMIT": "ALL"}

# Which ledger role carries each tax code's liability.
TAX_ACCOUNT_ROLES = {"VAT": "output_vat_payable", "SALES_TAX": "output_vat_payable"}


def tax_types_for(clients: DataFrame) -> DataFrame:
    """Every client's tax types: a generator over the fixed list (no join).
    tax_type_id = client_id * 100 + position."""
    arr = F.array(*[F.struct(F.lit(i + 1).alias("n"), F.lit(n).alias("tax_name"), F.lit(c).alias("tax_code"),
                             F.lit(r).cast("decimal(5,2)").alias("tax_rate"), F.lit(a).alias("is_active"))
                    for i, (n, c, r, a) in enumerate(TAX_TYPES)])
    t = clients.select("client_id", F.inline(arr))
    return t.select((F.col("client_id") * 100 + F.col("n")).alias("tax_type_id"), "client_id", "tax_name", "tax_code",
                    "tax_rate", "is_active")


def tax_rules_for(tax_types: DataFrame) -> DataFrame:
    scope = F.create_map(*[x for k, v in TAX_SCOPES.items() for x in (F.lit(k), F.lit(v))])
    return tax_types.select(F.col("tax_type_id"), scope[F.col("tax_code")].alias("applies_to"),
                            F.lit("0.00").cast(MONEY).alias("min_amount"),
                            F.lit("999999999.99").cast("decimal(15,2)").alias("max_amount"),
                            F.lit(True).alias("is_active"))


def tax_cents(base: Column, rate: Column) -> Column:
    """round-half-up(base × rate / 100) in cents for money base and % rate (exact integers)."""
    base_c = (base * 100).cast("long")
    rate_bp = (rate * 100).cast("long")
    return F.floor((base_c * rate_bp + F.lit(5000)).cast("decimal(38,0)") / F.lit(10000)).cast("long")


def _money(cents: Column) -> Column:
    return (cents.cast("decimal(20,0)") / 100).cast(MONEY)


def tax_calculations(transactions: DataFrame, tax_types: DataFrame, codes: list[str],
                     existing: DataFrame, due_days: int = 30) -> DataFrame:
    """One row per (transaction, applicable tax type) not already calculated.

    ``transactions``: transaction_id, client_id, date, base_amount.
    """
    tt = tax_types.where(F.col("tax_code").isin(*codes) & F.col("is_active")).select(
        "client_id", "tax_type_id", "tax_rate")
    j = transactions.join(tt, "client_id").join(existing.select("transaction_id", "tax_type_id"),
                                               ["transaction_id", "tax_type_id"], "left_anti")
    return j.select("transaction_id", "client_id", "tax_type_id", "base_amount", "tax_rate",
                    _money(tax_cents(F.col("base_amount"), F.col("tax_rate"))).alias("tax_amount"),
                    F.lit(True).alias("is_payable"), F.date_add("date", due_days).alias("due_date"),
                    F.lit("PENDING").alias("status"))


def tax_liabilities(base: DataFrame, tax_types: DataFrame, existing: DataFrame, due_days: int = 15) -> DataFrame:
    """Owed per active type and period; periods already on file are skipped.

    ``base``: client_id, period_start, period_end, total_taxable_amount.
    """
    tt = tax_types.where(F.col("is_active")).select("client_id", "tax_type_id", "tax_rate")
    keys = ["client_id", "tax_type_id", "period_start", "period_end"]
    j = base.join(tt, "client_id").join(existing.select(*keys), keys, "left_anti")
    owed = _money(tax_cents(F.col("total_taxable_amount"), F.col("tax_rate")))
    return j.select("client_id", "tax_type_id", "period_start", "period_end", "total_taxable_amount",
                    owed.alias("total_tax_owed"), F.lit(0).cast(MONEY).alias("total_tax_paid"),
                    owed.alias("balance_due"), F.date_add("period_end", due_days).alias("due_date"),
                    F.lit("OPEN").alias("status"))


def settle_tax(liabilities: DataFrame, tax_types: DataFrame, code: str, period_end) -> DataFrame:
    """Liabilities of ``code`` ending on ``period_end``: paid = owed, balance 0, PAID."""
    ids = tax_types.where(F.col("tax_code") == code).select("tax_type_id").withColumn("_hit", F.lit(True))
    l = liabilities.join(ids, "tax_type_id", "left")
    hit = F.coalesce(F.col("_hit"), F.lit(False)) & (F.col("period_end") == F.lit(str(period_end)).cast("date"))
    return l.select(*[F.when(hit, F.col("total_tax_owed")).otherwise(F.col(c)).alias(c) if c == "total_tax_paid"
                      else F.when(hit, F.lit(0).cast(MONEY)).otherwise(F.col(c)).alias(c) if c == "balance_due"
                      else F.when(hit, F.lit("PAID")).otherwise(F.col(c)).alias(c) if c == "status"
                      else F.col(c) for c in liabilities.columns])


def tax_liability_from_ledger(journals: DataFrame, role_map: DataFrame, code: str | None = None,
                              mapping: DataFrame | None = None) -> DataFrame:
    """Per client and tax code: Σ credit − Σ debit on the account mapped to the code.

    ``mapping`` (tax_code, role_name) is tenant data; by default the roles that the sample chart
    has.  ``code=None`` covers every mapped code; a code without a mapping has no liability row."""
    if mapping is None:
        mapping = journals.sparkSession.createDataFrame(list(TAX_ACCOUNT_ROLES.items()), "tax_code string, role_name string")
    if code is not None:
        mapping = mapping.where(F.col("tax_code") == code)
    charts = role_map.join(mapping, "role_name").select("client_id", "chart_id", "tax_code")
    j = journals.join(charts, "chart_id")
    return j.groupBy("client_id", "tax_code").agg(
        F.sum(F.when(~F.col("journal"), F.col("amount")).otherwise(-F.col("amount"))).cast("decimal(18,2)")
        .alias("tax_liability"))


def applicable_tax_rules(transactions: DataFrame, tax_types: DataFrame, rules: DataFrame) -> DataFrame:
    """(transaction, tax type) pairs whose rule scope is the transaction's scope or ALL and whose
    amount range holds (NULL max = open).  ``transactions``: transaction_id, client_id, scope, amount."""
    r = rules.where(F.col("is_active")).join(tax_types.select("tax_type_id", "client_id", "tax_code"), "tax_type_id")
    j = transactions.join(r, "client_id").where(
        ((F.col("applies_to") == F.col("scope")) | (F.col("applies_to") == "ALL"))
        & (F.col("amount") >= F.col("min_amount"))
        & (F.col("max_amount").isNull() | (F.col("amount") <= F.col("max_amount"))))
    return j.select("transaction_id", "tax_type_id", "tax_code", "applies_to")


def effective_tax_rate(transactions: DataFrame, tax_rates: DataFrame, tax_type: str = "VAT") -> DataFrame:
    """Rate in force on each transaction date: latest effective_date ≤ date whose expiry is after it.

    Any number of rates: both sides meet in an equi join over dyadic blocks of days (``as_of``)."""
    rates = tax_rates.where(F.col("tax_type") == tax_type)
    return as_of(transactions.select("transaction_id", "date"), rates, [], "date", "effective_date", "expiry_date", ["rate_id", "rate_percentage"])
