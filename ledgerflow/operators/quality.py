"""Q — data quality and compliance.

Constraints and domains of the reference become quarantine rules: each rule is
a predicate that must not be FALSE (NULL passes, as a CHECK does); a row's
failures are one array built by built-in expressions, exploded into violation
rows.  Existence checks are left / semi / anti joins on distinct keys, so the
parent side is read once and AQE can broadcast it when it is small.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import validators as V

Predicate = Callable[[Column], Column]

# domain name -> predicate over the column (TRUE or NULL = ok)
DOMAINS: dict[str, Predicate] = {
    "email_type": lambda x: x.rlike(V.EMAIL_PATTERN),
    "phone_type": lambda x: x.rlike(V.PHONE_PATTERN) | (x == ""),
    "amount_type": lambda x: x >= 0,
    "quantity_type": lambda x: x > 0,
    "account_code_type": lambda x: x > 0,
    "charts_typing": lambda x: x.isin(*V.CHART_TYPES),
    "action_typing": lambda x: x.isin(*V.ACTION_TYPES),
    "status_typing": lambda x: x.isin(*V.AR_STATUSES),
    "audit_log_typing": lambda x: x.isin(*V.AUDIT_OPERATIONS),
}

# table -> ordered (constraint name, row predicate)
CONSTRAINTS: dict[str, list[tuple[str, Callable[[], Column]]]] = {
    "ar_ext": [
        ("chk_ar_amount_nonnegative", lambda: F.col("amount") >= 0),
        ("chk_ar_invoice_before_due", lambda: F.col("invoice_date") <= F.col("due_date")),
        ("chk_ar_status", lambda: F.col("status").isin(*V.AR_STATUSES)),
    ],
    "ap_ext": [
        ("chk_ap_amount_nonnegative", lambda: F.col("amount") >= 0),
        ("chk_ap_invoice_before_due", lambda: F.col("invoice_date") <= F.col("due_date")),
        ("chk_ap_status", lambda: F.col("status").isin(*V.AR_STATUSES)),
    ],
    "inventory_audits": [
        ("chk_quantity_positive", lambda: F.col("quantity") > 0),
        ("chk_action_type", lambda: F.col("action_type").isin(*V.ACTION_TYPES)),
    ],
    "inventory_transfers": [
        ("chk_transfer_quantity_positive", lambda: F.col("quantity") > 0),
        ("chk_transfer_locations_differ", lambda: F.col("from_warehouse_id") != F.col("to_warehouse_id")),
    ],
    "journals": [
        ("date_not_null", lambda: F.col("date").isNotNull()),
        ("amount_not_null", lambda: F.col("amount").isNotNull()),
        ("positive_journal_amount", lambda: F.col("amount") >= 0),
    ],
    "charts": [
        ("chk_chart_type", lambda: F.col("type").isin(*V.CHART_TYPES)),
    ],
    "customers": [
        ("customer_name_not_null", lambda: F.col("customer_name").isNotNull()),
        ("email_not_null", lambda: F.col("email").isNotNull()),
        ("chk_customer_email", lambda: F.col("email").rlike(V.EMAIL_PATTERN)),
    ],
    "vendors": [
        ("vendor_name_not_null", lambda: F.col("vendor_name").isNotNull()),
        ("email_not_null", lambda: F.col("email").isNotNull()),
        ("chk_vendor_email", lambda: F.col("email").rlike(V.EMAIL_PATTERN)),
    ],
    "returns": [
        ("chk_return_quantity_positive", lambda: F.col("quantity") > 0),
    ],
    "operations": [
        ("chk_cost_nonnegative", lambda: F.col("product_cost") >= 0),
        ("chk_price_nonnegative", lambda: F.col("product_price") >= 0),
        ("chk_price_not_below_cost", lambda: F.col("product_price") >= F.col("product_cost")),
        ("chk_layer_quantity_nonnegative", lambda: F.col("quantity") >= 0),
    ],
}


def quarantine(df: DataFrame, table: str, key: str,
               rules: Iterable[tuple[str, Column, Column]]) -> tuple[DataFrame, DataFrame]:
    """(violations: table_name, record_id, rule, value; clean rows).

    ``rules``: (rule name, ok predicate, offending value shown in the report).
    """
    fails = F.array_compact(F.array(*[
        F.when(~ok, F.struct(F.lit(name).alias("rule"), value.cast("string").alias("value")))
        for name, ok, value in rules]))
    tagged = df.withColumn("_q_fails", fails)
    violations = tagged.select(F.lit(table).alias("table_name"), F.col(key).cast("string").alias("record_id"),
                               F.inline("_q_fails"))
    clean = tagged.where(F.size("_q_fails") == 0).drop("_q_fails")
    return violations, clean


def check_domains(df: DataFrame, table: str, key: str, columns: Mapping[str, str]) -> DataFrame:
    """Violations of column domains; ``columns`` maps column → domain name."""
    rules = [(f"{dom}({col})", DOMAINS[dom](F.col(col)), F.col(col)) for col, dom in columns.items()]
    return quarantine(df, table, key, rules)[0]


def check_constraints(df: DataFrame, table: str, key: str) -> DataFrame:
    """Violations of the row CHECK constraints declared for ``table``."""
    rules = [(name, pred(), F.lit(None).cast("string")) for name, pred in CONSTRAINTS[table]]
    return quarantine(df, table, key, rules)[0]


def check_unique(df: DataFrame, cols: list[str]) -> DataFrame:
    """Keys that occur more than once, with their count (partial aggregation first)."""
    return (df.groupBy(*cols).agg(F.count(F.lit(1)).alias("duplicate_count"))
              .where(F.col("duplicate_count") > 1))


def check_foreign_keys(child: DataFrame, parent: DataFrame, child_col: str, parent_col: str,
                       parent_filter: Column | None = None) -> DataFrame:
    """Child rows whose non-null reference has no (qualifying) parent."""
    p = parent if parent_filter is None else parent.where(parent_filter)
    p = p.select(F.col(parent_col).alias("_fk")).distinct()
    return (child.where(F.col(child_col).isNotNull())
            .join(p, F.col(child_col) == F.col("_fk"), "left_anti"))


EXISTS_MESSAGES = {
    "customer": "Customer ID does not exist: ",
    "vendor": "Vendor ID does not exist: ",
    "product": "Product ID does not exist: ",
    "warehouse": "Warehouse ID does not exist: ",
    "account": "Account ID does not exist or is inactive: ",
}


def validate_exists(keys: DataFrame, key_col: str, parent: DataFrame, parent_col: str, kind: str) -> DataFrame:
    """Per distinct requested key: is_valid and message (accounts must be active)."""
    p = parent.where(F.col("is_active")) if kind == "account" else parent
    found = p.select(F.col(parent_col).alias(key_col)).distinct().withColumn("_found", F.lit(True))
    k = keys.select(key_col).distinct().join(found, key_col, "left")
    ok = F.col("_found").isNotNull()
    return k.select(key_col, ok.alias("is_valid"),
                    F.when(ok, F.lit("")).otherwise(
                        F.concat(F.lit(EXISTS_MESSAGES[kind]), F.col(key_col).cast("string"))).alias("error_msg"))


def is_overdue_by_id(ids: DataFrame, documents: DataFrame, key: str, as_of: str) -> DataFrame:
    """Per requested ``document_id``: whether its document is overdue (NULL for an unknown id)."""
    d = documents.select(F.col(key).alias("_key"), V.is_overdue("due_date", as_of).alias("is_overdue"))
    return ids.join(d, F.col("document_id") == F.col("_key"), "left").select("document_id", "is_overdue")


def _exists_flag(df: DataFrame, col: str, parent: DataFrame, parent_col: str, flag: str) -> DataFrame:
    keys = parent.select(F.col(parent_col).alias("_k")).distinct().withColumn(flag, F.lit(True))
    return (df.join(keys, F.col(col) == F.col("_k"), "left").drop("_k")
              .withColumn(flag, F.coalesce(F.col(flag), F.lit(False))))


def validate_transaction_import(rows: DataFrame, charts: DataFrame, transactions: DataFrame, as_of: str) -> DataFrame:
    """Per row: amount < 0, future date, inactive account, missing transaction; '; '-joined."""
    r = _exists_flag(rows, "chart_id", charts.where(F.col("is_active")), "chart_id", "_chart_ok")
    r = _exists_flag(r, "transaction_id", transactions, "transaction_id", "_tx_ok")
    errs = V.errors_of([
        (F.col("amount") < 0, "Amount cannot be negative"),
        (F.col("date") > F.lit(as_of).cast("date"), "Transaction date cannot be in the future"),
        (~F.col("_chart_ok"), "Invalid chart/account ID"),
        (~F.col("_tx_ok"), "Transaction ID does not exist"),
    ])
    return r.withColumn("_e", errs).select(
        *[c for c in rows.columns], (F.size("_e") == 0).alias("is_valid"), V.joined(F.col("_e")).alias("errors"))


def validate_ar_import(rows: DataFrame, customers: DataFrame) -> DataFrame:
    """Four separate error columns (NULL = no error)."""
    r = _exists_flag(rows, "customer_id", customers, "customer_id", "_cust_ok")
    return r.select(
        *rows.columns,
        F.when(F.col("amount") <= 0, "AR amount must be positive").alias("amount_error"),
        F.when(F.col("invoice_date") > F.col("due_date"), "Invoice date cannot be after due date").alias("invoice_error"),
        F.when(~F.col("_cust_ok"), "Customer ID does not exist").alias("customer_error"),
        F.when(~F.col("status").isin(*V.AR_STATUSES), "Invalid AR status").alias("status_error"))


def validate_ap_import(rows: DataFrame, vendors: DataFrame, statuses: tuple[str, ...] = V.AP_STATUSES) -> DataFrame:
    r = _exists_flag(rows, "vendor_id", vendors, "vendor_id", "_vend_ok")
    errs = V.errors_of([
        (F.col("amount") <= 0, "AP amount must be positive"),
        (F.col("invoice_date") > F.col("due_date"), "Invoice date cannot be after due date"),
        (~F.col("_vend_ok"), "Vendor ID does not exist"),
        (~F.col("status").isin(*statuses), "Invalid AP status"),
    ])
    return r.withColumn("_e", errs).select(
        *rows.columns, (F.size("_e") == 0).alias("is_valid"), V.joined(F.col("_e")).alias("errors"))


def validate_inventory_import(rows: DataFrame, products: DataFrame, warehouses: DataFrame,
                              transactions: DataFrame) -> DataFrame:
    r = _exists_flag(rows, "product_id", products, "product_id", "_p_ok")
    r = _exists_flag(r, "warehouse_id", warehouses, "warehouse_id", "_w_ok")
    r = _exists_flag(r, "transaction_id", transactions, "transaction_id", "_t_ok")
    errs = V.errors_of([
        (F.col("quantity") <= 0, "Quantity must be greater than 0"),
        (~F.col("_p_ok"), "Product ID does not exist"),
        (~F.col("_w_ok"), "Warehouse ID does not exist"),
        (~F.col("action_type").isin(*V.ACTION_TYPES), "Invalid inventory action type"),
        (~F.col("_t_ok"), "Transaction ID does not exist"),
    ])
    return r.withColumn("_e", errs).select(
        *rows.columns, (F.size("_e") == 0).alias("is_valid"), V.joined(F.col("_e")).alias("errors"))


def validate_journal_rows(journals: DataFrame, charts: DataFrame, transactions: DataFrame) -> DataFrame:
    """Legs with a rejection reason: inactive/unknown account, then missing transaction."""
    r = _exists_flag(journals, "chart_id", charts.where(F.col("is_active")), "chart_id", "_c_ok")
    r = _exists_flag(r, "transaction_id", transactions, "transaction_id", "_t_ok")
    reason = (F.when(~F.col("_c_ok"), "Chart account is inactive or does not exist")
               .when(~F.col("_t_ok"), "Transaction does not exist"))
    return r.select(*journals.columns, reason.isNull().alias("is_valid"), reason.alias("rejection_reason"))


def validation_summary(log: DataFrame) -> DataFrame:
    """Per session: total, valid, invalid, warnings, pass rate % (2 dp; NULL when empty)."""
    total = F.count(F.lit(1))
    valid = F.count_if(F.col("is_valid"))
    return log.groupBy("session_id").agg(
        total.alias("total_rows"), valid.alias("valid_rows"),
        F.count_if(~F.col("is_valid")).alias("invalid_rows"),
        F.count_if(F.col("severity") == "WARNING").alias("warning_rows"),
        F.round(valid.cast("decimal(20,0)") * 100 / total, 2).cast("decimal(10,2)").alias("validation_pass_rate"))


def log_compliance_checks(results: DataFrame) -> DataFrame:
    """Normalised compliance rows; each must link a staging or a production record."""
    linked = F.col("staging_record_id").isNotNull() | F.col("production_record_id").isNotNull()
    return results.select(
        "client_id", F.col("rule_id").cast("int").alias("rule_id"), "session_id", "staging_record_id",
        "production_record_id", "table_name", F.upper(F.col("status")).alias("status"),
        F.coalesce(F.col("resolution_status"), F.lit("UNRESOLVED")).alias("resolution_status"),
        "checked_at", linked.alias("is_linked"))


def compliance_violations(logs: DataFrame, rules: DataFrame, client_id: int, days: int, as_of: str) -> DataFrame:
    """Non-PASS checks of one client in the last ``days``, newest first."""
    since = F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(days))
    l = logs.where((F.col("client_id") == client_id) & (F.col("status") != "PASS") & (F.col("checked_at") >= since)
                   & (F.col("checked_at") <= F.lit(as_of).cast("timestamp")))
    return (l.join(rules.select("rule_id", "rule_name", "check_type"), "rule_id", "left")
             .select("compliance_id", "rule_name", "check_type", "status", "details", "checked_at",
                     F.coalesce(F.col("resolution_status"), F.lit("UNRESOLVED")).alias("resolution_status"))
             .orderBy(F.col("checked_at").desc(), F.col("compliance_id").desc()))


def overdue_receivables(ar_ext: DataFrame, as_of: str, paid_status: str = "PAID") -> DataFrame:
    """Open receivables past due with days overdue."""
    d = F.lit(as_of).cast("date")
    return (ar_ext.where((F.col("due_date") < d) & (F.col("status") != paid_status))
                  .select("receivable_id", "amount", "due_date", F.datediff(d, F.col("due_date")).alias("days_overdue")))


AGING_BUCKETS = ("current", "days_1_30", "days_31_60", "days_61_90", "days_over_90")


def aging_report(ext: DataFrame, party_col: str, as_of: str, paid_status: str = "Paid") -> DataFrame:
    """Outstanding amount per party in Current / 1–30 / 31–60 / 61–90 / 90+ days past due."""
    d = F.datediff(F.lit(as_of).cast("date"), F.col("due_date"))
    bucket = (F.when(d <= 0, "current").when(d <= 30, "days_1_30").when(d <= 60, "days_31_60")
               .when(d <= 90, "days_61_90").otherwise("days_over_90"))
    open_ = ext.where(F.col("status") != paid_status).withColumn("_b", bucket)
    aggs = [F.sum(F.when(F.col("_b") == b, F.col("amount")).otherwise(0)).cast("decimal(18,2)").alias(b)
            for b in AGING_BUCKETS]
    aggs.append(F.sum("amount").cast("decimal(18,2)").alias("total_outstanding"))
    return open_.groupBy(party_col).agg(*aggs)
