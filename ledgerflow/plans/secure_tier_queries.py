"""Registered queries for tenant scope, masking, secure views, encryption (S) and tiering (T)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import posting, secure, tier
from ..session import ensure_checkpoint_dir
from .registry import query

AS_OF = "1999-01-01"


@query("tenant_scope_journals", "S1", views=["journals", "transactions"], money=["amount"], oracle="""
SELECT * FROM journals WHERE transaction_id IN (SELECT transaction_id FROM transactions WHERE client_id = 3)""")
def _tenant_scope_journals(b):
    return secure.tenant_scope(b.journals, 3, [(b.transactions, "transaction_id", "transaction_id")])


@query("tenant_scope_account_roles", "S1", views=["charts"], oracle="""
SELECT chart_id, role_name FROM charts WHERE role_name IS NOT NULL
  AND chart_id IN (SELECT chart_id FROM charts WHERE client_id = 2)""")
def _tenant_scope_account_roles(b):
    return secure.tenant_scope(posting.roles_of(b.charts), 2, [(b.charts, "chart_id", "chart_id")])


@query("tenant_scope_returns", "S1", views=["movements", "ar_ext", "transactions"], oracle="""
SELECT management_id, transaction_id AS document_id, quantity FROM movements
WHERE action_type = 'Sale Return' AND transaction_id IN (
  SELECT receivable_id FROM ar_ext WHERE transaction_id IN (SELECT transaction_id FROM transactions WHERE client_id = 4))""")
def _tenant_scope_returns(b):
    r = b.movements.where(F.col("action_type") == "Sale Return").select(
        "management_id", F.col("transaction_id").alias("document_id"), "quantity")
    return secure.tenant_scope(r, 4, [(b.ar_ext, "document_id", "receivable_id"),
                                      (b.transactions, "transaction_id", "transaction_id")])


def contacts(b):
    c = b.customers
    digits = F.lpad((F.col("customer_id") * 7919 % 1000000000).cast("string"), 9, "0")
    return c.select(
        "customer_id", "customer_name",
        F.concat(F.lower(F.regexp_replace("customer_name", "#", "")), F.lit("@mail.com")).alias("email"),
        F.when(F.col("customer_id") % 5 == 0, F.lit("")).otherwise((F.col("customer_id") * 7919).cast("string")).alias("phone"),
        F.concat(F.substring(digits, 1, 3), F.lit("-"), F.substring(digits, 4, 2), F.lit("-"), F.substring(digits, 6, 4))
        .alias("ssn_encrypted"))


_CONTACTS_SQL = """ct AS (SELECT customer_id, customer_name, lower(replace(customer_name, '#', '')) || '@mail.com' AS email,
       CASE WHEN customer_id % 5 = 0 THEN '' ELSE CAST(customer_id * 7919 AS VARCHAR) END AS phone,
       substring(lpad(CAST(customer_id * 7919 % 1000000000 AS VARCHAR), 9, '0'), 1, 3) || '-' ||
       substring(lpad(CAST(customer_id * 7919 % 1000000000 AS VARCHAR), 9, '0'), 4, 2) || '-' ||
       substring(lpad(CAST(customer_id * 7919 % 1000000000 AS VARCHAR), 9, '0'), 6, 4) AS ssn_encrypted FROM customers)"""


@query("mask_contacts", "S2", views=["customers"], oracle=f"""WITH {_CONTACTS_SQL}
SELECT customer_id, '***-**-' || substring(ssn_encrypted, 8, 4) AS ssn_masked,
       substring(split_part(email, '@', 1), 1, 1) || '***@' || split_part(email, '@', 2) AS email_masked,
       '***-****' || substring(phone, -4, 4) AS phone_masked FROM ct""")
def _mask_contacts(b):
    c = contacts(b)
    return c.select("customer_id", secure.mask_ssn("ssn_encrypted").alias("ssn_masked"),
                    secure.mask_email("email").alias("email_masked"), secure.mask_phone("phone").alias("phone_masked"))


@query("secure_view", "S3", views=["customers"], oracle=f"""WITH {_CONTACTS_SQL}
SELECT customer_id, customer_name, substring(split_part(email, '@', 1), 1, 1) || '***@' || split_part(email, '@', 2) AS email,
       phone, 'REDACTED' AS ssn_encrypted FROM ct""")
def _secure_view(b):
    return secure.secure_view(contacts(b), "analyst", "customers")


@query("secure_view_admin", "S3", views=["customers"], oracle=f"WITH {_CONTACTS_SQL}\nSELECT * FROM ct")
def _secure_view_admin(b):
    return secure.secure_view(contacts(b), "finance_admin", "customers")


def _vendor_contacts(b):
    k = F.col("vendor_id").cast("string")
    return b.vendors.select("vendor_id", "vendor_name", F.concat(F.lit("v"), k, F.lit("@mail.com")).alias("email"),
                            F.concat(F.lit("tax-"), k).alias("tax_id_encrypted"), F.concat(F.lit("acct-"), k).alias("bank_account_encrypted"))


@query("secure_view_vendors", "S3", views=["vendors"], oracle="""
SELECT vendor_id, vendor_name, 'v***@mail.com' AS email, 'REDACTED' AS tax_id_encrypted, 'REDACTED' AS bank_account_encrypted FROM vendors""")
def _secure_view_vendors(b):
    return secure.secure_view(_vendor_contacts(b), "analyst", "vendors")


@query("secure_view_transactions", "S3", views=["transactions"], oracle="""
SELECT transaction_id, client_id, description, 'REDACTED' AS internal_notes FROM transactions""")
def _secure_view_transactions(b):
    t = b.transactions.select("transaction_id", "client_id", "description", F.concat(F.lit("note "), F.col("transaction_id").cast("string")).alias("internal_notes"))
    return secure.secure_view(t, "analyst", "transactions")


# table -> hops to a table with client_id, as (parent, child key, parent key)
SCOPE_PATHS = {
    "customers": [], "vendors": [], "products": [], "charts": [], "transactions": [],
    "ar_ext": [("transactions", "transaction_id", "transaction_id")], "ap_ext": [("transactions", "transaction_id", "transaction_id")],
    "journals": [("transactions", "transaction_id", "transaction_id")], "tax_entries": [("transactions", "transaction_id", "transaction_id")],
    "movements": [("products", "product_id", "product_id")], "layers": [("products", "product_id", "product_id")],
    "salary_details": [("vendors", "employee_id", "vendor_id")], "statements": [("bank_accounts", "account_id", "account_id"), ("charts", "chart_id", "chart_id")],
    "bank_tx": [("bank_accounts", "account_id", "account_id"), ("charts", "chart_id", "chart_id")],
}


def scoped(b, table: str, client_id: int):
    from ..operators.bank import monthly_statements
    frame = monthly_statements(b.bank_tx) if table == "statements" else getattr(b, table)
    return secure.tenant_scope(frame, client_id, [(getattr(b, parent), child, key) for parent, child, key in SCOPE_PATHS[table]])


def _scope_sql(table: str) -> str:
    where = "client_id = c.client_id"
    for parent, child, key in reversed(SCOPE_PATHS[table]):
        where = f"{child} IN (SELECT {key} FROM {parent} WHERE {where})"
    return f"SELECT '{table}' AS table_name, c.client_id, (SELECT COUNT(*) FROM {table} WHERE {where}) AS visible_rows FROM clients c"


@query("tenant_scope_tables", "S1", views=["clients", "bank_accounts", *SCOPE_PATHS], oracle="\nUNION ALL ".join(_scope_sql(t) for t in SCOPE_PATHS))
def _tenant_scope_tables(b):
    """Rows of every tenant table that each client sees."""
    out = None
    for table in SCOPE_PATHS:
        for client in range(1, 6):
            n = scoped(b, table, client).agg(F.count(F.lit(1)).alias("visible_rows")).select(
                F.lit(table).alias("table_name"), F.lit(client).alias("client_id"), "visible_rows")
            out = n if out is None else out.unionByName(n)
    return out


@query("encrypt_roundtrip", "S4", views=["customers"], oracle="SELECT customer_id, TRUE AS round_trip_ok FROM customers")
def _encrypt_roundtrip(b):
    c = contacts(b).select("customer_id", "ssn_encrypted", "email")
    enc = secure.encrypt_columns(c, ["ssn_encrypted", "email"], "ledger-secret")
    dec = secure.decrypt_columns(enc.withColumnRenamed("customer_id", "cid"), ["ssn_encrypted", "email"], "ledger-secret")
    j = c.join(dec.select("cid", F.col("ssn_encrypted").alias("ssn_back"), F.col("email").alias("email_back")),
               F.col("customer_id") == F.col("cid"))
    return j.select("customer_id", ((F.col("ssn_encrypted") == F.col("ssn_back")) & (F.col("email") == F.col("email_back")))
                    .alias("round_trip_ok"))


def _label_m(c: str) -> str:
    return f"strftime(date_trunc('month', {c}), '%Y_%m') || '_m' || CAST(month(date_trunc('month', {c})) AS VARCHAR)"


def _label_w(c: str) -> str:
    return (f"strftime(date_trunc('week', {c}), '%Y_%m') || '_wk' || "
            f"CAST(weekofyear(CAST(date_trunc('week', {c}) AS DATE)) AS VARCHAR)")


_LABEL_M = _label_m("date")
_LABEL_W = _label_w("date")


@query("partition_label", "T2", views=["journals"], oracle=f"""
SELECT journal_id, date, {_LABEL_M} AS month_label, {_LABEL_W} AS week_label FROM journals""")
def _partition_label(b):
    return b.journals.select("journal_id", "date", tier.partition_label("date", "month").alias("month_label"),
                             tier.partition_label("date", "week").alias("week_label"))


@query("write_partitioned", "T1", views=["journals"], money=["amount"], oracle=f"""
SELECT *, {_LABEL_M} AS partition_label FROM journals""")
def _write_partitioned(b):
    path = ensure_checkpoint_dir(b.spark).rstrip("/") + f"/write_partitioned/{uuid.uuid4().hex}"
    tier.write_partitioned(b.journals, "date", path, "month")
    return b.spark.read.option("basePath", path).parquet(path)


@query("tier_partitions", "T3", views=["ar_ext"], money=["amount"], oracle=f"""
SELECT *, {_label_m('invoice_date')} AS partition_label,
       CASE WHEN date_trunc('month', invoice_date) <= date_trunc('month', DATE '{AS_OF}' - INTERVAL 30 DAY)
            THEN 'COLD' ELSE 'HOT' END AS tier FROM ar_ext""")
def _tier_partitions(b):
    return tier.tier_partitions(b.ar_ext, "invoice_date", AS_OF, "month")


@query("write_tiers", "T3", views=["ar_ext"], money=["amount"], oracle=f"""
SELECT *, {_label_m('invoice_date')} AS partition_label,
       CASE WHEN date_trunc('month', invoice_date) <= date_trunc('month', DATE '{AS_OF}' - INTERVAL 30 DAY)
            THEN 'COLD' ELSE 'HOT' END AS tier FROM ar_ext""")
def _write_tiers(b):
    base = ensure_checkpoint_dir(b.spark).rstrip("/") + f"/tiers/{uuid.uuid4().hex}"
    paths = {"HOT": f"{base}/hot", "COLD": f"{base}/cold"}
    tier.write_tiers(b.ar_ext, "invoice_date", paths["HOT"], paths["COLD"], AS_OF, "month")
    schema = tier.with_partition_label(b.ar_ext, "invoice_date").schema
    read = [b.spark.read.schema(schema).parquet(path).withColumn("tier", F.lit(t)) for t, path in paths.items()]
    return read[0].unionByName(read[1])


FIRST_RUN = "1997-03-15"


def _store(b):
    base = ensure_checkpoint_dir(b.spark).rstrip("/") + f"/tier_store/{uuid.uuid4().hex}"
    store = tier.TierStore(b.spark, base, "invoice_date", b.ar_ext.schema)
    store.load(b.ar_ext, FIRST_RUN)
    return store


@query("advance_tiers", "T3", views=["ar_ext"], money=["amount"], oracle=f"""
SELECT *, {_label_m('invoice_date')} AS partition_label,
       CASE WHEN date_trunc('month', invoice_date) <= date_trunc('month', DATE '{AS_OF}' - INTERVAL 30 DAY)
            THEN 'COLD' ELSE 'HOT' END AS tier FROM ar_ext""")
def _advance_tiers(b):
    store = _store(b)
    store.advance(AS_OF)
    return store.read()


@query("advance_tiers_moved", "T3", views=["ar_ext"], oracle=f"""
SELECT DISTINCT {_label_m('invoice_date')} AS partition_label FROM ar_ext
WHERE date_trunc('month', invoice_date) <= date_trunc('month', DATE '{AS_OF}' - INTERVAL 30 DAY)
  AND date_trunc('month', invoice_date) > date_trunc('month', DATE '{FIRST_RUN}' - INTERVAL 30 DAY)""")
def _advance_tiers_moved(b):
    return b.spark.createDataFrame([(x,) for x in _store(b).advance(AS_OF)], "partition_label string")


@query("tier_partitions_weekly", "T3", views=["ar_ext"], money=["amount"], oracle=f"""
SELECT *, {_label_w('invoice_date')} AS partition_label,
       CASE WHEN date_trunc('week', invoice_date) <= date_trunc('week', DATE '{AS_OF}' - INTERVAL 7 DAY)
            THEN 'COLD' ELSE 'HOT' END AS tier FROM ar_ext""")
def _tier_partitions_weekly(b):
    return tier.tier_partitions(b.ar_ext, "invoice_date", AS_OF, "week")


@query("archive_split", "T4", views=["ar_ext"], money=["amount"], oracle=f"""
SELECT * FROM ar_ext WHERE invoice_date < CAST(DATE '{AS_OF}' - INTERVAL 12 MONTH AS DATE)""")
def _archive_split(b):
    return tier.archive_split(b.ar_ext, "invoice_date", AS_OF, 12)[0]
