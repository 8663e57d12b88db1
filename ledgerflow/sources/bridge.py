"""Bridge views: the driver's TPC-H-like tables re-shaped into the ledger model.

Each property is a lazily built DataFrame.  The definitions mirror the SQL in
``ledgerflow.plans.oracle_views`` (which DuckDB runs for the parity check);
injected defects are deterministic so the reconciliation reports have
something to find.  Small literal tables (accounts, legs, components) have a
fixed row count and are the only ones broadcast by hint; everything else is
left to AQE, which broadcasts at runtime only under the size threshold.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ids import with_sequence_id
from .driver import read_table

# Chart of accounts per client (k, account, type, role_name).
ACCOUNTS = [
    (1, "Cash on Hand", "Asset", "cash_account_ar"),
    (2, "Cash in Bank", "Asset", "cash_account_ap"),
    (3, "Accounts Receivable", "Asset", "ar_account"),
    (4, "Accounts Payable", "Liability", "ap_account"),
    (5, "Sales Revenue", "Revenue", "revenue_account"),
    (6, "Cost of Goods Sold", "Expense", "COGS"),
    (7, "Inventory", "Asset", "inventory_account"),
    (8, "Output Tax Payable", "Liability", "output_vat_payable"),
    (9, "Inventory Expense", "Expense", "expense_account"),
    (10, "Owner Capital", "Equity", None),
]

# Journal legs per order status (leg, st, k, journal).
LEGS = [
    (0, "O", 3, True), (1, "O", 5, False),
    (2, "F", 3, True), (3, "F", 5, False), (4, "F", 1, True), (5, "F", 3, False),
    (6, "P", 9, True), (7, "P", 4, False),
]

# Payroll components (component_id, component_name, component_type).
COMPONENTS = [
    (1, "Basic Salary", "SALARY"),
    (2, "Rice Allowance", "ALLOWANCE"),
    (3, "Annual Bonus", "BONUS"),
    (4, "Loan Deduction", "DEDUCTION"),
    (5, "Withholding Tax", "TAX"),
    (6, "Statutory Contribution", "STATUTORY"),
    (7, "Employee Assistance", "BENEFIT"),
]

# Chart-of-accounts template 1 (template_id, account_code, account_name, account_type):
# the ten accounts every bridge client starts with plus five the postings need.
COA_TEMPLATE = [(1, 1000 + k, name, typ) for k, name, typ, _role in ACCOUNTS] + [
    (1, 1011, "Input Tax Receivable", "Asset"),
    (1, 1012, "Sales Returns and Allowances", "Contra Revenue"),
    (1, 1013, "Purchase Returns and Allowances", "Contra Expense"),
    (1, 1014, "Salary Expense", "Expense"),
    (1, 1015, "Salary Payable", "Liability"),
]

# Role assignment by account-name prefix (prefix, role).
ROLE_PREFIXES = [
    ("Input Tax", "input_vat_receivable"),
    ("Sales Returns", "SR&Allowances"),
    ("Purchase Returns", "PR&Allowances"),
    ("Salary Expense", "salary_expense"),
    ("Salary Payable", "salary_payable"),
]

# Bank accounts (account_id, account_number, bank_name, chart_id); each is the
# cash-on-hand chart of the client with the same id.
BANK_ACCOUNTS = [(1, "ACCT-0001", "Bank One", 101), (2, "ACCT-0002", "Bank Two", 201), (3, "ACCT-0003", "Bank Three", 301),
                 (4, "ACCT-0004", "Bank Four", 401), (5, "ACCT-0005", "Bank Five", 501)]

LINEITEM_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate"]

MONEY = T.DecimalType(15, 2)

ACCOUNT_FIELDS = (("k", "int"), ("account", "string"), ("type", "string"), ("role_name", "string"))


def _literal_array(rows, fields) -> F.Column:
    """A fixed table as an array<struct> literal, for ``inline`` (bounded size)."""
    return F.array(*[
        F.struct(*[F.lit(v).cast(t).alias(n) for v, (n, t) in zip(row, fields)]) for row in rows])


def _money(c) -> F.Column:
    return c.cast(MONEY)


class Bridge:
    """All bridge views over one driver scale directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def raw(self, name: str) -> DataFrame:
        return read_table(self.spark, self.sf_dir, name)

    # ---- tenancy and parties -------------------------------------------------
    @cached_property
    def clients(self) -> DataFrame:
        return self.raw("region").select(
            (F.col("r_regionkey") + 1).cast("int").alias("client_id"), F.col("r_name").alias("client_name"))

    @cached_property
    def _nation_client(self) -> DataFrame:
        return self.raw("nation").select("n_nationkey", (F.col("n_regionkey") + 1).cast("int").alias("client_id"))

    @cached_property
    def customers(self) -> DataFrame:
        c = self.raw("customer")
        return c.join(self._nation_client, c.c_nationkey == F.col("n_nationkey")).select(
            F.col("c_custkey").alias("customer_id"), "client_id", F.col("c_name").alias("customer_name"))

    @cached_property
    def vendors(self) -> DataFrame:
        s = self.raw("supplier")
        return s.join(self._nation_client, s.s_nationkey == F.col("n_nationkey")).select(
            F.col("s_suppkey").alias("vendor_id"), "client_id", F.col("s_name").alias("vendor_name"))

    @cached_property
    def products(self) -> DataFrame:
        return self.raw("part").select(
            F.col("p_partkey").alias("product_id"),
            (F.col("p_partkey") % 5 + 1).cast("int").alias("client_id"),
            F.col("p_name").alias("product_name"),
            _money(F.col("p_retailprice")).alias("product_price"))

    @cached_property
    def accounts(self) -> DataFrame:
        return self.spark.createDataFrame(ACCOUNTS, "k int, account string, type string, role_name string")

    @cached_property
    def coa_template(self) -> DataFrame:
        return self.spark.createDataFrame(
            COA_TEMPLATE, "template_id int, account_code int, account_name string, account_type string")

    @cached_property
    def client_templates(self) -> DataFrame:
        """Every bridge client uses chart template 1."""
        # a data column (not a folded literal) so the template copy stays an equi join
        return self.clients.select("client_id", F.when(F.col("client_id").isNotNull(), F.lit(1)).alias("template_id"))

    @cached_property
    def charts(self) -> DataFrame:
        # every client gets the fixed account list: a generator over a literal array, no join
        return self.clients.select("client_id", F.inline(_literal_array(ACCOUNTS, ACCOUNT_FIELDS))).select(
            (F.col("client_id") * 100 + F.col("k")).cast("int").alias("chart_id"),
            "client_id", "account",
            (F.lit(1000) + F.col("k")).cast("int").alias("account_code"),
            "type", "role_name", F.lit(True).alias("is_active"))

    # ---- ledger ----------------------------------------------------------------
    @cached_property
    def transactions(self) -> DataFrame:
        o = self.raw("orders")
        key = F.col("o_orderkey")
        return o.join(self.customers, o.o_custkey == F.col("customer_id")).select(
            key.alias("transaction_id"), "client_id",
            F.concat(F.lit("ORD-"), key.cast("string")).alias("idempotency_key"),
            F.when(key % 89 == 0, F.lit(None).cast("string"))
             .otherwise(F.concat(F.lit("Order "), key.cast("string"))).alias("description"),
            F.col("o_orderdate").cast("date").alias("date"),
            F.col("o_orderstatus").alias("st"),
            _money(F.col("o_totalprice")).alias("total"))

    @cached_property
    def legs(self) -> DataFrame:
        return self.spark.createDataFrame(LEGS, "leg int, st string, k int, journal boolean")

    @cached_property
    def journals(self) -> DataFrame:
        t = self.transactions
        bump = F.when(~F.col("journal") & (F.col("transaction_id") % 97 == 0), 1).otherwise(0)
        return t.join(F.broadcast(self.legs), "st").select(
            (F.col("transaction_id") * 8 + F.col("leg")).alias("journal_id"),
            "transaction_id",
            (F.col("client_id") * 100 + F.col("k")).cast("int").alias("chart_id"),
            "date", "journal",
            _money(F.col("total") + bump).alias("amount"))

    # ---- AR / AP ---------------------------------------------------------------
    @cached_property
    def ar_ext(self) -> DataFrame:
        o = self.raw("orders").where(F.col("o_orderstatus").isin("O", "F"))
        key = F.col("o_orderkey")
        inv = F.col("o_orderdate").cast("date")
        return o.select(
            key.alias("receivable_id"), key.alias("transaction_id"), F.col("o_custkey").alias("customer_id"),
            _money(F.col("o_totalprice") + F.when(key % 101 == 0, 5).otherwise(0)).alias("amount"),
            inv.alias("invoice_date"), F.date_add(inv, 30).alias("due_date"),
            F.when(F.col("o_orderstatus") == "F", "Paid").when(key % 3 == 0, "Partially Paid")
             .otherwise("Pending").alias("status"))

    @cached_property
    def ap_ext(self) -> DataFrame:
        o = self.raw("orders").where(F.col("o_orderstatus") == "P")
        l = self.raw("lineitem").select("l_orderkey", "l_suppkey")
        g = o.join(l, l.l_orderkey == o.o_orderkey).groupBy("o_orderkey").agg(
            F.min("l_suppkey").alias("vendor_id"), F.min("o_totalprice").alias("tp"),
            F.min("o_orderdate").alias("od"))
        key = F.col("o_orderkey")
        inv = F.col("od").cast("date")
        return g.select(
            key.alias("payable_id"), key.alias("transaction_id"), "vendor_id",
            _money(F.col("tp") + F.when(key % 103 == 0, 5).otherwise(0)).alias("amount"),
            inv.alias("invoice_date"), F.date_add(inv, 30).alias("due_date"),
            F.when(key % 4 == 0, "Paid").otherwise("Pending").alias("status"))

    # ---- inventory and tax (lineitem grain) -------------------------------------
    @cached_property
    def _lineitem_numbered(self) -> DataFrame:
        li = self.raw("lineitem")
        return with_sequence_id(li, LINEITEM_KEY, "line_no")

    @cached_property
    def movements(self) -> DataFrame:
        li = self._lineitem_numbered
        return li.select(
            F.col("line_no").alias("management_id"),
            F.col("l_partkey").alias("product_id"),
            (F.col("l_suppkey") % 3 + 1).cast("int").alias("warehouse_id"),
            F.col("l_orderkey").alias("transaction_id"),
            F.when(F.col("l_returnflag") == "A", "Purchase").when(F.col("l_returnflag") == "N", "Sale")
             .when(F.col("l_linestatus") == "F", "Sale Return").otherwise("Purchase Return").alias("action_type"),
            F.col("l_quantity").cast("long").alias("quantity"),
            F.col("l_shipdate").cast("date").alias("movement_date"),
            F.floor(F.col("l_extendedprice") * 100 / F.col("l_quantity")).cast("long").alias("unit_cost_cents"))

    @cached_property
    def layers(self) -> DataFrame:
        return self.movements.where(F.col("action_type") == "Purchase").select(
            F.col("management_id").alias("operation_id"), "product_id", "quantity", "unit_cost_cents",
            F.col("movement_date").alias("purchase_date"))

    @cached_property
    def tax_entries(self) -> DataFrame:
        li = self._lineitem_numbered
        return li.select(
            F.col("line_no").alias("tax_entry_id"),
            F.col("l_orderkey").alias("transaction_id"),
            F.when(F.col("l_linestatus") == "F", "VAT_OUTPUT").otherwise("VAT_INPUT").alias("tax_type"),
            F.floor(F.col("l_extendedprice") * F.col("l_tax") * 100).cast("long").alias("tax_cents"))

    @cached_property
    def tax_legs(self) -> DataFrame:
        return self.tax_entries.groupBy("transaction_id").agg(
            (F.sum("tax_cents") + F.when(F.col("transaction_id") % 83 == 0, 1).otherwise(0))
            .cast("long").alias("amount_cents")).withColumn("account", F.lit("Output Tax Payable"))

    # ---- bank ------------------------------------------------------------------
    @cached_property
    def bank_accounts(self) -> DataFrame:
        return self.spark.createDataFrame(BANK_ACCOUNTS, "account_id int, account_number string, bank_name string, chart_id int")

    @cached_property
    def bank_tx(self) -> DataFrame:
        o = self.raw("orders")
        key = F.col("o_orderkey")
        return o.where((F.col("o_orderstatus") == "F") & (key % 7 != 0)).select(
            key.alias("bank_trans_id"), (F.floor(key / 8) % 5 + 1).cast("int").alias("account_id"),
            F.date_add(F.col("o_orderdate").cast("date"), 2).alias("transaction_date"),
            F.when(key % 5 == 0, "DEBIT").otherwise("CREDIT").alias("transaction_type"),
            _money(F.col("o_totalprice")).alias("amount"))

    # ---- events, staging, ops logs --------------------------------------------
    @cached_property
    def event_log(self) -> DataFrame:
        e = self.raw("events")
        et = F.col("event_type")
        return e.select(
            "event_id",
            F.when(et == "purchase", "PURCHASE").when(et == "click", "SALE").when(et == "view", "RECEIVABLE")
             .when(et == "signup", "PAYABLE").otherwise("UNKNOWN").alias("event_type"),
            F.col("ts").alias("created_at"),
            F.concat(F.lit("ev-"), F.col("user_id").cast("string"), F.lit("-"), F.col("props")).alias("idempotency_key"),
            "user_id", _money(F.col("value")).alias("amount"), F.col("props").alias("payload"))

    @cached_property
    def stg_ar_imports(self) -> DataFrame:
        o = self.raw("orders")
        key = F.col("o_orderkey")
        inv = F.col("o_orderdate").cast("date")
        return o.select(
            key.alias("id"),
            F.when(key % 61 == 0, "x").otherwise(F.col("o_custkey").cast("string")).alias("customer_code"),
            F.when(key % 67 == 0, "99").otherwise("1").alias("client_code"),
            F.when(key % 53 == 0, "12,5").when(key % 71 == 0, F.lit(None).cast("string"))
             .otherwise(_money(F.col("o_totalprice")).cast("string")).alias("amount"),
            inv.cast("string").alias("invoice_date"),
            F.when(key % 59 == 0, "2026-02-30").when(key % 73 == 0, "1990-01-01")
             .otherwise(F.date_add(inv, 30).cast("string")).alias("due_date"),
            F.when(key % 79 == 0, "Open").when(F.col("o_orderstatus") == "F", "Paid").otherwise("Pending").alias("status"))

    @cached_property
    def metrics(self) -> DataFrame:
        e = self.raw("events")
        return e.select(
            F.col("event_id").alias("metric_id"), F.col("ts").alias("metric_timestamp"),
            F.col("event_type").alias("metric_name"), _money(F.col("value")).alias("metric_value"),
            F.when(F.col("value") > 200, "ALERT").when(F.col("value") > 100, "WARNING").otherwise("HEALTHY").alias("status"))

    @cached_property
    def access_log(self) -> DataFrame:
        e = self.raw("events")
        return e.select(
            F.col("event_id").alias("access_id"),
            F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("user_name"),
            F.col("ts").alias("login_time"),
            F.when(F.col("event_type") == "error", "FAILED").otherwise("SUCCESS").alias("status"))

    # ---- payroll ---------------------------------------------------------------
    @cached_property
    def components(self) -> DataFrame:
        return self.spark.createDataFrame(COMPONENTS, "component_id int, component_name string, component_type string")

    @cached_property
    def salary_details(self) -> DataFrame:
        s = self.raw("supplier").select("s_suppkey")
        cid = F.col("component_id")
        sk = F.col("s_suppkey")
        ids = F.array(*[F.lit(c[0]) for c in COMPONENTS])
        return s.select("s_suppkey", F.explode(ids).alias("component_id")).select(
            sk.alias("employee_id"), cid,
            F.when(cid == 1, F.lit(20000) + sk % 50 * 100).otherwise(cid * 100 + sk % 10).cast(MONEY).alias("amount"),
            F.lit("1995-01-01").cast("date").alias("effective_date"),
            F.when((sk + cid) % 11 == 0, F.lit("2024-12-31").cast("date")).alias("end_date"))


_CACHE: dict[tuple[str, str], Bridge] = {}


def bridge(spark: SparkSession, sf_dir: str) -> Bridge:
    """One Bridge per (application, directory) so fixture ids are numbered once."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _CACHE:
        _CACHE[key] = Bridge(spark, sf_dir)
    return _CACHE[key]


def forget() -> None:
    """Drop all bridges, so that the next query builds its inputs from the tables again."""
    _CACHE.clear()
