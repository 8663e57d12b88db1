"""P — rule-driven journal posting.

One rule table (kind → ordered legs of role, side, amount field) drives every
posting.  Legs are generated per event with ``inline`` over the kind's literal
leg array (no join); chart ids come from the (client, role) map, which has one
row per tenant and role.  As in the reference, an event whose roles do not all
resolve posts nothing and is reported.  Requests are de-duplicated on their
idempotency key against the existing ledger and within the batch (first
request wins) with a partial aggregation, not a window over the key, so one
hot key never lands whole in a task.  New ids are ``max(existing) + position``
from the distributed ``with_sequence_id``.  Money inside is integer cents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import with_sequence_id
from ..functions.money import MONEY

# Legs per posting kind, in leg order (role, is_debit, amount field).
POSTING_RULES: dict[str, list[tuple[str, bool, str]]] = {
    "AR": [("cash_account_ar", False, "amount"), ("ar_account", True, "amount")],
    "AP": [("cash_account_ap", True, "amount"), ("ap_account", False, "amount")],
    "EXPENSE": [("cash_account_ar", True, "amount"), ("expense_account", False, "amount")],
    "REVENUE": [("cash_account_ar", False, "amount"), ("revenue_account", True, "amount")],
    "PURCHASE": [("inventory_account", True, "net"), ("input_vat_receivable", True, "tax"),
                 ("ap_account", False, "gross")],
    "SALE": [("ar_account", True, "gross"), ("revenue_account", False, "net"), ("output_vat_payable", False, "tax"),
             ("COGS", True, "cost"), ("inventory_account", False, "cost")],
    "SALE_RETURN": [("SR&Allowances", False, "value"), ("ar_account", True, "value"),
                    ("inventory_account", False, "cost"), ("COGS", True, "cost")],
    "PURCHASE_RETURN": [("ap_account", True, "cost"), ("inventory_account", False, "cost"),
                        ("PR&Allowances", False, "cost")],
    "TRANSFER": [("inventory_account", True, "cost"), ("inventory_account", False, "cost")],
    "PAYROLL": [("salary_expense", True, "amount"), ("salary_payable", False, "amount")],
}

# standard=True: expense and revenue on their usual sides (the literal rules reverse them)
STANDARD_RULES = {
    **POSTING_RULES,
    "EXPENSE": [("expense_account", True, "amount"), ("cash_account_ar", False, "amount")],
    "REVENUE": [("cash_account_ar", True, "amount"), ("revenue_account", False, "amount")],
}

NO_KEY = "Idempotency key is required"
NO_AMOUNT = "Invalid Amount: Must not be null"
NEGATIVE_AMOUNT = "Invalid Amount: Must be positive"

AMOUNT_FIELDS = ("amount", "net", "tax", "gross", "cost", "value")


def _rules_column(rules: dict) -> Column:
    """kind → array<struct<leg_no, role, is_debit, field>> as a literal map (fixed size)."""
    entries = []
    for kind, legs in rules.items():
        arr = F.array(*[F.struct(F.lit(i).alias("leg_no"), F.lit(r).alias("role"), F.lit(d).alias("is_debit"),
                                 F.lit(f).alias("field")) for i, (r, d, f) in enumerate(legs)])
        entries += [F.lit(kind), arr]
    return F.create_map(*entries)


def resolve_account_role(charts: DataFrame, roles: DataFrame) -> DataFrame:
    """(client_id, role_name) → the lowest active chart_id holding that role."""
    active = charts.where(F.col("is_active")).select("chart_id", "client_id")
    return (roles.select("chart_id", "role_name").join(active, "chart_id")
            .groupBy("client_id", "role_name").agg(F.min("chart_id").alias("chart_id")))


def roles_of(charts: DataFrame) -> DataFrame:
    """account_roles rows from a chart of accounts carrying a role_name column."""
    return charts.where(F.col("role_name").isNotNull()).select("chart_id", "role_name")


def _with_complete(events: DataFrame, role_map: DataFrame, rules: dict) -> DataFrame:
    """Events with ``_complete``: their client has every role of their kind (else null)."""
    rules_df = events.sparkSession.createDataFrame(
        [(k, i, r) for k, legs in rules.items() for i, (r, _d, _f) in enumerate(legs)],
        "kind string, leg_no int, role_name string")
    n_legs = rules_df.groupBy("kind").agg(F.count(F.lit(1)).alias("_n"))
    complete = (rules_df.join(role_map, "role_name").groupBy("client_id", "kind").agg(F.count(F.lit(1)).alias("_n"))
                .join(n_legs, ["kind", "_n"]).select("client_id", "kind", F.lit(True).alias("_complete")))
    return events.join(complete, ["client_id", "kind"], "left")


def _rejected(ev: DataFrame, role_map: DataFrame, rules: dict, key: str) -> DataFrame:
    """(key, error) of events that cannot be posted: a role is missing, or the kind has no rule."""
    bad = ev.where(F.col("_complete").isNull())
    missing = (bad.select(key, "client_id", F.inline(_rules_column(rules)[F.col("kind")]))
               .join(role_map.withColumnRenamed("role_name", "role"), ["client_id", "role"], "left_anti")
               .groupBy(key, "client_id").agg(F.min(F.struct("leg_no", "role")).alias("_first")))
    rejected = missing.select(key, F.format_string("Account role %s not found for client %s",
                                                   F.col("_first.role"), F.col("client_id")).alias("error"))
    unknown = bad.where(~F.col("kind").isin(*rules.keys()) | F.col("kind").isNull()).select(
        key, F.lit("Unsupported action type").alias("error"))
    return rejected.unionByName(unknown)


def rejected_events(events: DataFrame, role_map: DataFrame, rules: dict = POSTING_RULES, key: str = "transaction_id") -> DataFrame:
    """What ``post_journals`` rejects, for events (key, kind, client_id) without amounts."""
    return _rejected(_with_complete(events, role_map, rules), role_map, rules, key)


def post_journals(events: DataFrame, role_map: DataFrame, rules: dict = POSTING_RULES,
                  key: str = "transaction_id") -> tuple[DataFrame, DataFrame]:
    """Expand events (key, kind, client_id, date, amount fields in cents) into legs.

    Returns (legs: key, leg_no, chart_id, date, journal, amount; rejected: key, error).
    """
    ev = _with_complete(events, role_map, rules)
    fields = [f for f in AMOUNT_FIELDS if f in events.columns]
    amounts = F.create_map(*[x for f in fields for x in (F.lit(f), F.col(f).cast("long"))])
    ok = ev.where(F.col("_complete"))
    legs = (ok.select(key, "client_id", "date", amounts.alias("_amt"), F.inline(_rules_column(rules)[F.col("kind")]))
            .join(role_map.withColumnRenamed("role_name", "role"), ["client_id", "role"])
            .select(key, "leg_no", "chart_id", "date", F.col("is_debit").alias("journal"),
                    (F.col("_amt")[F.col("field")].cast("decimal(20,0)") / 100).cast(MONEY).alias("amount")))
    return legs, _rejected(ev, role_map, rules, key)


def dedupe_idempotent(requests: DataFrame, existing: DataFrame, key: str = "idempotency_key",
                      order: str | list[str] = "request_id", existing_id: str = "transaction_id") -> dict[str, DataFrame]:
    """First request per key wins; keys already in ``existing`` and later repeats are duplicates.

    Returns {"fresh": winners, "duplicates": request rows + duplicate_of (existing id, or the
    winning request for in-batch repeats), "rejected": requests without a key, with the reason}.
    Every request is in exactly one of the three.  ``order`` is the request's id, or columns that end with it.
    """
    rejected = requests.where(F.col(key).isNull()).withColumn("error", F.lit(NO_KEY))
    requests = requests.where(F.col(key).isNotNull())
    place = F.col(order) if isinstance(order, str) else F.struct(*order)
    winners = requests.groupBy(key).agg(F.min(place).alias("_win"))
    tagged = requests.join(winners, key).withColumn("_first", place == F.col("_win"))
    if not isinstance(order, str):
        tagged = tagged.withColumn("_win", F.col("_win")[order[-1]])
    # a key that the ledger holds more than once still answers once, with its first id
    ex = existing.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_k")).agg(F.min(existing_id).alias("_existing"))
    tagged = tagged.join(ex, F.col(key) == F.col("_k"), "left").drop("_k")
    fresh = tagged.where(F.col("_first") & F.col("_existing").isNull()).drop("_win", "_first", "_existing")
    dup = tagged.where(~F.col("_first") | F.col("_existing").isNotNull()).select(
        *requests.columns,
        F.when(F.col("_existing").isNotNull(), F.lit("EXISTING")).otherwise(F.lit("BATCH")).alias("duplicate_source"),
        F.coalesce(F.col("_existing"), F.col("_win")).alias("duplicate_of"))
    return {"fresh": fresh, "duplicates": dup, "rejected": rejected}


def assign_ids(df: DataFrame, existing: DataFrame, existing_col: str, order: list[str], name: str) -> DataFrame:
    """``name`` = max(existing id) + 1-based position in ``order`` (distributed numbering)."""
    top = existing.agg(F.max(existing_col)).first()[0] or 0
    return with_sequence_id(df, order, name, start=int(top) + 1)


# ---- documents: AR / AP / expense / revenue ------------------------------------------

_DOC_LABEL = {"AR": "Account Receivable", "AP": "Account Payable"}
_DOC_ROLES = {"AR": ("cash_account_ar", "ar_account"), "AP": ("cash_account_ap", "ap_account"),
              "EXPENSE": ("cash", "expense"), "REVENUE": ("cash", "revenue")}


def _compliance(df: DataFrame, rule_name: str, description: str, check_type: str, details: Column) -> DataFrame:
    return df.select("request_id", "client_id", F.lit(rule_name).alias("compliance_rule"),
                     F.lit(description).alias("description"), F.lit(check_type).alias("check_type"),
                     F.lit("FAIL").alias("status"), details.alias("details"))


def post_document(requests: DataFrame, kind: str, clients: DataFrame, parties: DataFrame | None,
                  party_col: str | None, role_map: DataFrame, existing_tx: DataFrame | None,
                  standard: bool = False, checks_only: bool = False) -> dict[str, DataFrame]:
    """Post AR / AP / EXPENSE / REVENUE requests.

    Without ``existing_tx`` the requests are known to be new and keep their request ids as
    transaction ids: nothing is numbered and no key is looked up.

    ``checks_only`` returns compliance and rejected rows without numbering (and so without
    running a job while the plan is built).

    ``requests``: request_id, client_id, [party], amount (money), date columns
    (invoice_date + due_date + status for AR/AP; date + description otherwise),
    idempotency_key.  Checks run in the reference's order (client, party, accounts,
    amount, dates) and the first failure rejects the request; failures other than
    the account check are logged as compliance rows; then duplicates are skipped.
    """
    rules = STANDARD_RULES if standard else POSTING_RULES
    cli = clients.select(F.col("client_id").alias("_c")).distinct().withColumn("_client_ok", F.lit(True))
    r = requests.join(cli, F.col("client_id") == F.col("_c"), "left").drop("_c")
    if parties is not None:
        p = parties.select(F.col(party_col).alias("_p")).distinct().withColumn("_party_ok", F.lit(True))
        r = r.join(p, F.col(party_col) == F.col("_p"), "left").drop("_p")
    else:
        r = r.withColumn("_party_ok", F.lit(True))
    need = [role for role, _d, _f in rules[kind]]
    have = (role_map.where(F.col("role_name").isin(*need)).groupBy(F.col("client_id").alias("_rc"))
            .agg(F.count_distinct("role_name").alias("_nr")))
    r = r.join(have, F.col("client_id") == F.col("_rc"), "left").drop("_rc")
    accounts_ok = F.coalesce(F.col("_nr"), F.lit(0)) == len(set(need))
    is_doc = kind in ("AR", "AP")
    date_col = "invoice_date" if is_doc else "date"
    dates_bad = (F.col("invoice_date") > F.col("due_date")) if is_doc else F.lit(False)
    cname = "Customer" if kind == "AR" else "Vendor"
    roles_txt = "/".join(_DOC_ROLES[kind])
    reason = (F.when(F.col("_client_ok").isNull(), F.lit("Client not found!"))
               .when(F.col("_party_ok").isNull(), F.lit(f"{cname} not found!"))
               .when(~accounts_ok, F.format_string(f"Required accounts ({roles_txt}) not found for client %s",
                                                   F.col("client_id")))
               .when(F.col("amount").isNull(), F.lit(NO_AMOUNT))
               .when(F.col("amount") < 0, F.lit(NEGATIVE_AMOUNT))
               .when(F.coalesce(dates_bad, F.lit(False)), F.lit("Due Date must be after Invoice Date")))
    r = r.withColumn("_reason", reason)
    failed = r.where(F.col("_reason").isNotNull())
    comp = [
        _compliance(failed.where(F.col("_client_ok").isNull()), "Client Rules", "Client not found!",
                    "CLIENT_CHECK", F.lit("Client ID not found in database")),
        _compliance(failed.where(F.col("_client_ok").isNotNull() & F.col("_party_ok").isNull()),
                    f"{cname} Rules", f"{cname} not found!", f"{cname.upper()}_CHECK",
                    F.lit(f"{cname} ID not found in database")),
        _compliance(failed.where(F.col("_reason").isin(NO_AMOUNT, NEGATIVE_AMOUNT)), "Amounts Rule",
                    "Positive Amount Only!", "AMOUNT_CHECK",
                    F.concat(F.lit("Amount is "), F.coalesce(F.col("amount").cast("string"), F.lit("NULL")))),
    ]
    if is_doc:
        comp.append(_compliance(failed.where(F.col("_reason") == "Due Date must be after Invoice Date"), "Dates Rule",
                                "Due date must be after invoice date", "DATE_CHECK",
                                F.format_string("Invoice: %s, Due: %s", F.col("invoice_date"), F.col("due_date"))))
    passed = r.where(F.col("_reason").isNull()).select(*requests.columns)
    if existing_tx is None:
        none = passed.where(F.lit(False))
        d = {"fresh": passed, "rejected": none.withColumn("error", F.lit(NO_KEY)),
             "duplicates": none.withColumns({"duplicate_source": F.lit("BATCH"), "duplicate_of": F.lit(0)})}
    else:
        d = dedupe_idempotent(passed, existing_tx)
    dups = d["duplicates"]
    comp.append(dups.select("request_id", "client_id", F.lit("Duplicate Rules").alias("compliance_rule"),
                            F.lit("Duplicate Transaction Detected").alias("description"),
                            F.lit("DUPLICATE_CHECK").alias("check_type"), F.lit("FAIL").alias("status"),
                            F.format_string("Duplicate %s: %s", F.when(F.col("duplicate_source") == "EXISTING",
                                                                       F.lit("Transaction ID"))
                                            .otherwise(F.lit("Request ID")), F.col("duplicate_of")).alias("details")))
    compliance = comp[0]
    for c in comp[1:]:
        compliance = compliance.unionByName(c)

    rejected = (failed.select("request_id", F.col("_reason").alias("error"))
                .unionByName(dups.select("request_id", F.lit("Duplicate Transaction Detected").alias("error")))
                .unionByName(d["rejected"].select("request_id", "error")))
    if checks_only:
        return {"compliance": compliance, "rejected": rejected}
    if existing_tx is None:
        fresh = d["fresh"].withColumn("transaction_id", F.col("request_id").cast("long"))
    else:
        fresh = assign_ids(d["fresh"], existing_tx, "transaction_id", ["request_id"], "transaction_id")
    if is_doc:
        desc = F.concat(F.lit(f"{_DOC_LABEL[kind]} With Amount of "), F.col("amount").cast("string"),
                        F.lit(" Due Date on "), F.col("due_date").cast("string"), F.lit(" Status "), F.col("status"))
    else:
        desc = F.col("description")
    transactions = fresh.select("transaction_id", "client_id", "idempotency_key", desc.alias("description"),
                                F.col(date_col).alias("date"), "request_id")
    events = fresh.select("transaction_id", "client_id", F.lit(kind).alias("kind"), F.col(date_col).alias("date"),
                          (F.col("amount") * 100).cast("long").alias("amount"))
    legs, leg_rejects = post_journals(events, role_map, rules)
    out = {"transactions": transactions, "journals": legs, "compliance": compliance,
           "rejected": rejected, "leg_rejects": leg_rejects, "events": events}
    if is_doc:
        party = "customer_id" if kind == "AR" else "vendor_id"
        doc_id = "receivable_id" if kind == "AR" else "payable_id"
        out["documents"] = fresh.select(F.col("transaction_id").alias(doc_id), "transaction_id", party)
        out["extensions"] = fresh.select(F.col("transaction_id").alias(doc_id), "amount", "due_date",
                                         "invoice_date", "status")
        label = "Account Receivables" if kind == "AR" else "Account Payables"
        out["lifecycle"] = fresh.select("transaction_id", "client_id", F.lit(None).cast("string").alias("previous_state"),
                                        F.lit("DRAFT").alias("new_state"), F.lit("For Validation").alias("reason"),
                                        F.lit(f"{label} successful draft!").alias("notes"))
    return out


def post_ar(requests, clients, customers, role_map, existing_tx, checks_only: bool = False):
    return post_document(requests, "AR", clients, customers, "customer_id", role_map, existing_tx, checks_only=checks_only)


def post_ap(requests, clients, vendors, role_map, existing_tx):
    return post_document(requests, "AP", clients, vendors, "vendor_id", role_map, existing_tx)


def post_expense(requests, clients, role_map, existing_tx, standard: bool = False):
    return post_document(requests, "EXPENSE", clients, None, None, role_map, existing_tx, standard)


def post_revenue(requests, clients, role_map, existing_tx, standard: bool = False):
    return post_document(requests, "REVENUE", clients, None, None, role_map, existing_tx, standard)


# ---- inventory postings -------------------------------------------------------------

def _tax_cents(net: Column, rate_bp: int) -> Column:
    """round-half-up(net × rate) in cents, integer arithmetic only (rate in basis points)."""
    return F.floor((net * F.lit(rate_bp) + F.lit(5000)).cast("decimal(38,0)") / F.lit(10000)).cast("long")


def purchase_events(requests: DataFrame, vat_rate_bp: int = 1200) -> DataFrame:
    """Purchases with their posting kind and amounts."""
    return (requests.withColumn("net", F.col("quantity") * F.col("unit_cost_cents")).withColumn("tax", _tax_cents(F.col("net"), vat_rate_bp))
            .withColumn("gross", F.col("net") + F.col("tax")).withColumn("kind", F.lit("PURCHASE")))


def sale_events(sales: DataFrame, slices: DataFrame, vat_rate_bp: int = 1200) -> DataFrame:
    """One posting event per slice of a sale that is met in full; a slice knows what its sale gets."""
    return (slices.withColumnRenamed("sale_id", "transaction_id").drop("product_id")
            .join(sales.select("transaction_id", "client_id", "date", "unit_price_cents", "quantity"), "transaction_id")
            .where(F.col("sale_units") >= F.col("quantity"))
            .withColumn("net", F.col("units") * F.col("unit_price_cents"))
            .withColumn("tax", _tax_cents(F.col("net"), vat_rate_bp))
            .withColumn("gross", F.col("net") + F.col("tax"))
            .withColumn("cost", F.col("units") * F.col("unit_cost_cents")).withColumn("kind", F.lit("SALE")))


def return_events(returns: DataFrame) -> DataFrame:
    """Returns with their posting kind and amounts."""
    kind = (F.when(F.col("action_type") == "Sale Return", "SALE_RETURN")
             .when(F.col("action_type") == "Purchase Return", "PURCHASE_RETURN"))
    return (returns.withColumn("kind", kind).withColumn("value", F.col("quantity") * F.col("unit_price_cents"))
            .withColumn("cost", F.col("quantity") * F.col("unit_cost_cents")))


def as_events(rows: DataFrame, key: str = "transaction_id") -> DataFrame:
    """The columns that ``post_journals`` reads, with null for the amounts that a kind has not, so that kinds can be posted together."""
    amounts = [(F.col(f) if f in rows.columns else F.lit(None)).cast("long").alias(f) for f in AMOUNT_FIELDS]
    return rows.select(F.col(key).cast("long").alias(key), "client_id", "kind", "date", *amounts)


def post_purchase(requests: DataFrame, role_map: DataFrame, vat_rate_bp: int = 1200, due_days: int = 30):
    """Purchases (transaction_id, client_id, product_id, warehouse_id, quantity, unit_cost_cents, date):
    movement + cost layer + AP document (gross, due +30 d) + inventory D / input VAT D / AP C legs.

    A purchase whose legs are rejected leaves nothing else behind."""
    p = purchase_events(requests, vat_rate_bp)
    legs, rejected = post_journals(p, role_map)
    p = p.join(rejected.select("transaction_id"), "transaction_id", "left_anti")  # whole or not at all
    return {
        "movements": p.select("transaction_id", "product_id", "warehouse_id", F.lit("Purchase").alias("action_type"),
                              "quantity", F.col("date").alias("movement_date")),
        "layers": p.select(F.col("transaction_id").alias("operation_id"), "product_id", "quantity",
                           F.col("unit_cost_cents").alias("product_cost_cents"), F.col("date").alias("purchase_date")),
        "payables": p.select(F.col("transaction_id").alias("payable_id"), "transaction_id",
                             (F.col("gross").cast("decimal(20,0)") / 100).cast(MONEY).alias("amount"),
                             F.col("date").alias("invoice_date"), F.date_add("date", due_days).alias("due_date"),
                             F.lit("Pending").alias("status")),
        "journals": legs, "rejected": rejected,
    }


def post_sale(sales: DataFrame, slices: DataFrame, role_map: DataFrame, vat_rate_bp: int = 1200, due_days: int = 30):
    """Sales (transaction_id, client_id, product_id, warehouse_id, quantity, unit_price_cents, date) with
    their layer slices (from ``allocate_layers``: sale_id = transaction_id, units, unit_cost_cents).

    Unmet demand rejects the sale (requested > available), and so does a missing role; a rejected sale leaves
    no movement and no receivable.  Five legs per slice; one AR per sale.
    """
    got = slices.select(F.col("sale_id").alias("transaction_id"), F.col("sale_units").alias("_units")).repartition("transaction_id").distinct()
    s = sales.join(got, "transaction_id", "left")
    short = F.coalesce(F.col("_units"), F.lit(0)) < F.col("quantity")
    rejected = s.where(short).select("transaction_id", F.format_string(
        "Insufficient quantity for product ID: %s remaining quantity %s", F.col("product_id"),
        F.coalesce(F.col("_units"), F.lit(0))).alias("error"))
    ok = s.where(~short).drop("_units")
    sl = sale_events(sales, slices, vat_rate_bp)
    legs, _ = post_journals(sl, role_map)  # legs keep the sale's transaction id
    # the slices of a sale share its client and kind, so a sale is refused as one event
    leg_rej = rejected_events(s.where(~short & F.col("_units").isNotNull()).select("transaction_id", "client_id", F.lit("SALE").alias("kind")),
                              role_map).distinct()
    refused = leg_rej.select("transaction_id")
    ok, whole = (df.join(refused, "transaction_id", "left_anti") for df in (ok, sl))
    ar = whole.groupBy("transaction_id").agg(F.sum("gross").alias("_gross"), F.first("date").alias("invoice_date"))
    return {
        "movements": ok.select("transaction_id", "product_id", "warehouse_id", F.lit("Sale").alias("action_type"),
                               "quantity", F.col("date").alias("movement_date")),
        "receivables": ar.select(F.col("transaction_id").alias("receivable_id"), "transaction_id",
                                 (F.col("_gross").cast("decimal(20,0)") / 100).cast(MONEY).alias("amount"),
                                 "invoice_date", F.date_add("invoice_date", due_days).alias("due_date"),
                                 F.lit("Pending").alias("status")),
        "journals": legs, "rejected": rejected.unionByName(leg_rej),
    }


def post_returns(returns: DataFrame, documents: DataFrame, role_map: DataFrame):
    """Sale / purchase returns (transaction_id, client_id, action_type, quantity, unit_price_cents,
    unit_cost_cents, date, document_id): return row (q·price), document → Returned, legs."""
    r = return_events(returns)
    legs, rejected = post_journals(r, role_map)
    returned = r.where(F.col("kind").isNotNull()).select("document_id").distinct().withColumn("_ret", F.lit(True))
    docs = (documents.join(returned, "document_id", "left")
            .withColumn("status", F.when(F.col("_ret"), F.lit("Returned")).otherwise(F.col("status"))).drop("_ret"))
    rows = r.where(F.col("kind").isNotNull()).select(
        F.col("transaction_id").alias("return_id"), "document_id", "action_type", "quantity",
        (F.col("value").cast("decimal(20,0)") / 100).cast(MONEY).alias("amount"), F.col("date").alias("return_date"))
    return {"returns": rows, "documents": docs, "journals": legs, "rejected": rejected}


SAME_LOCATION = "Source and destination must differ"


def post_transfer(transfers: DataFrame, role_map: DataFrame):
    """Transfers (transaction_id, client_id, from_warehouse_id, to_warehouse_id, quantity, unit_cost_cents,
    date): inventory D and C.  A transfer within one location, or without one, is rejected."""
    t = transfers.withColumn("kind", F.lit("TRANSFER")).withColumn("cost", F.col("quantity") * F.col("unit_cost_cents"))
    moved = F.coalesce(F.col("from_warehouse_id") != F.col("to_warehouse_id"), F.lit(False))
    legs, rejected = post_journals(t.where(moved), role_map)
    return legs, rejected.unionByName(t.where(~moved).select("transaction_id", F.lit(SAME_LOCATION).alias("error")))


# ---- chart of accounts ----------------------------------------------------------------

def apply_coa_template(template_accounts: DataFrame, charts: DataFrame, clients: DataFrame) -> DataFrame:
    """New chart rows: each client's template accounts, skipping (client, account_code) present.

    ``clients`` carries the template each tenant uses (client_id, template_id); the copy is an
    equi join on template_id followed by an anti join on the existing chart.  New ids follow the
    largest existing chart id in (client, account code) order, so they cannot collide.
    """
    t = template_accounts.select("template_id", "account_code", "account_name", "account_type")
    wanted = clients.select("client_id", "template_id").join(t, "template_id")
    present = charts.select("client_id", "account_code")
    new = wanted.join(present, ["client_id", "account_code"], "left_anti")
    numbered = assign_ids(new, charts, "chart_id", ["client_id", "account_code"], "_new_id")
    return numbered.select(F.col("_new_id").cast("int").alias("chart_id"), "client_id", F.col("account_name").alias("account"), "account_code",
                      F.col("account_type").alias("type"), F.lit(True).alias("is_active"))


def assign_account_roles(charts: DataFrame, roles: DataFrame, prefixes: list[tuple[str, str]]) -> DataFrame:
    """New role rows for every account whose name matches a ``prefix%`` (all tenants), skipping
    (chart, role) pairs already present.  All prefixes are tested in one pass over the chart."""
    hits = F.array_compact(F.array(*[F.when(F.col("account").like(p + "%"), F.lit(r)) for p, r in prefixes]))
    hit = charts.select("chart_id", F.explode(hits).alias("role_name"))
    return hit.join(roles.select("chart_id", "role_name"), ["chart_id", "role_name"], "left_anti")


def assign_account_role(charts: DataFrame, roles: DataFrame, prefix: str, role: str) -> DataFrame:
    """New role rows for every account whose name matches ``prefix%`` (all tenants), skipping existing."""
    return assign_account_roles(charts, roles, [(prefix, role)])


# ---- recurring entries ------------------------------------------------------------------

def process_recurring(templates: DataFrame, details: DataFrame, execution_date, existing_tx: DataFrame,
                      client_id: int | None = None) -> dict[str, DataFrame]:
    """Active templates → one transaction each with the template's legs dated on the execution
    date; execution rows EXECUTED / FAILED (a template without legs fails); per-client counts.
    Idempotency key 'REC-<template>-<date>' makes a re-run a no-op for executed templates."""
    d = F.lit(str(execution_date)).cast("date")
    t = templates.where(F.col("is_active"))
    if client_id is not None:
        t = t.where(F.col("client_id") == client_id)
    has = details.select("template_id").distinct().withColumn("_has", F.lit(True))
    t = (t.join(has, "template_id", "left")
         .withColumn("idempotency_key", F.concat(F.lit("REC-"), F.col("template_id").cast("string"), F.lit("-"),
                                                 d.cast("string"))))
    ok = t.where(F.col("_has").isNotNull()).join(existing_tx.select("idempotency_key"), "idempotency_key", "left_anti")
    numbered = assign_ids(ok, existing_tx, "transaction_id", ["template_id"], "transaction_id")
    tx = numbered.select("transaction_id", "client_id", "idempotency_key", F.col("template_name").alias("description"),
                         d.alias("date"), "template_id")
    legs = (details.join(numbered.select("template_id", "transaction_id"), "template_id")
            .select("transaction_id", "chart_id", d.alias("date"), F.col("is_debit").alias("journal"),
                    F.col("amount").cast(MONEY).alias("amount")))
    execs = (t.join(numbered.select("template_id", "transaction_id"), "template_id", "left")
             .select("template_id", "client_id", d.alias("scheduled_date"),
                     F.when(F.col("transaction_id").isNotNull(), "EXECUTED")
                      .when(F.col("_has").isNull(), "FAILED").otherwise("SKIPPED").alias("status"),
                     "transaction_id",
                     F.when(F.col("_has").isNull(), F.lit("No recurring details for template")).alias("error_message")))
    summary = execs.groupBy("client_id").agg(
        F.count_if(F.col("status") == "EXECUTED").alias("executed_count"),
        F.count_if(F.col("status") == "FAILED").alias("failed_count")).withColumn(
        "message", F.format_string("Processed %d recurring transactions, %d failed",
                                   F.col("executed_count"), F.col("failed_count")))
    return {"transactions": tx, "journals": legs, "executions": execs, "summary": summary}


# ---- amendments ---------------------------------------------------------------------------

SUPERSEDED = "Superseded by a later correction"


def last_per_key(corrections: DataFrame, key: str, order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(one correction per key, key of every other one): the last by ``order``, ties and no order by the largest row.

    Keys are decided by a partial aggregation, so one key with many corrections never meets in one task."""
    rank = F.struct(*([F.col(order)] if order else []), *[F.col(c) for c in sorted(corrections.columns) if c not in (key, order)])
    ranked = corrections.withColumn("_rank", rank)
    groups = ranked.groupBy(key).agg(F.max("_rank").alias("_rank"), F.count(F.lit(1)).alias("_n"))
    last = groups.select(key, *[F.col(f"_rank.{c}").alias(c) for c in corrections.columns if c != key]).select(*corrections.columns)
    others = groups.where(F.col("_n") > 1).select(key, F.explode(F.sequence(F.lit(2).cast("long"), F.col("_n")))).select(key)
    return last, others

# Status vocabulary accepted by the amendment routines.
AMEND_STATUSES = ("Pending", "Paid", "Overdue")
_AMEND = {"AR": ("receivable_id", "customer_id", ("cash_account_ar", "ar_account"), "Account Receivable"),
          "AP": ("payable_id", "vendor_id", ("cash_account_ap", "ap_account"), "Account Payable")}


def amend_document(kind: str, corrections: DataFrame, ext: DataFrame, journals: DataFrame,
                   role_map: DataFrame, order: str | None = None) -> dict[str, DataFrame]:
    """Keyed overwrite of an AR / AP document from corrections (doc id, transaction_id, party,
    invoice_date, due_date, amount, status) after the reference's input checks.

    Returns the whole tables with the accepted corrections laid over them: ``extensions``
    (document rows with party, amount, dates and status, and whether they were amended) and
    ``journals`` (legs on the document's cash / control roles re-dated and re-amounted); the new
    ``transactions`` descriptions; ``warnings`` (the literal 'Insufficient Funds' condition: the
    new amount is below the balance of the client's cash account after the correction); and
    ``rejected`` corrections.  Of several valid corrections of one document the last one counts (by
    column ``order``, else the largest row) and the others are rejected, as are those of a document
    that does not exist: every correction is applied once or reported."""
    doc_id, party, roles, label = _AMEND[kind]
    c = corrections
    reason = (F.when(~F.col("status").isin(*AMEND_STATUSES) | F.col("status").isNull() | (F.col("status") == ""),
                     F.lit("Invalid Status"))
               .when(F.col(doc_id).isNull(), F.lit(f"Invalid {label.split()[1]} ID"))
               .when(F.col("invoice_date").isNull(), F.lit("Invalid  Invoice Date"))
               .when(F.col("due_date").isNull(), F.lit("Invalid  Due Date"))
               .when(F.col("amount").isNull() | (F.col("amount") < 0), F.lit("Invalid Amount"))
               .when(F.col("transaction_id").isNull(), F.lit("Transaction ID cannot be Null")))
    c = c.withColumn("_reason", reason)
    good = c.where(F.col("_reason").isNull()).drop("_reason")
    rejected = c.where(F.col("_reason").isNotNull()).select(doc_id, F.col("_reason").alias("error"))
    good, others = last_per_key(good, doc_id, order)
    known = ext.select(doc_id).distinct()
    unknown = good.join(known, doc_id, "left_anti").select(doc_id, F.lit(f"{label} not found").alias("error"))
    good = good.join(known, doc_id, "left_semi")
    rejected = rejected.unionByName(others.withColumn("error", F.lit(SUPERSEDED))).unionByName(unknown)
    fields = [party, "amount", "invoice_date", "due_date", "status"]
    new = good.select(doc_id, *[F.col(f).alias(f"_n_{f}") for f in fields], F.lit(True).alias("_amended"))
    hit = F.col("_amended").isNotNull()
    over = lambda f: F.when(hit, F.coalesce(f"_n_{f}", f) if f == party else F.col(f"_n_{f}")).otherwise(F.col(f))
    new_ext = (ext.join(new, doc_id, "left")
               .select(doc_id, "transaction_id", over(party).alias(party), over("amount").cast(MONEY).alias("amount"),
                       over("invoice_date").alias("invoice_date"), over("due_date").alias("due_date"), over("status").alias("status"),
                       hit.alias("amended")))
    desc = F.concat(F.lit(f"{label} With Amount of "), F.col("amount").cast("string"), F.lit("Due Date on "),
                    F.col("due_date").cast("string"), F.lit("Status "), F.col("status"), F.lit("This had been Updated"))
    tx = good.select("transaction_id", desc.alias("description"))
    role_charts = role_map.where(F.col("role_name").isin(*roles)).groupBy("chart_id").agg(
        F.bool_or(F.col("role_name") == roles[0]).alias("_cash"), F.min("client_id").alias("_client"))
    j = (journals.join(good.select("transaction_id", doc_id, F.col("invoice_date").alias("_i"), F.col("amount").alias("_a")),
                       "transaction_id", "left")
         .join(role_charts, "chart_id", "left"))
    change = F.col("_i").isNotNull() & F.col("_cash").isNotNull()
    j = j.withColumns({"date": F.when(change, F.col("_i")).otherwise(F.col("date")),
                       "amount": F.when(change, F.col("_a")).otherwise(F.col("amount")).cast(MONEY)})
    new_legs = j.select("journal_id", "transaction_id", "chart_id", "date", "journal", "amount", F.col("_i").isNotNull().alias("amended"))
    cash = j.where(F.col("_cash"))
    balances = cash.groupBy("chart_id").agg(F.sum(F.when(F.col("journal"), F.col("amount")).otherwise(-F.col("amount"))).alias("_balance"))
    cash_charts = role_map.where(F.col("role_name") == roles[0]).select(F.col("client_id").alias("_client"), "chart_id")
    warnings = (j.where(F.col(doc_id).isNotNull() & F.col("_client").isNotNull()).select(doc_id, "_client", F.col("_a").alias("amount")).distinct()
                .join(cash_charts, "_client").join(balances, "chart_id").where(F.col("amount") < F.col("_balance"))
                .select(doc_id, "chart_id", "amount", F.col("_balance").cast("decimal(18,2)").alias("cash_balance"),
                        F.lit("Insufficient Funds").alias("warning")))
    return {"extensions": new_ext, "transactions": tx, "journals": new_legs, "warnings": warnings, "rejected": rejected}


def amend_inventory(corrections: DataFrame, movements: DataFrame, prices: DataFrame,
                    role_map: DataFrame, vat_rate_bp: int = 1200, due_days: int = 30) -> dict[str, DataFrame]:
    """Rewrite movements (management_id, quantity, movement_date, warehouse_id), recompute the
    document amount (q × price for sales, q × cost otherwise), due date (+30 d) and the legs
    of the movement's action type."""
    bad = (F.when(F.col("quantity").isNull() | (F.col("quantity") <= 0), F.lit("Quantity must be greater than 0"))
            .when(F.col("movement_date").isNull(), F.lit("Date parameter is empty")))
    c = corrections.withColumn("_reason", bad)
    good = c.where(F.col("_reason").isNull()).drop("_reason")
    m = (movements.join(good.select("management_id", F.col("quantity").alias("_q"), F.col("movement_date").alias("_d"),
                                    F.col("warehouse_id").alias("_w")), "management_id")
         .join(prices, "product_id", "left"))
    new_m = m.select("management_id", "product_id", F.coalesce("_w", "warehouse_id").alias("warehouse_id"),
                     "transaction_id", "action_type", F.col("_q").cast("long").alias("quantity"),
                     F.col("_d").alias("movement_date"), "unit_cost_cents", "client_id", "unit_price_cents")
    is_sale = F.col("action_type").isin("Sale", "Sale Return")
    unit = F.when(is_sale, F.col("unit_price_cents")).otherwise(F.col("unit_cost_cents"))
    docs = new_m.select("management_id", "transaction_id", "action_type",
                        ((F.col("quantity") * unit).cast("decimal(20,0)") / 100).cast(MONEY).alias("amount"),
                        F.date_add("movement_date", due_days).alias("due_date"))
    kind = (F.when(F.col("action_type") == "Purchase", "PURCHASE").when(F.col("action_type") == "Sale", "SALE")
             .when(F.col("action_type") == "Sale Return", "SALE_RETURN")
             .when(F.col("action_type") == "Purchase Return", "PURCHASE_RETURN")
             .when(F.col("action_type") == "Transfer", "TRANSFER"))
    price_net = F.col("quantity") * F.col("unit_price_cents")
    cost_net = F.col("quantity") * F.col("unit_cost_cents")
    net = F.when(F.col("action_type") == "Sale", price_net).otherwise(cost_net)
    ev = new_m.select(F.col("management_id").alias("transaction_id"), "client_id", kind.alias("kind"),
                      F.col("movement_date").alias("date"), net.alias("net"),
                      F.floor((net * F.lit(vat_rate_bp) + F.lit(5000)).cast("decimal(38,0)") / F.lit(10000)).cast("long").alias("tax"),
                      cost_net.alias("cost"), price_net.alias("value"))
    ev = ev.withColumn("gross", F.col("net") + F.col("tax"))
    legs, leg_rej = post_journals(ev, role_map)
    return {"movements": new_m.drop("client_id", "unit_price_cents"), "documents": docs, "journals": legs,
            "rejected": c.where(F.col("_reason").isNotNull()).select("management_id", F.col("_reason").alias("error"))
                         .unionByName(leg_rej.withColumnRenamed("transaction_id", "management_id"))}


# ---- master data ---------------------------------------------------------------------------

def _master_checks(kind: str) -> list[tuple[str, F.Column]]:
    from ..functions.validators import CHART_TYPES, EMAIL_PATTERN
    name = {"customer": "customer_name", "vendor": "vendor_name", "product": "product_name",
            "warehouse": "warehouse_name", "chart": "account"}[kind]
    checks = [(f"{name} cannot be empty", F.col(name).isNull() | (F.trim(F.col(name)) == ""))]
    if kind in ("customer", "vendor"):
        checks.append(("Invalid email format",
                       F.col("email").isNotNull() & ~F.col("email").rlike(EMAIL_PATTERN)))
    if kind == "chart":
        checks.append(("Invalid account type", ~F.col("type").isin(*CHART_TYPES)))
    if kind == "product":
        checks.append(("Price cannot be negative", F.col("product_price") < 0))
    return checks


def update_master(kind: str, table: DataFrame, corrections: DataFrame, key: str, order: str | None = None) -> dict[str, DataFrame]:
    """Checked keyed overwrite of master data: a correction's non-null fields replace the
    stored ones; corrections failing a check are rejected with the first message.

    Of several corrections of one key the last one counts (by column ``order``, else the largest row)
    and the others are rejected, as are corrections without a key or of a key that the table does not
    hold: every correction is applied once or reported, and the table keeps one row per key."""
    no_key = corrections.where(F.col(key).isNull()).select(key, F.lit(f"{key} is required").alias("error"))
    corrections, others = last_per_key(corrections.where(F.col(key).isNotNull()), key, order)
    lost = corrections.join(table.select(key).distinct(), key, "left_anti").select(key, F.lit(f"{key} not found").alias("error"))
    fields = [c for c in corrections.columns if c not in (key, order)]
    marked = corrections.select(key, *[F.col(c).alias(f"_n_{c}") for c in fields], F.lit(True).alias("_corrected"))
    merged = table.join(marked, key, "left")
    cand = merged.select(key, *[F.coalesce(F.col(f"_n_{c}"), F.col(c)).alias(c) if c in fields else F.col(c)
                                for c in table.columns if c != key],
                         F.coalesce(F.col("_corrected"), F.lit(False)).alias("_corrected"))
    reason = None
    for msg, cond in _master_checks(kind):
        reason = F.when(F.coalesce(cond, F.lit(False)), F.lit(msg)) if reason is None \
            else reason.when(F.coalesce(cond, F.lit(False)), F.lit(msg))
    cand = cand.withColumn("_reason", F.when(F.col("_corrected"), reason))
    keep_old = table.join(cand.where(F.col("_reason").isNotNull()).select(key), key, "left_semi")
    updated = cand.where(F.col("_reason").isNull()).drop("_reason", "_corrected").select(*table.columns) \
                  .unionByName(keep_old)
    rejected = cand.where(F.col("_reason").isNotNull()).select(key, F.col("_reason").alias("error"))
    rejected = rejected.unionByName(others.withColumn("error", F.lit(SUPERSEDED))).unionByName(lost).unionByName(no_key)
    return {"table": updated, "rejected": rejected}
