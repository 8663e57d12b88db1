"""Hand-computed fixtures (from the reference's own sample values) and invariants."""

from __future__ import annotations

import datetime as dt
import random
from decimal import Decimal

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerflow.functions import validators as V
from ledgerflow.functions.ids import with_sequence_id
from ledgerflow.functions.windows import chunked_lag, running_sum
from ledgerflow.operators import audit, bank, costing, events, payroll, posting, secure
from ledgerflow.sources.bridge import bridge

from .conftest import SF_SMALL


def test_payroll_emp001(spark):
    comps = spark.createDataFrame(
        [(1, "Basic Salary", "SALARY"), (2, "Rice Allowance", "ALLOWANCE"), (3, "Transportation Allowance", "ALLOWANCE"),
         (4, "Communication Allowance", "ALLOWANCE"), (7, "SSS Contribution", "STATUTORY"),
         (8, "PhilHealth Premium", "STATUTORY"), (9, "Pag-IBIG Contribution", "STATUTORY"), (10, "Withholding Tax", "TAX")],
        "component_id int, component_name string, component_type string")
    amounts = {1: "30000.00", 2: "1500.00", 3: "2000.00", 4: "500.00", 7: "1350.00", 8: "500.00", 9: "200.00",
               10: "2000.00"}
    det = spark.createDataFrame([(1, c, a) for c, a in amounts.items()], "employee_id int, component_id int, amount string") \
        .select("employee_id", "component_id", F.col("amount").cast("decimal(15,2)").alias("amount"),
                F.lit("2025-01-01").cast("date").alias("effective_date"), F.lit(None).cast("date").alias("end_date"))
    r = payroll.employee_payroll(det, comps, "2025-01-01", "2025-01-31").collect()[0]
    assert (r.gross_amount, r.total_deductions, r.net_amount) == (Decimal("34000.00"), Decimal("4050.00"),
                                                                   Decimal("29950.00"))
    assert r.component_details.startswith("Basic Salary: $30000.00\nRice Allowance: $1500.00\n")


def test_fifo_lifo_small(spark):
    layers = spark.createDataFrame([(1, 7, "2025-01-01", 5, 100), (2, 7, "2025-01-02", 5, 200)],
                                   "operation_id long, product_id long, purchase_date string, quantity long, unit_cost_cents long") \
        .withColumn("purchase_date", F.col("purchase_date").cast("date"))
    sales = spark.createDataFrame([(10, 7, "2025-01-03", 7), (11, 7, "2025-01-04", 6)],
                                  "sale_id long, product_id long, sale_date string, quantity long") \
        .withColumn("sale_date", F.col("sale_date").cast("date"))
    fifo = sorted(tuple(r) for r in costing.allocate_layers(sales, layers, "fifo")
                  .select("sale_id", "operation_id", "units").collect())
    assert fifo == [(10, 1, 5), (10, 2, 2), (11, 2, 3)]
    lifo = sorted(tuple(r) for r in costing.allocate_layers(sales, layers, "lifo")
                  .select("sale_id", "operation_id", "units").collect())
    assert lifo == [(10, 1, 2), (10, 2, 5), (11, 1, 3)]
    cos = {r.sale_id: r for r in costing.cost_of_sales(sales.withColumn("unit_price_cents", F.lit(300)), layers).collect()}
    assert cos[11].shortage == 3 and cos[10].cogs == Decimal("9.00")


def test_a_product_without_layers_gets_no_slice(spark):
    layers = spark.createDataFrame([(1, 7, dt.date(2025, 1, 1), 5, 100)], "operation_id long, product_id long, purchase_date date, quantity long, unit_cost_cents long")
    sales = spark.createDataFrame([(10, 8, dt.date(2025, 1, 3), 7), (11, 7, dt.date(2025, 1, 3), 2)], "sale_id long, product_id long, sale_date date, quantity long")
    assert [tuple(r) for r in costing.allocate_layers(sales, layers).select("sale_id", "operation_id", "units", "sale_units").collect()] == [(11, 1, 2, 2)]
    assert costing.allocate_layers(sales, layers.where("product_id = 0")).count() == 0


def test_allocation_of_a_hot_product(spark):
    """90 % of the rows on one product, one huge layer, short stretches: the same slices as a plain loop."""
    from collections import deque
    rng = random.Random(6)
    product = lambda: 7 if rng.random() < 0.9 else rng.randint(1, 5)
    day = lambda: dt.date(2025, 1, 1) + dt.timedelta(days=rng.randint(0, 5))
    layers = [(i, product(), day(), rng.randint(0, 9), i) for i in range(300)] + [(999, 7, dt.date(2025, 1, 3), 5000, 1)]
    sales = [(i, product(), day(), rng.randint(0, 30)) for i in range(400)]
    ldf = spark.createDataFrame(layers, "operation_id long, product_id long, purchase_date date, quantity long, unit_cost_cents long")
    sdf = spark.createDataFrame(sales, "sale_id long, product_id long, sale_date date, quantity long")
    for method in ("fifo", "lifo"):
        want, units = [], {}
        for p in {s[1] for s in sales}:
            stock = deque([x[0], x[3]] for x in sorted((x for x in layers if x[1] == p and x[3] > 0), key=lambda x: (x[2], x[0]), reverse=method == "lifo"))
            for sid, _, _, q in sorted((x for x in sales if x[1] == p), key=lambda x: (x[2], x[0])):
                while q > 0 and stock:
                    n = min(q, stock[0][1])
                    want.append((sid, stock[0][0], n))
                    units[sid] = units.get(sid, 0) + n
                    q, stock[0][1] = q - n, stock[0][1] - n
                    if not stock[0][1]:
                        stock.popleft()
        for stretch in (16, costing.STRETCH):
            rows = costing.allocate_layers(sdf, ldf, method, stretch).collect()
            assert sorted((r.sale_id, r.operation_id, r.units) for r in rows) == sorted(want)
            assert all(r.sale_units == units[r.sale_id] for r in rows)


def test_allocation_invariants(spark):
    b = bridge(spark, SF_SMALL)
    sales = b.movements.where(F.col("action_type") == "Sale").select(
        F.col("management_id").alias("sale_id"), "product_id", F.col("movement_date").alias("sale_date"), "quantity")
    alloc = costing.allocate_layers(sales, b.layers, "fifo")
    per_sale = alloc.groupBy("sale_id").agg(F.sum("units").alias("u")).join(sales, "sale_id")
    assert per_sale.where(F.col("u") > F.col("quantity")).count() == 0
    per_layer = alloc.groupBy("operation_id").agg(F.sum("units").alias("u")).join(b.layers, "operation_id")
    assert per_layer.where(F.col("u") > F.col("quantity")).count() == 0
    demand = sales.groupBy("product_id").agg(F.sum("quantity").alias("d"))
    supply = b.layers.groupBy("product_id").agg(F.sum("quantity").alias("s"))
    got = alloc.groupBy("product_id").agg(F.sum("units").alias("a"))
    chk = demand.join(supply, "product_id").join(got, "product_id", "left").fillna(0, ["a"])
    assert chk.where(F.col("a") != F.least("d", "s")).count() == 0


def test_sequence_id_matches_row_number(spark):
    b = bridge(spark, SF_SMALL)
    li = b.raw("lineitem")
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate"]
    mine = with_sequence_id(li, keys, "rn")
    ref = li.withColumn("rn2", F.row_number().over(Window.orderBy(*keys)))
    assert mine.join(ref, keys).where(F.col("rn") != F.col("rn2")).count() == 0
    assert mine.count() == li.count()


def test_chunked_windows_match_plain_windows(spark):
    rnd = random.Random(7)
    rows = [(rnd.randint(1, 3), i, rnd.randint(1, 9)) for i in range(1, 400)]
    df = spark.createDataFrame(rows, "k int, id long, v long")
    rs = running_sum(df, ["k"], [("id", True)], "v", "s", chunk=16)
    ref = df.withColumn("s2", F.sum("v").over(Window.partitionBy("k").orderBy("id")))
    assert rs.join(ref, ["k", "id"]).where(F.col("s") != F.col("s2")).count() == 0
    lg = chunked_lag(df, ["k"], "id", "v", "p", chunk=16)
    ref = df.withColumn("p2", F.lag("v").over(Window.partitionBy("k").orderBy("id")))
    assert lg.join(ref, ["k", "id"]).where(~F.col("p").eqNullSafe(F.col("p2"))).count() == 0


def test_hash_chain_verifies_and_detects_tampering(spark):
    rows = [(i, "t" + str(i % 2), "INSERT", f'{{"n":{i}}}') for i in range(1, 60)]
    log = spark.createDataFrame(rows, "audit_id long, table_name string, operation string, record string")
    chained = audit.hash_chain(log, "table_name", ["audit_id"])
    assert audit.verify_hash_chain(chained).count() == 0
    tampered = chained.withColumn("record", F.when(F.col("audit_id") == 17, F.lit('{"n":999}')).otherwise(F.col("record")))
    bad = audit.verify_hash_chain(tampered).collect()
    assert [(r.audit_id, r.problem) for r in bad] == [(17, "ALTERED_ROW")]
    # appending from a stored tail continues the chain
    tails = chained.groupBy("table_name").agg(F.max_by("row_hash", "audit_id").alias("tail_hash"))
    more = spark.createDataFrame([(100, "t0", "INSERT", "{}")], "audit_id long, table_name string, operation string, record string")
    nxt = audit.hash_chain(more, "table_name", ["audit_id"], tails=tails).collect()[0]
    assert nxt.prev_hash == tails.where(F.col("table_name") == "t0").collect()[0].tail_hash


def _greedy(bank_rows, legs, shift=0, used=None, done=()):
    """Earliest unused leg of the row's account, rows by (statement, transaction date, id)."""
    used, out = set() if used is None else used, {}
    by: dict = {}
    for lid, account, ldate, lamt in sorted(legs, key=lambda r: (r[2], r[0])):
        by.setdefault((account, lamt), []).append((lid, ldate))
    for bid, account, sdate, _, amt in sorted(bank_rows, key=lambda r: (r[2], r[3], r[0])):
        for lid, ldate in by.get((account, amt + shift), []) if bid not in done else []:
            if lid not in used and ldate <= sdate:
                used.add(lid)
                out[bid] = lid
                break
    return out


def _match_frames(spark, br, lg):
    return (spark.createDataFrame(br, "bank_trans_id long, account_id int, statement_date date, transaction_date date, amt long"),
            spark.createDataFrame(lg, "journal_id long, account_id int, date date, amt long"))


def test_match_tier_equals_greedy(spark):
    rnd = random.Random(3)
    d0 = dt.date(2024, 1, 1)
    day = lambda n: d0 + dt.timedelta(days=n)
    br = [(i, rnd.randint(1, 2), day(30 * rnd.randint(0, 3) + 29), day(rnd.randint(0, 3)), rnd.choice([100, 200, 300])) for i in range(1, 160)]
    lg = [(1000 + i, rnd.randint(1, 2), day(rnd.randint(0, 150)), rnd.choice([99, 100, 200, 300])) for i in range(120)]
    for shift in (0, -1):
        got = {r.bank_trans_id: r.journal_id for r in bank.match_tier(*_match_frames(spark, br, lg), shift).collect()}
        assert got == _greedy(br, lg, shift) and got


def test_tiers_over_dense_amounts(spark):
    """Consecutive cents: every row has neighbours within the tolerance, all in one run."""
    from decimal import Decimal as D
    rnd = random.Random(5)
    d0 = dt.date(2024, 1, 1)
    day = lambda n: d0 + dt.timedelta(days=n)
    br = [(i, 1, dt.date(2024, 1, 31), day(rnd.randint(0, 20)), 1000 + i) for i in range(3000) if rnd.random() < 0.7]
    lg = [(9000 + i, 1, day(rnd.randint(0, 40)), 1000 + i) for i in range(3000) if rnd.random() < 0.7]
    used: set = set()
    want = _greedy(br, lg, 0, used)
    for shift in (-1, 1):
        want |= _greedy(br, lg, shift, used, want)
    tx = spark.createDataFrame([(i, a, t, "CREDIT", D(amt) / 100) for i, a, _, t, amt in br],
                               "bank_trans_id long, account_id int, transaction_date date, transaction_type string, amount decimal(15,2)")
    jr = spark.createDataFrame([(i, 77, d, True, D(amt) / 100) for i, _, d, amt in lg], "journal_id long, chart_id int, date date, journal boolean, amount decimal(15,2)")
    acct = spark.createDataFrame([(1, "x", "y", 77)], "account_id int, account_number string, bank_name string, chart_id int")
    out = bank.auto_match_bank(tx, jr, acct, bank.monthly_statements(tx))
    assert {r.bank_trans_id: r.journal_id for r in out["matches"].collect()} == want
    head = out["headers"].collect()
    assert sum(h.matched_count for h in head) == len(want) and sum(h.unmatched_count for h in head) == len(br) - len(want)
    assert {h.status for h in head} == {"IN_PROGRESS"}




def test_validator_columns(spark):
    df = spark.createDataFrame([("a@b.co", "+19171234567", "12.50", "7", "2024-02-30"),
                                ("bad", "12", "12,5", "-3", "2024-01-05"),
                                (None, None, "-1", "x", "2999-01-01")],
                               "email string, phone string, amount string, qty string, d string")
    r = df.select(V.validate_email("email").alias("e"), V.validate_phone("phone").alias("p"),
                  V.validate_decimal_amount("amount").alias("a"), V.validate_integer_quantity("qty").alias("q"),
                  V.validate_date("d", "2025-01-01").alias("t")).collect()
    assert [x.e.error_msg for x in r] == ["", "Invalid email format", "Email cannot be empty"]
    assert [x.p.is_valid for x in r] == [True, False, True]
    assert [x.a.error_msg for x in r] == ["", "Invalid decimal format: 12,5", "Amount cannot be negative"]
    assert [x.q.error_msg for x in r] == ["", "Quantity must be greater than 0", "Invalid integer format: x"]
    assert [x.t.error_msg for x in r] == ["Invalid date format: 2024-02-30", "", "Date cannot be in the future"]


def test_postings_balance(spark):
    b = bridge(spark, SF_SMALL)
    from ledgerflow.plans import posting_queries as pq
    legs = posting.post_ar(pq.ar_requests(b), b.clients, b.customers, pq.role_map(b), b.transactions)["journals"]
    bal = legs.groupBy("transaction_id").agg(
        F.sum(F.when(F.col("journal"), F.col("amount")).otherwise(-F.col("amount"))).alias("d"))
    assert bal.where(F.col("d") != 0).count() == 0
    assert legs.count() > 0


def test_tenant_scopes_disjoint(spark):
    b = bridge(spark, SF_SMALL)
    scopes = [secure.tenant_scope(b.journals, c, [(b.transactions, "transaction_id", "transaction_id")])
              .select("journal_id") for c in range(1, 6)]
    total = sum(s.count() for s in scopes)
    assert total == b.journals.count()
    try:
        secure.tenant_scope(b.journals, None)
        raise AssertionError("missing client context must raise")
    except ValueError:
        pass


def test_stream_posts_late_events_once(spark, tmp_path):
    """Two micro-batches: the second holds a repeat, a rejected request and an event far older than the first batch."""
    from ledgerflow.streaming.events import EVENT_SCHEMA, start_stream_post_events
    row = lambda i, key, day, kind="SALE": (i, kind, dt.datetime(2025, 1, day), key, 1, Decimal("5.00"), "{}", "PENDING")
    src, sink, ckpt = (str(tmp_path / d) for d in ("src", "sink", "ckpt"))
    post = lambda fresh: fresh.select(F.col("event_id").alias("transaction_id"), "payload_key")
    for rows in ([row(1, "a", 20), row(2, "a", 20), row(3, "b", 20), row(4, "z", 20)],
                 [row(5, "a", 21), row(6, "late", 2), row(7, None, 21), row(8, "c", 21, "OTHER"), row(9, "old", 21)]):
        spark.createDataFrame(rows, EVENT_SCHEMA).coalesce(1).write.mode("append").parquet(src)
        known = spark.createDataFrame([("z", 99)], "idempotency_key string, transaction_id long")
        start_stream_post_events(spark, src, sink, ckpt, post, known).awaitTermination()
    read = lambda kind: spark.read.parquet(f"{sink}/{kind}").collect()
    assert sorted((r.transaction_id, r.payload_key) for r in read("journals")) == [(1, "a"), (3, "b"), (6, "late"), (9, "old")]
    assert sorted((r.event_id, r.error) for r in read("errors")) == [
        (2, "Duplicate Transaction Detected"), (4, "Duplicate Transaction Detected"), (5, "Duplicate Transaction Detected"),
        (7, "Idempotency key is required"), (8, "Unknown event type")]


def test_requests_without_key_or_amount(spark):
    none = spark.createDataFrame([], "idempotency_key string, transaction_id long")
    req = spark.createDataFrame([(1, "a"), (2, None), (3, "a"), (4, None)], "request_id long, idempotency_key string")
    d = posting.dedupe_idempotent(req, none)
    assert {k: sorted(r.request_id for r in v.collect()) for k, v in d.items()} == {"fresh": [1], "duplicates": [3], "rejected": [2, 4]}
    clients = spark.createDataFrame([(1,)], "client_id int")
    roles = spark.createDataFrame([(1, "cash_account_ar", 10), (1, "expense_account", 11)], "client_id int, role_name string, chart_id int")
    rows = [(1, 1, Decimal("5.00"), "x", "k1"), (2, 1, None, "x", "k2"), (3, 1, Decimal("-1.00"), "x", "k3")]
    out = posting.post_expense(spark.createDataFrame(rows, "request_id long, client_id int, amount decimal(15,2), description string, idempotency_key string")
                               .withColumn("date", F.current_date()), clients, roles, none)
    assert {r.request_id: r.error for r in out["rejected"].collect()} == {2: posting.NO_AMOUNT, 3: posting.NEGATIVE_AMOUNT}
    assert out["journals"].where("amount is null").count() == 0 and out["journals"].count() == 2
    assert sorted(r.details for r in out["compliance"].collect()) == ["Amount is -1.00", "Amount is NULL"]


def test_chart_ids_do_not_collide(spark):
    template = spark.createDataFrame([(1, 1000, "Cash", "Asset"), (1, 1100, "Receivables", "Asset")],
                                     "template_id int, account_code int, account_name string, account_type string")
    charts = spark.createDataFrame([(7, 1, 1000)], "chart_id int, client_id int, account_code int")
    clients = spark.createDataFrame([(1, 1), (2, 1)], "client_id int, template_id int")
    new = {(r.client_id, r.account_code): r.chart_id for r in posting.apply_coa_template(template, charts, clients).collect()}
    assert new == {(1, 1100): 8, (2, 1000): 9, (2, 1100): 10}


def test_csv_is_bound_by_header(spark, tmp_path):
    import pytest

    from ledgerflow.operators import staging
    f = tmp_path / "a.csv"
    f.write_text("client_code, Customer_Code ,due_date,invoice_date,amount,status,note\n1,20,2026-08-13,2026-07-14,71,Paid,x\n")
    r = staging.import_csv(spark, str(f)).collect()[0]
    assert (r.client_code, r.customer_code, r.due_date, r.invoice_date, r.amount, r.status) == ("1", "20", "2026-08-13", "2026-07-14", "71", "Paid")
    (tmp_path / "b.csv").write_text("client_code,amount\n1,2\n")
    with pytest.raises(ValueError, match="customer_code"):
        staging.import_csv(spark, str(tmp_path / "b.csv"))


def test_chain_check_is_null_safe(spark):
    rows = spark.createDataFrame([("t", i, "INSERT", None if i == 2 else f"r{i}") for i in range(1, 6)],
                                 "table_name string, audit_id long, operation string, record string")
    log = audit.hash_chain(rows).cache()
    tails = log.groupBy("table_name").agg(F.max_by("row_hash", "audit_id").alias("tail_hash"))
    check = lambda df: sorted((r.audit_id, r.problem) for r in audit.verify_hash_chain(df, tails=tails).collect())
    assert check(log) == []
    assert check(log.withColumn("record", F.when(F.col("audit_id") != 5, F.col("record")))) == [(5, "ALTERED_ROW")]
    assert (5, "ALTERED_ROW") in check(log.withColumn("row_hash", F.when(F.col("audit_id") != 5, F.col("row_hash"))))
    assert check(log.where("audit_id < 5")) == [(4, "MISSING_TAIL")]
    assert check(log.where("audit_id > 9")) == [(None, "MISSING_TAIL")]


def test_rates_and_periods_have_no_last_year(spark):
    from ledgerflow.operators import tax
    rates = spark.createDataFrame([(1, "VAT", "10.00", "1990-01-01", None), (2, "VAT", "12.00", "1998-01-01", "2000-01-01"), (3, "X", "1.00", "1990-01-01", None)],
                                  "rate_id int, tax_type string, rate_percentage string, effective_date string, expiry_date string") \
        .withColumns({c: F.col(c).cast("date") for c in ("effective_date", "expiry_date")})
    tx = spark.createDataFrame([(1, "1989-01-01"), (2, "1999-12-31"), (3, "2000-01-01"), (4, "2150-06-01")], "transaction_id int, d string") \
        .select("transaction_id", F.col("d").cast("date").alias("date"))
    assert {r.transaction_id: r.rate_id for r in tax.effective_tax_rate(tx, rates).collect()} == {1: None, 2: 2, 3: 1, 4: 1}
    work = spark.createDataFrame([(9, "2025-01-31", 9.0), (9, "2025-02-01", 8.0), (9, "2025-02-20", 4.0)], "employee_id long, d string, hours double") \
        .select("employee_id", F.col("d").cast("date").alias("work_date"), "hours")
    periods = spark.createDataFrame([(1, "2025-01-25", "2025-02-10"), (2, "2025-02-11", "2025-02-25")], "period_id int, s string, e string") \
        .select("period_id", F.col("s").cast("date").alias("period_start"), F.col("e").cast("date").alias("period_end"))
    got = {r.period_id: (float(r.total_hours), float(r.overtime_hours)) for r in payroll.period_hours(work, periods).collect()}
    assert got == {1: (17.0, 1.0), 2: (4.0, 0.0)}


def test_payslip_ids_of_large_employee_ids(spark):
    emp = spark.createDataFrame([(1_000_000, 1), (2_000_000, 1), (0, 1001)], "employee_id long, client_id int")
    det = spark.createDataFrame([], "employee_id long, component_id int, amount decimal(15,2), effective_date date, end_date date")
    comp = spark.createDataFrame([], "component_id int, component_name string, component_type string")
    slips = payroll.payroll_run(emp, det, comp, 1, "2025-01-01", "2025-01-31")["payslips"].unionByName(
        payroll.payroll_run(emp, det, comp, 2, "2025-02-01", "2025-02-28")["payslips"])
    assert slips.select("payslip_id").distinct().count() == 6 and slips.select("run_id").distinct().count() == 4


def test_retry_state(spark):
    a = spark.createDataFrame([(1, "FAILURE"), (1, "FAILURE"), (1, "FAILURE"), (2, "FAILURE"), (2, "SUCCESS"),
                               (3, "FAILURE")], "event_id long, outcome string") \
        .withColumn("attempted_at", F.current_timestamp())
    got = {r.event_id: (r.retry_count, r.status) for r in events.retry_state(a).collect()}
    assert got == {1: (3, "FAILED"), 2: (1, "PROCESSED"), 3: (1, "PENDING")}


def test_retry_state_stream_equals_batch(spark):
    from ledgerflow.plans import event_queries as eq
    from ledgerflow.streaming.retry import run_retry_state_available_now
    b = bridge(spark, SF_SMALL)
    att = eq.attempts(b)
    batch = {(r.event_id, r.retry_count, r.status) for r in events.retry_state(att).collect()}
    stream = {(r.event_id, r.retry_count, r.status) for r in run_retry_state_available_now(spark, att).collect()}
    assert stream == batch
