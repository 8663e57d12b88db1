"""Steps whose work or memory must grow no faster than the rows."""

from __future__ import annotations

import datetime as dt
import random
from pathlib import Path

from pyspark.sql import functions as F

from ledgerflow.operators import audit, bank, costing
from ledgerflow.session import ensure_checkpoint_dir
from ledgerflow.streaming import events as se

from .test_streams import LAYER, _sale


def test_dense_amounts_are_matched_with_a_short_reach_first(spark, monkeypatch):
    rng, day, cents = random.Random(8), dt.date(2024, 3, 1), 160
    rows = [(i, 1, day + dt.timedelta(rng.randint(5, 9)), day + dt.timedelta(rng.randint(0, 4)), a) for i, a in enumerate(rng.sample(range(400), 36))]
    rows.append((500, 2, day, day, 10))  # nothing in reach
    legs = [(1000 + i, 1, day + dt.timedelta(rng.randint(0, 12)), a) for i, a in enumerate(rng.sample(range(400), 44))]
    b = spark.createDataFrame(rows, "bank_trans_id long, account_id int, statement_date date, transaction_date date, amt long")
    l = spark.createDataFrame(legs, "journal_id long, account_id int, date date, amt long")
    pairs = sorted((abs(y[3] - x[4]), y[3] > x[4], x[2], x[3], x[0], y[2], y[0]) for x in rows for y in legs
                   if x[1] == y[1] and abs(y[3] - x[4]) <= cents and y[2] <= x[2])
    want, used = {}, set()
    for *_, i, _date, j in pairs:
        if i not in want and j not in used:
            want[i] = j
            used.add(j)
    seen, best = [], bank.best_pairs
    monkeypatch.setattr(bank, "CROWD", 2)
    monkeypatch.setattr(bank, "best_pairs", lambda x, y, reach: seen.append(reach) or best(x, y, reach))
    assert {r.bank_trans_id: r.journal_id for r in bank.match_near(b, l, cents).collect()} == want
    assert seen == sorted(seen) and seen[0] < cents / 4 and seen[-1] == cents


def test_a_long_chain_is_folded_slice_by_slice(spark, monkeypatch):
    schema = "audit_id long, table_name string, operation string, record string"
    rows = [(i, None if i % 7 == 0 else "t0" if i < 40 else f"t{i % 3}", "INSERT", None if i % 11 == 0 else f'{{"n":{i}}}') for i in range(90)]
    log = spark.createDataFrame(random.Random(3).sample(rows, len(rows)), schema)
    tails = spark.createDataFrame([("t0", "a" * 32), ("t2", "b" * 32), ("t9", "c" * 32)], "table_name string, tail_hash string")
    read = lambda df: sorted(tuple(r) for r in df.select("audit_id", F.coalesce("table_name", F.lit("")), "prev_hash", "row_hash").fillna("").collect())
    whole = [read(audit.hash_chain(log, tails=t)) for t in (None, tails)]
    sizes, fold = [], audit._fold_chains
    monkeypatch.setattr(audit, "_fold_chains", lambda part, *more: sizes.append(part.count()) or fold(part, *more))
    cut = [audit.hash_chain(log, tails=t, slice_rows=20) for t in (None, tails)]
    assert [read(c) for c in cut] == whole and cut[0].columns == audit.hash_chain(log).columns
    assert sum(sizes[:5]) == 90 and max(sizes[:10]) < 40


def test_runs_of_days_land_as_many_files(spark):
    days = [[_sale(10 * d + i, 7, 1, d) for i in range(8)] for d in (1, 2, 3, 4)]
    events = spark.createDataFrame([r for d in days for r in d], se.EVENT_SCHEMA).repartition(4)
    stock = spark.createDataFrame([(1, 7, 100, 5, dt.date(2023, 1, 1))], LAYER)
    root = Path(ensure_checkpoint_dir(spark).removeprefix("file:")) / "stream_post_events"
    before = set(root.iterdir()) if root.exists() else set()
    from ledgerflow.plans import event_queries as eq
    got = se.run_available_now(spark, events, eq.allocate_fresh, lambda fresh, slices: slices, stock, batches=2)
    assert sorted((r.sale_id, r.units) for r in got.collect()) == sorted((e[0], 1) for d in days for e in d)
    (base,) = set(root.iterdir()) - before
    assert len(list((base / "source").glob("*.parquet"))) > 2 and len(list((base / "sink/journals").glob("part=*"))) == 2


LAYERS = "operation_id long, product_id long, purchase_date date, quantity long, unit_cost_cents long"
SALES = "sale_id long, product_id long, sale_date date, quantity long"


def _stock_lines(spark):
    rng, day = random.Random(4), lambda: None if rng.random() < 0.1 else dt.date(2025, 1, 1) + dt.timedelta(rng.randint(0, 5))
    null = lambda v: None if rng.random() < 0.05 else v
    layers = [(null(i), null(rng.randint(1, 9)), day(), null(rng.randint(0, 9)), i) for i in range(300)]
    sales = [(null(i), null(rng.randint(1, 9)), day(), null(rng.randint(0, 9))) for i in range(300)]
    return spark.createDataFrame(sales, SALES), spark.createDataFrame(layers, LAYERS)


def test_small_products_are_shuffled_once(spark):
    sales, layers = _stock_lines(spark)
    slices = costing.allocate_layers(sales, layers)
    assert slices.collect()
    final = slices._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert final.count("Exchange hashpartitioning(product_id") == 1


def test_rows_without_date_or_id_take_the_same_units_either_way(spark):
    sales, layers = _stock_lines(spark)
    read = lambda df: sorted(map(tuple, df.collect()))
    for method in ("fifo", "lifo"):
        whole = costing.allocate_layers(sales, layers, method)
        assert read(whole) == read(costing.allocate_layers(sales, layers, method, stretch=8)) != []


def test_post_sale_reads_landed_slices(spark, monkeypatch):
    from ledgerflow.plans import posting_queries as pq
    from ledgerflow.plans.registry import load_all
    calls, allocate = [], costing.allocate_layers
    monkeypatch.setattr(costing, "allocate_layers", lambda *a: calls.append(1) or allocate(*a))
    df = load_all()["post_sale_roleless"].build(spark, "/root/testdata/sf0.001")
    assert calls == [1] and "Window" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert pq.landed(df.limit(0), "post_sale/none").count() == 0
