"""Streams against one batch: stock over micro-batches, replays, layer snapshots, late metrics, the key index."""

from __future__ import annotations

import datetime as dt
import json
import random
from decimal import Decimal

from pyspark.sql import functions as F

from ledgerflow.operators.key_index import KeyIndex
from ledgerflow.plans import event_queries as eq
from ledgerflow.streaming import events as se
from ledgerflow.streaming import trend

LAYER = "operation_id long, product_id long, quantity long, unit_cost_cents long, purchase_date date"


def _sale(i: int, product: int, quantity: int, day: int, key: str | None = None):
    at = dt.datetime(2024, 1, day, 12)
    payload = {"product_id": str(product), "quantity": str(quantity), "price": "2.00", "date": str(at.date()), "client_id": "1", "warehouse_id": "1"}
    return (i, "SALE", at, key or f"k{i}", 1, Decimal("2.00"), json.dumps(payload), "PENDING")


def _drain(spark, base: str, batches, stock):
    """The slices of the events, landed as one file per batch; ``post`` hands the slices on as journals."""
    for rows in batches:
        spark.createDataFrame(rows, se.EVENT_SCHEMA).coalesce(1).write.mode("append").parquet(f"{base}/source")
    start = lambda: se.start_stream_post_events(spark, f"{base}/source", f"{base}/sink", f"{base}/checkpoint",
                                                lambda fresh, slices: slices, allocate=eq.allocate_fresh, stock=stock, files_per_batch=1).awaitTermination()
    start()
    read = lambda: sorted((r.sale_id, r.operation_id, r.units, r.sale_units) for r in spark.read.parquet(f"{base}/sink/journals/*").collect())
    return start, read


def test_stock_is_sold_once_over_batches_and_after_a_replay(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(se, "SNAPSHOT", 2)
    rng = random.Random(4)
    stock = spark.createDataFrame([(i, p, q, 100 * i, dt.date(2023, 1, i)) for i, p, q in [(1, 7, 10), (2, 8, 5), (3, 8, 50), (4, 9, 3)]], LAYER)
    days = [[_sale(1, 7, 6, 1)], [_sale(2, 7, 6, 2), _sale(3, 8, 4, 2), *[_sale(10 + i, rng.choice([8, 9]), rng.randint(1, 9), 3 + i) for i in range(5)]],
            [_sale(20, 8, 30, 9), _sale(21, 8, 1, 9, "k3"), _sale(22, 7, 1, 9), _sale(23, 5, 1, 9)]]  # 7 is sold out by then, 5 was never there
    _, one = _drain(spark, f"{tmp_path}/one", [[r for d in days for r in d]], stock)
    start, many = _drain(spark, f"{tmp_path}/many", days, stock)
    assert many() == one() and [r for r in one() if r[0] in (1, 2)] == [(1, 1, 6, 6), (2, 1, 4, 4)]
    last = max(int(p.name) for p in (tmp_path / "many/checkpoint/commits").iterdir() if p.name.isdigit())
    assert last == 2
    (tmp_path / f"many/checkpoint/commits/{last}").unlink()  # the last batch was cut off after its writes, and runs again
    (tmp_path / f"many/checkpoint/commits/.{last}.crc").unlink(missing_ok=True)
    start()
    assert many() == one()
    errors = {r.event_id: r.error for r in spark.read.parquet(f"{tmp_path}/many/sink/errors/*").collect()}
    assert errors == {21: "Duplicate Transaction Detected"}


def test_key_index_opens_only_parts_that_may_hold_a_key(spark, tmp_path):
    index = KeyIndex(spark, f"{tmp_path}/index")
    for part in range(6):
        rows = [(f"{part}-{i}", 1000 * part + i) for i in range(900 if part == 2 else 40)]
        index.add(part, spark.createDataFrame([*rows, (None, 5)], "idempotency_key string, transaction_id long"))
    ask = spark.createDataFrame([("2-17",), ("4-3",), ("nobody",), (None,)], "idempotency_key string")
    assert {2, 4} <= set(index.candidates(ask, range(6))) <= {0, 1, 2, 3, 4, 5} and len(index.candidates(ask, range(6))) < 5
    assert index.candidates(ask, [0, 4]) in ([4], [0, 4])
    found = {r.idempotency_key: r.transaction_id for r in index.lookup(ask, range(6)).join(ask, "idempotency_key", "left_semi").collect()}
    assert found == {"2-17": 2017, "4-3": 4003}
    every = spark.createDataFrame([(f"{p}-{i}",) for p in range(6) for i in range(40)], "idempotency_key string")
    assert index.lookup(every, range(6)).join(every, "idempotency_key", "left_semi").count() == 240
    index.add(4, spark.createDataFrame([], "idempotency_key string, transaction_id long"))  # a part written again
    assert index.lookup(ask, [4]).count() == 0 and index.lookup(ask, []).count() == 0


def test_trend_counts_late_rows_and_loses_none(spark):
    at = lambda h, m=0: dt.datetime(2024, 5, 1, h, m)
    row = lambda i, when: (i, "cpu", Decimal("1.50"), when)
    days = [[row(1, at(1)), row(2, at(5, 30))], [row(3, at(4, 40)), row(4, at(1, 10)), row(5, at(9))], [row(6, at(5, 45)), row(7, None), row(8, at(9, 59))]]
    frames = [spark.createDataFrame(d, trend.METRICS) for d in days]
    got = {r.time_bucket and r.time_bucket.hour: (r.cents, r.n, r.late) for r in trend.run_available_now(spark, frames).collect()}
    # after the first arrival the watermark is 4:30 (window 1-2 is closed, 4-5 is open), after the second 8:00
    assert got == {1: (300, 2, 1), 4: (150, 1, 0), 5: (300, 2, 1), 9: (300, 2, 0)}
