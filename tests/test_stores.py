"""Stores that are kept up to date: tiers, snapshots with digests, daily balances — broken-off runs and what is rewritten."""

from __future__ import annotations

import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerflow.operators import tier
from ledgerflow.operators.balances import BalanceStore
from ledgerflow.operators.snapshots import Snapshot, changed_buckets, changed_rows
from ledgerflow.operators.tier import TierStore


def _docs(spark):
    days = [None, *[dt.date(2024, 1, 5) + dt.timedelta(days=9 * i) for i in range(40)]]
    return spark.createDataFrame([(i, d) for i, d in enumerate(days)], "id int, day date")


def _expected(df, as_of):
    return sorted(map(tuple, tier.tier_partitions(df, "day", as_of).collect()), key=str)


def _mtimes(path):
    return {p.parent.name: p.stat().st_mtime_ns for p in path.glob("partition_label=*/part-*")}


def test_a_later_run_moves_only_crossed_labels(spark, tmp_path):
    df = _docs(spark)
    store = TierStore(spark, str(tmp_path), "day", df.schema)
    store.load(df, "2024-05-20")
    before = _mtimes(tmp_path / "cold")
    moved = store.advance("2024-08-01")
    after = _mtimes(tmp_path / "cold")
    assert moved and {k: v for k, v in after.items() if k in before} == before and {k.split("=")[1] for k in after} - {k.split("=")[1] for k in before} == set(moved)
    assert sorted(map(tuple, store.read().collect()), key=str) == _expected(df, "2024-08-01")
    assert store.advance("2024-08-01") == [] and not any((tmp_path / "hot" / f"partition_label={m}").exists() for m in moved)


def test_a_move_broken_off_at_either_step_loses_nothing(spark, tmp_path, monkeypatch):
    df = _docs(spark)
    store = TierStore(spark, str(tmp_path), "day", df.schema)
    store.load(df, "2024-05-20")
    rows = lambda: sorted(map(tuple, store.read().collect()), key=str)

    def broken(*_):
        raise RuntimeError("cut off")

    with monkeypatch.context() as m:  # after the copy, before the commit
        m.setattr(store.manifest, "commit", broken)
        with pytest.raises(RuntimeError):
            store.advance("2024-08-01")
    assert rows() == _expected(df, "2024-05-20")
    with monkeypatch.context() as m:  # after the commit, before the drop
        m.setattr(store, "_drop_stale", broken)
        with pytest.raises(RuntimeError):
            store.advance("2024-08-01")
    assert rows() == _expected(df, "2024-08-01")
    assert store.advance("2024-08-01") == [] and rows() == _expected(df, "2024-08-01")


def test_equal_buckets_are_not_read(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, rng.choice([None, "a", "b"]), rng.choice([None, 1])) for i in range(500)]
    kind = "id long, name string, n int"
    old = Snapshot(spark, f"{tmp_path}/a").write(spark.createDataFrame(rows, kind), "id", 32)
    again = Snapshot(spark, f"{tmp_path}/b").write(spark.createDataFrame(rows[::-1], kind).repartition(3), "id", 32)
    assert changed_buckets(old, again) == []
    assert [df.count() for df in changed_rows(old, again, kind)] == [0, 0]
    swapped = [(i, n, x) if i != 7 else (7, "changed", x) for i, n, x in rows if i != 9] + [(1000, None, None)]
    new = Snapshot(spark, f"{tmp_path}/c").write(spark.createDataFrame(swapped, kind), "id", 32)
    buckets = changed_buckets(old, new)
    place = {r.id: r.b for r in spark.createDataFrame([(7,), (9,), (1000,)], "id long").select("id", F.pmod(F.xxhash64("id"), F.lit(32)).alias("b")).collect()}
    assert buckets == sorted(set(place.values()))
    before, after = changed_rows(old, new, kind)
    assert {tuple(r) for r in before.collect()} ^ {tuple(r) for r in after.collect()} == {rows[7], rows[9], (7, "changed", rows[7][2]), (1000, None, None)}
    plan = before._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan.replace("isnotnull(bucket", "bucket").replace("#", " ").replace("PartitionFilters: [ bucket", "PartitionFilters: [bucket")


def test_null_places_differ(spark, tmp_path):
    kind = "id long, a int, b int"
    x = Snapshot(spark, f"{tmp_path}/x").write(spark.createDataFrame([(1, None, 5)], kind), "id", 4)
    y = Snapshot(spark, f"{tmp_path}/y").write(spark.createDataFrame([(1, 5, None)], kind), "id", 4)
    assert len(changed_buckets(x, y)) == 1


def test_balances_equal_a_scan_and_old_postings_touch_their_month(spark, tmp_path):
    rng = random.Random(3)
    day = lambda: dt.date(2024, 1, 1) + dt.timedelta(days=rng.randint(0, 200))
    leg = lambda: (rng.choice([1, 1, 1, 2]), day(), rng.random() < 0.5, Decimal(rng.randint(1, 9999)) / 100)
    kind = "chart_id int, date date, journal boolean, amount decimal(15,2)"
    batches = [[leg() for _ in range(60)] for _ in range(3)] + [[(1, dt.date(2024, 2, 3), True, Decimal("5.00")), (1, None, True, Decimal("9.00"))]]
    store = BalanceStore(spark, str(tmp_path))
    points = spark.createDataFrame([(c, dt.date(2023, 12, 1) + dt.timedelta(days=31 * i)) for c in (1, 2, 3) for i in range(9)], "chart_id int, date date")

    def check(n):
        legs = [x for b in batches[:n] for x in b]
        got = {(r.chart_id, r.date): r.balance_cents for r in store.as_of(points, n).collect()}
        assert len(got) == 27
        for (c, d), v in got.items():
            assert v == sum(int(a * 100) * (1 if j else -1) for k, x, j, a in legs if k == c and x and x <= d)

    store.post(1, spark.createDataFrame(batches[0], kind))
    check(1)
    store.post(2, spark.createDataFrame(batches[1], kind))
    assert len(store.fold(2)) >= 6
    check(2)
    for n in (3, 3):  # the batch is written again after a failure
        store.post(n, spark.createDataFrame(batches[2], kind))
    check(3)
    store.fold(3)
    store.post(4, spark.createDataFrame(batches[3], kind))
    assert store.fold(4) == ["202402", "none"] and store.fold(4) == []
    check(4)
