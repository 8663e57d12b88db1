"""Interval lookups, band matching, CSV records, segments of the hash chain and keys outside the plan, against plain loops."""

from __future__ import annotations

import csv
import datetime as dt
import io
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerflow.functions.intervals import as_of, dyadic_blocks
from ledgerflow.operators import audit, bank, posting, secure, staging, tax

from .test_units import _greedy


def test_dyadic_blocks_cover_an_interval_once(spark):
    rng = random.Random(1)
    spans = [(a, a + rng.randint(0, 40)) for a in (rng.randint(-50, 50) for _ in range(200))]
    rows = spark.createDataFrame(spans, "s long, e long").select("s", "e", dyadic_blocks(F.col("s"), F.col("e"), 8).alias("b")).collect()
    for r in rows:
        points = [p for x in r.b for p in range(x.block << x.level, (x.block + 1) << x.level)]
        assert sorted(points) == list(range(r.s, r.e)) and len(r.b) <= 12


def test_twenty_thousand_rates_of_one_type(spark):
    rng = random.Random(2)
    d0 = dt.date(2020, 1, 1)
    day = lambda n: d0 + dt.timedelta(days=n)
    rates = []
    for i in range(20_000):
        a = rng.randint(0, 1500)
        rates.append((i, "VAT", Decimal(rng.randint(1, 9999)) / 100, day(a), None if i % 5000 == 0 else day(a + rng.randint(0, 20))))
    rates += [(90_000, "OTHER", Decimal("1"), day(0), None), (90_001, "VAT", Decimal("1"), None, None)]
    tx = [(i, None if i == 5 else day(rng.choice([77, rng.randint(-10, 1600)]))) for i in range(600)]
    got = {r.transaction_id: r.rate_id for r in tax.effective_tax_rate(
        spark.createDataFrame(tx, "transaction_id long, date date"),
        spark.createDataFrame(rates, "rate_id long, tax_type string, rate_percentage decimal(5,2), effective_date date, expiry_date date")).collect()}
    best = {}
    for d in {d for _, d in tx if d}:
        held = [(e, i) for i, t, _, e, x in rates if t == "VAT" and e and e <= d and (x is None or d < x)]
        best[d] = max(held)[1] if held else None
    assert got == {i: best.get(d) for i, d in tx} and len(got) == 600


def test_as_of_by_key_and_time(spark):
    at = lambda h: dt.datetime(2024, 1, 1, h)
    spans = spark.createDataFrame([("a", at(1), at(5), 1), ("a", at(2), at(3), 2), ("a", at(2), at(3), 3), ("b", at(0), None, 4)], "k string, s timestamp, e timestamp, v int")
    points = spark.createDataFrame([("a", at(0)), ("a", at(1)), ("a", at(2)), ("a", at(3)), ("a", at(5)), ("b", at(9)), (None, at(2)), ("a", None)], "k string, t timestamp")
    got = {(r.k, r.t and r.t.hour): r.v for r in as_of(points, spans, ["k"], "t", "s", "e", ["v"]).collect()}
    assert got == {("a", 0): None, ("a", 1): 1, ("a", 2): 3, ("a", 3): 1, ("a", 5): None, ("b", 9): 4, (None, 2): None, ("a", None): None}


@pytest.mark.parametrize("cents", [100, 5000])
def test_near_matches_equal_the_tiers_one_by_one(spark, cents):
    rng = random.Random(cents)
    d0 = dt.date(2024, 1, 1)
    day = lambda n: d0 + dt.timedelta(days=n)
    month = lambda: (dt.date(2024, 1, 31), dt.date(2024, 2, 29), dt.date(2024, 3, 31))[rng.randint(0, 2)]
    br, lg = [], []
    for i in range(150):
        s = month()
        br.append((i, rng.randint(1, 2), s, s - dt.timedelta(days=rng.randint(0, 27)), rng.choice([500, 520, rng.randint(-300, 300) * cents // 60])))
    for i in range(150):
        lg.append((1000 + i, rng.randint(1, 2), day(rng.randint(0, 100)), rng.choice([500, 521, rng.randint(-300, 300) * cents // 60])))
    used: set = set()
    want = _greedy(br, lg, 0, used)
    for shift in (x for c in range(1, cents + 1) for x in (-c, c)):
        want |= _greedy(br, lg, shift, used, want)
    b = spark.createDataFrame(br, "bank_trans_id long, account_id int, statement_date date, transaction_date date, amt long")
    l = spark.createDataFrame(lg, "journal_id long, account_id int, date date, amt long")
    exact = bank.match_tier(b, l)
    near = bank.match_near(b.join(exact, "bank_trans_id", "left_anti"), l.join(exact, "journal_id", "left_anti"), cents)
    assert {r.bank_trans_id: r.journal_id for r in exact.unionByName(near).collect()} == want


def _rows_of(text: str) -> list[list[str]]:
    return [r for r in csv.reader(io.StringIO(text, newline="")) if r]


def test_csv_with_quoted_line_breaks_over_many_blocks(spark, tmp_path):
    rng = random.Random(7)
    out = io.StringIO(newline="")
    w = csv.writer(out, lineterminator="\r\n")
    w.writerow(["amount", "note", "status"])
    for i in range(400):
        note = rng.choice(["plain", "a,b", 'say "x"', "two\nlines", "three\r\n\nlines", "\n", '"', "long " * 30 + "\n" + "y" * 200])
        w.writerow([str(i), note, "Paid"])
    (tmp_path / "a.csv").write_bytes(out.getvalue().encode())
    (tmp_path / "b.csv").write_bytes(b'\xef\xbb\xbfamount,note,status\n1,"x\ny",Open\n\n2,z,Open')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "512")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        tasks = staging.csv_records(spark, str(tmp_path / "a.csv")).select("_block").distinct().count()
        got = {}
        for name in ("a", "b"):
            rows = staging.import_csv(spark, str(tmp_path / f"{name}.csv"), ("status", "amount", "note")).orderBy("row_number").collect()
            got[name] = [[r.amount, r.note, r.status] for r in rows]
            assert [r.row_number for r in rows] == list(range(1, len(rows) + 1)) and not any(r._corrupt_record for r in rows)
        both = staging.import_csv(spark, str(tmp_path), ("amount",)).count()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert tasks > 20 and both == 402
    flat = lambda rows: [[c.replace("\r\n", "\n") for c in r] for r in rows]  # noqa: E731  the parser gives one kind of line end
    assert flat(got["a"]) == flat(_rows_of(out.getvalue())[1:]) and got["b"] == [["1", "x\ny", "Open"], ["2", "z", "Open"]]


def test_csv_refuses_what_it_cannot_be_sure_of(spark, tmp_path):
    (tmp_path / "odd.csv").write_text('amount\n1\n"2\n3\n')
    with pytest.raises(ValueError, match="balance"):
        staging.import_csv(spark, str(tmp_path / "odd.csv"), ("amount",))
    folder = tmp_path / "two"
    folder.mkdir()
    (folder / "a.csv").write_text("amount\n1\n")
    (folder / "b.csv").write_text("other\n1\n")
    with pytest.raises(ValueError, match="different headers"):
        staging.import_csv(spark, str(folder), ("amount",))


def test_a_hot_table_is_folded_by_many_tasks(spark):
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 60)
    log = spark.range(6000).select(F.col("id").alias("audit_id"), F.lit("hot").alias("table_name"), F.lit("INSERT").alias("operation"),
                                   F.col("id").cast("string").alias("record"), F.when(F.col("id") % 1000 != 3, at).alias("changed_at"))
    chained = audit.segment_chain(log, segment_ids=500).cache()
    anchors = audit.anchor_chain(chained).cache()
    assert chained.select(F.spark_partition_id()).distinct().count() > 1 and anchors.count() == chained.select("segment").distinct().count() > 12
    check = lambda c, a: sorted((r.audit_id, r.problem) for r in audit.verify_segments(c, a).collect())
    assert check(chained, anchors) == []
    gone = anchors.orderBy("segment_no").collect()[5]
    assert (gone.last_id, "NO_ANCHOR") in check(chained, anchors.where(F.col("segment") != gone.segment))
    assert (None, "MISSING_TAIL") in check(chained.where(F.col("segment") != gone.segment), anchors)
    swapped = chained.withColumn("record", F.when(F.col("audit_id") == 77, "x").otherwise(F.col("record")))
    assert check(swapped, anchors) == [(77, "ALTERED_ROW")]


def test_the_key_is_in_no_plan(spark, capsys):
    import hashlib
    df = spark.createDataFrame([(1, "a@b.co"), (2, None)], "id int, email string")
    enc = secure.encrypt_columns(df, ["email"], "my-secret-7")
    rows = {r.id: r.email for r in secure.decrypt_columns(enc, ["email"], "my-secret-7").collect()}
    assert rows == {1: "a@b.co", 2: None} and enc.where("id = 1").first().email != "a@b.co"
    enc.collect()
    enc.explain("extended")
    text = capsys.readouterr().out + enc._jdf.queryExecution().toString()
    key = hashlib.sha256(b"my-secret-7")
    hexed = key.hexdigest()
    for hidden in ("my-secret-7", hexed, hexed.upper(), str(list(key.digest()))[1:30]):
        assert hidden not in text
    assert "aes_key" in text


def test_every_correction_has_one_fate(spark):
    table = spark.createDataFrame([(1, 1, "A", None), (2, 1, "B", None)], "customer_id int, client_id int, customer_name string, email string")
    corr = spark.createDataFrame([(1, "first", 1), (1, "second", 2), (1, "second", 2), (9, "nobody", 1), (None, "x", 1), (2, " ", 1)],
                                 "customer_id int, customer_name string, n int")
    out = posting.update_master("customer", table, corr, "customer_id", order="n")
    assert sorted((r.customer_id, r.customer_name) for r in out["table"].collect()) == [(1, "second"), (2, "B")]
    assert sorted((r.customer_id or 0, r.error) for r in out["rejected"].collect()) == [
        (0, "customer_id is required"), (1, posting.SUPERSEDED), (1, posting.SUPERSEDED), (2, "customer_name cannot be empty"), (9, "customer_id not found")]
