"""B1 / L8 — balances as of any day from maintained daily sums, without scanning the ledger's legs.

Legs are posted in batches.  A batch adds one row per chart and day to the tail; ``fold`` merges the
tail into the base, which holds daily sums by month and one total per chart and month.  A month's
days are written to a folder of their own for each fold that touches them, and a manifest names the
folder that counts, so postings to an old day rewrite that month and nothing else, and a fold that
breaks off changes nothing.  A balance as of a day is the sum of the months before it, of the days of
its month up to it, and of the tail: it reads a row per chart and month, the months asked for, and
the batches since the last fold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .manifest import Manifest, union_parts

_DAYS = "chart_id long, date date, net long"
_KEPT = "month string, folder string, upto long"


def _month(day: Column) -> Column:
    return F.coalesce(F.date_format(day, "yyyyMM"), F.lit("none"))


class BalanceStore:
    """Daily net cents (debit less credit) of every chart under ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.manifest = Manifest(spark, f"{self.path}/manifest", _KEPT)

    def post(self, batch: int, legs: DataFrame) -> None:
        """Add batch number ``batch`` (1, 2, ...) of legs (chart_id, date, journal, amount); written again, it replaces itself."""
        cents = (F.when(F.col("journal"), F.col("amount")).otherwise(-F.col("amount")) * 100).cast("long")
        (legs.groupBy(F.col("chart_id").cast("long").alias("chart_id"), "date").agg(F.sum(cents).alias("net"))
         .write.mode("overwrite").parquet(f"{self.path}/tail/batch={batch}"))

    def _state(self) -> tuple[int, dict[str, str], int]:
        version, rows = self.manifest.latest()
        return version, {r["month"]: r["folder"] for r in rows}, max((r["upto"] for r in rows), default=0)

    def _tail(self, after: int, upto: int) -> DataFrame:
        return union_parts(self.spark, _DAYS, [f"{self.path}/tail/batch={b}" for b in range(after + 1, upto + 1)])

    def fold(self, upto: int) -> list[str]:
        """Merge the batches up to ``upto`` into the base; returns the months that were rewritten."""
        version, folders, done = self._state()
        tail = self._tail(done, upto).withColumn("month", _month(F.col("date")))
        months = sorted(r["month"] for r in tail.select("month").distinct().collect())  # one row per month
        if not months:
            return []
        old = union_parts(self.spark, _DAYS, [f"{self.path}/days/{folders[m]}/month={m}" for m in months if m in folders])
        merged = (old.withColumn("month", _month(F.col("date"))).unionByName(tail).groupBy("chart_id", "date", "month")
                  .agg(F.sum("net").alias("net")))
        folder = f"fold={version + 1}"
        merged.select("chart_id", "date", "net", "month").hint("rebalance", F.col("month")).write.mode("overwrite").partitionBy("month").parquet(f"{self.path}/days/{folder}")
        written = self.spark.read.schema(f"{_DAYS}, month string").parquet(f"{self.path}/days/{folder}")
        written.groupBy("chart_id", "month").agg(F.sum("net").alias("net")).write.mode("overwrite").partitionBy("month").parquet(f"{self.path}/months/{folder}")
        folders |= {m: folder for m in months}
        self.manifest.commit(version + 1, [(m, f, upto) for m, f in sorted(folders.items())])
        return months

    def as_of(self, points: DataFrame, batches: int) -> DataFrame:
        """``points`` (chart_id, date) -> chart_id, date, balance_cents over the batches 1 .. ``batches``."""
        _, folders, done = self._state()
        p = points.select(F.col("chart_id").cast("long").alias("chart_id"), "date").distinct().withColumn("month", _month(F.col("date")))
        asked = {r["month"] for r in p.select("month").distinct().collect()}
        part = lambda kind, m: f"{self.path}/{kind}/{folders[m]}/month={m}"
        days = union_parts(self.spark, _DAYS, [part("days", m) for m in sorted(folders) if m in asked])
        totals = None
        if folders:  # the month is a folder's name, which the files do not hold
            totals = (self.spark.read.schema("chart_id long, net long, fold int, month string").option("basePath", f"{self.path}/months")
                      .parquet(*[part("months", m) for m in sorted(folders)]))
        tail = self._tail(done, batches).select("chart_id", "date", "net").where(F.col("date").isNotNull())
        flag = lambda df, n: df.withColumn("_tag", F.lit(n))
        upto = lambda *by: Window.partitionBy("chart_id", *by).rowsBetween(Window.unboundedPreceding, 0)
        asked_rows = flag(p.withColumn("net", F.lit(0).cast("long")), 1)
        # days of the point's month up to it
        own = flag(days.where(F.col("date").isNotNull()).withColumn("month", _month(F.col("date"))), 0).unionByName(asked_rows)
        own = own.withColumn("_days", F.sum("net").over(upto("month").orderBy("date", "_tag"))).where("_tag = 1").select("chart_id", "date", "_days")
        # months before it
        months = flag(p.select("chart_id", "month", F.lit(0).cast("long").alias("net")).distinct(), 0)
        if totals is not None:
            months = flag(totals.where(F.col("month") != "none").select("chart_id", "month", "net"), 1).unionByName(months)
        months = (months.withColumn("_months", F.sum("net").over(upto().orderBy("month", "_tag"))).where("_tag = 0")
                  .select("chart_id", "month", "_months"))
        # and the tail
        late = flag(tail, 0).unionByName(asked_rows.drop("month"))
        late = late.withColumn("_tail", F.sum("net").over(upto().orderBy("date", "_tag"))).where("_tag = 1").select("chart_id", "date", "_tail")
        return (p.join(own, ["chart_id", "date"]).join(months, ["chart_id", "month"]).join(late, ["chart_id", "date"])
                .select("chart_id", "date", (F.col("_days") + F.col("_months") + F.col("_tail")).alias("balance_cents")))
