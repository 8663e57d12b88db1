"""T — time partitioning, hot / cold tiering and archiving.

The reference creates one table partition per month or ISO week and moves old
ones to a cold tablespace.  Here the partition is a Parquet directory
(``partitionBy``), so filters on the label are pruned at planning time, and
tiering is a label comparison.  ``TierStore`` keeps the tiers up to date: a later run moves only the
labels that have crossed the cutoff since, and a manifest says which copy of a label counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .manifest import Manifest, drop_path


def partition_label(date_col: str | Column, grain: str = "month") -> Column:
    """``YYYY_MM_m<month>`` of the month start, or ``YYYY_MM_wk<ISO week>`` of the week's Monday."""
    d = F.col(date_col) if isinstance(date_col, str) else date_col
    if grain == "month":
        start = F.trunc(d, "month")
        return F.concat(F.date_format(start, "yyyy_MM"), F.lit("_m"), F.month(start).cast("string"))
    if grain == "week":
        start = F.date_trunc("week", d).cast("date")
        return F.concat(F.date_format(start, "yyyy_MM"), F.lit("_wk"), F.weekofyear(start).cast("string"))
    raise ValueError(f"unknown grain {grain!r}")


def period_start(date_col: str | Column, grain: str) -> Column:
    d = F.col(date_col) if isinstance(date_col, str) else date_col
    return F.trunc(d, "month") if grain == "month" else F.date_trunc("week", d).cast("date")


def with_partition_label(df: DataFrame, date_col: str, grain: str = "month") -> DataFrame:
    return df.withColumn("partition_label", partition_label(date_col, grain))


def write_partitioned(df: DataFrame, date_col: str, path: str, grain: str = "month") -> None:
    """Write ``df`` partitioned by its month or ISO-week label (one directory per partition).

    Rows are clustered by label first, so a label is not written by every task; REBALANCE lets
    adaptive execution split a heavy label over several tasks and merge light ones."""
    labelled = with_partition_label(df, date_col, grain)
    labelled.hint("rebalance", F.col("partition_label")).write.mode("overwrite").partitionBy("partition_label").parquet(path)


def cutoff_of(as_of: str, grain: str = "month") -> Column:
    """The latest period start that is cold on ``as_of``."""
    return period_start(F.date_sub(F.lit(as_of).cast("date"), 30 if grain == "month" else 7), grain)


def tier_partitions(df: DataFrame, date_col: str, as_of: str, grain: str = "month") -> DataFrame:
    """HOT / COLD per row: a partition is cold once its period starts on or before the period
    of as_of − 30 days (month) or as_of − 7 days (week)."""
    return (with_partition_label(df, date_col, grain)
            .withColumn("tier", F.when(period_start(date_col, grain) <= cutoff_of(as_of, grain), "COLD").otherwise("HOT")))


def write_tiers(df: DataFrame, date_col: str, hot_path: str, cold_path: str, as_of: str, grain: str = "month") -> None:
    """Write the hot partitions to one storage path and the cold ones to another, each partitioned by label."""
    tiered = tier_partitions(df, date_col, as_of, grain)
    for label, path in (("HOT", hot_path), ("COLD", cold_path)):
        rows = tiered.where(F.col("tier") == label).drop("tier")
        rows.hint("rebalance", F.col("partition_label")).write.mode("overwrite").partitionBy("partition_label").parquet(path)


def archive_split(df: DataFrame, date_col: str, as_of: str, months: int = 12) -> tuple[DataFrame, DataFrame]:
    """(rows to archive: older than as_of − months, rows kept)."""
    cut = F.add_months(F.lit(as_of).cast("date"), -months)
    old = F.col(date_col) < cut
    return df.where(old), df.where(~old | F.col(date_col).isNull())


class TierStore:
    """A table in two storage paths, moved label by label as time goes on.

    The manifest holds one row per label: its period start and the tier whose copy counts.  A move copies
    the labels that crossed the cutoff to the cold path (dynamic partition overwrite: other labels are not
    touched), commits the manifest and then drops the hot copies.  Broken off before the commit, the hot copy
    still counts and the next run copies again; broken off after it, the next run drops what is left.
    """

    def __init__(self, spark: SparkSession, base: str, date_col: str, schema, grain: str = "month"):
        self.spark, self.date_col, self.grain = spark, date_col, grain
        self.paths = {"HOT": f"{base.rstrip('/')}/hot", "COLD": f"{base.rstrip('/')}/cold"}
        self.schema = spark.createDataFrame([], schema).withColumn("partition_label", F.lit(None).cast("string")).schema
        self.manifest = Manifest(spark, f"{base.rstrip('/')}/manifest", "partition_label string, start date, tier string")

    def load(self, df: DataFrame, as_of: str) -> None:
        """First load: both paths whole, and the first manifest."""
        write_tiers(df, self.date_col, self.paths["HOT"], self.paths["COLD"], as_of, self.grain)
        tiers = tier_partitions(df, self.date_col, as_of, self.grain).select(
            "partition_label", period_start(self.date_col, self.grain).alias("start"), "tier").distinct()
        self.manifest.commit(1, [tuple(r) for r in tiers.collect()])  # one row per label

    def _copy(self, tier: str, labels: list) -> DataFrame:
        rows = self.spark.read.schema(self.schema).parquet(self.paths[tier])
        known = [x for x in labels if x is not None]
        keep = F.col("partition_label").isin(known) if known else F.lit(False)
        return rows.where(keep | F.col("partition_label").isNull() if None in labels else keep)

    def advance(self, as_of: str) -> list[str]:
        """Move the labels that have become cold; returns them."""
        version, rows = self.manifest.latest()
        cut = self.spark.range(1).select(cutoff_of(as_of, self.grain).alias("c")).first()["c"]
        crossed = sorted(r["partition_label"] for r in rows if r["tier"] == "HOT" and r["start"] is not None and r["start"] <= cut)
        if crossed:
            moved = self._copy("HOT", crossed).hint("rebalance", F.col("partition_label"))
            moved.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("partition_label").parquet(self.paths["COLD"])
            self.manifest.commit(version + 1, [(r["partition_label"], r["start"], "COLD" if r["partition_label"] in crossed else r["tier"]) for r in rows])
        self._drop_stale()
        return crossed

    def _drop_stale(self) -> None:
        """Drop hot copies of labels that are cold by the manifest."""
        for r in self.manifest.latest()[1]:
            if r["tier"] == "COLD":
                drop_path(self.spark, f"{self.paths['HOT']}/partition_label={r['partition_label']}")

    def read(self) -> DataFrame:
        """All rows with label and tier, each label from the copy that counts."""
        rows = self.manifest.latest()[1]
        parts = [self._copy(t, [r["partition_label"] for r in rows if r["tier"] == t]).withColumn("tier", F.lit(t)) for t in ("HOT", "COLD")]
        return parts[0].unionByName(parts[1])
