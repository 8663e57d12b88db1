"""A3 / A4 / A13 — differences of written snapshots: digests per key bucket first, rows only where they differ.

A snapshot is written in buckets of its key, with a digest of each bucket: the number of rows and two
sums of 64-bit row hashes, which no order of rows can change.  Two snapshots are compared by their
digests; only buckets whose digests differ are read, and since a key is in the same bucket of every
snapshot, the change audit of these buckets is the change audit of the whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_DIGEST = "bucket int, n long, a decimal(38,0), b decimal(38,0)"


def _row_hash(seed: int, columns: list[str]) -> Column:
    # a null leaves a hash as it is, so the places of nulls are hashed too
    return F.xxhash64(F.lit(seed), *[F.col(c) for c in columns], *[F.col(c).isNull() for c in columns]).cast("decimal(38,0)")


class Snapshot:
    """One written snapshot: ``path``/rows/bucket=<n> and ``path``/digests."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def write(self, rows: DataFrame, key: str, buckets: int = 64) -> Snapshot:
        """Write ``rows`` in buckets of ``key``; snapshots that are compared have equally many."""
        names = rows.columns
        dealt = rows.withColumn("bucket", F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int"))
        dealt.hint("rebalance", F.col("bucket")).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/rows")
        own = self.rows(rows.schema.simpleString()[7:-1].replace(":", " "), None)
        (own.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum(_row_hash(1, names)).cast("decimal(38,0)").alias("a"),
                                   F.sum(_row_hash(2, names)).cast("decimal(38,0)").alias("b"))
         .coalesce(1).write.mode("overwrite").parquet(f"{self.path}/digests"))
        return self

    def rows(self, schema: str, buckets: list[int] | None) -> DataFrame:
        """Rows with their ``bucket``; with ``buckets``, only those folders are listed and read."""
        rows = self.spark.read.schema(f"{schema}, bucket int").parquet(f"{self.path}/rows")
        return rows if buckets is None else rows.where(F.col("bucket").isin(buckets) if buckets else F.lit(False))

    def digests(self) -> DataFrame:
        return self.spark.read.schema(_DIGEST).parquet(f"{self.path}/digests")


def changed_buckets(before: Snapshot, after: Snapshot) -> list[int]:
    """The buckets whose digests differ (at most as many as there are buckets)."""
    a, b = before.digests().alias("a"), after.digests().alias("b")
    same = F.col("a.n").eqNullSafe(F.col("b.n")) & F.col("a.a").eqNullSafe(F.col("b.a")) & F.col("a.b").eqNullSafe(F.col("b.b"))
    differ = a.join(b, F.col("a.bucket") == F.col("b.bucket"), "full").where(~same)
    return sorted(r["bucket"] for r in differ.select(F.coalesce("a.bucket", "b.bucket").alias("bucket")).collect())


def changed_rows(before: Snapshot, after: Snapshot, schema: str) -> tuple[DataFrame, DataFrame]:
    """The rows of both snapshots in the buckets that differ, as input of any change audit."""
    buckets = changed_buckets(before, after)
    return before.rows(schema, buckets).drop("bucket"), after.rows(schema, buckets).drop("bucket")
