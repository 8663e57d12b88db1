"""A versioned manifest: which written parts make up a table right now.

Each version is one small Parquet table under ``path``/version=<n>, and the highest one is the truth.
Data is written first and becomes part of the table when the next version is committed, so a job that
breaks off leaves either the old table or the new one, never a mixture.  One writer at a time.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F


class Manifest:
    """Rows of ``schema`` (one per label of the table, so few) in versions under ``path``."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def latest(self) -> tuple[int, list[Row]]:
        """The highest committed version and its rows; (0, []) before the first commit."""
        try:
            versions = self.spark.read.schema(f"{self.schema}, version int").parquet(self.path)
            top = versions.agg(F.max("version")).first()[0]
        except AnalysisException:
            return 0, []
        if top is None:
            return 0, []
        return top, versions.where(F.col("version") == top).drop("version").collect()

    def commit(self, version: int, rows: list) -> None:
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/version={version}")


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a folder of any file system that Spark reaches, if it is there."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(target):
        files.delete(target, True)


def union_parts(spark: SparkSession, schema: str, paths: list[str]) -> DataFrame:
    """The rows of the given part folders (none: an empty table)."""
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
