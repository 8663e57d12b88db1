"""Reproducible surrogate ids without pulling a table into one task.

``row_number() OVER (ORDER BY k)`` with no partition moves every row into a
single task.  ``with_sequence_id`` gives the same numbers the distributed way:
a range-partitioned sort, ``monotonically_increasing_id`` (partition id in the
high bits, position in the low bits), a reliable checkpoint so the partition
layout is fixed, then per-partition counts turned into offsets.  The offsets
table has one row per partition, so broadcasting it is bounded by the
partition count, not by the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

_POS_BITS = 33


def with_sequence_id(df: DataFrame, order_cols: list[str | Column], name: str, start: int = 1) -> DataFrame:
    """Add ``name`` = 1-based position of each row in the total order ``order_cols``.

    ``order_cols`` must be a unique key, otherwise ties are numbered arbitrarily.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    tagged = (
        df.orderBy(*order_cols)
        .withColumn("_lf_mid", F.monotonically_increasing_id())
        .checkpoint(eager=True)
    )
    pid = F.shiftright(F.col("_lf_mid"), _POS_BITS)
    pos = F.col("_lf_mid").bitwiseAND(F.lit((1 << _POS_BITS) - 1))
    # one (partition, count) row per partition: bounded by the partition count, so the prefix
    # offsets are computed on the driver and joined back as a small local relation
    counts = sorted((r[0], r[1]) for r in tagged.groupBy(pid.alias("p")).count().collect())
    offsets, running = [], 0
    for p, n in counts:
        offsets.append((int(p), running))
        running += int(n)
    off_df = spark.createDataFrame(offsets or [(0, 0)], "_lf_pid long, _lf_off long")
    return (
        tagged.withColumn("_lf_pid", pid)
        .join(F.broadcast(off_df), "_lf_pid")
        .withColumn(name, (F.col("_lf_off") + pos + F.lit(start)).cast("long"))
        .drop("_lf_pid", "_lf_off", "_lf_mid")
    )
