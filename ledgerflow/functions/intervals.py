"""Which interval is in force at a point: an equi join over dyadic blocks.

``as_of`` gives every row of a fact table the carried columns of the interval [start, end) that
holds its point; of several, the one that starts latest.  Nothing is collected, nothing is
compared pair by pair and no key is swept in order: on a line of whole numbers, an interval is cut
into its canonical dyadic blocks (at most two a level, so about twice the logarithm of its
length), and a point lies in one block of each level.  Each block keeps the best interval that
covers it, so the join finds at most one row a level, and the largest of them is the answer.

Points meet the blocks once for each distinct (key, point), so a key with a third of all rows costs no
more than its distinct points; the block table is dealt out evenly before the join, whose larger side
adaptive execution can therefore split.  Open-ended intervals end with the line.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Line by type: conversion to whole numbers, and the levels that cover it.
_LINES = {T.DateType: (F.unix_date, 23), T.TimestampType: (F.unix_micros, 59)}


def _line(df: DataFrame, name: str) -> tuple[Column, int]:
    kind = type(df.schema[name].dataType)
    if kind in _LINES:
        convert, levels = _LINES[kind]
        return convert(F.col(name)).cast("long"), levels
    if kind in (T.ByteType, T.ShortType, T.IntegerType, T.LongType):
        return F.col(name).cast("long"), 61
    raise ValueError(f"{name}: a date, a timestamp or a whole number is asked for")


def dyadic_blocks(start: Column, end: Column, levels: int) -> Column:
    """array<struct<level, block>>: the canonical blocks of [start, end); block b of level k is [b 2^k, (b + 1) 2^k)."""
    def of(k: Column) -> Column:
        low = -F.call_function("shiftright", -start, k)  # rounded up
        high = F.call_function("shiftright", end, k)
        at = lambda block: F.struct(k.alias("level"), block.alias("block"))
        left = F.when((low < high) & (low % 2 != 0), at(low))
        right = F.when((low < high) & (high % 2 != 0), at(high - 1))
        return F.array_compact(F.array(left, right))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(levels)), of))


def as_of(points: DataFrame, intervals: DataFrame, by: Sequence[str], at: str, start: str, end: str, carry: Sequence[str]) -> DataFrame:
    """``points`` with ``carry`` of the interval in force: start ≤ at < end (null end: open), the latest start, then the largest ``carry``.

    ``by`` are equal columns of both sides.  A null point, key or start has no interval; the carried columns are null then.
    """
    keys = [f"_by{i}" for i in range(len(by))]
    from_, levels = _line(intervals, start)
    upto, _ = _line(intervals, end)
    upto = F.least(F.coalesce(upto, F.lit(1 << (levels - 1))), F.lit(1 << (levels - 1)))
    best = F.struct(from_.alias("start"), *[F.col(c).alias(c) for c in carry])
    blocks = (intervals.where(F.col(start).isNotNull()).select(*[F.col(c).alias(k) for c, k in zip(by, keys)], best.alias("_best"),
                                                              F.inline(dyadic_blocks(from_, upto, levels)))
              .groupBy(*keys, "level", "block").agg(F.max("_best").alias("_best")))
    # dealt out anew, so that the join below shuffles both sides and can split the points of a hot block
    blocks = blocks.repartition(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    place, _ = _line(points, at)
    times = points.where(F.col(at).isNotNull()).select(*[F.col(c).alias(k) for c, k in zip(by, keys)], place.alias("_at")).distinct()
    probes = times.select("*", F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("level")).withColumn("block", F.expr("shiftright(_at, level)"))
    found = probes.join(blocks, [*keys, "level", "block"]).groupBy(*keys, "_at").agg(F.max("_best").alias("_best"))
    found = found.repartition(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    same = place == F.col("_at")
    for c, k in zip(by, keys):
        same = same & (F.col(c) == F.col(k))
    return points.join(found, same, "left").select(*[F.col(c) for c in points.columns], *[F.col(f"_best.{c}").alias(c) for c in carry])
