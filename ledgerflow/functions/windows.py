"""Skew-safe window building blocks.

``running_sum`` is a per-key cumulative sum that never puts a whole key into one window
partition: rows are grouped into ordered chunks ``(leading order columns, id div chunk)``, which
hold at most ``chunk`` rows because ids are unique integers.  Rows are shuffled once, by (key,
chunk); chunk totals are summed per key, and the per-row sum is the chunk's offset plus a running
sum inside the chunk.  With a date as the leading order column a key has about one total per
day (and per ``chunk`` ids), however many rows it has, so a key with a third of all rows is spread
over its days and only its totals meet in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Order = Sequence[tuple[str, bool]]  # (column, ascending)


def sort_columns(cols: Order, names: Sequence[str] | None = None) -> list[Column]:
    out = []
    for i, (c, asc) in enumerate(cols):
        name = names[i] if names else c
        out.append(F.col(name).asc() if asc else F.col(name).desc())
    return out


def running_sum(df: DataFrame, keys: Sequence[str], order: Order, value: str, out: str,
                chunk: int = 1 << 20, inclusive: bool = True) -> DataFrame:
    """Add ``out`` = Σ ``value`` over rows of the same ``keys`` up to this row in ``order``.

    The last ``order`` column must be a unique integer id (tie breaker).
    ``inclusive=False`` gives the sum strictly before the row.
    """
    *lead, (last, last_asc) = order
    ckeys = [*keys, *[c for c, _ in lead], "_rs_chunk"]
    corder = [*lead, ("_rs_chunk", last_asc)]
    # totals and row sums below both find the rows in this partitioning
    chunks = df.withColumn("_rs_chunk", F.floor(F.col(last) / F.lit(chunk))).repartition(*ckeys)
    totals = chunks.groupBy(*ckeys).agg(F.sum(value).alias("_rs_ct"))
    w_chunks = Window.partitionBy(*keys).orderBy(*sort_columns(corder)).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*ckeys, F.coalesce(F.sum("_rs_ct").over(w_chunks), F.lit(0)).alias("_rs_off"))
    w_rows = Window.partitionBy(*ckeys).orderBy(*sort_columns(order))
    frame = w_rows.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    local = chunks.withColumn("_rs_loc", F.coalesce(F.sum(value).over(frame), F.lit(0)))
    return (local.join(offsets, ckeys)
            .withColumn(out, F.col("_rs_off") + F.col("_rs_loc"))
            .drop("_rs_chunk", "_rs_off", "_rs_loc"))


def chunked_lag(df: DataFrame, keys: Sequence[str], order_id: str, value: str, out: str,
                chunk: int = 4096) -> DataFrame:
    """``out`` = ``value`` of the previous row of the same ``keys`` in ``order_id`` order.

    The row-level window runs over (keys, id div chunk) groups of at most ``chunk`` rows; the
    first row of a chunk takes the last value of the previous non-empty chunk from the chunk table.
    """
    c = F.floor(F.col(order_id) / F.lit(chunk))
    d = df.withColumn("_cl_chunk", c)
    w_rows = Window.partitionBy(*keys, "_cl_chunk").orderBy(order_id)
    d = (d.withColumn("_cl_prev", F.lag(value).over(w_rows))
          .withColumn("_cl_first", F.row_number().over(w_rows) == 1))
    last = d.groupBy(*keys, "_cl_chunk").agg(F.max_by(value, order_id).alias("_cl_last"))
    w_chunks = Window.partitionBy(*keys).orderBy("_cl_chunk")
    last = last.select(*keys, "_cl_chunk", F.lag("_cl_last").over(w_chunks).alias("_cl_before"))
    return (d.join(last, [*keys, "_cl_chunk"])
             .withColumn(out, F.when(F.col("_cl_first"), F.col("_cl_before")).otherwise(F.col("_cl_prev")))
             .drop("_cl_chunk", "_cl_prev", "_cl_first", "_cl_before"))
