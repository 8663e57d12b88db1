"""Mixing sources to target weights by subset-sum budget fitting.

Targets: sources in code point order (null last) take the weights in turn and share the words of
all documents; a target stops at ``max_repeats`` times its source, and the excess is shared anew
by weight until no target is above its stop.

Fitting: a source is taken whole ``floor(target / size)`` times.  For the budget that is left,
documents are counted by exact size, and each size gives the same share of its documents.  What
then still lacks is fitted from the spare documents: large sizes first, and for the last stretch
(``WINDOW`` words and a few times the largest size, for which the smallest documents are decided
anew) a bounded-knapsack dynamic programme over the sizes, whose reachable sums are a bit set; if it
misses the budget, it runs again with more documents decided anew.  The
table of counts by size is bounded by the number of different sizes; that is all one task sees of
a source.

Selection: of the documents of one size, those with the smallest seeded hash of their id are
taken.  A large group is cut into hash ranges first, so that only the range which holds the last
taken document is ranked; no group of documents is gathered in a task.

Defined results: a null or word-less text has size 0 and is taken 0 times; a null source is a
source of its own; rows of one id, source and size are interchangeable: they are counted, and each
copy is decided by a hash of its own, so a repeated id does not gather.  Equal input gives equal output.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import with_sequence_id
from .common import cut, ship_by_value, unit_hash

WORD = r"[^\x20\x09-\x0D]+"
WINDOW = 1 << 15
RANGE = 1024
#: Bits that the knapsack's rows may have together when it runs again.
TABLE_BITS = 1 << 31
ship_by_value(__name__)


def targets(sizes: DataFrame, weights: tuple[float, ...], max_repeats: float) -> DataFrame:
    """(source, source_size) -> source, source_size, target; one row per source."""
    named = sizes.withColumn("_last", F.col("source").isNull().cast("int"))
    ranked = with_sequence_id(named, ["_last", "source"], "_rank", start=0)
    table = cut(ranked.select("source", "source_size", (F.col("source_size") * F.lit(float(max_repeats))).alias("_cap"),
                              F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                                           (F.col("_rank") % len(weights) + 1).cast("int")).alias("_w")))
    share, capped = 0.0, -1
    while True:  # each round stops at least one more source at its cap
        over = F.col("_cap") < F.col("_w") * F.lit(share)
        r = table.agg(F.sum("source_size").alias("all"), F.sum(F.when(over, F.col("_cap"))).alias("cap"),
                      F.sum(F.when(~over, F.col("_w"))).alias("w"), F.count(F.when(over, 1)).alias("n")).first()
        if r["n"] == capped or not r["w"]:
            break
        capped, share = r["n"], ((r["all"] or 0) - (r["cap"] or 0.0)) / r["w"]
    return table.select("source", "source_size", F.least("_cap", F.col("_w") * F.lit(share)).alias("target"))


def fit(counts: list[tuple[int, int]], budget: int) -> dict[int, int]:
    """How many documents of each size to take so that their sizes sum to ``budget``, or as near below as can be.

    The programme runs on what is decided anew, starting with little.  Where it misses the budget (by more
    than the sizes' common divisor explains), eight times as much is decided anew, up to all documents; it ends
    before that only if the table of reachable sums would pass ``TABLE_BITS``.
    """
    total = sum(s * c for s, c in counts)
    if budget >= total:
        return dict(counts)
    take = {s: c * budget // total for s, c in counts}
    left = budget - sum(s * k for s, k in take.items())
    spare = {s: c - take[s] for s, c in counts}
    for s in sorted(spare, reverse=True):  # large sizes first, down to the last stretch
        k = min(spare[s], max(0, left - WINDOW) // s)
        take[s], spare[s], left = take[s] + k, spare[s] - k, left - k * s
    step, room, best = math.gcd(*spare), 2 * max(spare), None
    while True:
        kept, free, gap = _free(take, spare, left, room)
        parts = sum(min(n, gap // s).bit_length() for s, n in free.items())
        if best is not None and gap * parts > TABLE_BITS:
            return best[1]
        more, lacks = _knapsack(free, gap)
        if best is None or lacks < best[0]:
            best = lacks, {s: kept[s] + more.get(s, 0) for s in kept}
        if lacks == gap % step or not any(kept.values()):
            return best[1]
        room *= 8


def _free(take: dict[int, int], spare: dict[int, int], left: int, room: int) -> tuple[dict[int, int], dict[int, int], int]:
    """Give back taken documents of about ``room`` words, small sizes first: what stays taken, the free documents, the budget for them."""
    kept, free = dict(take), dict(spare)
    for s in sorted(free):
        k = min(kept[s], -(-room // s))
        kept[s], free[s], left, room = kept[s] - k, free[s] + k, left + k * s, max(0, room - k * s)
    return kept, free, left


def _knapsack(free: dict[int, int], budget: int) -> tuple[dict[int, int], int]:
    """Bounded knapsack: how many free documents of each size to take, and the words that then still lack.

    Bit n of a row says that n words can be reached with the sizes so far."""
    mask, rows, parts = (1 << (budget + 1)) - 1, [1], []
    for s in sorted(free, reverse=True):
        n, step = min(free[s], budget // s), 1
        while n > 0:
            k = min(step, n)
            rows.append((rows[-1] | rows[-1] << (s * k)) & mask)
            parts.append((s, k))
            n, step = n - k, step * 2
        if rows[-1] >> budget & 1:
            break
    at = rows[-1].bit_length() - 1
    lacks, more = budget - at, {}
    for i in range(len(parts) - 1, -1, -1):
        s, k = parts[i]
        if not rows[i] >> at & 1:
            more[s], at = more.get(s, 0) + k, at - s * k
    return more, lacks


def _fit_source(group: pd.DataFrame) -> pd.DataFrame:
    counts = [(int(s), int(c)) for s, c in sorted(zip(group["size"], group["n"], strict=True))]
    size, target = int(group["source_size"].iloc[0]), float(group["target"].iloc[0])
    whole = int(target // size)
    take = fit(counts, int(round(target)) - whole * size) if round(target) < (whole + 1) * size else dict(counts)
    out = group[["source", "size", "n"]].copy()
    out["repeats"], out["extra"] = whole, [take[int(s)] for s in group["size"]]
    return out


def _copies(rows: DataFrame) -> DataFrame:
    """The rows again, with ``_copy``, the number of each among its equals; many copies of one row are dealt out in runs of RANGE."""
    counted = cut(rows.groupBy(*rows.columns).agg(F.count("*").alias("_n")))
    last = lambda n: F.sequence(F.lit(1).cast("long"), n)
    few = counted.where(F.col("_n") <= RANGE).withColumn("_copy", F.explode(last(F.col("_n")))).drop("_n")
    runs = counted.where(F.col("_n") > RANGE).withColumn("_run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / RANGE))))
    runs = runs.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    here = F.least(F.lit(RANGE), F.col("_n") - F.col("_run") * RANGE)
    many = runs.withColumn("_i", F.explode(last(here))).withColumn("_copy", F.col("_run") * RANGE + F.col("_i")).drop("_n", "_run", "_i")
    return few.unionByName(many)


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), max_repeats: int = 3, seed: int = 17) -> DataFrame:
    """(doc_id, text, source) -> doc_id, source, size, source_size, target, repeats, taken."""
    rows = cut(_copies(docs.select("doc_id", "source", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("size")))
               .withColumn("_u", unit_hash(F.col("doc_id"), F.col("_copy"), seed=seed)))
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = cut(targets(sizes, weights, max_repeats))
    counts = rows.where("size > 0").groupBy("source", "size").agg(F.count("*").alias("n"))
    plan = cut(counts.join(goal.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
               .groupBy(F.coalesce("source", F.lit("")), F.col("source").isNull())
               .applyInPandas(_fit_source, "source string, size long, n long, repeats long, extra long"))
    # hash ranges of about RANGE documents; the range with the last taken document is ranked, the others are not
    parts = plan.select(F.col("source").alias("_s"), F.col("size").alias("_z"), "repeats", "extra", F.ceil(F.col("n") / RANGE).alias("_parts"))
    placed = (rows.join(parts, F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z")), "left").drop("_s", "_z")
              .withColumn("_part", F.floor(F.col("_u") * F.col("_parts"))))
    same = F.coalesce(F.col("source"), F.lit("")), F.col("source").isNull(), F.col("size")
    held = (placed.where("_parts > 1 and extra > 0 and repeats is not null").groupBy("source", "size", "_part").agg(F.count("*").alias("_here")))
    before = Window.partitionBy(*same).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = held.select(F.col("source").alias("_s"), F.col("size").alias("_z"), F.col("_part").alias("_p"), "_here",
                         F.coalesce(F.sum("_here").over(before), F.lit(0)).alias("_before"))
    met = placed.join(starts, F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z")) & (F.col("_part") == F.col("_p")), "left").drop("_s", "_z", "_p")
    lacks = F.col("extra") - F.coalesce("_before", F.lit(0))
    small = F.col("_parts") == 1
    sure = (F.when(F.col("extra").isNull() | (F.col("extra") == 0), F.lit(0))
            .when(~small & (lacks >= F.col("_here")), F.lit(1)).when(~small & (lacks <= 0), F.lit(0)))
    met = met.withColumns({"_sure": sure, "_lacks": F.when(small, F.col("extra")).otherwise(lacks)})
    settled = met.where("_sure is not null").withColumn("_more", F.col("_sure"))
    rank = F.row_number().over(Window.partitionBy(*same, F.col("_part")).orderBy("_u", "doc_id", "_copy"))
    ranked = met.where("_sure is null").withColumn("_more", (rank <= F.col("_lacks")).cast("int"))
    g = goal.select(F.col("source").alias("_s"), "source_size", "target")
    return (settled.unionByName(ranked).join(g, F.col("source").eqNullSafe(F.col("_s")))
            .select("doc_id", "source", "size", "source_size", "target", F.coalesce("repeats", F.lit(0)).alias("repeats"),
                    (F.col("size") * (F.coalesce("repeats", F.lit(0)) + F.col("_more"))).cast("long").alias("taken")))
