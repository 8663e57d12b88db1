"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import sys
import uuid
from functools import reduce

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def ship_by_value(module_name: str) -> None:
    """Pickle a module's functions by value, so tasks need no copy of this package on the executors."""
    cloudpickle.register_pickle_by_value(sys.modules[module_name])


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared ``spark.checkpoint.dir``.

    The files outlive any executor.  Only narrow frames (ids, hashes, counts) are cut this way.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table in the shared ``spark.checkpoint.dir``, read back.

    Like ``cut``, but compressed, and the plan that reads it knows no partitioning, so that a join on
    it shuffles both sides and the adaptive planner can split the hot keys.
    """
    folder = f"{ensure_checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def bounded_broadcast(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """A narrow checkpointed frame, marked for broadcast only if it has at most ``rows`` rows."""
    df = cut(df)
    return F.broadcast(df) if df.count() <= rows else df


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only; every other character stays."""
    return F.translate(c, UPPER, LOWER)


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id written as text, modulo ``n`` (a null id counts as the empty text)."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def unit_hash(*cols: Column, seed: int) -> Column:
    """A seeded hash of the columns as a double in [0, 1)."""
    h = F.xxhash64(F.lit(seed), *cols)
    return F.shiftrightunsigned(h, 11).cast("double") / F.lit(float(1 << 53))


def all_of(conditions) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, rows: int, max_chars: int,
                    seed: int) -> list[tuple[str, int]]:
    """At most ``rows`` labelled texts for a classifier to be fitted on, each cut to ``max_chars``.

    ``learn`` is a condition on ``doc_id`` that keeps held-out rows out.  The ids are drawn by a
    seeded hash, so the sample is the same in every run; the id list has at most ``rows`` entries,
    which bounds its broadcast.  Documents that share an id count once, by their smallest cut text that is
    not empty, so the texts that come back are bounded by ``rows * max_chars``.
    """
    own = (labels.select("doc_id", F.col(label).cast("int").alias("_y")).where(F.col("doc_id").isNotNull() & F.col("_y").isin(0, 1))
           .where(learn).groupBy("doc_id").agg(F.max("_y").alias("_y")))
    drawn = own.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(rows)
    text = F.substring("text", 1, max_chars)
    texts = (docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").groupBy("doc_id", "_y")
             .agg(F.coalesce(F.min(F.when(text != "", text)), F.lit("")).alias("_text")))
    return [(r["_text"], r["_y"]) for r in sorted(texts.collect(), key=lambda r: (r["doc_id"], r["_text"]))]


def runs_of(texts, limit: int = 1 << 17):
    """Consecutive texts with about ``limit`` characters, so that memory is bounded by it and the longest text."""
    run, size = [], 0
    for t in texts:
        run.append(t)
        size += len(t)
        if size >= limit:
            yield run
            run, size = [], 0
    if run:
        yield run


ship_by_value(__name__)
