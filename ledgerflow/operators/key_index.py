"""P11 / E8 — an index of idempotency keys: one part per date or batch, with Bloom blocks in front.

A ledger's keys are written in parts (a month of the ledger, a batch of a stream).  Beside the keys
of a part lie its Bloom blocks: a key belongs to one of the part's blocks and sets four bits there,
and a block is stored as its 64-bit words that are not zero, about a tenth of the keys' size.  A
batch of requests is first tested against the blocks of all parts, an equi join on (block, word);
the parts in which no key of the batch can be are not opened at all.  The exact join then reads the
keys of the other parts only, so a false hit of the blocks costs reading, never a wrong result.

Parts are added and replaced one by one (writing a part again overwrites it), so a replayed batch
leaves the index as it was.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORDS = 64
PROBES = 4
_BLOOM = "block long, word int, bits long"


def _blocks_for(keys: int) -> int:
    """Blocks of 64 words of 64 bits with room for about 400 keys each: a power of two, so that parts share probes."""
    n = 1
    while n * 400 < keys:
        n *= 2
    return n


def _probes(key: Column) -> Column:
    """array<struct<word, mask>>: the bits that a key sets in its block."""
    def one(i: int) -> Column:
        h = F.xxhash64(F.lit(i), key)
        bit = F.pmod(h, F.lit(64)).cast("int")
        return F.struct(F.pmod(F.shiftright(h, 6), F.lit(WORDS)).cast("int").alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("mask"))

    return F.array(*[one(i) for i in range(1, PROBES + 1)])


class KeyIndex:
    """Keys (``idempotency_key``, ``transaction_id``) under ``path``/keys/part=<label> and ``path``/blooms/part=<label>."""

    def __init__(self, spark: SparkSession, path: str, key_type: str = "long"):
        self.spark, self.path = spark, path.rstrip("/")
        self.keys_schema = f"idempotency_key string, transaction_id {key_type}"

    def _dir(self, kind: str, part) -> str:
        return f"{self.path}/{kind}/part={part}"

    def add(self, part, keys: DataFrame) -> None:
        """Write (or replace) one part."""
        keys.where(F.col("idempotency_key").isNotNull()).select("idempotency_key", "transaction_id").write.mode("overwrite").parquet(self._dir("keys", part))
        own = self.spark.read.schema(self.keys_schema).parquet(self._dir("keys", part))
        blocks = _blocks_for(own.count())
        bits = own.select(F.pmod(F.xxhash64("idempotency_key"), F.lit(blocks)).alias("block"), F.inline(_probes(F.col("idempotency_key"))))
        (bits.groupBy("block", "word").agg(F.bit_or("mask").alias("bits")).withColumn("blocks", F.lit(blocks))
         .write.mode("overwrite").parquet(self._dir("blooms", part)))

    def candidates(self, keys: DataFrame, parts: Iterable) -> list:
        """The parts that may hold a key of ``keys`` (``idempotency_key``); never misses one that does."""
        parts = list(parts)
        if not parts:
            return []
        blooms = (self.spark.read.schema(f"{_BLOOM}, blocks int, part string").option("basePath", f"{self.path}/blooms")
                  .parquet(*[self._dir("blooms", p) for p in parts]))
        sizes = F.array(*[F.lit(1 << i) for i in range(40)])
        used = [r["blocks"] for r in blooms.select("blocks").distinct().collect()]  # powers of two: a few numbers
        wanted = keys.select("idempotency_key").distinct().withColumn("blocks", F.explode(F.filter(sizes, lambda n: n.isin(*used) if used else F.lit(False))))
        probes = wanted.select("idempotency_key", F.col("blocks").cast("int").alias("blocks"), F.pmod(F.xxhash64("idempotency_key"), F.col("blocks")).alias("block"),
                               F.inline(_probes(F.col("idempotency_key"))))
        hits = (probes.join(blooms, ["blocks", "block", "word"]).where(F.col("bits").bitwiseAND(F.col("mask")) != 0)
                .groupBy("part", "idempotency_key").agg(F.count("*").alias("_n")).where(F.col("_n") == PROBES))
        held = {r["part"] for r in hits.select("part").distinct().collect()}  # at most one row per part
        return [p for p in parts if str(p) in held]

    def lookup(self, keys: DataFrame, parts: Iterable) -> DataFrame:
        """idempotency_key, transaction_id of the parts that may hold a key of ``keys``; others are not read."""
        paths = [self._dir("keys", p) for p in self.candidates(keys, parts)]
        if not paths:
            return self.spark.createDataFrame([], self.keys_schema)
        return self.spark.read.schema(self.keys_schema).parquet(*paths)
