"""Benchmark decontamination: size-partitioned min-hash containment search, verified exactly.

Items and documents are sets of hashed five-word shingles (words are runs of letters and digits,
lower-cased).  A document contains an item if it holds at least ``threshold`` of the item's
different shingles, wherever they stand in it: repeated phrases, inserted text and the place of the
leak do not matter.

Items are partitioned by size into classes of doubling numbers of shingles.  The signature of an item
is the shingle with the least value under each of m hash functions; a document that holds a share c
of the item's shingles holds each of these with probability c, so the hits of a signature in a
document estimate containment, however long the document is.  A class of larger items has a longer
signature and asks for more hits; the number asked for is the largest that loses a document at the
threshold with a probability of at most ``MISS`` (a binomial tail).  Items of up to ``SHORT`` shingles
take an exact way: a document that holds ceil(t q) of q shingles holds one of any q - ceil(t q) + 1
of them.  A document also needs as many shingles as the item asks for, so the long items' classes skip
short documents.  Candidates are verified on all shingles that document and item share.

The tables of item shingles are broadcast in blocks of about ``block_shingles`` shingles, which bounds
their size; more items mean more passes, never more memory.  Nothing but document shingles that
occur in an item is shuffled, by document, so a hot source or item does not meet in one task.

Defined results: a null text has no shingles; a text of fewer than five words has none either, so
such an item matches nothing and such a document is clean; repeated documents or items count once
per id; one row per (doc_id, item_id) with its largest containment.  A null id matches like any other.
"""

from __future__ import annotations

from math import comb

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_broadcast, free_name, union_all, written

SHINGLE = 5
#: Items of at most so many shingles are found exactly.
SHORT = 16
#: Largest probability that the signature search loses a document that holds just the threshold.
MISS = 1e-6


def shingles(texts: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``_sh``, the array of hashed shingles of the text in order (empty below five words)."""
    joined = F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    words = texts.withColumn("_w", F.transform(F.split(joined, " "), lambda w: F.xxhash64(w)))
    n = F.size("_w")
    gram = lambda i: F.xxhash64(*[F.get("_w", i + k) for k in range(SHINGLE)])
    none = F.array().cast("array<bigint>")
    return words.withColumn("_sh", F.when(n >= SHINGLE, F.transform(F.sequence(F.lit(0), n - SHINGLE), gram)).otherwise(none)).drop("_w")


def item_sets(items: DataFrame, id_col: str) -> DataFrame:
    """Items with their distinct shingles and a key."""
    sets = (shingles(items.select(F.col(id_col).alias("_item"), F.col("text").alias("text")))
            .select("_item", F.array_distinct("_sh").alias("_ish")).distinct())
    return sets.select("_item", "_ish", F.size("_ish").alias("_q"), F.xxhash64("_item", "_ish").alias("_key"))


def find_contained(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", threshold: float = 0.8,
                   block_shingles: int = 1_000_000) -> DataFrame:
    """(doc_id, text) x (item_id, text) -> doc_id, item_id, containment of at least ``threshold``."""
    return (_contained(docs, items, doc_id, item_id, threshold, block_shingles)
            .groupBy("_doc", "_item").agg(F.max("containment").alias("containment"))
            .select(F.col("_doc").alias(doc_id), F.col("_item").alias(item_id), "containment"))


def _contained(docs: DataFrame, items: DataFrame, doc_id: str, item_id: str, threshold: float, block_shingles: int) -> DataFrame:
    """_doc, _text (hash of the text), _item, containment."""
    sets = item_sets(items, item_id)
    blocks = max(1, -(-(sets.agg(F.sum("_q")).first()[0] or 0) // block_shingles))
    hashed = (shingles(docs.select(F.col(doc_id).alias("_doc"), F.col("text").alias("text")))
              .select("_doc", F.xxhash64(F.coalesce("text", F.lit(""))).alias("_text"), "_sh"))
    found = [_search(hashed, sets.where(F.pmod(F.col("_key"), F.lit(blocks)) == b) if blocks > 1 else sets, threshold)
             for b in range(blocks)]
    return union_all(found)


def size_class(q: int) -> tuple[int, int]:
    """Class and number of hash functions of an item of ``q`` shingles: 16 for up to 32, half as many more each time the size doubles, 64 at most."""
    k = max(0, (q - 1).bit_length() - 5)
    return k, min(64, 16 + 8 * k)


def hits_asked(m: int, threshold: float) -> int:
    """The largest number of m hits that a document at the threshold misses with a probability of at most ``MISS``; at least one."""
    tail, r = 0.0, 0
    while r < m:
        tail += comb(m, r) * threshold ** r * (1 - threshold) ** (m - r)
        if tail > MISS:
            break
        r += 1
    return max(1, r)


def signatures(sets: DataFrame, threshold: float) -> DataFrame:
    """_s, _key, _weight, _asked: the shingles that stand for an item, and the weight that makes it a candidate.

    Items of up to ``SHORT`` shingles: the prefix, of which one is enough.  Larger ones: the least shingle of each hash
    function; a shingle that is the least of several counts as often.
    """
    grams = sets.select("_key", "_q", F.explode("_ish").alias("_s"))
    need = F.ceil(F.col("_q") * F.lit(threshold) - F.lit(1e-9))  # a rounded product must not shorten the prefix
    place = F.row_number().over(Window.partitionBy("_key").orderBy("_s"))
    short = (grams.where(F.col("_q") <= SHORT).withColumn("_place", place).where(F.col("_place") <= F.col("_q") - need + 1)
             .select("_s", "_key", F.lit(1).alias("_weight"), F.lit(1).alias("_asked")))
    classes = [size_class(1 << k) for k in range(5, 12)]
    size = F.least(F.greatest(F.ceil(F.log2(F.col("_q")) - 1e-9) - 5, F.lit(0)), F.lit(len(classes) - 1)).cast("int")
    functions = F.element_at(F.array(*[F.lit(m) for _, m in classes]), size + 1)
    asked = F.element_at(F.array(*[F.lit(hits_asked(m, threshold)) for _, m in classes]), size + 1)
    values = (sets.where(F.col("_q") > SHORT).select("_key", "_ish", asked.alias("_asked"), F.explode(F.sequence(F.lit(1), functions)).alias("_f")))
    least = F.array_min(F.transform("_ish", lambda s: F.struct(F.xxhash64(F.col("_f"), s).alias("h"), s.alias("s"))))
    long = (values.select("_key", "_asked", least["s"].alias("_s")).groupBy("_s", "_key")
            .agg(F.count("*").cast("int").alias("_weight"), F.first("_asked").alias("_asked")))
    return short.unionByName(long)


def _search(hashed: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    sets = written(sets)
    # outer: else the optimizer infers a test of the array's size and evaluates the array anew for it
    hits = (hashed.select("_doc", "_text", F.posexplode_outer("_sh").alias("_pos", "_s"))
            .join(F.broadcast(sets.select(F.explode("_ish").alias("_s")).distinct()), "_s"))
    own = written(hits.groupBy("_doc", "_text").agg(F.collect_set("_s").alias("_own")))
    # a document without as many item shingles as the item asks for cannot hold it
    need = F.ceil(F.col("_q") * F.lit(threshold) - F.lit(1e-9))
    marks = F.broadcast(signatures(sets, threshold).join(sets.select("_key", need.alias("_need")), "_key"))
    near = (own.select("_doc", "_text", F.size("_own").alias("_n"), F.explode("_own").alias("_s")).join(marks, "_s")
            .where(F.col("_n") >= F.col("_need")).groupBy("_doc", "_text", "_key")
            .agg(F.sum("_weight").alias("_hits"), F.first("_asked").alias("_asked")).where(F.col("_hits") >= F.col("_asked")))
    near = written(near.groupBy("_doc", "_text").agg(F.collect_set("_key").alias("_near")))
    both = F.size(F.array_intersect("_ish", "_own"))
    same = F.col("a._doc").eqNullSafe(F.col("b._doc")) & (F.col("a._text") == F.col("b._text"))
    return (own.alias("a").join(near.alias("b"), same).select("a._doc", "a._text", "_own", F.explode("_near").alias("_key"))
            .join(F.broadcast(sets), "_key").select("_doc", "_text", "_item", (both / F.col("_q")).alias("containment"))
            .where(F.col("containment") >= threshold))


def drop_contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", threshold: float = 0.8,
                      block_shingles: int = 1_000_000) -> DataFrame:
    """The rows whose own text contains no item, all columns kept; a row that shares an id with a contaminated one stays."""
    name, text = free_name(docs, "_dirty"), free_name(docs, "_dirty_text")
    found = _contained(docs, items, doc_id, item_id, threshold, block_shingles)
    dirty = bounded_broadcast(found.select(F.col("_doc").alias(name), F.col("_text").alias(text)).distinct())
    own = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    return docs.join(dirty, F.col(doc_id).eqNullSafe(F.col(name)) & (own == F.col(text)), "left_anti")
