"""Near-duplicate detection by Order MinHash with banded alignment.

A text is the sequence of its five-word shingles (words are lower-cased runs of letters, marks and
digits; a text of fewer words is one shingle), each labelled with its occurrence number, so that no label repeats.
Sketch i orders the labels by a seeded hash, takes the ``TUPLE`` smallest and keeps them in text
order; the tuple is hashed to a bucket.  Texts that agree in most places *and* in order share
buckets: at similarity 0.8 one of the ``SKETCHES`` = 16 tuples agrees with probability 0.99999.

Similarity: the longest common subsequence M of two label sequences, as M / (a + b - M); without
moved or repeated parts this is their Jaccard similarity.  At ``threshold`` the sequences differ by
at most (a + b)(1 - 2 t / (1 + t)) insertions and deletions, so the alignment runs within a band of
that half-width and is exact there.  Labels do not repeat, so it is a longest increasing run of
matched positions.  A link also needs that Jaccard similarity of the sets of different shingles, so
texts that share little but one phrase repeated many times are not linked.

Scale: exact copies are collapsed by content hash before anything is paired.  Buckets with the same
members are searched once.  A bucket is cut into blocks of about ``BLOCK`` shingles; every pair of
blocks is one piece of work for one task, which counts common labels for all its pairs, aligns
pairs only while they are not yet linked, and emits links that span what it found.  So no pair of
candidates is skipped, no task holds a whole large bucket, and no pairs are emitted.  Components
of the links are found by repeated minimum labels with pointer jumps over checkpointed narrow
tables.

Defined results: one row per input row.  A null text is empty; texts without words are copies of
each other.  ``class_id`` is the smallest non-null id of the class (null only if all are null);
rows that repeat an id or a text keep their own rows.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_broadcast, cut, free_name, runs_of, ship_by_value

SHINGLE = 5
SKETCHES = 16
TUPLE = 3
BLOCK = 100_000
SALTS = 16
LINK = "a binary, b binary"
ship_by_value(__name__)


def normal(text: Column) -> Column:
    """The lower-cased words of a text, joined by single spaces."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}\p{N}]+", " "))


def content_key(normal_text: Column) -> Column:
    return F.unhex(F.md5(normal_text.cast("binary")))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def odd(n: int) -> np.ndarray:
    return _mix(np.arange(1, n + 1, dtype=np.uint64)) | np.uint64(1)


def labels_of(texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each normal text: its occurrence-labelled shingle hashes in text order, and which of them are first occurrences."""
    parts = [t.encode("utf-8", "replace") for t in texts]
    ends = np.cumsum([len(p) + 1 for p in parts])
    data = np.frombuffer(b"\n".join(parts) + b"\n", dtype=np.uint8)
    inside = data != 32
    inside[ends - 1] = False
    first = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
    if not len(first):
        return [np.zeros(0, dtype=np.uint64) for _ in texts], [np.zeros(0, dtype=bool) for _ in texts]
    start = np.zeros(len(data), dtype=np.int64)
    start[first] = first
    place = (np.arange(len(data)) - np.maximum.accumulate(start)).astype(np.uint64)
    signs = _mix(data.astype(np.uint64) + (place << np.uint64(8)) + np.uint64(1 << 40))
    word = _mix(np.add.reduceat(np.where(inside, signs, np.uint64(0)), first))
    doc = np.searchsorted(ends, first, side="right")
    n_words = np.bincount(doc, minlength=len(texts))
    mult = odd(SHINGLE)
    gram = np.zeros(len(word), dtype=np.uint64)
    here = np.arange(len(word)) - np.repeat(np.cumsum(n_words) - n_words, n_words)  # place of a word in its text
    for k in range(SHINGLE):
        ok = here + k < n_words[doc]
        gram[ok] += word[np.flatnonzero(ok) + k] * mult[k]
    keep = here < np.maximum(n_words - SHINGLE + 1, 1)[doc]  # a short text keeps its first, which holds all its words
    gram, doc = _mix(gram[keep]), doc[keep]
    order = np.argsort(gram, kind="stable")
    same = np.concatenate([[False], (gram[order][1:] == gram[order][:-1]) & (doc[order][1:] == doc[order][:-1])])
    at = np.arange(len(order))
    nth = np.zeros(len(order), dtype=np.uint64)
    nth[order] = (at - np.maximum.accumulate(np.where(same, 0, at))).astype(np.uint64)
    labels = _mix(gram + nth * np.uint64(0x9E3779B97F4A7C15))
    cuts = np.searchsorted(doc, np.arange(1, len(texts)))
    return np.split(labels, cuts), np.split(nth == 0, cuts)


def sketch(labels: np.ndarray) -> np.ndarray:
    """The bucket of each sketch: hash of its smallest labels in text order."""
    n = len(labels)
    if not n:
        return np.zeros(0, dtype=np.int64)
    seeds, size = odd(SKETCHES), min(TUPLE, n)
    out = np.empty(SKETCHES, dtype=np.uint64)
    step = max(1, 400_000 // n)  # a few rows at a time for a very long text
    mult = odd(size)
    for lo in range(0, SKETCHES, step):
        value = (labels[None, :] ^ seeds[lo:lo + step, None]) * np.uint64(0xBF58476D1CE4E5B9)
        value ^= value >> np.uint64(29)
        value *= np.uint64(0x94D049BB133111EB)
        value ^= value >> np.uint64(32)
        least = np.sort(np.argpartition(value, size - 1, axis=1)[:, :size], axis=1) if n > size else np.tile(np.arange(n), (len(value), 1))
        out[lo:lo + step] = _mix((labels[least] * mult).sum(axis=1, dtype=np.uint64) + seeds[lo:lo + step])
    return out.view(np.int64)


def common_run(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """Length of the longest common subsequence within ``band`` of the diagonal; labels do not repeat."""
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    near = np.abs(i - j) <= band
    tails: list[int] = []
    for p in j[near][np.argsort(i[near])].tolist():
        k = bisect_left(tails, p)
        if k == len(tails):
            tails.append(p)
        else:
            tails[k] = p
    return len(tails)


def similarity(a: np.ndarray, b: np.ndarray, threshold: float) -> float:
    total = len(a) + len(b)
    m = common_run(a, b, int(total * (1 - 2 * threshold / (1 + threshold)) + 1e-9))
    return m / (total - m) if total else 1.0


class Index:
    """Which sets hold an element, for counting what one set shares with all others."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.array([len(x) for x in sets])
        _, code = np.unique(np.concatenate(sets), return_inverse=True)
        self.holders = np.repeat(np.arange(len(sets)), self.size)[np.argsort(code, kind="stable")]
        self.count = np.bincount(code)
        self.begin = np.cumsum(self.count) - self.count
        self.own = np.split(code, np.cumsum(self.size)[:-1])

    def alike(self, i: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """Of the sets before ``i``: which have at least that Jaccard similarity to it, and what each shares."""
        n, lo = self.count[self.own[i]], self.begin[self.own[i]]
        flat = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        shared = np.bincount(self.holders[flat], minlength=len(self.own))[:i]
        return shared * (1 + threshold) >= threshold * (self.size[:i] + self.size[i]) - 1e-9, shared


def block_links(labels: list[np.ndarray], firsts: list[np.ndarray], side: list[int], cross: bool, threshold: float) -> list[tuple[int, int]]:
    """Links that span all pairs of at least ``threshold``; with ``cross`` only pairs of different sides are looked at."""
    side_of = np.array(side)
    root = np.arange(len(labels))
    links = []
    distinct, labelled = Index([x[f] for x, f in zip(labels, firsts, strict=True)]), Index(labels)
    for i in range(1, len(labels)):
        if not len(labels[i]):
            continue
        ok, _ = distinct.alike(i, threshold)
        if cross:
            ok &= side_of[:i] != side_of[i]
        if not ok.any():
            continue
        both, shared = labelled.alike(i, threshold)
        partners = np.flatnonzero(ok & both)
        for j in partners[np.argsort(-shared[partners], kind="stable")].tolist():
            if root[i] != root[j] and similarity(labels[i], labels[j], threshold) >= threshold - 1e-12:
                links.append((j, i))
                root[root == root[i]] = root[j]
    return links


def sketch_table(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc id, content key, number of shingles and buckets of every row."""

    @F.pandas_udf("struct<n:int,buckets:array<bigint>>")
    def sketches(texts: pd.Series) -> pd.DataFrame:
        n, buckets = [], []
        for run in runs_of(texts):
            for labels in labels_of(run)[0]:
                n.append(len(labels))
                buckets.append(sketch(labels))
        return pd.DataFrame({"n": n, "buckets": buckets})

    rows = docs.select(F.col(doc_id).alias("_id"), normal(F.col(text)).alias("_normal"))
    return rows.select("_id", content_key(F.col("_normal")).alias("_c"), sketches("_normal").alias("_s")).select("_id", "_c", "_s.n", "_s.buckets")


def find_links(docs: DataFrame, table: DataFrame, text: str, threshold: float) -> DataFrame:
    """Links (a, b) between content keys that span every candidate pair of at least ``threshold``."""
    texts = table.dropDuplicates(["_c"])
    bands = texts.select("_c", "n", F.explode("buckets").alias("_bucket"))
    h = F.xxhash64("_c")
    buckets = (bands.groupBy("_bucket").agg(F.count("*").alias("_members"), F.sum("n").alias("_total"), F.bit_xor(h).alias("_x"),
                                            F.bit_xor(F.xxhash64(F.lit(1), "_c")).alias("_y")).where("_members > 1"))
    chosen = buckets.groupBy("_members", "_x", "_y").agg(F.min("_bucket").alias("_bucket"), F.min("_total").alias("_total"))
    parts = F.ceil(F.col("_total") / BLOCK).cast("int")
    members = cut(bands.join(chosen.select("_bucket", parts.alias("_parts")), "_bucket").select("_bucket", "_parts", "_c"))
    wanted = bounded_broadcast(members.select("_c").distinct())
    rows = docs.select(normal(F.col(text)).alias("_normal")).withColumn("_c", content_key(F.col("_normal")))
    bodies = rows.join(wanted, "_c", "left_semi").groupBy("_c").agg(F.first("_normal").alias("_normal"))
    own = F.pmod(F.xxhash64(F.lit(2), "_c"), F.col("_parts")).cast("int")
    placed = (members.withColumn("_part", own).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
              .select("_c", "_bucket", F.least("_part", "_other").alias("_lo"), F.greatest("_part", "_other").alias("_hi"), "_part"))
    work = placed.join(bodies, "_c").repartition("_bucket", "_lo", "_hi").sortWithinPartitions("_bucket", "_lo", "_hi", "_c")

    def link(frames):
        held: list[tuple] = []

        def settle():
            if len(held) < 2:
                return []
            parts = [labels_of(run) for run in runs_of(r[4] for r in held)]
            labels, firsts = ([x for part in parts for x in part[k]] for k in (0, 1))
            found = block_links(labels, firsts, [r[5] for r in held], held[0][1] != held[0][2], threshold)
            return [(held[i][3], held[j][3]) for i, j in found]

        for frame in frames:
            found = []
            for row in zip(frame["_bucket"], frame["_lo"], frame["_hi"], frame["_c"], frame["_normal"], frame["_part"], strict=True):
                if held and row[:3] != held[0][:3]:
                    found += settle()
                    held.clear()
                held.append(row)
            yield pd.DataFrame(found, columns=["a", "b"])
        yield pd.DataFrame(settle(), columns=["a", "b"])

    return cut(work.mapInPandas(link, LINK).distinct())


def components(links: DataFrame) -> DataFrame:
    """(a, b) -> node, label: the smallest node that each linked node is connected with."""
    edges = cut(links.select(F.col("a").alias("_u"), F.col("b").alias("_v")).unionAll(links.select("b", "a")).distinct())
    labels = cut(edges.groupBy("_u").agg(F.min("_v").alias("_v")).select(F.col("_u").alias("node"), F.least("_u", "_v").alias("label")))
    while True:
        near = edges.join(labels.select(F.col("node").alias("_v"), "label"), "_v").groupBy("_u").agg(F.min("label").alias("_near"))
        low = labels.join(near, F.col("node") == F.col("_u")).select("node", "label", F.least("label", "_near").alias("_low"))
        up = labels.select(F.col("node").alias("_low"), F.col("label").alias("_up"))  # pointer jump: the label's own label
        new = cut(low.join(up, "_low").select("node", F.col("label").alias("_old"), F.least("_low", "_up").alias("label")))
        labels = new.select("node", "label")
        if not new.where(F.col("_old") != F.col("label")).limit(1).count():
            return labels


def classes(docs: DataFrame, doc_id: str, text: str, threshold: float) -> tuple[DataFrame, DataFrame]:
    """The sketch table, and per content key: copies, class_id, class_rows and the content that stands for the class."""
    table = cut(sketch_table(docs.select(doc_id, text), doc_id, text))
    labels = components(find_links(docs, table, text, threshold))
    contents = table.groupBy("_c").agg(F.min("_id").alias("_least"), F.count("*").alias("copies"))
    labelled = cut(contents.join(labels, F.col("_c") == F.col("node"), "left").select("_c", "_least", "copies", "label"))
    alone = labelled.where("label is null").select("_c", "copies", F.col("_least").alias("class_id"), F.col("copies").alias("class_rows"), F.col("_c").alias("_kept"))
    linked = labelled.where("label is not null")
    first = F.min(F.struct(F.col("_least").isNull().alias("none"), F.col("_least").alias("id"), F.col("_c").alias("c")))
    groups = linked.groupBy("label").agg(first.alias("_first"), F.sum("copies").alias("class_rows"))
    # a large class is spread: each class goes out once per salt, each text meets the one of its salt
    spread = groups.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    joined = (linked.withColumn("_salt", F.pmod(F.xxhash64(F.lit(3), "_c"), F.lit(SALTS)).cast("int")).join(spread, ["label", "_salt"])
              .select("_c", "copies", F.col("_first.id").alias("class_id"), "class_rows", F.col("_first.c").alias("_kept")))
    known = alone.unionByName(joined)
    return table, known


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.8) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id, copies (rows with the same words), class_rows."""
    table, known = classes(docs, doc_id, text, threshold)
    return (table.select("_id", "_c").join(known, "_c")
            .select(F.col("_id").alias(doc_id), "class_id", F.col("copies"), F.col("class_rows")))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.8) -> DataFrame:
    """The documents, all columns, with one row of each class: that of the smallest id, then content key."""
    table, known = classes(docs, doc_id, text, threshold)
    stays = F.col("_id").eqNullSafe(F.col("class_id")) & (F.col("_c") == F.col("_kept"))
    judged = cut(table.select("_id", "_c").join(known.select("_c", "class_id", "_kept"), "_c").select("_id", "_c", stays.alias("_stays")))
    gone_id, gone_c = free_name(docs, "_gone"), free_name(docs, "_gone_c")
    gone = bounded_broadcast(judged.where("not _stays").select(F.col("_id").alias(gone_id), F.col("_c").alias(gone_c)).distinct())
    own = content_key(normal(F.col(text)))
    left = docs.join(gone, F.col(doc_id).eqNullSafe(F.col(gone_id)) & (own == F.col(gone_c)), "left_anti")
    if judged.where("_stays").groupBy("_id", "_c").count().where("count > 1").limit(1).count():  # rows that repeat id and words
        left = left.withColumn(gone_c, own).dropDuplicates([doc_id, gone_c]).drop(gone_c)
    return left
