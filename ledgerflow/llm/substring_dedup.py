"""Substring deduplication: seed and extend on winnowed anchors.

A text is a list of words.  A window is ``least`` consecutive words of one document.  A word is a
repeat if a window that covers it also starts in a document with a smaller id; windows are judged
on the input, not on what is left of it.

* Seeds.  The anchor of a window is the rightmost of its word ``SEED``-grams with the least hash
  (winnowing), so equal windows have equal anchors at equal places, and no repeat can be missed.
  Consecutive windows share an anchor; they make one row with the hash of the words they span.
  Only anchors that several documents hold go on, by a join on the anchor.
* Extension.  A seed is extended both ways over its whole span.  Seeds of equal spans form a class;
  the class's smallest document keeps the words, and in all others the whole span is a repeat.
  Where an anchor has several classes, the extension stops inside the span: one seed for each class
  and smallest document is extended window by window, and equal windows meet in the same way.
  Copies are therefore compared with classes, never with each other: work grows with the words.
* Maximal repeats.  Windows and spans that touch or overlap are merged in each document.

Spans and windows are compared by 128 bits of independent hashes of their words.  Minima are
aggregated before the shuffle, and the joins that bring them back to the rows can be split by the
adaptive planner, as both sides come from plain shuffles: a passage that a third of all documents
hold does not meet in one task.  Seeds, classes and windows are written to the shared folder of
``spark.checkpoint.dir``.  Memory of a task is bounded by one batch of texts and the longest text.

Defined results: a null text has no words; a text with fewer words than a window has no repeat; a
row with a null id neither repeats nor is repeated; rows that share an id are one document for
"smaller", each text judged on its own, so repeated rows give repeated results; an empty table
gives an empty result; extra columns stay untouched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_broadcast, free_name, runs_of, ship_by_value, written

#: Words of a seed.
SEED = 16
#: Windows of a text that are hashed at a time.
BLOCK = 1 << 18
_BASE = np.array([0x9E3779B97F4A7C15, 0xD1342543DE82EF95], dtype=np.uint64)


def words_of(text: str | None) -> list[bytes]:
    """The words: runs of characters other than space and \\x09-\\x0D (what ``bytes.split`` splits at)."""
    return (text or "").encode("utf-8", "replace").split()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class _Hashes:
    """Hashes of any range of words, by prefix sums of a polynomial modulo 2**64; two independent streams."""

    def __init__(self, words: list[bytes]):
        n = len(words)
        h = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), dtype=np.uint64).reshape(n, 2)
        self.sums, self.back = [], []
        for j in (0, 1):
            powers = np.ones(n, dtype=np.uint64)
            powers[1:] = _BASE[j]
            backs = np.ones(n + 1, dtype=np.uint64)
            backs[1:] = np.uint64(pow(int(_BASE[j]), -1, 1 << 64))
            sums = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum(h[:, j] * np.multiply.accumulate(powers), out=sums[1:])
            self.sums.append(sums)
            self.back.append(np.multiply.accumulate(backs))

    def of(self, stream: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        s = self.sums[stream]
        return _mix((s[end] - s[start]) * self.back[stream][start])


def seeds_of(words: list[bytes], least: int, seed: int) -> tuple[np.ndarray, ...]:
    """anchor, span, start, windows: one entry for each run of windows that share their anchor."""
    found = []
    for at in range(0, max(0, len(words) - least + 1), BLOCK):
        hashes = _Hashes(words[at:at + BLOCK + least - 1])
        n = len(hashes.sums[0]) - 1
        i = np.arange(n - seed + 1)
        value, place, wide, have = hashes.of(0, i, i + seed), i, least - seed + 1, 1
        while have < wide:  # the rightmost least gram among the next `have`, doubled until a window is covered
            step = min(have, wide - have)
            right = value[step:] <= value[:-step]
            value, place = np.where(right, value[step:], value[:-step]), np.where(right, place[step:], place[:-step])
            have += step
        start = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        count = np.diff(np.r_[start, len(place)])
        span = hashes.of(1, start, start + count + least - 1)
        span = _mix(span ^ _mix(((place[start] - start) * (least + 1) + count).astype(np.uint64)))
        found.append((value[start], span, start + at, count))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.uint64),) * 2 + (np.empty(0, np.int64),) * 2


def stretches(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs (first window, windows) merged to stretches [first, end) of windows that follow each other, in order."""
    out: list[list[int]] = []
    for start, n in sorted(runs):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], start + n)
        else:
            out.append([start, start + n])
    return [(a, b) for a, b in out]


def windows_of(words: list[bytes], at: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """w1, w2 of the windows that start at ``at``."""
    hashes = _Hashes(words)
    return hashes.of(0, at, at + least), hashes.of(1, at, at + least)


def _seed_rows(least: int, seed: int):
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            done = 0
            for run in runs_of(batch["_text"], 1 << 20):
                ids, keys = (batch[c].iloc[done:done + len(run)] for c in ("_doc", "_key"))
                done += len(run)
                parts = [seeds_of(words_of(t), least, seed) for t in run]
                sizes = [len(p[0]) for p in parts]
                a, s, start, n = (np.concatenate(x) for x in zip(*parts, strict=True))
                yield pd.DataFrame({"_a": a.astype(np.int64), "_s": s.astype(np.int64), "_doc": ids.repeat(sizes).to_numpy(),
                                    "_key": keys.repeat(sizes).to_numpy(), "_at": start, "_n": n})
    return rows


def _window_rows(least: int):
    """Windows of the runs; only the words that these windows cover are hashed, many texts at a time."""
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words: list[bytes] = []
        held: list[tuple] = []  # document, key, first window in the text, windows, place among ``words``

        def flush() -> pd.DataFrame:
            n = np.array([h[3] for h in held], dtype=np.int64)
            inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            w1, w2 = windows_of(words, np.repeat(np.array([h[4] for h in held], dtype=np.int64), n) + inside, least)
            doc, key, first = (pd.Series([h[i] for h in held]).repeat(n).to_numpy() for i in range(3))
            out = pd.DataFrame({"_w1": w1.astype(np.int64), "_w2": w2.astype(np.int64), "_doc": doc, "_key": key, "_at": first + inside, "_n": 1})
            words.clear()
            held.clear()
            return out

        for batch in batches:
            for doc, key, text, runs in zip(batch["_doc"], batch["_key"], batch["_text"], batch["_runs"], strict=True):
                own = words_of(text)
                for first, end in stretches([(r["_at"], r["_n"]) for r in runs]):
                    held.append((doc, key, first, end - first, len(words)))
                    words.extend(own[first:end + least - 1])
                if len(words) >= BLOCK:
                    yield flush()
            if held:
                yield flush()
    return rows


def merged(runs, least: int) -> list[tuple[int, int]]:
    """Maximal word ranges [start, end) covered by runs (start, windows), in order."""
    out: list[list[int]] = []
    for start, n in sorted(runs):
        end = start + n + least - 1
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    own = docs.where(F.col(doc_id).isNotNull() & (F.col(text) != "")).select(F.col(doc_id).alias("_doc"), F.col(text).alias("_text"))
    return own.withColumn("_key", F.xxhash64("_text"))


def find_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = 50, seed: int = SEED) -> DataFrame:
    """_doc, _key (hash of the text), _runs: the runs (first window, windows) that an earlier document also holds."""
    if not 1 <= seed <= least:
        raise ValueError("a seed has at least one word and at most those of a window")
    own = _keyed(docs, doc_id, text)
    kind = own.schema["_doc"].dataType.simpleString()
    row = f"_doc {kind}, _key long, _at long, _n long"
    seeds = written(own.mapInPandas(_seed_rows(least, seed), f"_a long, _s long, {row}"))
    several = F.col("_first") < F.col("_last")
    ends = [F.min("_doc").alias("_first"), F.max("_doc").alias("_last")]
    shared = written(seeds.groupBy("_a").agg(*ends).where(several).select("_a"))
    hits = written(seeds.join(shared, "_a", "left_semi"))
    classes = written(hits.groupBy("_a", "_s").agg(F.min("_doc").alias("_first")))
    parted = written(classes.groupBy("_a").agg(F.min("_first").alias("_least"), F.max("_first").alias("_most"))
                     .where(F.col("_least") < F.col("_most")).select("_a", F.lit(True).alias("_open")))
    opened = written(classes.join(parted, "_a", "left"))
    seen = written(hits.join(opened, ["_a", "_s"]).where((F.col("_doc") > F.col("_first")) | F.col("_open")))
    whole = seen.where(F.col("_doc") > F.col("_first")).select("_doc", "_key", "_at", "_n")
    rest = (seen.where(F.col("_doc") == F.col("_first")).groupBy("_doc", "_key")
            .agg(F.collect_set(F.struct("_at", "_n")).alias("_runs")))
    rest = written(rest)
    narrow = own.join(bounded_broadcast(rest.select("_doc", "_key")), ["_doc", "_key"], "left_semi")
    windows = written(narrow.join(rest, ["_doc", "_key"]).mapInPandas(_window_rows(least), f"_w1 long, _w2 long, {row}"))
    firsts = written(windows.groupBy("_w1", "_w2").agg(*ends).where(several).select("_w1", "_w2", "_first"))
    single = windows.join(firsts, ["_w1", "_w2"]).where(F.col("_doc") > F.col("_first")).select("_doc", "_key", "_at", "_n")
    return whole.unionByName(single).groupBy("_doc", "_key").agg(F.collect_set(F.struct("_at", "_n")).alias("_runs"))


def _with_runs(docs: DataFrame, doc_id: str, text: str, least: int, seed: int) -> tuple[DataFrame, str]:
    """``docs`` with the runs of each row in a column of a free name."""
    runs = written(find_runs(docs, doc_id, text, least, seed))
    id_, key, name = (free_name(docs, c) for c in ("_doc", "_key", "_runs"))
    runs = runs.select(F.col("_doc").alias(id_), F.col("_key").alias(key), F.col("_runs").alias(name))
    same = (F.col(doc_id) == F.col(id_)) & (F.xxhash64(F.coalesce(F.col(text), F.lit(""))) == F.col(key))
    return docs.join(runs, same, "left").drop(id_, key), name


def _cut_words(words: list[bytes], ranges: list[tuple[int, int]]) -> bytes:
    left, at = [], 0
    for start, end in ranges:
        left += words[at:start]
        at = end
    return b" ".join(left + words[at:])


def _ranges(runs, least: int) -> list[tuple[int, int]]:
    return [] if runs is None else merged(((r["_at"], r["_n"]) for r in runs), least)


def maximal_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = 50, seed: int = SEED) -> DataFrame:
    """(doc_id, text) -> doc_id, n_words, repeats array<struct<start, n_words>>, kept: one row for each row of ``docs``.

    ``repeats`` are the maximal word ranges that earlier documents hold, ``kept`` the other words joined by one space.
    """
    @F.pandas_udf("n_words long, repeats array<struct<start: long, n_words: long>>, kept string")
    def said(texts: pd.Series, runs: pd.Series) -> pd.DataFrame:
        out = []
        for t, r in zip(texts, runs, strict=True):
            words, ranges = words_of(t), _ranges(r, least)
            out.append((len(words), [{"start": a, "n_words": b - a} for a, b in ranges], _cut_words(words, ranges).decode("utf-8")))
        return pd.DataFrame(out, columns=["n_words", "repeats", "kept"])

    rows, name = _with_runs(docs, doc_id, text, least, seed)
    return rows.select(F.col(doc_id), said(F.col(text), F.col(name)).alias("_said")).select(doc_id, "_said.*")


def digest(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = 50, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of ``maximal_repeats``, without shipping the kept words back."""
    @F.pandas_udf("n_words long, n_removed long, kept_sha256 string")
    def said(texts: pd.Series, runs: pd.Series) -> pd.DataFrame:
        out = []
        for t, r in zip(texts, runs, strict=True):
            words, ranges = words_of(t), _ranges(r, least)
            out.append((len(words), sum(b - a for a, b in ranges), hashlib.sha256(_cut_words(words, ranges)).hexdigest()))
        return pd.DataFrame(out, columns=["n_words", "n_removed", "kept_sha256"])

    rows, name = _with_runs(docs, doc_id, text, least, seed)
    return rows.select(F.col(doc_id), said(F.col(text), F.col(name)).alias("_said")).select(doc_id, "_said.*")


ship_by_value(__name__)
