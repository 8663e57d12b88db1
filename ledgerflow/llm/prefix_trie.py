"""Prefix tries of conversations: double-array tries per prefix shard, merged at their shared upper nodes.

A sequence is a conversation's turns in order; a node is a distinct prefix, and the conversations
that start with it are its members.  Turns are identified by 128 bits of hashes of (role, text).

* Equal sequences meet first and go on as one, with their count and smallest id, so copies cost
  nothing later.
* Shards.  Sequences are sharded by their first turn; shards of more than ``limit`` sequences are
  sharded anew by their first 2, 4, 8, ... turns.  A node as deep as its shard's prefix or deeper
  lies in one shard only; the nodes above it may be shared between shards.
* Each bucket of whole shards packs one double-array trie over dense turn ids: the child of state s by
  turn c is BASE[s] + c, if CHECK there is s.  Traversing it gives the nodes of the bucket, complete
  ones with all their figures, shared upper ones with the part that this bucket knows.
* Upper nodes are merged by their prefix (sums and minima, aggregated before the shuffle); each
  adds what it knows to its ancestors, of which it has fewer than its shard's prefix is long.

The digest of the conversations that end at a node is a SHA-256 over their ids in order: ids are
joined in chunks in parallel, and the chunks of one node are then hashed one after the other as they
stream through one task, which holds one chunk at a time.

Defined results: rows with a null conversation id belong to no conversation; null roles and texts
count as empty; turns are ordered by turn (null first), ties by role and then by the hash of the
text; repeated rows are repeated turns; a table without conversations has no node.  One
conversation is one row, so its turns (hashes and counts, not texts) must fit into a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship_by_value, union_all, written

WORD = r"[^\x20\x09-\x0D]+"
_CHUNK_IDS = 4096
NONE = hashlib.sha256(b"").hexdigest()
_NODE = ("upper boolean, key string, parent_key string, path string, conv_id long, depth long, parent_conv_id long, n_convs long, words long, "
         "n_children long, n_leaves long, saved_tokens long, end_conv long")


def sequences(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) -> conv_id, turns array<struct<turn, role, h1, h2, words>> in order."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turn = F.struct(F.col("turn").alias("turn"), role.alias("role"), F.xxhash64(role, text).alias("h1"), F.xxhash64(F.lit(1), role, text).alias("h2"),
                    F.regexp_count(text, F.lit(WORD)).alias("words"))
    return (rows.where(F.col("conv_id").isNotNull()).select("conv_id", turn.alias("_t"))
            .groupBy("conv_id").agg(F.sort_array(F.collect_list("_t")).alias("turns")))


def prefix_trie(convs: DataFrame, limit: int = 256, bucket: int = 1024) -> DataFrame:
    """(conv_id, turns) with unique ids -> one row per node.

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens (over the subtree, members
    beyond the first times the words of the node's turn), ends_sha256 (of the ids that end here, ascending, joined by commas).
    """
    part = lambda name: F.transform("turns", lambda t: t[name])
    seqs = written(convs.select("conv_id", part("h1").alias("_h1"), part("h2").alias("_h2"), part("words").alias("_words"))
                   .withColumn("_k1", F.xxhash64("_h1")).withColumn("_k2", F.xxhash64("_h2")))
    classes = written(seqs.groupBy("_k1", "_k2").agg(F.min("conv_id").alias("_conv"), F.count("*").alias("_n")))
    distinct = written(classes.join(seqs.select(F.col("conv_id").alias("_conv"), "_h1", "_h2", "_words"), "_conv").drop("_k1", "_k2"))
    buckets = max(1, -(-distinct.count() // bucket))
    sharded = _shards(distinct, limit).withColumn("_bucket", F.pmod(F.xxhash64("_shard"), F.lit(buckets)))
    nodes = written(sharded.drop("_shard").groupBy("_bucket").applyInPandas(_bucket_nodes, _NODE))
    merged = _merge_upper(nodes.where("upper"))
    inner = nodes.where(~F.col("upper"))
    parents = written(merged.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("_parent")))
    named = [c for c in merged.columns if c != "key"]
    tops = inner.where(F.col("parent_conv_id").isNull()).unionByName(merged.select(*named), allowMissingColumns=True)
    tops = tops.join(parents, "parent_key", "left").withColumn("parent_conv_id", F.col("_parent"))
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    rows = inner.where(F.col("parent_conv_id").isNotNull()).select(*out, "end_conv").unionByName(tops.select(*out, "end_conv"))
    rows = written(rows)
    ended = rows.where(F.col("end_conv").isNotNull()).join(_ends(seqs, classes), F.col("end_conv") == F.col("_conv"))
    return ended.select(*out, "ends_sha256").unionByName(rows.where(F.col("end_conv").isNull()).select(*out, F.lit(NONE).alias("ends_sha256")))


def _shards(seqs: DataFrame, limit: int) -> DataFrame:
    """Adds ``_shard`` and ``_depth``, the turns that its prefix has; shards hold at most ``limit`` sequences."""
    placed, depth = [], 1
    while True:
        keyed = seqs.withColumn("_shard", F.xxhash64(F.lit(depth), F.slice("_h1", 1, depth), F.slice("_h2", 1, depth))).withColumn("_depth", F.lit(depth))
        large = written(keyed.groupBy("_shard").agg(F.count("*").alias("_n")).where(F.col("_n") > limit).select("_shard", F.lit(True).alias("_large")))
        if large.isEmpty():
            return union_all([*placed, keyed])
        marked = written(keyed.join(large, "_shard", "left"))
        placed.append(marked.where(F.col("_large").isNull()).drop("_large"))
        seqs, depth = marked.where("_large").drop("_large", "_shard", "_depth"), 2 * depth


class DoubleArray:
    """A trie over codes 1, 2, ...: the child of state s by code c is base[s] + c if check[base[s] + c] is s; state 0 is the root."""

    FREE = -1

    def __init__(self, codes: int):
        self.codes, self._low = codes, 1
        self.base = np.zeros(max(16, 2 * codes), dtype=np.int64)
        self.check = np.full(len(self.base), self.FREE, dtype=np.int64)
        self.check[0] = -2  # the root is nobody's child

    def _reach(self, n: int) -> None:
        if n >= len(self.base):
            more = max(n + 1, 2 * len(self.base)) - len(self.base)
            self.base = np.concatenate([self.base, np.zeros(more, dtype=np.int64)])
            self.check = np.concatenate([self.check, np.full(more, self.FREE, dtype=np.int64)])

    def add(self, state: int, codes: np.ndarray) -> np.ndarray:
        """Give ``state`` children by these ascending codes, at the first place where they all fit; returns their states."""
        while self._low < len(self.check) and self.check[self._low] != self.FREE:
            self._low += 1
        slot, wide = self._low, int(codes[-1] - codes[0])
        while True:
            self._reach(slot + wide + 1)
            if self.check[slot] == self.FREE and (self.check[slot - codes[0] + codes] == self.FREE).all():
                break
            slot += 1
        self.base[state] = slot - codes[0]
        self.check[self.base[state] + codes] = state
        return self.base[state] + codes

    def children(self, state: int) -> list[tuple[int, int]]:
        """(code, state) of the children, found by CHECK."""
        at = int(self.base[state])
        low = max(1, at + 1)
        return [(int(k) + low - at, int(k) + low) for k in np.flatnonzero(self.check[low:at + self.codes + 1] == state)]


def pack(seqs: list[tuple[int, ...]], codes: int) -> tuple[DoubleArray, dict[int, int]]:
    """The double array of distinct sequences of codes, and the sequence number that ends at a state."""
    trie, ends = DoubleArray(codes), {}
    order = sorted(range(len(seqs)), key=seqs.__getitem__)
    todo = [(0, 0, len(order), 0)]
    for state, low, high, depth in todo:  # grows as it goes: breadth first
        if low < high and len(seqs[order[low]]) == depth:
            ends[state] = order[low]
            low += 1
        if low == high:
            continue
        turn = np.array([seqs[i][depth] for i in order[low:high]])
        starts = np.flatnonzero(np.r_[True, turn[1:] != turn[:-1]])
        bounds = [*starts.tolist(), high - low]
        states = trie.add(state, turn[starts])
        todo += [(int(s), low + a, low + b, depth + 1) for s, a, b in zip(states, bounds, bounds[1:])]
    return trie, ends


def _bucket_nodes(rows: pd.DataFrame) -> pd.DataFrame:
    """One bucket's sequences as a double-array trie, and the figures of its nodes."""
    sizes = [len(x) for x in rows["_h1"]]
    flat = lambda c: np.concatenate([np.asarray(x, dtype=np.int64) for x in rows[c]] or [np.empty(0, np.int64)])
    ids = np.stack([flat("_h1"), flat("_h2")], axis=1)
    known, first, dense = np.unique(ids, axis=0, return_index=True, return_inverse=True)
    dense, words = dense.reshape(-1) + 1, flat("_words")[first]
    ends_at = np.cumsum([0, *sizes])
    seqs = [tuple(dense[a:b].tolist()) for a, b in zip(ends_at, ends_at[1:])]
    convs, counts, depths = (rows[c].tolist() for c in ("_conv", "_n", "_depth"))
    trie, ends = pack(seqs, len(known))
    # (state, depth, parent's place in this list, code), parents first
    found, parent_of = [(0, 0, -1, 0)], 0
    while parent_of < len(found):
        state, depth, _, _ = found[parent_of]
        found += [(s, depth + 1, parent_of, c) for c, s in trie.children(state)]
        parent_of += 1
    n = len(found)
    total, least, shard, kids, leaves, saved, complete = [0] * n, [None] * n, [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
    for i in range(n - 1, -1, -1):
        state, depth, up, code = found[i]
        if state in ends:
            k = ends[state]
            total[i] += counts[k]
            least[i] = convs[k] if least[i] is None else min(least[i], convs[k])
            shard[i] = max(shard[i], depths[k])
        if depth >= shard[i]:  # the whole subtree is here
            complete[i] = 1
            leaves[i] += kids[i] == 0
            saved[i] += (total[i] - 1) * int(words[code - 1])
        if up >= 0:
            total[up] += total[i]
            least[up] = least[i] if least[up] is None else min(least[up], least[i])
            shard[up] = max(shard[up], shard[i])
            if complete[i]:
                kids[up] += 1
                leaves[up] += leaves[i]
                saved[up] += saved[i]
    keys, out = [""] * n, []
    for i, (state, depth, up, code) in enumerate(found):
        end = convs[ends[state]] if state in ends else None
        top = up >= 0 and not complete[up]
        if not complete[i]:
            own = "" if up < 0 else keys[up][-32:]
            keys[i] = (keys[up] if up >= 0 else "") + hashlib.blake2b(own.encode() + (b"" if up < 0 else known[code - 1].tobytes()), digest_size=16).hexdigest()
        out.append((not complete[i], keys[i][-32:] or None, keys[up][-32:] if top else None, keys[i] or None, least[i], depth,
                    None if up < 0 or top else least[up], total[i], int(words[code - 1]) if code else 0, kids[i], leaves[i], saved[i], end))
    frame = pd.DataFrame(out, columns=[c.split()[0] for c in _NODE.split(", ")])
    for c in ("parent_conv_id", "end_conv"):
        frame[c] = pd.array([None if x is None else int(x) for x in (r[list(frame.columns).index(c)] for r in out)], dtype="Int64")
    return frame


def _merge_upper(partial: DataFrame) -> DataFrame:
    """The shared upper nodes of all buckets with their whole figures."""
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    known = [F.min(c).alias(c) for c in ("parent_key", "path", "conv_id", "depth", "words", "end_conv")]
    nodes = written(partial.groupBy("key").agg(*sums, *known))
    shared = nodes.where(F.col("parent_key").isNotNull()).groupBy(F.col("parent_key").alias("key")).agg(F.count("*").alias("_kids"))
    nodes = written(nodes.join(shared, "key", "left").withColumn("n_children", F.col("n_children") + F.coalesce("_kids", F.lit(0))).drop("_kids"))
    own_leaves = F.col("n_leaves") + F.when(F.col("n_children") == 0, 1).otherwise(0)
    own_saved = F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("words")
    above = F.transform(F.sequence(F.lit(0), F.col("depth")), lambda i: F.substring(F.col("path"), (i * 32 + 1).cast("int"), F.lit(32)))
    sums = (nodes.select(F.explode(above).alias("key"), own_leaves.alias("_leaves"), own_saved.alias("_saved"))
            .groupBy("key").agg(F.sum("_leaves").alias("n_leaves"), F.sum("_saved").alias("saved_tokens")))
    return nodes.drop("n_leaves", "saved_tokens").join(sums, "key").drop("path")


def _ends(seqs: DataFrame, classes: DataFrame) -> DataFrame:
    """_conv (smallest id of a class of equal sequences), ends_sha256 of all its ids."""
    alone = classes.where(F.col("_n") == 1).select("_conv", F.sha2(F.col("_conv").cast("string").cast("binary"), 256).alias("ends_sha256"))
    several = classes.where(F.col("_n") > 1).select("_k1", "_k2", "_conv")
    members = seqs.select("conv_id", "_k1", "_k2").join(several, ["_k1", "_k2"])
    chunks = (members.groupBy("_conv", F.floor(F.col("conv_id") / F.lit(_CHUNK_IDS)).alias("_chunk"))
              .agg(F.sort_array(F.collect_list("conv_id")).alias("_ids"))
              .select("_conv", "_chunk", F.array_join(F.transform("_ids", lambda x: x.cast("string")), ",").alias("_text")))
    ordered = chunks.repartition("_conv").sortWithinPartitions("_conv", "_chunk")
    return alone.unionByName(ordered.mapInPandas(_stream_digests, "_conv long, ends_sha256 string"))


def _stream_digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    now, state = None, None
    for batch in batches:
        out = []
        for conv, text in zip(batch["_conv"], batch["_text"], strict=True):
            if now is None or conv != now:
                if now is not None:
                    out.append((now, state.hexdigest()))
                now, state = conv, hashlib.sha256(text.encode())
            else:
                state.update(b"," + text.encode())
        yield pd.DataFrame(out, columns=["_conv", "ends_sha256"])
    if now is not None:
        yield pd.DataFrame([(now, state.hexdigest())], columns=["_conv", "ends_sha256"])


ship_by_value(__name__)
