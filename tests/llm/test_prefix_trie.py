from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np

from ledgerflow.llm import prefix_trie as P
from ledgerflow.llm.queries import op12_prefix_trie
from pyspark.sql import functions as F

ROWS = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(convs: dict[int, list[tuple[str, str]]]):
    members, ends = {}, {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
        ends.setdefault(tuple(turns), []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for p, who in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in kids
            saved[p[:d]] += (len(who) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
    return sorted((min(who), len(p), min(members[p[:-1]]) if p else -1, len(who), len(kids.get(p, [])), leaves[p], saved[p],
                   hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()) for p, who in members.items())


def ordered(rows) -> dict[int, list[tuple[str, str]]]:
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [t[2:] for t in sorted(ts)] for c, ts in convs.items()}


def nodes(df):
    return sorted(tuple(-1 if v is None else v for v in r) for r in df.select(*COLUMNS).collect())


def fixture(seed: int = 21):
    """Sequences over few turns, a hot first turn, long shared beginnings, many equal conversations, odd rows."""
    rng = random.Random(seed)
    rows, said = [], [("user", "a b"), ("assistant", "c\td  e"), ("user", ""), (None, "x"), ("user", None)]
    stem = [("user", f"turn {i} of the stem") for i in range(11)]
    for c in range(150):
        turns = [rng.choice(said) for _ in range(rng.choice([1, 2, 3, 4, 9]))]
        if c % 3 == 0:
            turns = stem[:rng.choice([1, 5, 11])] + turns
        elif c % 3 == 1:
            turns = stem + [("assistant", "one answer")]
        rows += [(c * 37 - 900, None if i == 0 and c % 5 == 0 else i, *t) for i, t in enumerate(turns)]
    return [*rows, (None, 0, "user", "lost"), (5000, 3, "user", "u"), (5000, 3, "user", "u")]


def test_nodes_against_brute_force(spark):
    rows = fixture()
    seqs = P.sequences(spark.createDataFrame(rows, ROWS))
    want = brute(ordered(rows))
    assert nodes(P.prefix_trie(seqs, limit=3, bucket=8)) == want
    assert nodes(P.prefix_trie(seqs)) == want


def test_turnless_conversations_and_none(spark):
    rows = [(c, 0, "user", "hello there") for c in range(4)]
    seqs = P.sequences(spark.createDataFrame(rows, ROWS))
    none = seqs.withColumn("turns", F.expr("slice(turns, 1, 0)"))
    assert nodes(P.prefix_trie(none)) == brute({c: [] for c in range(4)})
    both = seqs.unionByName(none.withColumn("conv_id", F.col("conv_id") + 10))
    assert nodes(P.prefix_trie(both)) == brute({c: [("user", "hello there")] for c in range(4)} | {c + 10: [] for c in range(4)})
    assert P.prefix_trie(seqs.limit(0)).count() == 0


def test_query_rebuilds_the_conversations(spark, tmp_path):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"{c % 7} said {t}") for c in range(64) if c not in (20, 47) for t in range(c % 5 + 1)]
    spark.createDataFrame(rows, ROWS).write.parquet(f"{tmp_path}/conversations.parquet")
    own = ordered(rows)
    convs = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        convs[c] = own.get(c - c % 20, [])[:h] + turns[h:]
    assert any(not t for t in convs.values())
    assert nodes(op12_prefix_trie(spark, str(tmp_path))) == brute(convs)


def test_double_array_holds_every_sequence():
    rng = random.Random(5)
    seqs = sorted({tuple(rng.randint(1, 40) for _ in range(rng.randint(0, 6))) for _ in range(800)})
    trie, ends = P.pack(seqs, 40)
    assert len(ends) == len(seqs)
    for i, seq in enumerate(seqs):
        state = 0
        for code in seq:
            to = int(trie.base[state]) + code
            assert trie.check[to] == state and (code, to) in trie.children(state)
            state = to
        assert ends[state] == i
    assert np.count_nonzero(trie.check >= 0) == len({s[:d] for s in seqs for d in range(1, len(s) + 1)})
