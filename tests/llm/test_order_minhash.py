from __future__ import annotations

import random
from collections import Counter

import numpy as np
import regex

from ledgerflow.llm import order_minhash as om

from .conftest import DOC, words


def normal(text):
    return " ".join(regex.findall(r"[\p{L}\p{M}\p{N}]+", (text or "").lower()))


def labels(text):
    w = normal(text).split()
    seen: Counter = Counter()
    out = []
    for i in range(max(1, len(w) - 4) if w else 0):
        g = tuple(w[i:i + 5])
        out.append((g, seen[g]))
        seen[g] += 1
    return out


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def sim(a, b):
    a, b = labels(a), labels(b)
    distinct = {g for g, _ in a}, {g for g, _ in b}
    if len(distinct[0] & distinct[1]) < 0.8 * len(distinct[0] | distinct[1]):
        return 0.0
    m = lcs(a, b)
    return m / (len(a) + len(b) - m) if a or b else 1.0


def classes(rows):
    texts = {normal(t) for _, t in rows}
    texts = sorted(texts)
    root = {t: t for t in texts}

    def find(t):
        while root[t] != t:
            t = root[t]
        return t

    for i, a in enumerate(texts):
        for b in texts[:i]:
            na, nb = len(labels(a)), len(labels(b))
            if min(na, nb) >= 0.8 * max(na, nb) and na and set(labels(a)) & set(labels(b)) and sim(a, b) >= 0.8 - 1e-12:
                root[find(a)] = find(b)
    ids: dict = {}
    for i, t in rows:
        ids.setdefault(find(normal(t)), []).append(i)
    return sorted((str(i), str(min((x for x in ids[find(normal(t))] if x is not None), default=None))) for i, t in rows)


def corpus():
    rng = random.Random(4)
    rows, base = [], [words(rng, n) for n in (7, 9, 12, 30, 60, 150)]
    for k in range(160):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 5])):
            p = rng.randrange(len(w))
            rng.choice([lambda: w.__setitem__(p, "zz" + str(k)), lambda: w.insert(p, "yy"), lambda: w.pop(p) if len(w) > 5 else None])()
        if rng.random() < 0.1:
            w = w[len(w) // 2:] + w[: len(w) // 2]  # moved: alike as a set, not in order
        if k % 7 == 0:
            w = [x + rng.choice(["", ",", "."]) for x in w]
        rows.append((k, " ".join(w)))
    for k in range(12):  # little in common but one phrase, repeated
        rows.append((800 + k, " ".join(words(rng, 12) + ["over", "and"] * 60)))
    return rows + [(900, "!! ??"), (901, "...")]


def test_against_brute_force(spark):
    rows = corpus()
    got = om.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), str(r.class_id)) for r in got) == classes(rows)


def test_blocks_find_the_same(spark, monkeypatch):
    rows = corpus()
    monkeypatch.setattr(om, "BLOCK", 400)
    got = om.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), str(r.class_id)) for r in got) == classes(rows)


def test_alignment_is_exact_within_the_band():
    rng = np.random.default_rng(1)
    for _ in range(300):
        a = rng.permutation(40)[: rng.integers(1, 30)].astype(np.uint64)
        b = np.array([x for x in a if rng.random() < 0.9] + list(range(100, 100 + rng.integers(0, 4))), dtype=np.uint64)
        if len(b) > 3 and rng.random() < 0.5:
            i, j = rng.integers(0, len(b), 2)
            b[[i, j]] = b[[j, i]]
        m = lcs(a.tolist(), b.tolist())
        true = m / (len(a) + len(b) - m)
        got = om.similarity(a, b, 0.8)
        assert got <= true + 1e-12 and (true < 0.8 - 1e-12 or abs(got - true) < 1e-12)


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(bytes([i]), bytes([i + 1])) for i in range(60)] + [(b"\xf0", b"\xf1")], om.LINK)
    got = {bytes(r.node): bytes(r.label) for r in om.components(links).collect()}
    assert got == {bytes([i]): b"\x00" for i in range(61)} | {b"\xf0": b"\xf0", b"\xf1": b"\xf0"}


def test_odd_rows(spark, odd_docs, clashing, odd_rows):
    got = sorted((str(r.doc_id), str(r.class_id)) for r in om.near_duplicates(odd_docs).collect())
    assert got == sorted([("None", "1"), ("1", "1"), ("2", "1"), ("3", "3"), ("4", "4"), ("5", "4"), ("5", "4"), ("6", "4"), ("None", "4"), ("7", "7"), ("8", "8"), ("9", "9")])
    kept = om.keep_one(clashing)
    assert kept.columns == clashing.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3, 4, 7, 8, 9]
    repeated = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, None)], "doc_id long, text string")
    assert sorted(str(r.doc_id) for r in om.keep_one(repeated).collect()) == ["1", "None"]
    assert om.near_duplicates(spark.createDataFrame([], DOC)).count() == 0 and om.keep_one(spark.createDataFrame([], DOC)).count() == 0
