from __future__ import annotations

import random
import re

from ledgerflow.llm import mixing

from .conftest import DOC


def waterfill(sizes, weights=(5, 2, 1), most=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, open_, target = sum(sizes.values()), set(order), {}
    while open_:
        share = (total - sum(target.values())) / sum(w[s] for s in open_)
        over = {s for s in open_ if w[s] * share > most * sizes[s]}
        if not over:
            return target | {s: w[s] * share for s in open_}
        target |= {s: most * sizes[s] for s in over}
        open_ -= over
    return target


def check(rows, out):
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows]
    sizes: dict = {}
    for r, n in zip(rows, size, strict=True):
        sizes[r[3]] = sizes.get(r[3], 0) + n
    goal = waterfill(sizes)
    assert sorted((r[0] is None, r[0] or 0, n) for r, n in zip(rows, size, strict=True)) == sorted((r.doc_id is None, r.doc_id or 0, r.size) for r in out)
    taken: dict = {}
    for r in out:
        assert r.source_size == sizes[r.source] and abs(r.target - goal[r.source]) < 1e-6 and 0 <= r.taken <= 3 * r.size
        assert r.taken == r.repeats * r.size or r.taken == (r.repeats + 1) * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    return taken, goal


def test_odd_rows(spark, odd_docs, odd_rows, clashing):
    out = mixing.mix_sources(odd_docs).collect()
    check(odd_rows, out)
    key = lambda rows: sorted(map(str, (tuple(r) for r in rows)))
    assert key(out) == key(mixing.mix_sources(clashing).collect())


def test_targets_are_met(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(["w"] * rng.choice([1, 2, 3, 5, 8, 13, 40, 40, 40])), None, rng.choice(["a", "a", "a", "b", "c", "d", None]), 0) for i in range(4000)]
    rows += [(10_000 + i, "w " * 7, None, "tiny", 0) for i in range(3)]
    df = spark.createDataFrame(rows, DOC)
    out = mixing.mix_sources(df).collect()
    taken, goal = check(rows, out)
    assert all(abs(taken[s] - goal[s]) <= 1 for s in goal)
    again = mixing.mix_sources(df.repartition(7)).collect()
    assert {(r.doc_id, r.taken) for r in out} == {(r.doc_id, r.taken) for r in again}


def reachable(counts):
    """All sums of some of the documents."""
    sums = {0}
    for s, c in counts:
        sums = {x + s * k for x in sums for k in range(c + 1)}
    return sums


def test_fit_against_brute_force():
    rng = random.Random(2)
    cases = [([(8, 1), (32, 6), (34, 4)], 227)]
    for _ in range(1500):
        counts = [(s, rng.randint(1, 6)) for s in sorted(rng.sample(range(1, rng.choice([12, 40, 300])), rng.randint(1, 5)))]
        cases.append((counts, rng.randint(0, sum(s * c for s, c in counts) + 3)))
    for counts, budget in cases:
        take = mixing.fit(counts, budget)
        assert all(0 <= take[s] <= c for s, c in counts)
        assert sum(s * k for s, k in take.items()) == max(x for x in reachable(counts) if x <= budget)
    assert sum(s * k for s, k in mixing.fit([(1, 50), (7, 90), (1000, 80)], 44_321).items()) == 44_321
    assert sum(s * k for s, k in mixing.fit([(1000, 50), (1500, 90)], 44_321).items()) == 44_000


def test_a_third_of_the_rows_under_one_id(spark):
    rng = random.Random(6)
    rows = [(7, "w " * 9, None, "a", 0)] * 3000 + [(7, "w " * 4, None, None, 0)] * 20 + [(i, "w " * rng.randint(0, 30), None, rng.choice(["a", "b", None]), 0) for i in range(6000)]
    df = spark.createDataFrame(rows, DOC)
    out = mixing.mix_sources(df).collect()
    taken, goal = check(rows, out)
    assert all(abs(taken[s] - goal[s]) <= 1 for s in goal)
    key = lambda rows: sorted(str(tuple(r)) for r in rows)
    assert key(out) == key(mixing.mix_sources(df.repartition(7)).collect())


def test_empty(spark):
    assert mixing.mix_sources(spark.createDataFrame([], DOC)).count() == 0
