from __future__ import annotations

import random
import re

from ledgerflow.llm import decontaminate as D

from .conftest import DOC, words

ITEM = "item_id long, text string"


def grams(text):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return [tuple(w[i:i + 5]) for i in range(len(w) - 4)]


def brute(docs, items, threshold=0.8):
    """Containment of every item in every whole document."""
    out = {}
    for item, text in items:
        own = set(grams(text))
        for doc, body in docs:
            c = len(own & set(grams(body))) / len(own) if own else 0
            if c >= threshold:
                out[doc, item] = max(c, out.get((doc, item), 0))
    return out


def fixture():
    rng = random.Random(9)
    items = [(i, " ".join(words(rng, n))) for i, n in enumerate([5, 6, 9, 14, 20, 36, 37, 60, 69, 120])]
    docs = []
    for i in range(120):
        w = words(rng, rng.choice([0, 3, 5, 30, 200, 3000]))
        if i % 3 == 0:
            own = items[i % len(items)][1].split()
            if i % 2:  # changed at the end: some are still above the threshold
                own = own[: max(1, int(len(own) * rng.choice([0.7, 0.85, 0.95])))]
            at = rng.randint(0, len(w))
            w[at:at] = [x.upper() + "," for x in own]
        docs.append((i, " ".join(w)))
    items += [(50, "too short"), (51, None), (None, items[4][1]), (4, items[4][1]), (4, items[5][1])]
    return docs, items


def test_against_brute_force(spark):
    docs, items = fixture()
    docs += [(None, items[3][1]), (200, None), (0, docs[0][1])]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    want = {}
    for pair, c in brute(docs, items).items():
        want[pair] = max(c, want.get(pair, 0))
    bench = spark.createDataFrame(items, ITEM)
    for block in (1_000_000, 200):
        got = D.find_contained(frame, bench, block_shingles=block).collect()
        assert {(r.doc_id, r.item_id): round(r.containment, 9) for r in got} == {p: round(c, 9) for p, c in want.items()}
        assert len(got) == len(want)
    bad = {d for d, t in docs if brute([(d, t)], items)}
    kept = [(r.doc_id, r.text) for r in D.drop_contaminated(frame, bench).collect()]
    assert sorted(kept, key=str) == sorted([(d, t) for d, t in docs if d not in bad], key=str)


def test_odd_rows(spark, odd_docs, clashing, odd_rows):
    bench = spark.createDataFrame([(1, odd_rows[4][1])], ITEM)
    assert {r.doc_id for r in D.find_contained(clashing, bench).collect()} == {4, 5, 6, None}
    assert sorted(str(r.doc_id) for r in D.drop_contaminated(clashing, bench).collect()) == sorted(["1", "2", "3", "7", "8", "9", "None"])  # the null text
    assert D.drop_contaminated(clashing, bench).columns == clashing.columns
    none = spark.createDataFrame([], ITEM)
    assert D.find_contained(odd_docs, none).count() == 0 and D.drop_contaminated(odd_docs, none).count() == odd_docs.count()
    assert D.find_contained(spark.createDataFrame([], DOC), bench).count() == 0


def leak_texts():
    """An item with a phrase that repeats, and an item with text inserted into its copy."""
    rng = random.Random(4)
    w = words(rng, 8000)
    phrased = w[:24] + w[24:29] * 20 + w[29:53]
    plain = w[60:94]
    parted = plain[:17] + w[100:120] + plain[17:]
    return phrased, plain, parted, w[200:]


def test_whole_documents_at_every_offset(spark):
    phrased, plain, parted, rest = leak_texts()
    own = set(grams(" ".join(plain)))
    share = len(own & set(grams(" ".join(parted)))) / len(own)
    assert len(own) == 30 and len(set(grams(" ".join(phrased)))) == 53 and 0.8 <= share < 0.9
    docs = [(k, " ".join(rest[:k] + phrased + rest[500:700])) for k in range(64)]
    docs += [(100 + k, " ".join(rest[:k] + parted + rest[500:700])) for k in range(64)]
    docs += [(300, " ".join(plain[:17] + rest[:3000] + plain[17:])), (301, " ".join(plain[:22] + rest[:3000]))]
    bench = spark.createDataFrame([(1, " ".join(phrased)), (2, " ".join(plain))], ITEM)
    got = {(r.doc_id, r.item_id): round(r.containment, 9) for r in D.find_contained(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    want = {(k, 1): 1.0 for k in range(64)} | {(100 + k, 2): round(share, 9) for k in range(64)} | {(300, 2): round(share, 9)}
    assert got == want


def test_short_items_are_exact(spark):
    rng = random.Random(6)
    items = [(i, " ".join(words(rng, 5 + i % 4))) for i in range(1200)]
    docs = [(i, " ".join(t.split() + words(rng, 40))) for i, t in items]
    got = D.find_contained(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, ITEM)).collect()
    assert sorted((r.doc_id, r.item_id) for r in got if r.containment == 1) == [(i, i) for i, _ in items]


def test_recall_of_each_size_class(spark):
    """Documents that hold just the threshold of an item, in pieces far apart, beside 4,000 other words."""
    rng = random.Random(8)
    sizes = [12, 16, 17, 32, 33, 64, 65, 130, 300, 700]
    items = [(i, " ".join(words(rng, n + 4))) for i, n in enumerate(sizes)]
    docs = []
    for i, text in items:
        w = text.split()
        for k in range(30):
            lost = max(0, int((len(w) - 4) * 0.2) - 4)  # a gap of n words breaks n + 4 shingles
            at = rng.randint(0, len(w) - lost - 1)
            docs.append((100 * i + k, " ".join(words(rng, 2000) + w[:at] + words(rng, 2000) + w[at + lost:])))
    want = brute(docs, items)
    got = {(r.doc_id, r.item_id): r.containment for r in D.find_contained(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, ITEM)).collect()}
    assert set(got) <= set(want) and len(want) >= 200
    for i in range(len(items)):
        own = {p for p in want if p[1] == i}
        assert len(own & set(got)) >= 0.9 * len(own)


def test_a_clean_row_stays_beside_a_dirty_one(spark):
    rng = random.Random(10)
    item = " ".join(words(rng, 40))
    rows = [(1, item), (1, "clean words of the same id that stay here"), (None, item + " end"), (None, "clean words without an id that stay"), (2, None),
            *[(7, item if i % 2 else f"clean number {i} under one hot id") for i in range(40)]]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [tuple(r) for r in D.drop_contaminated(frame, spark.createDataFrame([(5, item)], ITEM)).collect()]
    assert sorted(kept, key=str) == sorted([r for r in rows if item not in (r[1] or "")], key=str)


def test_signature_lengths():
    assert [D.size_class(q) for q in (17, 32, 33, 64, 65, 2048, 5000)] == [(0, 16), (0, 16), (1, 24), (1, 24), (2, 32), (6, 64), (8, 64)]
    for m in (16, 24, 64):
        r = D.hits_asked(m, 0.8)
        assert 1 <= r < m and D.hits_asked(m, 0.99) > r
