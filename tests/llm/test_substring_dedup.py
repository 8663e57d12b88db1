from __future__ import annotations

import hashlib
import random

from ledgerflow.llm import substring_dedup as S

from .conftest import DOC, words

PAIR = "doc_id long, text string"


def brute(docs, least):
    """One (doc_id, n_words, kept words) for each row, by comparing every window with those of smaller ids."""
    first = {}
    split = [(doc, (text or "").encode().split()) for doc, text in docs]
    for doc, w in split:
        for i in range(len(w) - least + 1):
            if doc is not None:
                key = tuple(w[i:i + least])
                first[key] = min(doc, first.get(key, doc))
    out = []
    for doc, w in split:
        gone = set()
        for i in range(len(w) - least + 1):
            if doc is not None and first[tuple(w[i:i + least])] < doc:
                gone.update(range(i, i + least))
        out.append((doc, len(w), b" ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def check(spark, docs, least, seed, digest=False):
    frame = spark.createDataFrame(docs, PAIR)
    want = brute(docs, least)
    key = lambda r: tuple((x is not None, x or 0) for x in r[:1]) + r[1:]
    if digest:
        got = [tuple(r) for r in S.digest(frame, least=least, seed=seed).collect()]
        assert sorted(got, key=key) == sorted([(d, n, n - len(k.split()), hashlib.sha256(k).hexdigest()) for d, n, k in want], key=key)
    full = S.maximal_repeats(frame, least=least, seed=seed).collect()
    assert sorted([(r.doc_id, r.n_words, r.kept.encode()) for r in full], key=key) == sorted(want, key=key)
    for r in full:
        ends = [(x.start, x.start + x.n_words) for x in r.repeats]
        assert all(b - a >= least for a, b in ends) and all(b < c for (_, b), (c, _) in zip(ends, ends[1:]))


def test_few_words_and_short_windows(spark):
    """Few different words, so that anchors are shared, tie and meet with every kind of context."""
    rng = random.Random(11)
    docs = [(rng.randint(0, 60), " ".join(rng.choice("abc") for _ in range(rng.choice([0, 3, 7, 8, 9, 30, 80])))) for _ in range(120)]
    docs += [(rng.randint(0, 60), " ".join("ab"[i % 2] for i in range(n))) for n in (20, 31, 50)] + [(5, "a " * 60), (70, "a " * 90)]
    docs += [(None, docs[4][1]), (None, "a " * 60), (80, None), (81, "")]
    check(spark, docs, 8, 3)
    check(spark, docs[:60], 8, 1)


def test_passages_of_fifty_words(spark):
    rng = random.Random(12)
    passages = [words(rng, n) for n in (49, 50, 51, 64, 120)]
    docs = []
    for i in range(60):
        w = words(rng, rng.choice([0, 10, 100, 400]))
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(w))
            w[at:at] = rng.choice(passages)
        docs.append((rng.randint(0, 40), "\t ".join(w)))
    docs += docs[:10] + [(100 + i, docs[3][1]) for i in range(5)]
    check(spark, docs, 50, S.SEED, digest=True)


def test_a_third_of_the_rows_under_one_id_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 16)
    rng = random.Random(13)
    body = words(rng, 300)
    docs = [(7, " ".join(body[i:i + 70])) for i in range(40)] + [(7, " ".join(body))] * 20
    docs += [(i, " ".join(words(rng, 20) + body[2 * i:2 * i + 60])) for i in range(100)]
    check(spark, docs, 50, S.SEED)


def test_odd_rows(spark, odd_docs, clashing, odd_rows):
    want = brute([(r[0], r[1]) for r in odd_rows], 50)
    got = [(r.doc_id, r.n_words, r.kept.encode()) for r in S.maximal_repeats(clashing).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert S.digest(spark.createDataFrame([], DOC)).count() == 0
    named = odd_docs.selectExpr("doc_id AS _doc", "text AS _runs", "lang AS _key", "source AS _text")
    assert S.digest(named, doc_id="_doc", text="_runs").count() == len(odd_rows)
