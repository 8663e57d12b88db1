from __future__ import annotations

import collections
import hashlib
import random

from ledgerflow.llm import fingerprint as fp

from .conftest import DOC, words


def weights(text):
    c = collections.Counter()
    for w in text.lower().split():
        c[w] += len(w)
    return c


def jaccard(a, b):
    keys = set(a) | set(b)
    return sum(min(a[k], b[k]) for k in keys) / max(1, sum(max(a[k], b[k]) for k in keys))


def test_contract_and_estimate(spark):
    rng = random.Random(5)
    texts = [" ".join(words(rng, rng.randint(0, 120))) for _ in range(150)] + ["a b c d"] * 3 + ["été 😀 été"]
    ids = [i * 7 + 3 for i in range(len(texts))]
    rows = sorted(fp.fingerprint_documents(spark.createDataFrame([(i, t, None, None, None) for i, t in zip(ids, texts, strict=True)], DOC).repartition(5)).collect(), key=lambda r: r.doc_id)
    assert [r.doc_id for r in rows] == ids
    errors = []
    for k, (r, t) in enumerate(zip(rows, texts, strict=True)):
        following = texts[(k + 1) % len(texts)]
        q = len(t) // 4
        edited = t[:len(t) - q] + following[:q]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 and len(r.fingerprint) == 4 * fp.SAMPLES
        if t and edited.strip() and following:
            errors += [r.near_edited - jaccard(weights(t), weights(edited)), r.near_next - jaccard(weights(t), weights(following))]
    assert abs(sum(errors) / len(errors)) < 0.01 and sum(map(abs, errors)) / len(errors) < 0.06
    same = {t: {r.fingerprint for r, x in zip(rows, texts, strict=True) if x == t} for t in texts}
    assert all(len(f) == 1 for f in same.values())


def test_odd_rows(spark, odd_docs, clashing):
    rows = fp.fingerprint_documents(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert len({r.fingerprint for r in rows if r.doc_id in (1, 2)}) == 1
    key = lambda rows: sorted(map(str, (tuple(r) for r in rows)))
    assert key(rows) == key(fp.fingerprint_documents(clashing).collect())
    last = [r for r in rows if r.doc_id == 9][0]
    text = "été naïve 漢字 😀"  # the next of the last is the first: the null id, whose smallest text is empty
    assert last.edited_sha256 == hashlib.sha256(text[:len(text) - len(text) // 4].encode()).hexdigest()


def test_empty_and_single(spark):
    assert fp.fingerprint_documents(spark.createDataFrame([], DOC)).count() == 0
    one = fp.fingerprint_documents(spark.createDataFrame([(1, "a b c d e", None, None, None)], DOC)).collect()[0]
    assert one.near_next == 1.0


def test_a_third_of_the_rows_under_one_id(spark):
    from .conftest import words
    import random
    rng = random.Random(5)
    texts = [" ".join(words(rng, 40)) for _ in range(20)]
    rows = [(7, texts[0])] * 1500 + [(7, t) for t in texts[1:6]] * 3 + [(None, texts[2])] * 2 + [(100 + i, t) for i, t in enumerate(texts)]
    got = fp.fingerprint_documents(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_chars", "fingerprint").collect()
    assert len(got) == len(rows)
    by_id = {100 + i: r for i in range(20) for r in got if r.doc_id == 100 + i}
    own = sorted(r.fingerprint for r in got if r.doc_id == 7)
    assert own == sorted([by_id[100].fingerprint] * 1500 + [by_id[100 + i].fingerprint for i in range(1, 6)] * 3)
    assert [r.fingerprint for r in got if r.doc_id is None] == [by_id[102].fingerprint] * 2
