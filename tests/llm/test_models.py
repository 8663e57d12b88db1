"""Language identification, toxicity and quality: odd rows, small fixtures and held-out accuracy."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerflow.llm import lang_id, quality, toxicity
from ledgerflow.llm.common import labelled_sample
from ledgerflow.llm.queries import QUERIES

from .conftest import DOC, words

ALL = lambda: F.lit(True)
SF = "/root/testdata/sf0.01"


def ppm_bits(samples: list[str], text: str, order: int = 3, contexts=None) -> float:
    """Code length by the plain recursive definition over the contexts that the model keeps."""
    gap = b"\n" * order
    data = b"".join(gap + t.lower().encode() for t in samples)
    body = gap + text.lower().encode()

    def p(ctx: bytes, sym: int) -> dict:
        if ctx is None:
            return {s: 1 / 256 for s in range(256)}
        low = p(ctx[1:] if ctx else None, sym)
        if ctx and not contexts(ctx):
            return low
        count: dict = {}
        for i in range(order, len(data)):
            if data[i - len(ctx):i] == ctx:
                count[data[i]] = count.get(data[i], 0) + 1
        if not count:
            return low
        n, d = sum(count.values()), len(count)
        rest = 1 - sum(low[s] for s in count)
        return {s: count[s] / (n + d) if s in count else d / (n + d) * low[s] / max(rest, 1e-9) for s in range(256)}

    return sum(-math.log2(p(body[i - order:i], body[i])[body[i]]) for i in range(order, len(body)))


def test_code_lengths_are_exact():
    texts = {"x": ["abab abra abba", "bab aab"], "y": ["cdc dcd cc", "abc"]}
    model = lang_id.Model(texts, 32 << 20)
    gap = b"\n" * 3
    every = b"".join(gap + t.encode() for ts in texts.values() for t in ts)
    joined = [b"".join(gap + t.encode() for t in ts) for ts in texts.values()]

    def kept(ctx):  # contexts that occur twice in the samples, counted where a byte follows
        return sum(j[i - len(ctx):i] == ctx for j in joined for i in range(3, len(j))) >= 2

    probe = ["abra", "cc dd", "", "zé ab"]
    got = model.lengths(probe)
    assert every
    for r, t in enumerate(probe):
        for c, lang in enumerate(model.langs):
            assert got[r, c] == pytest.approx(ppm_bits(texts[lang], t, contexts=kept), rel=1e-4, abs=1e-3)


def test_lengths_do_not_depend_on_chunks(monkeypatch):
    rng = random.Random(1)
    model = lang_id.Model({"x": [" ".join(words(rng, 200))], "y": ["unlike this " * 50]}, 32 << 20)
    probe = [" ".join(words(rng, n)) for n in (0, 1, 40, 300)]
    whole = model.lengths(probe)
    monkeypatch.setattr(lang_id, "CHUNK", 17)
    assert np.allclose(model.lengths(probe), whole, rtol=1e-4)


def test_long_documents_do_not_empty_the_sample(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(words(rng, 250))[:1500], lang) for k, lang in enumerate(("x", "y", "z")) for i in range(k * 1000, k * 1000 + 100)]
    rows += [(5000 + k, "ab cd " * 200_000, lang) for k, lang in enumerate(("x", "y", "z") * 3)]
    rows += [(6000 + k, "long only " * 50_000, "w") for k in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for seed in range(3):
        got = lang_id.sample_texts(docs, ALL(), 20_000, seed)
        assert sorted(got) == ["w", "x", "y", "z"]
        assert all(20_000 <= sum(map(len, texts)) < 27_000 for texts in got.values())
        assert all(sum(not t.startswith("ab cd") for t in got[lang]) >= 10 for lang in "xyz")


def test_unlearned_languages_and_junk_go(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("text is not null and length(text) > 0")
    rng = random.Random(7)
    other = {"it": "Nel mezzo del cammin di nostra vita mi ritrovai per una selva oscura, che la diritta via era smarrita.",
             "ru": "Все счастливые семьи похожи друг на друга, каждая несчастливая семья несчастлива по-своему.",
             "base64": "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(800)),
             "hex": rng.randbytes(600).hex()}
    junk = spark.createDataFrame([(-1 - i, t) for i, t in enumerate(other.values())], "doc_id long, text string")
    every = docs.unionByName(junk, allowMissingColumns=True)
    kept = {r.doc_id for r in lang_id.keep_known(every, F.col("doc_id") % 3 != 1).select("doc_id").collect()}
    lettered = {r.doc_id for r in docs.where(F.col("text").rlike(r"\p{L}")).collect()}
    assert not kept & {-1 - i for i in range(len(other))}
    assert kept == lettered


def test_language_odd_rows(spark, odd_docs, clashing):
    got = sorted((str(r.doc_id), r.lang_pred, 0 <= r.score <= 1) for r in lang_id.predict_language(clashing, ALL()).collect())
    assert len(got) == odd_docs.count() and all(ok for *_, ok in got)
    assert [p for i, p, _ in got if i in ("1", "2", "8")] == ["und"] * 3
    assert all(p in {"en", "fr", "und"} for _, p, _ in got)  # de has no text with a letter
    assert lang_id.keep_known(clashing, ALL()).columns == clashing.columns
    assert lang_id.predict_language(odd_docs, F.lit(False)).where("lang_pred <> 'und' or score <> 0").count() == 0
    assert lang_id.predict_language(spark.createDataFrame([], DOC), ALL()).count() == 0


def labelled(spark, column):
    return spark.createDataFrame([(i, i % 2) for i in range(10)] + [(3, None), (None, 1), (99, 1)], f"doc_id long, {column} int")


def test_classifier_odd_rows(spark, odd_docs, clashing):
    for score, column in ((toxicity.score_toxicity, "toxic"), (quality.score_quality, "quality")):
        labels = labelled(spark, column)
        plain = sorted((str(r.doc_id), r.score, r.predicted) for r in score(odd_docs, labels, ALL()).collect())
        assert len(plain) == odd_docs.count() and all(0 <= s <= 1 and p == int(s >= 0.7) for _, s, p in plain)
        assert plain == sorted((str(r.doc_id), r.score, r.predicted) for r in score(clashing, labels, ALL()).collect())
        assert score(odd_docs, labels.where("doc_id < 0"), ALL()).where("score <> 0").count() == 0
        assert score(spark.createDataFrame([], DOC), labels, ALL()).count() == 0
    assert toxicity.drop_toxic(clashing, labelled(spark, "toxic"), ALL()).columns == clashing.columns


def test_repeated_ids_are_drawn_once(spark):
    docs = spark.createDataFrame([(1, f"b{i}") for i in range(500)] + [(1, None), (1, ""), (2, "cd"), (3, None)], "doc_id long, text string")
    marks = spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "doc_id long, toxic int")
    assert labelled_sample(docs, marks, "toxic", ALL(), 10, 2, 1) == [("b0", 1), ("cd", 0), ("", 1)]


def test_monotone():
    assert np.allclose(toxicity.monotone(np.array([0.1, 0.4, 0.2, 0.9]), np.ones(4)), [0.1, 0.3, 0.3, 0.9])


def test_toxicity_on_planted_words(spark):
    rng = random.Random(8)
    bad = ["grumblefoot", "snotweasel", "muckbrain", "wartface"]
    rows, labels = [], []
    for i in range(600):
        w = words(rng, rng.randint(20, 200))
        y = int(i % 4 == 0)
        if y:
            for _ in range(max(2, len(w) // 40)):
                w.insert(rng.randrange(len(w)), rng.choice(bad))
        rows.append((i, " ".join(w)))
        labels.append((i, y))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r.predicted for r in toxicity.score_toxicity(docs, marks, F.col("doc_id") < 400).collect()}
    unseen = [(got[i], y) for i, y in labels if i >= 400]
    assert sum(p and y for p, y in unseen) >= 0.9 * sum(y for _, y in unseen)
    assert sum(p and not y for p, y in unseen) <= 0.02 * len(unseen)


def test_dual_descent_reaches_the_optimum():
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(-1, 1, (40, 3)), rng.normal(1, 1, (40, 3))])
    x = np.concatenate([x, np.ones((80, 1))], 1)
    y = np.repeat([-1.0, 1.0], 40)
    c = np.full(80, 0.5)
    w = quality.descend([(np.arange(4), v) for v in x], y, 4, c, 500, 0)
    value = lambda w: 0.5 * w @ w + (c * np.maximum(0, 1 - y * (x @ w))).sum()
    best = value(w)
    for _ in range(2000):
        assert value(w + rng.normal(0, 0.05, 4)) >= best - 1e-3


def test_features_are_the_same_in_any_batch():
    texts = ["A b  b c!!", "", "xx\nxx yy", "été 12"]
    doc, f = quality.features(texts)
    for i, t in enumerate(texts):
        _, own = quality.features([t])
        assert sorted(f[doc == i]) == sorted(own)


@pytest.mark.parametrize(("name", "label", "least"), [("op7_toxicity", "toxic", 0.7), ("op8_quality", "quality", 0.95)])
def test_held_out_accuracy(spark, name, label, least):
    got = QUERIES[name](spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").toPandas()
    rank, y = got["score"].rank(), got[label] == 1
    assert (rank[y].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (~y).sum()) >= least


def test_held_out_languages(spark):
    got = QUERIES["op5_language_id"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out and lang is not null")
    assert got.where("lang = lang_pred").count() >= 0.98 * got.count()
