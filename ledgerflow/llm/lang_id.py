"""Language identification by prediction by partial matching (PPM).

One variable-order byte context tree per language is learned from a bounded sample.  A symbol seen
in a context has probability c / (n + d) there (c its count, n all counts, d different symbols);
an unseen one costs the escape d / (n + d) and is then coded in the next shorter context, with the
symbols of the longer one excluded; below order 0 every byte has 1/256.  After fitting the
statistics are frozen, so the code length of a byte depends on its context alone: the trees of all
languages are compiled into one table of bits by (context, byte, language), and scoring a text is
two table look-ups per byte.  The language with the shortest exact code wins; the score is the
posterior of that language under equal priors.

Bounds: the sample has ``sample_bytes`` per language (one document's cut text more at most), and
contexts are pruned by count until the table fits ``model_bytes``; beside it stands an index of one
number per possible context (the cube of the byte classes: 68 MB at most), and the model is broadcast
under these two bounds.  Whole texts are scored, in runs that are shorter the more languages there are.

The posterior is relative to the learned languages, so ``keep_known`` also tests the code length itself,
of the letters alone (other signs become spaces: numbers and marks say nothing of the language): it must
not exceed the bytes times the limit of the best language, plus SLACK bits.  Each half of a language's
sample is coded by a model of the other halves; the limit is MARGIN times the 0.9 quantile of these bits
per byte, so clean texts stay.  Junk, other scripts and other languages are above it; a text of some
words, or in a near relative of a learned language, can still pass.

Defined results: a null text or one without a letter is ``und`` with score 0, and so is every
text when there is nothing to learn from; equal code lengths go to the first language by name.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import runs_of, ship_by_value, unit_hash

ORDER = 3
PARTS = 20
MARGIN, SLACK = 2.0, 64.0
CHUNK = 1 << 17
GAP = b"\n" * ORDER
ship_by_value(__name__)


def sample_texts(docs: DataFrame, learn: Column, sample_bytes: int, seed: int) -> dict[str, list[str]]:
    """Texts by language, about ``sample_bytes`` of each, in the order of a seeded hash of id and text.

    Rows with equal ids and texts count once, so a repeated row neither fills the sample nor gathers in one task.

    A text is cut to a PARTS-th of the sample, or to an equal part of it where a language has fewer texts,
    so a few very long ones neither fill the sample nor lower the share of the others.
    """
    rows = (docs.where(learn & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
            .select("lang", F.substring("text", 1, sample_bytes).alias("text"), unit_hash(F.col("doc_id"), F.col("text"), seed=seed).alias("_u")))
    counts = rows.groupBy("lang").agg(F.least(F.count("*"), F.lit(PARTS)).alias("_parts"))
    cut = F.substring(F.col("text"), F.lit(1), F.ceil(F.lit(float(sample_bytes)) / F.col("_parts")).cast("int"))
    rows = rows.join(F.broadcast(counts), "lang").withColumn("text", cut).withColumn("_n", F.octet_length("text"))  # one row per language is broadcast
    share = rows.groupBy("lang").agg((F.lit(4.0 * sample_bytes) / F.sum("_n")).alias("_share"), F.min("_u").alias("_least"))
    near = rows.join(F.broadcast(share), "lang").where((F.col("_u") < F.col("_share")) | (F.col("_u") == F.col("_least")))
    near = near.groupBy("lang", "_u").agg(F.min("text").alias("text")).withColumn("_n", F.octet_length("text"))
    before = F.sum("_n").over(Window.partitionBy("lang").orderBy("_u").rowsBetween(Window.unboundedPreceding, -1))
    kept = near.withColumn("_before", F.coalesce(before, F.lit(0))).where(F.col("_before") < sample_bytes)
    texts: dict[str, list[str]] = {}
    for r in sorted(kept.select("lang", "text").collect(), key=lambda r: (r["lang"], r["text"])):
        texts.setdefault(r["lang"], []).append(r["text"])
    return texts


def to_bytes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased UTF-8 of the texts, a gap before each, and where each text starts (and the end)."""
    parts = [t.lower().encode("utf-8", "replace") for t in texts]
    starts = np.cumsum([0, *[len(p) + ORDER for p in parts]])
    return np.frombuffer(b"".join(GAP + p for p in parts), dtype=np.uint8), starts


def _codes(sym: np.ndarray, k: int, a: int) -> np.ndarray:
    """For each position from ORDER on: its k preceding symbols as one number in base ``a``."""
    code = np.zeros(len(sym) - ORDER, dtype=np.int64)
    for j in range(k, 0, -1):
        code = code * a + sym[ORDER - j: len(sym) - j]
    return code


class Model:
    """Compiled trees: ``classes`` by byte, ``node`` by the last three symbols, ``bits`` by node, symbol and language."""

    def __init__(self, texts: dict[str, list[str]], model_bytes: int):
        self.langs = sorted(texts)
        data = [to_bytes(texts[lang])[0] for lang in self.langs]
        seen = np.flatnonzero(np.bincount(np.concatenate(data), minlength=256)) if data else np.array([], dtype=int)
        self.classes = np.zeros(256, dtype=np.int32)  # class 0: a byte that no sample holds
        self.classes[seen] = np.arange(1, len(seen) + 1)
        a, n_lang = len(seen) + 1, len(self.langs)
        self.a = a
        syms = [self.classes[d].astype(np.int64) for d in data]
        room = max(1, model_bytes // (4 * a * max(1, n_lang)))
        contexts = [np.zeros(1, dtype=np.int64)]
        for k in range(1, ORDER + 1):  # contexts of any language, pruned until all orders fit
            codes, n = np.unique(np.concatenate([_codes(s, k, a) for s in syms]), return_counts=True) if syms else (np.array([], dtype=np.int64),) * 2
            least, free = 2, room - sum(map(len, contexts))
            while (n >= least).sum() > max(0, free * k // ORDER):
                least += 1
            contexts.append(codes[n >= least])
        bases = np.cumsum([0, *map(len, contexts)])
        prob = np.full((bases[-1], a, n_lang), 1 / 256)
        for k, own in enumerate(contexts):
            lo, hi = bases[k], bases[k + 1]
            if k:  # start from the distribution of the context that is one symbol shorter
                prob[lo:hi] = prob[self._find(contexts, bases, own % a ** (k - 1), k - 1)]
            for i, s in enumerate(syms):
                at = np.searchsorted(own, c := _codes(s, k, a))
                hit = (at < len(own)) & (own[np.minimum(at, len(own) - 1)] == c) if len(own) else np.zeros(len(c), dtype=bool)
                count = np.bincount(at[hit] * a + s[ORDER:][hit], minlength=len(own) * a).reshape(len(own), a).astype(float)
                total, kinds = count.sum(1, keepdims=True), (count > 0).sum(1, keepdims=True)
                low = np.where(count > 0, 0, prob[lo:hi, :, i])
                escape = kinds / np.maximum(total + kinds, 1) / np.maximum(1 - (prob[lo:hi, :, i] * (count > 0)).sum(1, keepdims=True), 1e-9)
                prob[lo:hi, :, i] = np.where(total > 0, np.where(count > 0, count / np.maximum(total + kinds, 1), escape * low), prob[lo:hi, :, i])
        self.bits = (-np.log2(np.maximum(prob, 1e-12))).astype(np.float32).reshape(-1, n_lang)
        every = np.arange(a ** ORDER, dtype=np.int64)
        self.node = self._find(contexts, bases, every, ORDER).astype(np.int32)

    def _find(self, contexts, bases, codes: np.ndarray, k: int) -> np.ndarray:
        """Row of the longest known suffix of each ``k``-symbol context."""
        if k == 0:
            return np.zeros(len(codes), dtype=np.int64)
        row = self._find(contexts, bases, codes % self.a ** (k - 1), k - 1)
        own = contexts[k]
        if len(own):
            at = np.minimum(np.searchsorted(own, codes), len(own) - 1)
            row = np.where(own[at] == codes, bases[k] + at, row)
        return row

    def lengths(self, texts: list[str]) -> np.ndarray:
        """Exact code length in bits of each text (rows) under each language (columns)."""
        data, starts = to_bytes(texts)
        out = np.zeros((len(texts), len(self.langs)))
        sym = self.classes[data].astype(np.int64)
        a = self.a
        step = max(1, CHUNK * 8 // max(8, len(self.langs)))
        for lo in range(0, len(sym) - ORDER, step):  # positions lo + ORDER ... hi - 1
            hi = min(len(sym), lo + step + ORDER)
            part = sym[lo:hi]
            code = (part[:-3] * a + part[1:-2]) * a + part[2:-1]
            bits = self.bits[self.node[code].astype(np.int64) * a + part[3:]]
            first = np.searchsorted(starts, lo + ORDER, side="right") - 1
            last = np.searchsorted(starts, hi - 1, side="right") - 1
            cuts = np.concatenate([[lo + ORDER], starts[first + 1: last + 1]]) - lo - ORDER
            sums = np.add.reduceat(bits, cuts, axis=0, dtype=np.float64)
            out[first: last + 1] += sums
        # the gap bytes before a text cost the same under all of its runs, but not under all languages
        if len(starts) > 1:
            for j in range(ORDER):
                at = starts[1:-1] + j
                out[1:] -= self.bits[self.node[(sym[at - 3] * a + sym[at - 2]) * a + sym[at - 1]].astype(np.int64) * a + sym[at]]
        return out


def letters_of(texts: list[str]) -> list[str]:
    return [re.sub(r"[\W\d_]+", " ", t) for t in texts]


def bits_limits(texts: dict[str, list[str]], model_bytes: int) -> dict[str, float]:
    """The most bits per byte that the letters of a text may cost (no limit below two sample texts)."""
    rates: dict[str, list[float]] = {lang: [] for lang, t in texts.items() if len(t) > 1}
    for own in (0, 1) if rates else ():
        model = Model({lang: texts[lang][1 - own::2] for lang in rates}, model_bytes)
        for i, lang in enumerate(model.langs):
            part = letters_of(texts[lang][own::2])
            rates[lang] += list(model.lengths(part)[:, i] / byte_counts(part))
    return {lang: MARGIN * float(np.quantile(rates[lang], 0.9)) if lang in rates else np.inf for lang in texts}


def byte_counts(texts: list[str]) -> np.ndarray:
    """Bytes of each text as it is coded (1 for an empty one)."""
    return np.maximum(np.diff(to_bytes(texts)[1]) - ORDER, 1)


def fit_predictor(docs: DataFrame, learn: Column, sample_bytes: int = 200_000, model_bytes: int = 32 << 20, seed: int = 5,
                  limited: bool = False):
    """A function from the text column to struct<lang, score, fits>; ``learn`` says which rows may be learned from.

    ``fits``, whether the letters cost no more than the limit, is only tested if ``limited``.
    """
    unknown = F.struct(F.lit("und").alias("lang"), F.lit(0.0).alias("score"), F.lit(False).alias("fits"))
    texts = sample_texts(docs.select("doc_id", "text", "lang"), learn, sample_bytes, seed)
    if not texts:
        return lambda text: unknown
    limits = bits_limits(texts, model_bytes) if limited else dict.fromkeys(texts, np.inf)
    model = docs.sparkSession.sparkContext.broadcast(Model(texts, model_bytes))

    @F.pandas_udf("struct<lang:string,score:double,fits:boolean>")
    def best(text: pd.Series) -> pd.DataFrame:
        m = model.value
        pred, score, fits = [], [], []
        for run in runs_of(text):
            bits = m.lengths(run)
            least = bits.min(1)
            own = [m.langs[i] for i in bits.argmin(1)]
            pred += own
            score += list(1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(1))
            if limited:
                plain = letters_of(run)
                bits, most = m.lengths(plain), np.array([limits[lang] for lang in m.langs])
                fits += list(bits.min(1) <= most[bits.argmin(1)] * byte_counts(plain) + SLACK)
            else:
                fits += [True] * len(run)
        return pd.DataFrame({"lang": pred, "score": score, "fits": fits})

    return lambda text: F.when(text.rlike(r"\p{L}"), best(F.coalesce(text, F.lit("")))).otherwise(unknown)


def predict_language(docs: DataFrame, learn: Column, **how) -> DataFrame:
    """(doc_id, text, lang) -> doc_id, lang_pred, score."""
    said = docs.select("doc_id", fit_predictor(docs, learn, **how)(F.col("text")).alias("_said"))
    return said.select("doc_id", F.col("_said.lang").alias("lang_pred"), F.col("_said.score").alias("score"))


def keep_known(docs: DataFrame, learn: Column, least_score: float = 0.5, **how) -> DataFrame:
    """The documents, all columns, whose text fits a learned language and has a posterior of at least ``least_score``."""
    said = fit_predictor(docs, learn, limited=True, **how)(F.col("text"))
    return docs.where((said["lang"] != "und") & (said["score"] >= least_score) & said["fits"])
