"""Toxicity by compression distance with separate zstandard dictionaries.

Two dictionaries are trained on a bounded sample of labelled texts: one on ordinary text, one on
what sets toxic text apart (the words with a telling form: a word, or its first ``STEM`` letters,
that at least ``min_share`` of the toxic texts hold and that is ``min_ratio`` times as frequent
there).  The toxic dictionary is the trained one with the most frequent telling words behind it.
The ordinary coder is primed with the first dictionary, the toxic coder with both, and the first
is padded with zeros to the same length, so shared text costs the same in both coders and cancels
out.  Each window of ``WINDOW`` words is compressed by both; a constant run in front keeps zstandard
from storing a short window as it is, which would hide what a dictionary saves.

A text's evidence is the bytes that the toxic coder saves on windows where it saves at least
``threshold``, less three times what ordinary text of that many windows saves by accident.  The
threshold (of greatest likelihood) and the share of toxic texts by evidence, smoothed and made
monotone, are calibrated on the sample.

The whole text is scored, window by window.  Defined results: a null or empty text has no window
and gets the score of no evidence; with no toxic (or no ordinary) text to learn from every score
is 0; repeated rows score alike.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import labelled_sample, ship_by_value

WINDOW = 6
LEVEL = 3
LEAD = b"\x01" * 48
STEM = 4
STEPS = 16
CUT_OFF = 0.7
ship_by_value(__name__)


def windows(text: str) -> list[bytes]:
    w = text.lower().split()
    return [LEAD + f" {' '.join(w[i:i + WINDOW])} ".encode("utf-8", "replace") for i in range(0, len(w), WINDOW)]


def train_dictionary(size: int, samples: list[bytes], **how) -> bytes:
    """A zstandard dictionary, or the samples' own bytes where they are too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples, **how).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def telling_forms(texts: list[tuple[str, int]], min_share: float, min_ratio: float, min_texts: int = 5) -> set[str]:
    """Words and stems of many toxic texts that ordinary texts hold far less often; copies of a text count once."""
    n, found = [0, 0], (Counter(), Counter())
    for words, y in {(tuple(t.lower().split()), y) for t, y in texts}:
        n[y] += 1
        found[y].update(set(words) | {w[:STEM] for w in words if len(w) > STEM})
    return {w for w, c in found[1].items() if len(w) >= STEM and c >= max(min_texts, min_share * n[1])
            and c * max(n[0], 1) >= min_ratio * (found[0][w] + 1) * n[1]}


def frequent_words(words: Counter, size: int) -> bytes:
    """The most frequent words within ``size`` bytes, the most frequent last (nearest to the window)."""
    out, used = [], 1
    for w, _ in sorted(words.items(), key=lambda x: (-x[1], x[0])):
        part = f" {w}".encode("utf-8", "replace")
        if used + len(part) > size:
            break
        out.append(part)
        used += len(part)
    return b"".join(out[::-1]) + b" "


class Model:
    """The two dictionaries, the window threshold and the score by evidence."""

    def __init__(self, texts: list[tuple[str, int]], ordinary_size: int, toxic_size: int, words_size: int, min_share: float, min_ratio: float):
        forms = telling_forms(texts, min_share, min_ratio)
        told = [k for t, y in texts if y and (k := [w for w in t.lower().split() if w in forms or w[:STEM] in forms])]
        samples = [f" {' '.join(k)} ".encode("utf-8", "replace") for k in told]
        plain = lambda label: [w[len(LEAD):] for t, y in texts if y == label for w in windows(t)]
        self.ordinary = train_dictionary(ordinary_size, plain(0))
        self.toxic = (train_dictionary(toxic_size, samples or plain(1), k=24, d=6)
                      + frequent_words(Counter(w for k in told for w in k), words_size))
        saved, y = [self.saved(t) for t, _ in texts], np.array([y for _, y in texts])
        n = np.array([len(s) for s in saved])
        fits = []
        for threshold in range(2, 13):
            found = np.array([float(s[s >= threshold].sum()) for s in saved])
            accident = found[y == 0].sum() / max(1, n[y == 0].sum())
            some = (found > 0) & (y == 1)
            steps = np.linspace(0, 1, min(STEPS, 2 + int(some.sum()) // 8))
            edges = np.unique(np.quantile((found - 3 * accident * n)[some], steps)) if some.any() else np.zeros(1)
            k = self.step(found, n, accident, edges)
            pos, seen = np.bincount(k, weights=y, minlength=len(edges) + 2), np.bincount(k, minlength=len(edges) + 2)
            rate = monotone((pos + y.mean()) / (seen + 1), seen + 1)
            fits.append(((pos * np.log(rate) + (seen - pos) * np.log1p(-rate)).sum(), threshold, accident, edges, rate))
        _, self.threshold, self.accident, self.edges, self.rate = max(fits, key=lambda f: f[:2])

    @staticmethod
    def step(found, n, accident, edges):
        """0 without evidence, else the step of the evidence on the scale of ``edges``."""
        return np.where(found > 0, 1 + np.searchsorted(edges, found - 3 * accident * n, side="right"), 0)

    def coders(self):
        out = []
        for content in (self.ordinary + bytes(len(self.toxic)), self.ordinary + self.toxic):
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            out.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False).compress)
        return out

    def saved(self, text: str) -> np.ndarray:
        """Bytes that the toxic coder saves on each window."""
        if "_own" not in self.__dict__:
            self._own = self.coders()
        a, b = self._own
        return np.array([len(a(w)) - len(b(w)) for w in windows(text)], dtype=np.int64)

    def score(self, text: str) -> float:
        s = self.saved(text)
        return float(self.rate[self.step(s[s >= self.threshold].sum(), len(s), self.accident, self.edges)])

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_own"}


def monotone(rate: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The nearest non-decreasing sequence (pool adjacent violators)."""
    pools: list[list[float]] = []
    for r, w in zip(rate, weight, strict=True):
        pools.append([r, w, 1])
        while len(pools) > 1 and pools[-2][0] > pools[-1][0]:
            (r1, w1, n1), (r2, w2, n2) = pools[-2:]
            pools[-2:] = [[(r1 * w1 + r2 * w2) / (w1 + w2), w1 + w2, n1 + n2]]
    return np.clip(np.concatenate([np.full(int(n), r) for r, _, n in pools]), 1e-6, 1 - 1e-6)


def fit_scorer(docs: DataFrame, labels: DataFrame, learn: Column, sample_rows: int = 6000, sample_chars: int = 20_000,
               ordinary_size: int = 16 << 10, toxic_size: int = 1 << 10, words_size: int = 512, min_share: float = 0.03, min_ratio: float = 8.0, seed: int = 7):
    """A function from the text column to the score column; ``learn`` says which label rows may be learned from."""
    texts = labelled_sample(docs, labels, "toxic", learn, sample_rows, sample_chars, seed)
    if len({y for _, y in texts}) < 2:
        return lambda text: F.lit(0.0)
    model = docs.sparkSession.sparkContext.broadcast(Model(texts, ordinary_size, toxic_size, words_size, min_share, min_ratio))

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        return text.map(model.value.score)

    return lambda text: score(F.coalesce(text, F.lit("")))


def score_toxicity(docs: DataFrame, labels: DataFrame, learn: Column, cut_off: float = CUT_OFF, **how) -> DataFrame:
    """(doc_id, text) x (doc_id, toxic) -> doc_id, score double, predicted int."""
    scored = docs.select("doc_id", fit_scorer(docs, labels, learn, **how)(F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= cut_off).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, learn: Column, cut_off: float = CUT_OFF, **how) -> DataFrame:
    """The documents, all columns, that score below ``cut_off``."""
    return docs.where(fit_scorer(docs, labels, learn, **how)(F.col("text")) < cut_off)
