"""Quality classifier: naive Bayes support vectors (NBSVM).

Features are indicators of hashed n-grams: words (1, 2) and word shapes (1 to 3).  A shape keeps
the runs of character kinds of a word and says whether the word repeats the one before.  Each
indicator is scaled by its class log-count ratio, a text's vector is brought to unit length, and a
linear L2-regularised hinge-loss model is fitted by dual coordinate descent.  The margin becomes a
probability by a logistic fit on a part of the sample that the descent has not seen.

The model is fitted on a bounded sample (``sample_rows`` texts of at most ``sample_chars``) and is a
vector of 2^18 weights, broadcast under that bound; whole texts are scored, with numpy over a batch
of texts at a time.

Defined results: a null or empty text has the bias as its margin; with labels of one class only
every score is 0; repeated rows score alike.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import labelled_sample, runs_of, ship_by_value

BITS = 18
MULT = np.uint64(0x9E3779B97F4A7C15)
ship_by_value(__name__)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * MULT
    return h ^ (h >> np.uint64(32))


def _kinds() -> np.ndarray:
    """Character kind by byte: white space 0, lower case 1 (and all non-ASCII), upper case 2, digit 3, other signs by themselves."""
    kind = np.arange(256, dtype=np.uint64)
    for part, value in ((b" \t\n\r\x0b\x0c", 0), (b"abcdefghijklmnopqrstuvwxyz", 1), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 2), (b"0123456789", 3)):
        kind[list(part)] = value
    kind[128:] = 1
    return kind


KIND = _kinds()


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text number, feature) pairs of the texts, as two arrays sorted by text."""
    data = np.frombuffer(b"\n".join([t.encode("utf-8", "replace") for t in texts]) + b"\n", dtype=np.uint8)
    ends = np.cumsum([len(t.encode("utf-8", "replace")) + 1 for t in texts])
    kind = KIND[data]
    inside = kind > 0
    first = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))  # where words start
    if not len(first):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    low = np.where(kind == 2, data + np.uint8(32), data).astype(np.uint64)
    start = np.zeros(len(data), dtype=np.int64)
    start[first] = first
    place = (np.arange(len(data)) - np.maximum.accumulate(start)).astype(np.uint64)
    word = _mix(np.add.reduceat(np.where(inside, _mix(low * np.uint64(256) + np.uint64(1) + (place << np.uint64(20))), np.uint64(0)), first))
    turn = inside & (kind != np.concatenate([[np.uint64(0)], kind[:-1]]))  # a run of one kind begins
    runs = np.cumsum(turn)
    nth = (runs - (np.maximum.accumulate(np.where(np.isin(np.arange(len(data)), first), runs, 0)))).astype(np.uint64)
    shape = _mix(np.add.reduceat(np.where(turn, _mix(kind * np.uint64(64) + np.uint64(7) + (nth << np.uint64(20))), np.uint64(0)), first))
    doc = np.searchsorted(ends, first, side="right")
    same = np.concatenate([[False], (word[1:] == word[:-1]) & (doc[1:] == doc[:-1])])
    shape = _mix(shape + same.astype(np.uint64) * np.uint64(0x51ED27))
    docs, grams = [], []
    for kind_no, (token, orders) in enumerate(((word, 2), (shape, 3))):
        h = np.full(len(token), np.uint64(kind_no + 1))
        for k in range(orders):
            n = len(token) - k
            if n <= 0:
                break
            h = _mix(h[:n] + token[k:] * np.uint64(2 * k + 3))
            whole = doc[:n] == doc[k:]
            docs.append(doc[:n][whole])
            grams.append(h[whole] >> np.uint64(64 - BITS))
    pairs = np.unique(np.concatenate(docs).astype(np.int64) << BITS | np.concatenate(grams).astype(np.int64))
    return pairs >> BITS, pairs & ((1 << BITS) - 1)


def margins(texts: list[str], weights: np.ndarray, ratios: np.ndarray, bias: float) -> np.ndarray:
    """w . x for the unit-length scaled indicators of each text, plus the bias."""
    doc, f = features(texts)
    dot = np.bincount(doc, weights=weights[f] * ratios[f], minlength=len(texts))
    length = np.sqrt(np.bincount(doc, weights=ratios[f].astype(float) ** 2, minlength=len(texts)))
    return dot / np.maximum(length, 1e-9) + bias


def descend(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, dim: int, cost: np.ndarray, epochs: int, seed: int) -> np.ndarray:
    """L2-regularised hinge loss by dual coordinate descent; ``rows`` are (feature, value), the last feature is the bias."""
    w, alpha, rng = np.zeros(dim), np.zeros(len(rows)), np.random.default_rng(seed)
    norms = np.array([max(float(v @ v), 1e-12) for _, v in rows])
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(len(rows)):
            f, v = rows[i]
            g = y[i] * float(w[f] @ v) - 1
            new = min(max(alpha[i] - g / norms[i], 0.0), cost[i])
            if new != alpha[i]:
                w[f] += (new - alpha[i]) * y[i] * v
                worst = max(worst, abs(new - alpha[i]))
                alpha[i] = new
        if worst < 1e-3:
            break
    return w


def logistic(m: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """a, b of 1 / (1 + exp(-(a m + b))) by Newton steps, with smoothed targets."""
    n1, n0 = y.sum(), len(y) - y.sum()
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    theta, x = np.zeros(2), np.stack([m, np.ones(len(m))], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (t - p))
        theta = theta + step
        if abs(step).max() < 1e-6:
            break
    return float(theta[0]), float(theta[1])


def fit(texts: list[tuple[str, int]], c: float = 4.0, epochs: int = 12, seed: int = 8) -> dict:
    """Weights, log-count ratios, bias and the logistic map, from (text, label) pairs of both classes."""
    y = np.array([label for _, label in texts])
    parts, done = [], 0
    for run in runs_of(t for t, _ in texts):
        d, f = features(run)
        parts.append((d.astype(np.int32) + done, f.astype(np.int32)))
        done += len(run)
    doc, f = (np.concatenate(a) for a in zip(*parts, strict=True))
    part = np.random.default_rng(seed).random(len(texts)) < 0.8
    if min(len(set(y[part])), len(set(y[~part]))) < 2:
        part = np.ones(len(texts), dtype=bool)
    # the texts that calibrate the scores have no part in the ratios either
    own, fitted = y[doc] == 1, part[doc]
    p, q = (1 + np.bincount(f[m & fitted], minlength=1 << BITS) for m in (own, ~own))
    ratios = np.log((p / p.sum()) / (q / q.sum())).astype(np.float32)
    cuts = np.searchsorted(doc, np.arange(len(texts) + 1))
    rows = []
    for i in range(len(texts)):
        own_f = f[cuts[i]:cuts[i + 1]]
        v = ratios[own_f].astype(float)
        rows.append((np.append(own_f, 1 << BITS), np.append(v / max(np.sqrt(v @ v), 1e-9), 1.0)))
    sign, share = 2.0 * y - 1, np.bincount(y, minlength=2) / len(y)
    cost = c * 0.5 / share[y]  # both classes weigh the same
    w = descend([r for r, k in zip(rows, part, strict=True) if k], sign[part], (1 << BITS) + 1, cost[part], epochs, seed)
    unseen = ~part if (~part).any() else part
    m = np.array([float(w[i] @ v) for (i, v), k in zip(rows, unseen, strict=True) if k])
    a, b = logistic(m, y[unseen])
    return {"weights": w[:-1].astype(np.float32), "ratios": ratios, "bias": float(w[-1]), "a": a, "b": b}


def score_quality(docs: DataFrame, labels: DataFrame, learn: Column, sample_rows: int = 6000, sample_chars: int = 20_000,
                  cut_off: float = 0.7, seed: int = 8) -> DataFrame:
    """(doc_id, text) x (doc_id, quality) -> doc_id, score double, predicted int; ``learn`` says which label rows may be learned from."""
    texts = labelled_sample(docs, labels, "quality", learn, sample_rows, sample_chars, seed)
    docs = docs.select("doc_id", "text")
    if len({y for _, y in texts}) < 2:
        return docs.select("doc_id").withColumns({"score": F.lit(0.0), "predicted": F.lit(0)})
    model = docs.sparkSession.sparkContext.broadcast(fit(texts, seed=seed))

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        m, out = model.value, []
        for run in runs_of(text):
            z = m["a"] * margins(run, m["weights"], m["ratios"], m["bias"]) + m["b"]
            out.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
        return pd.Series(np.concatenate(out) if out else np.zeros(0))

    scored = docs.select("doc_id", score(F.coalesce("text", F.lit(""))).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= cut_off).cast("int"))
