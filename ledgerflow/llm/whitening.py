"""Embedding whitening by Golub-Kahan-Lanczos bidiagonalisation of the centred rows.

With X the centred rows, each step makes the products X v and Xᵀ u in one distributed pass over
blocks of rows: a task multiplies its block with the direction and adds up the block's share of the
second product, and d + 1 sums come back.  The left vectors u, as long as the table, are never
stored: u = X y for a short vector y that the recurrence carries along, so a pass makes its share
anew.  Both sides are fully reorthogonalised, twice: the right vectors against each other, the left
ones through y and the products Xᵀ u that are known.  Where the recurrence ends early (a rank below
the dimension, or repeated singular values) it starts again with a new direction orthogonal to all
before, so after d steps every singular triplet is there.  The singular value decomposition of the
small bidiagonal matrix then gives the components and their deviations.

The rows are integers and are centred as such (whole part of the mean first), so no digits are lost.
The driver holds vectors of length d and matrices of d by d only; ``steps`` below d bounds the passes
for very wide vectors and gives the leading components as far as they have converged.  Rows are
written as blocks to the shared folder of ``spark.checkpoint.dir``; any pass can be repeated.

Defined results: vectors that are null or empty, hold null or non-finite entries, entries beyond
2**52 in size, or have another length than most (the longer, at a tie) are left out of fit and
result; repeated rows count as often as they stand and give repeated results; directions without
variance have no component, so equal vectors give no rows; a sum of squares beyond a long is null;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship_by_value, written

_BLOCK_BYTES = 1 << 20
#: Eigenvalues below this share of the largest are rounding, not variance.
RANK = 1e-13


@dataclass(frozen=True)
class Whitening:
    """n, per-dimension sums, unit components (one per row) by falling eigenvalue, trace, and the check of the whitened rows."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    identity_error: float


def usable(rows: DataFrame, vector: str) -> DataFrame:
    """The rows whose vector has entries, all of them finite and at most 2**52 in size, and the commonest length."""
    v = F.col(vector)
    sound = F.forall(v, lambda c: F.coalesce(~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) <= float(1 << 52)), F.lit(False)))
    kept = rows.where(v.isNotNull() & (F.size(v) > 0)).where(sound)
    common = kept.groupBy(F.size(v).alias("_d")).agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), F.desc("_d")).limit(1).collect()
    return kept.where(F.size(v) == common[0]["_d"]) if common else kept


def _blocks(rows: DataFrame, dims: int) -> DataFrame:
    """Rows of long arrays as binary blocks of about a megabyte."""
    size = max(1, _BLOCK_BYTES // (8 * dims))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), size):
                yield pd.DataFrame({"block": [np.stack(batch["_x"].iloc[at:at + size].to_list()).astype(np.int64).tobytes()]})

    return written(rows.mapInPandas(pack, "block binary"))


class _Rows:
    """The centred rows in blocks; ``sums`` runs one pass and brings back the sums that ``share`` makes of each block."""

    def __init__(self, blocks: DataFrame, n: int, sums: list[int]):
        self.blocks, self.n, self.dims = blocks, n, len(sums)
        self.whole = np.array([s // n for s in sums], dtype=np.int64)
        self.part = np.array([s % n / n for s in sums])

    def sums(self, share) -> np.ndarray:
        dims, whole, part = self.dims, self.whole, self.part

        def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = None
            for batch in batches:
                for block in batch["block"]:
                    x = (np.frombuffer(block, dtype=np.int64).reshape(-1, dims) - whole).astype(float) - part
                    own = share(x)
                    total = own if total is None else total + own
            if total is not None:
                yield pd.DataFrame({"i": np.arange(len(total)), "s": total})

        got = self.blocks.mapInPandas(add, "i int, s double").groupBy("i").agg(F.sum("s").alias("s")).collect()
        return np.array([r["s"] for r in sorted(got, key=lambda r: r["i"])])


def bidiagonalise(rows: _Rows, steps: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Right vectors (one per column) and the upper bidiagonal matrix B with X V = U B."""
    d, random = rows.dims, np.random.default_rng(seed)
    right, left, back = np.zeros((d, steps)), np.zeros((d, steps)), np.zeros((d, steps))
    band, scale = np.zeros((steps, steps)), 0.0

    def clear(v: np.ndarray, k: int) -> np.ndarray:
        for _ in range(2):
            v = v - right[:, :k] @ (right[:, :k].T @ v)
        return v

    def fresh(k: int) -> np.ndarray:
        v = clear(random.standard_normal(d), k)
        return v / np.linalg.norm(v)

    v, beta = fresh(0), 0.0
    for k in range(steps):
        right[:, k] = v
        y = v - beta * left[:, k - 1] if k else v

        def share(x: np.ndarray, y=y) -> np.ndarray:
            u = x @ y
            return np.append(x.T @ u, u @ u)

        got = rows.sums(share)
        g, norm = got[:-1], got[-1]
        for _ in range(2):  # u against the earlier left vectors, by their short forms
            c = left[:, :k].T @ g
            if np.abs(c).max(initial=0.0) > 0:
                y, g, norm = y - left[:, :k] @ c, g - back[:, :k] @ c, max(norm - c @ c, 0.0)
        alpha = float(np.sqrt(norm))
        scale = max(scale, alpha)
        if alpha <= 1e-12 * scale:
            alpha, w = 0.0, np.zeros(d)
        else:
            left[:, k], back[:, k] = y / alpha, g / alpha
            w = clear(back[:, k] - alpha * v, k + 1)
        band[k, k] = alpha
        if k + 1 == steps:
            break
        beta = float(np.linalg.norm(w))
        if beta <= 1e-12 * scale:
            beta, v = 0.0, fresh(k + 1)
        else:
            v = clear(w / beta, k + 1)
            v /= np.linalg.norm(v)
        band[k, k + 1] = beta
    return right, band


def fit(rows: DataFrame, x: str = "x", components: int = 8, steps: int | None = None) -> Whitening | None:
    """Fit on rows of equally long arrays of longs; None where there are none."""
    own = rows.select(F.col(x).alias("_x"))
    totals = own.select(F.posexplode("_x").alias("i", "c")).groupBy("i").agg(F.sum("c").alias("s"), F.count("*").alias("n")).collect()
    if not totals:
        return None
    sums, n, d = [r["s"] for r in sorted(totals, key=lambda r: r["i"])], totals[0]["n"], len(totals)
    blocks = _blocks(own, d).persist(StorageLevel.MEMORY_AND_DISK)
    table = _Rows(blocks, n, sums)
    trace = float(table.sums(lambda b: np.array([np.square(b).sum()]))[0]) / n
    right, band = bidiagonalise(table, min(d, steps or d))
    _, sigma, turned = np.linalg.svd(band)
    values = np.square(sigma) / n
    some = int((values[:components] > RANK * max(values[0], np.finfo(float).tiny)).sum())
    axes = (right @ turned[:some].T).T
    axes /= np.linalg.norm(axes, axis=1, keepdims=True) if some else 1.0
    error = 0.0
    if some:
        onto = (axes / np.sqrt(values[:some])[:, None]).T
        mean = table.sums(lambda b: (b @ onto).sum(axis=0)) / n

        def square(b: np.ndarray) -> np.ndarray:
            z = b @ onto - mean
            return (z.T @ z).ravel()

        error = float(np.abs(table.sums(square).reshape(some, some) / n - np.eye(some)).max())
    blocks.unpersist()
    return Whitening(n, sums, axes, values[:some], trace, error)


def _deviation(x: Column, model: Whitening) -> Column:
    """Sum over dimensions of (n x - S)^2 in exact longs; null beyond a long."""
    off = F.zip_with(x, F.array(*[F.lit(s) for s in model.sums]), lambda c, s: F.try_subtract(F.try_multiply(c, F.lit(model.n).cast("long")), s.cast("long")))
    return F.aggregate(off, F.lit(0).cast("long"), lambda t, q: F.try_add(t, F.try_multiply(q, q)))


def whiten(rows: DataFrame, vec_id: str = "vec_id", x: str = "x", components: int = 8, steps: int | None = None) -> DataFrame:
    """(id, array of longs) -> id, component, n, deviation, whitened, explained, identity_error: a row for each row and component."""
    own = written(rows.select(F.col(vec_id).alias("_id"), F.col(x).alias("_x")))
    model = fit(own, "_x", components, steps)
    if model is None or not len(model.eigenvalues):
        empty = own.limit(0).select(F.col("_id").alias(vec_id), *[F.lit(0).cast(t).alias(c) for c, t in (
            ("component", "int"), ("n", "long"), ("deviation", "long"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double"))])
        return empty
    table = _Rows(own, model.n, model.sums)
    whole, part, onto = table.whole, table.part, (model.components / np.sqrt(model.eigenvalues)[:, None]).T

    @F.pandas_udf("array<double>")
    def project(xs: pd.Series) -> pd.Series:
        return pd.Series(list(((np.stack(xs.to_list()) - whole).astype(float) - part) @ onto)) if len(xs) else pd.Series([], dtype=object)

    share = F.array(*[F.lit(float(e / model.trace)) for e in model.eigenvalues])
    return (own.select("_id", _deviation(F.col("_x"), model).alias("deviation"), project("_x").alias("_z"))
            .select("_id", "deviation", F.posexplode("_z").alias("_c", "whitened"))
            .select(F.col("_id").alias(vec_id), (F.col("_c") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
                    F.get(share, F.col("_c")).alias("explained"), F.lit(model.identity_error).alias("identity_error")))


ship_by_value(__name__)
