from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerflow.llm import whitening as W
from ledgerflow.llm.queries import op13_whitening

NAMES = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def by_eigh(x: np.ndarray):
    c = x - x.mean(axis=0)
    values, axes = np.linalg.eigh(c.T @ c / len(x))
    return values[::-1], axes.T[::-1], c


def check(spark, x: np.ndarray, components: int = 8, steps: int | None = None):
    frame = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "vec_id long, x array<long>")
    rows = W.whiten(frame, components=components, steps=steps).collect()
    values, axes, c = by_eigh(x)
    some = [k for k in range(min(components, x.shape[1])) if values[k] > W.RANK * values[0]]
    assert len(rows) == len(x) * len(some)
    z = {(r.vec_id, r.component): r for r in rows}
    for k in some:
        got = np.array([z[i, k + 1].whitened for i in range(len(x))])
        assert abs(z[0, k + 1].explained - values[k] / values.sum()) <= 1e-10
        lone = all(abs(values[k] - v) > 1e-6 * values[0] for j, v in enumerate(values) if j != k)
        if lone:
            want = c @ axes[k] / math.sqrt(values[k])
            want = want if got @ want > 0 else -want
            assert np.abs(got - want).max() < 1e-8
    if some:
        all_z = np.array([[z[i, k + 1].whitened for k in some] for i in range(len(x))])
        off = all_z - all_z.mean(axis=0)
        error = np.abs(off.T @ off / len(x) - np.eye(len(some))).max()
        assert error < 1e-8 and abs(rows[0].identity_error - error) < 1e-9
    sums = x.sum(axis=0)
    for i in range(len(x) if some else 0):
        assert z[i, 1].deviation == sum((len(x) * int(a) - int(s)) ** 2 for a, s in zip(x[i], sums)) and z[i, 1].n == len(x)


def test_against_eigh(spark):
    rng = np.random.default_rng(1)
    mixed = rng.standard_normal((300, 12)) @ np.diag(2.0 ** -np.arange(12)) @ rng.standard_normal((12, 12))
    check(spark, (mixed * 1000).astype(np.int64) + 100_000)
    check(spark, rng.integers(-50, 50, (40, 64)))


@pytest.mark.parametrize("case", ["flat", "deficient", "repeated", "few", "equal", "one"])
def test_ranks_and_ties(spark, case):
    rng = np.random.default_rng(2)
    x = rng.integers(0, 1000, (60, 6))
    if case == "flat":
        x[:, 2] = 7
    elif case == "deficient":
        x = np.concatenate([x, x[:, :3] * 2], axis=1)
    elif case == "repeated":  # four equal eigenvalues
        x = np.concatenate([np.eye(4, dtype=np.int64) * 9, -9 * np.eye(4, dtype=np.int64)])
    elif case == "few":
        x = x[:3]
    elif case == "equal":
        x = np.repeat(x[:1], 5, axis=0)
    elif case == "one":
        x = x[:1]
    check(spark, x)


def test_fewer_steps_reach_the_leading_component(spark):
    rng = np.random.default_rng(3)
    x = (rng.standard_normal((200, 20)) @ np.diag([400.0] + [10.0] * 19)).astype(np.int64)
    check(spark, x, components=1, steps=8)


def test_odd_vectors(spark, tmp_path):
    rng = np.random.default_rng(4)
    sound = [(i, [float(v) for v in rng.standard_normal(4)], i) for i in range(30)]
    odd = [(100, None, 0), (101, [], 0), (102, [1.0, None, 1.0, 1.0], 0), (103, [1.0, math.nan, 1.0, 1.0], 0), (104, [math.inf, 1.0, 1.0, 1.0], 0),
           (105, [1.0, 2.0], 0), (106, [1e30, 1.0, 1.0, 1.0], 0)]
    again = [sound[3], (None, sound[4][1], 1), *[(7, sound[5][1], 2)] * 15]
    frame = spark.createDataFrame([*sound, *odd, *again], "vec_id long, embedding array<float>, _id int")
    frame.write.parquet(f"{tmp_path}/embeddings.parquet")
    rows = op13_whitening(spark, str(tmp_path)).collect()
    assert rows[0].n == 47 and len(rows) == 47 * 4 and list(rows[0].asDict()) == NAMES
    assert sum(r.vec_id is None for r in rows) == 4 and {r.vec_id for r in rows} == {None, *range(30)}
    one = {(r.vec_id, r.component): r.whitened for r in rows if r.vec_id == 3}
    assert len(one) == 4 and sum(r.vec_id == 3 for r in rows) == 8
    assert rows[0].identity_error < 1e-9
    none = W.whiten(W.usable(frame.where("vec_id > 99"), "embedding").select("vec_id", F.expr("cast(embedding as array<long>) as x")).where("size(x) = 9"))
    assert none.count() == 0 and none.columns == NAMES
