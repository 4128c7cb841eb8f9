"""Whitening against dense eigenvectors in numpy and exact Python integers."""

import math

import numpy as np
import pytest

from strandframe.llm import whitening
from strandframe.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def dense(vectors):
    """n, integer rows, eigenvalues falling, eigenvectors as columns."""
    x = np.array([[math.floor(1024 * float(c)) + 100000 for c in v] for v in vectors])
    y = (len(x) * x - x.sum(0)) / len(x)
    e, q = np.linalg.eigh(y.T @ y / len(x))
    return x, y, e[::-1], q[:, ::-1]


def check(got, vectors, k, components=8):
    x, y, e, q = dense(list(vectors.values()))
    n, place = len(x), {i: at for at, i in enumerate(vectors)}
    assert len(got) == n * k and {r.component for r in got} == set(range(1, k + 1)) and k <= components
    table = np.zeros((n, k))
    for r in got:
        table[place[r.vec_id], r.component - 1] = r.whitened
        assert r.n == n and math.isclose(r.explained, e[r.component - 1] / e.sum(), rel_tol=1e-10) and r.identity_error < 1e-8
    for r in got[:200]:
        row = [int(v) for v in x[place[r.vec_id]]]
        assert r.deviation == sum((n * v - int(s)) ** 2 for v, s in zip(row, x.sum(0)))
    want = y @ q[:, :k] / np.sqrt(e[:k])
    assert np.abs(table - want * np.sign((table * want).sum(0))).max() < 1e-7


@pytest.mark.parametrize("block", [64, whitening.BLOCK])
def test_registered_query(spark, monkeypatch, block):
    monkeypatch.setattr(whitening, "BLOCK", block)
    monkeypatch.setattr(whitening, "DIRECT", 2 if block == 64 else 256)
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    check(QUERIES["op11_whitening"](spark, SF).collect(), {r.vec_id: r.embedding for r in rows}, 8)


def test_low_rank_and_repeated_eigenvalues(spark):
    flat = {i: [0.5 * (i % 3), 2.0, 1.0 * (i % 3), 0.0] for i in range(30)}  # rank 1
    frame = spark.createDataFrame([(i, v, "x") for i, v in flat.items()], "vec_id long, embedding array<double>, component string")
    check(whitening.whitened(frame).collect(), flat, 1)
    cross = [(i, [float((i == j) - (i == j + 6)) for j in range(6)]) for i in range(12)]  # one eigenvalue, six times
    got = whitening.whitened(spark.createDataFrame(cross, "vec_id long, embedding array<float>")).collect()
    assert len(got) == 72 and all(math.isclose(r.explained, 1 / 6) and r.identity_error < 1e-9 for r in got)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [0.0, 5.0]), (2, None), (3, [nan, 1.0]), (4, [1.0, None]), (5, [-inf, 0.0]), (6, []), (7, [1.0, 2.0, 3.0]), (8, [4.0, 4.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("n", whitening.F.lit("clash"))
    got = whitening.whitened(frame, wanted=1).collect()
    assert sorted((r.vec_id or 0, r.n) for r in got) == [(0, 4), (1, 4), (1, 4), (8, 4)]
    assert whitening.whitened(frame.limit(0)).count() == 0
    assert whitening.whitened(frame.where("vec_id = 1")).count() == 0  # no variance
    huge = spark.createDataFrame([("a", [1e300, 0.0]), ("b", [0.0, 1.0]), ("c", [1.0, 0.0])], "vec_id string, embedding array<double>")
    got = whitening.whitened(huge).collect()
    assert {r.vec_id for r in got} == {"a", "b", "c"} and all(r.deviation is None and math.isfinite(r.whitened) for r in got)


def test_bidiagonalisation_stops_early_on_wide_rows():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((400, 150)) * np.where(np.arange(150) < 8, 50 - 3 * np.arange(150), 1.0)
    sigma, vectors, steps = whitening.bidiagonalised(lambda q: (x.T @ (x @ q), float((x @ q) @ (x @ q))), 150, 8)
    _, s, vt = np.linalg.svd(x)
    assert steps < 150 and np.allclose(sigma[:8], s[:8], rtol=1e-12) and np.allclose(np.abs((vt[:8] @ vectors[:, :8]).diagonal()), 1, atol=1e-10)
