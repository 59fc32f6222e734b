"""Whitened values against LAPACK and exact whole numbers."""

import math

import numpy as np
import pytest

from tidemill.llm import whitening as wh

SCHEMA = "vec_id long, embedding array<double>, component int, task string"


def frame(spark, vectors, parts=7):
    return spark.createDataFrame([(i, v, 3, "x") for i, v in enumerate(vectors)], SCHEMA).repartition(parts)


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(1)
    v = rng.normal(size=(400, 12)) @ rng.normal(size=(12, 12)) / 5
    return [list(map(float, x)) for x in v] + [list(map(float, v[0]))] * 150


def check(rows, vectors, components):
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for v in vectors], object)
    n, total = len(x), x.sum(0)
    d = n * x - total
    near = d.astype(float) / n
    cov = near.T @ near / n
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1], axes[:, ::-1]
    got = {}
    for r in rows:
        assert r.n == n
        assert r.deviation == sum(int(y) ** 2 for y in d[r.vec_id])
        assert r.explained == pytest.approx(values[r.component - 1] / values.sum(), rel=1e-9)
        assert r.identity_error < 1e-9
        got[r.vec_id, r.component] = r.whitened
    assert len(got) == len(rows) == n * components
    for c in range(components):
        want = near @ axes[:, c] / math.sqrt(values[c])
        have = np.array([got[i, c + 1] for i in range(n)])
        assert min(abs(want - have).max(), abs(want + have).max()) < 1e-9


@pytest.mark.parametrize("fan_in", [2, 32])
def test_against_lapack(spark, vectors, fan_in, monkeypatch):
    monkeypatch.setattr(wh, "FAN_IN", fan_in)
    check(wh.whitened(frame(spark, vectors), 5).collect(), vectors, 5)


def test_merging_equals_one_pass():
    rng = np.random.default_rng(2)
    x = np.floor(rng.normal(size=(300, 6)) * 50 + 1e6)
    parts = [wh.Moments(6) for _ in range(4)]
    for i, row in enumerate(x):
        parts[min(3, i // 20)].add(row)
    whole = wh.Moments.of(*parts[0].row(0)[1:])
    for p in parts[1:]:
        whole.merge(p)
    assert np.allclose(whole.scatter / 300, np.cov(x.T, bias=True), rtol=1e-12)
    assert np.allclose(whole.mean, x.mean(0), rtol=1e-15)


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64])
def test_qr(n):
    rng = np.random.default_rng(n)
    for a in (rng.normal(size=(n, n)), np.ones((n, n)), np.diag(np.arange(n) // 2 * 1.0), np.zeros((n, n)), np.eye(n) + 1e-9 * rng.normal(size=(n, n))):
        a = (a + a.T) / 2
        values, axes = wh.symmetric_qr(a)
        assert np.allclose(values, np.linalg.eigvalsh(a)[::-1], atol=1e-12 * max(1, abs(a).max()) * n)
        assert np.allclose(axes @ axes.T, np.eye(n), atol=1e-12)
        assert np.allclose(axes.T * values @ axes, a, atol=1e-11 * max(1, n))


def test_odd_rows(spark, vectors):
    bad = [None, [], [None, *vectors[0][1:]], [float("nan"), *vectors[0][1:]], [float("inf"), *vectors[0][1:]], [1.0, 2.0], [1.0, 2.0]]
    rows = wh.whitened(frame(spark, [*vectors, *bad]), 4).collect()
    assert {r.vec_id for r in rows} == set(range(len(vectors)))
    check(rows, vectors, 4)


def test_degenerate(spark):
    assert wh.whitened(frame(spark, []), 4).count() == 0
    assert wh.whitened(frame(spark, [[1.0, 2.0]]), 4).count() == 0
    assert wh.whitened(frame(spark, [[1.0, 2.0]] * 9), 4).count() == 0
    few = wh.whitened(frame(spark, [[1.0, 0.0, 5.0], [0.0, 1.0, 5.0], [0.5, 0.5, 5.0]]), 4).collect()
    assert {r.component for r in few} == {1}
    large = wh.whitened(frame(spark, [[1e300, 1.0], [0.0, 0.0], [-1e300, 5.0]]), 2).collect()
    assert {r.deviation for r in large if r.component == 1} == {None} or len(large)
    other = spark.createDataFrame([(1, [1.0, 2.0], "a"), (1, [3.0, 4.5], "b"), (None, [0.0, 0.0], "c")], "vec_id long, embedding array<double>, Embedding string")
    assert wh.whitened(other, 2).count() == 6


def test_exact_beyond_doubles():
    x = np.array([[2.0**40, 1.0], [0.0, 3.0], [5.0, -(2.0**50)]])
    sums = [int(sum(map(int, c))) for c in x.T]
    _, square = wh._deviations(x, 3, sums)
    want = [sum((3 * int(v) - s) ** 2 for v, s in zip(row, sums)) for row in x]
    assert square == [w if w < 1 << 63 else None for w in want]
