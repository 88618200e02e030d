"""Whitening against NumPy's eigenvectors and exact integer arithmetic."""

import math

import numpy as np
import pytest

from barloom.llm import queries
from barloom.llm.whitening import fit, leading_eigenvectors, polar, whiten


def brute(rows, k=4):
    """(id, component, n, deviation, whitened up to sign, explained) of rows (id, vector)."""
    kept = []
    for ident, v in rows:
        if v is not None and all(c is not None and math.isfinite(c) for c in v):
            kept.append((ident, tuple(math.floor(256 * c) for c in v)))
    width = max((len(x) for _, x in kept), default=0)
    kept = [(i, x + (0,) * (width - len(x))) for i, x in kept]
    distinct = sorted({x for _, x in kept})
    n, sums = len(distinct), [sum(c) for c in zip(*distinct)]
    centred = np.array([[float(n * c - s) / n for c, s in zip(x, sums)] for x in distinct])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    out = []
    for ident, x in kept:
        d = [n * c - s for c, s in zip(x, sums)]
        for c in range(len(values)):
            out.append((ident, c + 1, n, sum(y * y for y in d), float(np.array(d, float) / n @ vectors[:, c] / math.sqrt(values[c])),
                        float(values[c] / np.trace(centred.T @ centred / n))))
    return out


def same(got, want):
    assert len(got) == len(want)
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[3], abs(r[4]))
    signs = {}
    for g, w in zip(sorted(got, key=key), sorted(want, key=key)):
        assert tuple(g[:4]) == w[:4]
        assert g[4] == pytest.approx(w[4], rel=1e-7, abs=1e-9) or g[4] == pytest.approx(-w[4], rel=1e-7, abs=1e-9)
        if abs(w[4]) > 1e-6:
            assert signs.setdefault(w[1], np.sign(g[4] * w[4])) == np.sign(g[4] * w[4])
        assert g[5] == pytest.approx(w[5], rel=1e-9)


def test_query_equals_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    got = queries.QUERIES["op11_embedding_whitening"](spark, sf).collect()
    same(got, brute(rows))
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, -0.5, 1.25]), (1, [0.5, -0.5, 1.25]), (2, [0.5, -0.5, 1.25]), (3, None), (4, [1.0, None, 2.0]), (5, [nan, 0.0, 0.0]),
            (6, [inf, 0.0, 0.0]), (None, [-0.001, 3.0, 2.0]), (7, [1.0, 2.0]), (8, [0.0, -0.0, 0.1]), (9, [7.0, 1.0, -1.0]), (10, [])]
    frame = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, id string, n int").repartition(3)
    got = whiten(frame, fit(frame)).collect()
    want = brute([(i, None if v is None else [c if c is None else float(np.float32(c)) for c in v]) for i, v in rows])
    same(got, want)


def test_nothing_left_and_no_variance(spark):
    empty = spark.createDataFrame([(1, None)], "vec_id long, embedding array<double>")
    assert whiten(empty, fit(empty)).count() == 0
    alike = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")
    rows = whiten(alike, fit(alike)).collect()
    assert [(r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained) for r in sorted(rows)] \
        == [(i, c, 1, 0, 0.0, 0.0) for i in (1, 2) for c in (1, 2)]


def test_huge_entries_stay_exact(spark):
    rows = [(1, [2.0 ** 50, 1.0]), (2, [-(2.0 ** 50), 1.5]), (3, [2.0 ** 54, 0.0]), (4, [2.0 ** 30, 4.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = whiten(frame, fit(frame)).collect()
    assert {r.vec_id for r in got} == {1, 2, 4} and {r.n for r in got} == {3}
    assert {r.deviation for r in got} == {None}  # beyond a long


@pytest.mark.parametrize("n", [1, 2, 7, 40])
def test_eigenvectors(n):
    rng = np.random.default_rng(n)
    for a in (np.cov(rng.normal(size=(n, 3 * n)) * 9, bias=True).reshape(n, n), np.diag(np.repeat([5.0, 2.0], n)[:n]), np.zeros((n, n))):
        values, vectors = leading_eigenvectors(a, 4)
        assert np.allclose(values, np.linalg.eigvalsh(a)[::-1][:4], rtol=1e-12, atol=1e-12)
        assert np.allclose(a @ vectors, vectors * values, atol=1e-12 * max(1, np.abs(a).max()))
        assert np.allclose(vectors.T @ vectors, np.eye(len(values)), atol=1e-13)


def test_polar_factor():
    a = np.random.default_rng(2).normal(size=(30, 30))
    a = a + a.T
    u = polar(a)
    values, vectors = np.linalg.eigh(a)
    assert np.allclose(u, vectors * np.sign(values) @ vectors.T, atol=1e-11)
