"""Spectrum slicing against numpy, whitening against a plain form."""

import math

import numpy as np
import pytest

from tagflow.llm import spectrum, whitening

SCHEMA = "vec_id long, embedding array<float>, component int, n long, v string"


@pytest.mark.parametrize("values", [[5, 4, 3, 2, 1, 0], [5, 5, 5, 2, 2, 1], [1, 1, 1, 1, 1, 1], [0, 0, 0, 0, 0, 0], [3, 3 - 1e-9, 3 - 2e-9, -1, -2, 1e-12],
                                    [1e12, 1, 1e-3, 1e-6, 0, -1e3]])
def test_eigenpairs_and_counts(values):
    rng = np.random.default_rng(4)
    q = np.linalg.qr(rng.normal(size=(6, 6)))[0]
    a = q @ np.diag(values) @ q.T
    a = (a + a.T) / 2
    norm = max(map(abs, values)) or 1
    for shift in (-1.5, 0.5, 2.5, 4.5):
        if min(abs(v - shift) for v in values) > 1e-9 * norm:
            assert spectrum.inertia(a, shift)[0] == sum(v > shift for v in values)
    found, vectors = spectrum.leading(a, 5)
    assert np.allclose(found, sorted(values, reverse=True)[:5], atol=1e-13 * norm, rtol=0)
    assert np.allclose(vectors.T @ vectors, np.eye(5), atol=1e-12)
    assert np.abs(a @ vectors - vectors * found).max() <= 1e-12 * norm


def test_pivots_of_two():
    a = np.array([[0.0, 1, 0, 2], [1, 0, 3, 0], [0, 3, 0, 1], [2, 0, 1, 0]])
    assert spectrum.inertia(a, 0.0) == (2, 0)
    assert spectrum.inertia(np.zeros((3, 3)), 0.0) == (0, 3)
    rng = np.random.default_rng(8)
    for _ in range(50):
        m = rng.normal(size=(9, 9))
        m = m + m.T
        s = float(rng.normal())
        assert spectrum.inertia(m, s)[0] == (np.linalg.eigvalsh(m) > s).sum()


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def awkward():
    rng = np.random.default_rng(6)
    rows = [(n, (rng.normal(0, 1, 6) * [3, 2, 1, 1, .5, .1]).tolist()) for n in range(120)]
    return rows + [rows[3], (3, rows[4][1]), (None, rows[5][1]), (200, None), (201, [float("nan")] * 6), (202, [None] + [1.0] * 5),
                   (203, [float("inf")] * 6), (204, [1.0, 2.0]), (205, [])]


def test_whitening_is_that_of_numpy(spark):
    rows = awkward()
    df = spark.createDataFrame([(i, v, 7, 7, "x") for i, v in rows], SCHEMA).repartition(3)
    prepared = whitening.prepared(df)
    model = whitening.fit(prepared, 4)
    got = whitening.whiten(prepared, model).collect()
    kept = [(i, v) for i, v in rows if usable(v)]
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] + [1_000_000] * (6 - len(v)) for _, v in kept])
    n, total = len(x), x.sum(axis=0)
    values, vectors = np.linalg.eigh(np.cov(x.T, bias=True))
    values, vectors = values[::-1], vectors[:, ::-1]
    white = (x - total / n) @ vectors[:, :4] / np.sqrt(values[:4])
    deviation = ((n * x - total) ** 2).sum(axis=1)
    assert len(got) == 4 * n and {r["component"] for r in got} == {1, 2, 3, 4} and {r["n"] for r in got} == {n}
    assert model.identity_error < 1e-10 and {r["identity_error"] for r in got} == {model.identity_error}
    for c in range(1, 5):
        own = sorted(((r["deviation"], r["whitened"]) for r in got if r["component"] == c))
        wanted = sorted(zip(deviation.tolist(), white[:, c - 1].tolist()))
        assert [d for d, _ in own] == [d for d, _ in wanted]
        assert np.allclose(sorted(abs(w) for _, w in own), sorted(abs(w) for _, w in wanted), atol=1e-7)
        assert all(math.isclose(r["explained"], values[c - 1] / values.sum(), rel_tol=1e-9) for r in got if r["component"] == c)


def test_no_rows_and_no_spread(spark):
    empty = whitening.prepared(spark.createDataFrame([], SCHEMA))
    assert whitening.fit(empty) is None
    same = whitening.prepared(spark.createDataFrame([(n, [1.0, 2.0], 0, 0, "") for n in range(5)], SCHEMA))
    assert whitening.whiten(same, whitening.fit(same)).collect() == []
    line = whitening.prepared(spark.createDataFrame([(n, [float(n), 2.0], 0, 0, "") for n in range(5)], SCHEMA))
    assert {r["component"] for r in whitening.whiten(line, whitening.fit(line)).collect()} == {1}


def test_large_deviations_are_exact_or_null():
    model = whitening.Whitening(2 ** 31, (0, 5), np.ones(1), np.ones((2, 1)), 1.0)
    assert whitening.deviations(np.array([[1, 0]]), model) == [2 ** 62 + 25]
    assert whitening.deviations(np.array([[2, 0]]), model) == [None]
