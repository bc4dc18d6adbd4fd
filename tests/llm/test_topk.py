"""Exact top-k against a plain search."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagflow.llm import topk

SCHEMA = "vec_id long, embedding array<float>, rank int, score long"


def plain(rows, every, k):
    best = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        s = [math.floor(256 * float(np.float32(x))) for x in v]
        best[i] = min(best.get(i, s), s)
    dim = max(map(len, best.values()), default=0)
    ids = sorted(best)
    m = np.array([best[i] + [0] * (dim - len(best[i])) for i in ids], dtype=np.int64).reshape(len(ids), dim)
    out = []
    for n, i in enumerate(ids):
        if i % every == 0:
            s = m @ m[n]
            ranked = sorted((-int(s[c]), ids[c]) for c in range(len(ids)) if c != n)[:k]
            out += [(i, r + 1, j, -x) for r, (x, j) in enumerate(ranked)]
    return sorted(out)


def found(spark, rows, every=5, k=5, **options):
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], SCHEMA)
    return sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % every == 0, k, **options).collect())


@pytest.mark.parametrize("options", [{}, {"cell": 8, "block": 4, "pivots": 3}])
def test_random_and_tied_vectors(spark, options):
    rng = np.random.default_rng(1)
    rows = [(n, rng.normal(0, 1, 8).round(1).tolist()) for n in range(150)]
    rows += [(n, [0.5] * 8) for n in range(150, 220)]  # a common vector
    rows += [(7, rows[3][1]), (8, rows[8][1]), (None, [1.0] * 8), (300, None), (305, [float("nan")] * 8), (310, [None] * 8),
             (315, [float("inf")] + [0.0] * 7), (320, [1.0, 2.0]), (325, [])]
    assert found(spark, rows, **options) == plain(rows, 5, 5)


def test_few_rows(spark):
    assert found(spark, []) == []
    assert found(spark, [(0, [1.0])]) == []
    rows = [(0, [1.0]), (1, [2.0]), (5, [-1.0])]
    assert found(spark, rows) == plain(rows, 5, 5)


def test_far_cells_are_skipped(spark):
    """Two clusters far apart: the second round has nothing left to visit for most cells."""
    rng = np.random.default_rng(2)
    rows = [(n, ((1 if n % 2 else -1) * 10 + rng.normal(0, 0.01, 4)).tolist()) for n in range(200)]
    assert found(spark, rows, cell=16, block=16, pivots=4) == plain(rows, 5, 5)
