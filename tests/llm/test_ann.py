"""Approximate neighbours: exact scores, recall against a plain search, defined cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagflow.llm import ann, kmeans_tree

SCHEMA = "vec_id long, embedding array<float>, rank int, leaf long"


def plain(rows, every, k):
    own = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v):
            own[i] = min(own.get(i, v), v)
    ids = sorted(own)
    dim = max((len(own[i]) for i in ids), default=0)
    m = np.array([np.float32(own[i] + [0.0] * (dim - len(own[i]))) for i in ids], dtype=np.float64).reshape(len(ids), dim)
    out = {}
    for n, i in enumerate(ids):
        if i % every == 0:
            score = [sum(float(a) * float(b) for a, b in zip(m[n], m[c])) for c in range(len(ids))]
            out[i] = sorted((-score[c], ids[c]) for c in range(len(ids)) if c != n)[:k]
    return out


def found(spark, rows, every=5, k=5, **options):
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], SCHEMA)
    out = {}
    for r in ann.nearest_neighbours(df, F.col("vec_id") % every == 0, k, **options).orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((-r["score"], r["vec_id"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def recall(got, wanted):
    return sum(len({v for _, v in got.get(q, [])} & {v for _, v in w}) for q, w in wanted.items()) / sum(map(len, wanted.values()))


def test_recall_and_scores(spark):
    rng = np.random.default_rng(1)
    middle = rng.normal(0, 1, (20, 16))
    rows = [(n, (middle[n % 20] + rng.normal(0, 0.4, 16)).tolist()) for n in range(1500)]
    got, wanted = found(spark, rows, k=10, leaf=30, cell=20), plain(rows, 5, 10)
    assert recall(got, wanted) >= 0.9
    scores = {(q, v): s for q, w in plain(rows, 5, 1500).items() for s, v in w}
    assert all(math.isclose(s, scores[q, v], rel_tol=1e-12) for q, w in got.items() for s, v in w)


def test_a_tree_skips_most_leaves_of_clustered_points(spark):
    rng = np.random.default_rng(2)
    middle = rng.normal(0, 5, (64, 8))
    rows = [(n, (middle[n % 64] + rng.normal(0, 0.1, 8)).tolist()) for n in range(2000)]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], SCHEMA)
    index = ann.build(df, leaf=20)
    visits, share = ann.calibrate(index, index.points.where("vec_id % 20 = 0"), 5)
    assert share >= 0.95 and index.tree.leaves >= 64 and visits <= index.tree.leaves / 4


@pytest.mark.parametrize("options", [{}, {"leaf": 8, "cell": 7, "target": 1.0}])
def test_ties_and_awkward_rows(spark, options):
    rng = np.random.default_rng(3)
    rows = [(n, rng.normal(0, 1, 8).round(1).tolist()) for n in range(80)]
    rows += [(n, [0.5] * 8) for n in range(100, 160)]  # a common vector
    rows += [(7, rows[3][1]), (8, rows[8][1]), (None, [1.0] * 8), (300, None), (305, [float("nan")] * 8), (310, [None] * 8),
             (315, [float("inf")] + [0.0] * 7), (320, [1.0, 2.0]), (325, []), (330, [0.0] * 8)]
    got, wanted = found(spark, rows, **options), plain(rows, 5, 5)
    if options:
        assert {q: [v for _, v in w] for q, w in got.items()} == {q: [v for _, v in w] for q, w in wanted.items()}
    assert set(got) == set(wanted) and all(len(w) == 5 for w in got.values())


def test_few_rows(spark):
    assert found(spark, []) == {}
    assert found(spark, [(0, [1.0])]) == {}
    rows = [(0, [1.0]), (1, [2.0]), (5, [-1.0])]
    assert found(spark, rows, k=20) == plain(rows, 5, 20)


def test_pieces_of_a_popular_leaf(spark):
    rows = [(n, [1.0, float(n % 3)]) for n in range(60)]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], SCHEMA)
    index = ann.build(df, leaf=30, cell=5)
    asked = index.points.where("vec_id % 5 = 0").select("vec_id", "v")
    got = {(r["query_id"], r["vec_id"]) for r in ann.search(index, asked, index.tree.leaves, 4, piece=3).collect()}
    assert got == {(q, v) for q, w in plain(rows, 5, 4).items() for _, v in w}


def test_best_bin_first_visits_every_leaf_once():
    rng = np.random.default_rng(4)
    points = rng.normal(size=(300, 5))
    tree = kmeans_tree.fit(points, 10)
    assert all(sorted(order) == list(range(tree.leaves)) for order in kmeans_tree.best_bin_first(tree, points[:20], tree.leaves))
    own = kmeans_tree.leaf_of(tree, points)
    first = [order[0] for order in kmeans_tree.best_bin_first(tree, points, 1)]
    assert own.tolist() == first  # points and queries go down alike
