"""Community detection: certificates of a local optimum, Leiden's refinement, loops, awkward graphs."""

import random

import pytest
from pyspark.sql import functions as F

from tagflow.operators import community as CM

SCHEMA = "src string, dst string, weight double"


def planted(nodes=120, groups=6, inside=0.3, between=0.02, seed=2):
    rng = random.Random(seed)
    rows = []
    for i in range(nodes):
        for j in range(i, nodes):
            share = 0.05 if i == j else inside if i % groups == j % groups else between
            if rng.random() < share:
                rows.append((f"n{i:03d}", f"n{j:03d}", round(rng.uniform(0.5, 2), 2)))
    return rows


def plain_gains(rows, memb, gamma=1.0):
    """Nodes that gain by moving to a neighbouring community or one of their own, by the definition of Q."""
    m = sum(w for *_, w in rows)
    k, near = {}, {}
    for a, b, w in rows:
        k[a] = k.get(a, 0) + w
        k[b] = k.get(b, 0) + w
        if a != b:
            near.setdefault(a, {})[b] = near.get(a, {}).get(b, 0) + w
            near.setdefault(b, {})[a] = near.get(b, {}).get(a, 0) + w
    big = {}
    for n, c in memb.items():
        big[c] = big.get(c, 0) + k[n]
    found = set()
    for n, c in memb.items():
        into = {}
        for b, w in near.get(n, {}).items():
            into[memb[b]] = into.get(memb[b], 0) + w
        stay = into.get(c, 0) - gamma * k[n] * (big[c] - k[n]) / (2 * m)
        there = max([0.0] + [w - gamma * k[n] * big[x] / (2 * m) for x, w in into.items() if x != c])
        if there - stay > 1e-7:
            found.add(n)
    return found


@pytest.mark.parametrize("detect", [CM.louvain, CM.leiden])
def test_no_node_gains_and_planted_groups_are_found(spark, detect):
    rows = planted()
    found = {r["tag"]: r["comm"] for r in detect(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert not plain_gains(rows, found)
    by_group = [{found[n] for n in found if int(n[1:]) % 6 == g} for g in range(6)]
    assert sum(len(g) for g in by_group) <= 8 and len(set.union(*by_group)) >= 5


def test_unsettled_is_what_the_definition_says(spark):
    rows = planted(40, 4)
    nodes = sorted({x for a, b, _ in rows for x in (a, b)})
    memb = {n: f"c{int(n[1:]) % 3}" for n in nodes}
    edges = spark.createDataFrame(rows, SCHEMA)
    frame = spark.createDataFrame(list(memb.items()), "node string, comm string")
    assert {r["node"] for r in CM.unsettled(edges, frame).collect()} == plain_gains(rows, memb)
    labels = {r["node"] for r in CM.unsettled_labels(edges, frame).collect()}
    heavy = set()
    for n in nodes:
        into = {}
        for a, b, w in rows:
            if a != b and n in (a, b):
                other = memb[b if a == n else a]
                into[other] = into.get(other, 0) + w
        if into and max(into.values()) > into.get(memb[n], 0) + 1e-7:
            heavy.add(n)
    assert labels == heavy


def test_refined_parts_are_connected_and_inside_their_community(spark):
    rows = planted(60, 3)
    edges = spark.createDataFrame(rows, SCHEMA)
    level = CM.Level(edges)
    memb = level.nodes.select("node", F.pmod(F.substring("node", 2, 3).cast("int"), F.lit(2)).cast("string").alias("comm"))
    parts = CM.refine(level, memb)
    both = {r["node"]: (r["part"], r["comm"]) for r in parts.join(memb, "node").collect()}
    assert len(both) == level.nodes.count() and len({c for _, c in both.values()}) == 2
    assert len({p for p, _ in both.values()}) == len(set(both.values())) < len(both)
    pieces = CM.split_disconnected(edges, parts.withColumnRenamed("part", "comm"))
    assert pieces.select("comm").distinct().count() == len(set(both.values()))
    level.close()


def test_independent_moves_touch_no_community_twice(spark):
    rng = random.Random(5)
    rows = [(f"n{i}", f"c{rng.randrange(8)}", rng.random(), f"d{rng.randrange(4)}") for i in range(60)]
    wanted = spark.createDataFrame(rows, "node string, comm string, gain double, target string")
    moves = CM.independent(wanted).collect()
    touched = [c for r in moves for c in (r["comm"], r["target"])]
    assert moves and len(touched) == len(set(touched))
    assert max(rows, key=lambda r: r[2])[0] in {r["node"] for r in moves}


def test_graphs_without_edges_between_nodes(spark):
    empty = spark.createDataFrame([], SCHEMA)
    loops = spark.createDataFrame([("a", "a", 1.0), ("b", "b", 2.0)], SCHEMA)
    for detect in (CM.louvain, CM.leiden, CM.label_propagation):
        assert detect(empty).collect() == []
        assert {r["tag"]: r["comm"] for r in detect(loops).collect()} == {"a": "a", "b": "b"}
