"""Pair tiles and nearest nodes against brute force, with blocks so small that graphs span many."""

import math
import random

import numpy as np
import pytest

from graphloom.operators import layouts as L
from graphloom.operators import losses as G
from graphloom.operators import messages as M
from graphloom.operators import neighbours as N
from graphloom.operators import pairs as P

KEY = "bundle string, graph_id long, "
XY = KEY + "node long, x double, y double"
SIZES = {1: 1, 2: 2, 3: 40, 4: 7}


def by_node(df, *columns):
    return {(r["graph_id"], r["node"]): tuple(r[c] for c in columns) for r in df.collect()}


@pytest.fixture(scope="module")
def points():
    r = random.Random(1)
    return {(g, v): (r.uniform(-1, 1), r.uniform(-1, 1)) for g, n in SIZES.items() for v in range(n)}


@pytest.fixture(scope="module")
def coords(spark, points):
    return spark.createDataFrame([("b", g, v, *xy) for (g, v), xy in points.items()], XY).repartition(3)


@pytest.fixture(params=[512, 8])
def block(request, monkeypatch):
    """One tile a graph, or blocks of about eight nodes and steps of 20 pairs."""
    made = P.over_pairs
    monkeypatch.setattr(P, "over_pairs", lambda *a, **k: made(*a, **{**k, "block": request.param}))
    if request.param == 8:
        monkeypatch.setattr(P, "STEP", 20)
    return request.param


def test_dense_attention_and_distance_repulsion(spark, points, coords, block):
    r = random.Random(2)
    q = {k: tuple([r.gauss(0, 9) for _ in range(3)] for _ in "qkv") for k in points}
    rows = spark.createDataFrame([("b", *k, *v) for k, v in q.items()], KEY + "node long, q array<double>, k array<double>, v array<double>")
    got = by_node(M.dense_attention(rows, 3), "f")
    moved = by_node(M.distance_repulsion(rows.selectExpr("bundle", "graph_id", "node", "v AS f"), coords, 0.1), "f")
    for g, n in SIZES.items():
        a, b, c = (np.array([q[g, v][i] for v in range(n)]) for i in range(3))
        e = a @ b.T / 3**0.5
        w = np.exp(e - e.max(1, keepdims=True))
        want = (w / w.sum(1, keepdims=True)) @ c
        xy = np.array([points[g, v] for v in range(n)])
        near = np.exp(-np.linalg.norm(xy[:, None] - xy[None], axis=2)) * (1 - np.eye(n))
        for v in range(n):
            assert np.allclose(got[g, v][0], want[v], atol=1e-12)
            assert np.allclose(moved[g, v][0], c[v] - 0.1 * near[v] @ c, atol=1e-12)


def test_repulsion_and_pairwise_loss(spark, points, coords, block):
    parts = spark.createDataFrame([("b", g, v, v % 2 if g == 3 else 0) for g, v in points], KEY + "node long, component int")
    k = coords.selectExpr("bundle", "graph_id", "node", "0.5 AS k")
    got = by_node(M.fr_repulsion(coords, parts, k.selectExpr("bundle", "graph_id", "node", "double(k) AS k")), "fx", "fy")
    pred = coords.withColumnRenamed("node", "idx")
    loss = {r["graph_id"]: r["pairwise_loss"] for r in G.pairwise_distance_loss(pred, pred.selectExpr("bundle", "graph_id", "idx", "x * x AS x", "y + 1 AS y")).collect()}
    assert set(got) == {(g, v) for g, v in points if g != 1}
    for g, n in SIZES.items():
        xy = np.array([points[g, v] for v in range(n)])
        true = np.stack([xy[:, 0] ** 2, xy[:, 1] + 1], 1)
        far = lambda p: np.linalg.norm(p[:, None] - p[None], axis=2)
        assert math.isclose(loss[g], ((far(xy) - far(true)) ** 2).mean(), abs_tol=1e-12)
        for v in range(n if g > 1 else 0):
            force = np.zeros(2)
            for o in range(n):
                if o != v and (g != 3 or o % 2 == v % 2):
                    d = xy[v] - xy[o]
                    force += d * 0.25 / (np.linalg.norm(d) + 1e-2) ** 2
            assert np.allclose(got[g, v], force, atol=1e-9)


def test_a_large_graph_is_many_tasks(spark):
    """20,000 nodes: 40 blocks, so 40 keys of tiles, none of which holds more than a 20th of the nodes."""
    rows = spark.range(20_000).selectExpr("'b' AS bundle", "1L AS graph_id", "id AS node", "rand(3) AS x", "rand(4) AS y")
    blocks = P._blocks(rows, P.K, ["x", "y"], P.BLOCK).selectExpr("b", "nb", "size(c) AS n").collect()
    assert len(blocks) == blocks[0]["nb"] == 40 and max(b["n"] for b in blocks) < 1000
    got = P.over_pairs(rows, ["x", "y"], lambda p: {"s": p.sum((P.distance(p)[2] < 0.1).astype(float))}, {"s": "double"}).toPandas()
    xy = rows.toPandas()
    for v in range(0, 20_000, 997):
        near = np.hypot(xy.x - xy.x[v], xy.y - xy.y[v]) < 0.1
        assert got.s[got.node == v].item() == near.sum()


def test_results_do_not_depend_on_partitioning(spark, coords, monkeypatch):
    made, found = P.over_pairs, []
    monkeypatch.setattr(P, "over_pairs", lambda *a, **k: made(*a, **{**k, "block": 8}))
    edges = spark.createDataFrame([("b", 3, i, i + 1, 1.0) for i in range(39)], KEY + "src long, dst long, weight double")
    for parts in (1, 5):
        at = coords.repartition(parts).selectExpr("*", "int(node) AS idx")
        heat = at.select("bundle", "graph_id").distinct().selectExpr("*", "0.1D AS heat")
        found.append(by_node(L.spring_step(at, edges.repartition(parts), heat), "x", "y"))
    assert found[0].keys() == found[1].keys() and all(np.allclose(found[0][k], found[1][k], atol=1e-15) for k in found[0])


@pytest.mark.parametrize("block", [512, 6])
@pytest.mark.parametrize("k", [1, 2, 5, 60])
def test_nearest_nodes(spark, block, k):
    r = random.Random(4)
    shapes = {1: [(0.0, 0.0)], 2: [(0.5, 0.5)] * 30, 3: [(r.gauss(0, 1) ** 3, r.gauss(0, 1)) for _ in range(90)], 4: [(float(i), 0.0) for i in range(40)], 5: [(i % 5, i // 5) for i in range(25)] + [(100.0, 100.0)], 6: [(0.0, 0.0)] * 20 + [(1.0, 1.0)] * 20 + [(0.3, 0.9)]}
    rows = spark.createDataFrame([("b", g, v, float(x), float(y)) for g, xy in shapes.items() for v, (x, y) in enumerate(xy)], XY).repartition(3)
    got = {}
    for row in N.knn_within_graph(rows, k, block).collect():
        got.setdefault((row["graph_id"], row["node"]), {})[row["rank"]] = (row["other"], row["d"])
    for g, xy in shapes.items():
        for v, (x, y) in enumerate(xy):
            want = sorted((math.sqrt((x - a) * (x - a) + (y - b) * (y - b)), o != v, o) for o, (a, b) in enumerate(xy))[:k]
            found = [got[g, v][i + 1] for i in range(len(want))]
            assert len(got[g, v]) == len(want) and [o for o, _ in found] == [o for *_, o in want]
            assert all(math.isclose(d, w[0], abs_tol=1e-15) for (_, d), w in zip(found, want, strict=True))
