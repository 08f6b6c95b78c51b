"""Rounds over routes, and triangles by lists, against numpy: hubs in slices, isolated nodes, many graphs; and what their plans move."""

import random
import re

import numpy as np
import pytest

from graphloom.operators import messages as M
from graphloom.operators import routes as R
from graphloom.operators import structure as S

KEY = "bundle string, graph_id long, "


@pytest.fixture(scope="module")
def graphs():
    """graph: (nodes, edges); a hub, a triangle, an isolated node, one node, a random graph."""
    r = random.Random(6)
    hub = [(0, i) for i in range(1, 30)] + [(i, i + 1) for i in range(1, 29, 2)]
    return {1: (31, hub), 2: (3, [(0, 1), (1, 2), (0, 2)]), 3: (1, []), 4: (25, sorted({tuple(sorted(r.sample(range(25), 2))) for _ in range(120)}))}


@pytest.fixture(scope="module")
def frames(spark, graphs):
    r = random.Random(7)
    feat = {(g, v): [r.gauss(0, 1), r.gauss(0, 1)] for g, (n, _) in graphs.items() for v in range(n)}
    nodes = spark.createDataFrame([("b", g, v, f) for (g, v), f in feat.items()], KEY + "node long, f array<double>")
    edges = spark.createDataFrame([("b", g, a, b, 1.0 + a % 3) for g, (_, pairs) in graphs.items() for a, b in pairs], KEY + "src long, dst long, weight double")
    return nodes, edges, feat


def matrix(n, pairs):
    a = np.zeros((n, n))
    for i, j in pairs:
        a[i, j] = a[j, i] = 1
    return a


def by_node(df, *columns):
    return {(r["graph_id"], r["node"]): tuple(r[c] for c in columns) for r in df.collect()}


@pytest.fixture(params=[1 << 16, 4])
def slices(request, monkeypatch):
    made = R.Routes.__init__
    monkeypatch.setattr(R.Routes, "__init__", lambda self, n, e, rounds, slice_size=0: made(self, n, e, rounds, request.param))


@pytest.mark.parametrize("hops", [1, 3])
@pytest.mark.parametrize("residual", [False, True])
def test_hops(frames, graphs, slices, hops, residual):
    nodes, edges, feat = frames
    got = by_node(M.propagate_hops(nodes, edges, hops, residual, 2), "f")
    for g, (n, pairs) in graphs.items():
        a = matrix(n, pairs) + np.eye(n)
        d = 1 / np.sqrt(a.sum(1))
        step = d[:, None] * a * d[None] + (np.eye(n) if residual else 0)
        want = np.linalg.matrix_power(step, hops) @ np.array([feat[g, v] for v in range(n)])
        assert all(np.allclose(got[g, v][0], want[v], atol=1e-12) for v in range(n))


def test_chebyshev_terms(frames, graphs, slices):
    nodes, edges, feat = frames
    got = by_node(M.chebyshev_basis(nodes, edges, 4, 2), "t0", "t1", "t2", "t3")
    for g, (n, pairs) in graphs.items():
        a = matrix(n, pairs)
        d = 1 / np.sqrt(np.maximum(a.sum(1), 1))
        lap = -(d[:, None] * a * d[None])
        t = [np.array([feat[g, v] for v in range(n)])]
        t.append(lap @ t[0])
        for _ in range(2):
            t.append(2 * lap @ t[-1] - t[-2])
        assert all(np.allclose(got[g, v][j], t[j][v], atol=1e-12) for v in range(n) for j in range(4))


def test_refinement_moves_by_dense_layers(frames, graphs, slices):
    nodes, edges, feat = frames
    coords = nodes.selectExpr("bundle", "graph_id", "node", "f[1] AS x", "-f[0] AS y")
    layers = [[([[0.5, -1, 2], [1, 0.2, 0], [0.1, 1, 1], [-1, 0, 0.3]], [0.1, 0, -0.2]), ([[1, 0], [0.5, -1], [0.2, 0.3]], [0.0, 0.1])], [([[1, 0], [0, 1], [0.5, 0], [0, 0.5]], [0.0, 0.2])]]
    got = by_node(M.iterative_refine(nodes, coords, edges, [0.3, 0.1], layers, 2), "x", "y")
    for g, (n, pairs) in graphs.items():
        a = matrix(n, pairs) + np.eye(n)
        d = 1 / np.sqrt(a.sum(1))
        f = np.array([feat[g, v] for v in range(n)])
        xy = np.stack([f[:, 1], -f[:, 0]], 1)
        for size, own in zip([0.3, 0.1], layers, strict=True):
            m = (d[:, None] * a * d[None]) @ np.concatenate([f, xy], 1)
            for i, (w, b) in enumerate(own):
                m = m @ np.array(w) + np.array(b)
                m = np.maximum(m, 0) if i < len(own) - 1 else m
            xy = xy + size * m
        assert all(np.allclose(got[g, v], xy[v], atol=1e-12) for v in range(n))


def test_force_steps_over_routes(frames, graphs, slices):
    nodes, edges, feat = frames
    coords = nodes.selectExpr("bundle", "graph_id", "node", "f[0] AS x", "f[1] AS y")
    got = by_node(M.fr_unrolled(coords, edges, 2), "x", "y")
    k = M.ideal_length(M.prep.connected_components(coords.select("bundle", "graph_id", "node"), edges))
    parts = by_node(M.prep.connected_components(coords.select("bundle", "graph_id", "node"), edges).join(k, ["bundle", "graph_id", "component"]), "component", "k")
    for g, (n, pairs) in graphs.items():
        xy = np.array([feat[g, v] for v in range(n)])
        w = {frozenset(p): 1.0 + p[0] % 3 for p in pairs}
        for _ in range(2):
            force = np.zeros((n, 2))
            for i in range(n):
                for j in range(n):
                    delta = xy[i] - xy[j]
                    d = np.linalg.norm(delta) + 1e-2
                    if i != j and parts[g, i][0] == parts[g, j][0]:
                        force[i] += delta * (parts[g, i][1] / d) ** 2
                    if frozenset((i, j)) in w and i != j:
                        force[i] -= 2 * delta * d / parts[g, i][1] * w[frozenset((i, j))]
            size = np.linalg.norm(force, axis=1, keepdims=True)
            xy = xy + force * np.minimum(1, 0.05 / (size + 1e-9))
        assert all(np.allclose(got[g, v], xy[v], atol=1e-9) for v in range(n))


def test_rounds_exchange_messages_only(spark, frames):
    """Three rounds: one exchange each, and one of the nodes that start; the routes are read from their buckets as they are."""
    nodes, edges, _ = frames
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        routes = R.Routes(nodes, edges, 3)
        state = routes.start(nodes)
        first = state._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
        for _ in range(3):
            state = M._gcn(routes, state, 2)
        plan = state._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == first + 3
        assert len(re.findall(r"Scan parquet .*Bucketed: true", plan)) == 3 or plan.count("Bucketed: true") == 3
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("size", [4096, 2])
def test_triangles_by_lists(frames, graphs, size):
    nodes, edges, _ = frames
    got = by_node(S.triangles(edges, size=size), "triangles")
    for g, (n, pairs) in graphs.items():
        a = matrix(n, pairs)
        want = np.diag(a @ a @ a) / 2
        assert all(got.get((g, v), (0,))[0] == want[v] for v in range(n))


def test_triangles_of_a_dense_graph_in_slices(spark):
    pairs = [(i, j) for i in range(40) for j in range(i + 1, 40)]
    edges = spark.createDataFrame([("b", 1, a, b, 1.0) for a, b in pairs], KEY + "src long, dst long, weight double")
    assert {r["triangles"] for r in S.triangles(edges, size=7).collect()} == {39 * 38 // 2}


@pytest.mark.parametrize("hops", [1, 3])
def test_rounds_over_edges_that_lie_by_graph_exchange_nothing(spark, frames, graphs, hops):
    from graphloom import shared

    nodes, edges, feat = frames
    before = {k: spark.conf.get(k) for k in ("spark.sql.requireAllClusterKeysForCoPartition", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    shared.by_graph(spark)
    try:
        with shared.scratch(spark):
            lie = [shared.kept_by_graph(df, "lie", 4) for df in (nodes, edges)]
            got = M.propagate_hops(*lie, hops, False, 2)
            plan = got._jdf.queryExecution().executedPlan().toString()
            assert "Exchange" not in plan and "SortAggregate" not in plan
            got = by_node(got, "f")
        for g, (n, pairs) in graphs.items():
            a = matrix(n, pairs) + np.eye(n)
            d = 1 / np.sqrt(a.sum(1))
            want = np.linalg.matrix_power(d[:, None] * a * d[None], hops) @ np.array([feat[g, v] for v in range(n)])
            assert all(np.allclose(got[g, v][0], want[v], atol=1e-12) for v in range(n))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_components_of_edges_that_lie_by_graph_lie_so_too(spark, frames):
    from graphloom import shared
    from graphloom.operators import prep

    nodes, edges, _ = frames
    before = {k: spark.conf.get(k) for k in ("spark.sql.requireAllClusterKeysForCoPartition", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    want = by_node(prep.connected_components(nodes, edges), "component")
    shared.by_graph(spark)
    try:
        with shared.scratch(spark):
            lie = [shared.kept_by_graph(df, "lie", 4) for df in (nodes, edges)]
            assert "Exchange" not in prep.smallest_reached(*lie)._jdf.queryExecution().executedPlan().toString()
            assert by_node(prep.connected_components(*lie), "component") == want
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_corners_of_edges_that_lie_by_graph_exchange_nodes_only(spark, frames, graphs, monkeypatch):
    """Degrees, triangles and clustering of whole graphs, some at a time; and every feature of their nodes, in the steps smallest and as they are."""
    from graphloom import shared

    nodes, edges, _ = frames
    before = {k: spark.conf.get(k) for k in ("spark.sql.requireAllClusterKeysForCoPartition", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    want = by_node(S.with_clustering(nodes, edges), "degree", "triangles", "clustering")
    shared.by_graph(spark)
    try:
        with shared.scratch(spark):
            lie = [shared.kept_by_graph(df, "lie", 4) for df in (nodes, edges)]
            found = S.with_clustering(*lie)
            plan = found._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange") == 1 and "Exchange" not in plan[plan.index("MapInArrow") :]
            assert by_node(found, "degree", "triangles", "clustering") == want
            monkeypatch.setattr(S, "TOGETHER", 20)
            monkeypatch.setattr(S, "WEDGES", 3)
            rows = S.corners(lie[1]).collect()
            steps = list(S._corner_rows(iter([S.pa.RecordBatch.from_pylist([{"bundle": "b", "graph_id": g, "src": [a for a, _ in e], "dst": [b for _, b in e]} for g, (_, e) in graphs.items() if e])])))
            assert len(steps) == 3 and {(r.graph_id, r.node): (r.degree, r.triangles) for r in rows} == {(r["graph_id"], r["node"]): (r["degree"], r["triangles"]) for s in steps for r in s.to_pylist()}
        for g, (n, pairs) in graphs.items():
            a = matrix(n, pairs)
            t = np.diag(a @ a @ a) / 2
            assert all(want[g, v][:2] == (a[v].sum(), t[v]) for v in range(n))
            assert all((r.degree, r.triangles) == (a[r.node].sum(), t[r.node]) for r in rows if r.graph_id == g)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
