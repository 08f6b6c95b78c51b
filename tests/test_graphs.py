"""Graph operators against brute force and hand cases, and the file layer."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.keys import rank_within
from graphloom.operators import layouts as L
from graphloom.operators import messages as M
from graphloom.operators import prep, structure
from graphloom.operators import losses as G
from graphloom.sources import text as T

KEY = "bundle string, graph_id long, "
EDGES = KEY + "src long, dst long, weight double"
NODES = KEY + "node long, idx int"


def graph(spark, pairs, n, bundle="b", graph_id=1, weight=1.0):
    nodes = spark.createDataFrame([(bundle, graph_id, i, i) for i in range(n)], NODES)
    return nodes, spark.createDataFrame([(bundle, graph_id, a, b, weight) for a, b in pairs], EDGES)


def roots(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return [find(i) for i in range(n)]


def by_node(df, *columns):
    return {r["node"]: tuple(r[c] for c in columns) for r in df.collect()}


@pytest.mark.parametrize("batch", [10_000, 7])
def test_components_of_many_and_of_large_graphs(spark, batch):
    """With batches of 7 edges every graph spans several, and the rounds of joins have to finish it."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        r, edges, nodes, want = random.Random(4), [], [], {}
        path = list(range(120))
        r.shuffle(path)
        shapes = {1: (120, list(zip(path, path[1:]))), 2: (40, [(0, i) for i in range(1, 30)]), 3: (60, [(r.randrange(60), r.randrange(60)) for _ in range(35)]), 4: (3, []), 5: (2, [(1, 1)])}
        for g, (n, pairs) in shapes.items():
            for bundle in "ab":
                nodes += [(bundle, g, i, i) for i in range(n)]
                edges += [(bundle, g, a, b, 1.0) for a, b in pairs]
                found = roots(n, pairs)
                order = {x: k for k, x in enumerate(sorted(set(found)))}
                want |= {(bundle, g, i): order[x] for i, x in enumerate(found)}
        r.shuffle(edges)
        got = prep.connected_components(spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES).repartition(3))
        assert {(x.bundle, x.graph_id, x.node): x.component for x in got.collect()} == want
        none = prep.connected_components(spark.createDataFrame(nodes[:3], NODES), spark.createDataFrame([], EDGES))
        assert sorted(x.component for x in none.collect()) == [0, 1, 2]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_ranks_of_a_group_over_partitions(spark):
    rows = [("a", i % 2, i * 7 % 1000) for i in range(1000)] + [("b", 0, 5)]
    df = spark.createDataFrame(rows, "bundle string, graph_id int, v int").repartition(5)
    want = {}
    for b, g, v in sorted(set(rows)):
        want[b, g, v] = sum(1 for x in rows if x[:2] == (b, g) and x[2] < v)
    assert {(x.bundle, x.graph_id, x.v): x["rank"] for x in rank_within(df, ["bundle", "graph_id"], "v").collect()} == want


def test_hand_cases_of_structure(spark):
    nodes, edges = graph(spark, [(0, 1), (1, 2), (0, 2), (3, 4)], 6)
    assert by_node(structure.degrees(nodes, edges), "degree") == {0: (2,), 1: (2,), 2: (2,), 3: (1,), 4: (1,), 5: (0,)}
    assert by_node(structure.local_clustering(nodes, edges), "clustering") == {0: (1.0,), 1: (1.0,), 2: (1.0,), 3: (0.0,), 4: (0.0,), 5: (0.0,)}
    one = structure.zscore(spark.createDataFrame([(1.0,)], "density double"), ["density"]).first()
    assert math.isnan(one.density_norm)
    same = structure.zscore(spark.createDataFrame([(1.0,), (1.0,)], "density double"), ["density"]).collect()
    assert [x.density_norm for x in same] == [0.0, 0.0]


def test_layouts_of_one_two_and_equal_nodes(spark):
    nodes, edges = graph(spark, [], 1)
    assert by_node(L.circular_layout(nodes), "x", "y") == by_node(L.spring_layout(nodes, edges), "x", "y") == {0: (0.0, 0.0)}
    equal = spark.createDataFrame([("b", 1, i, i, 3.0, 4.0) for i in range(3)], NODES + ", x double, y double")
    assert set(by_node(L.normalize_coords(equal), "x", "y").values()) == {(0.0, 0.0)}
    assert by_node(L.normalize_coords(equal, "other"), "x", "y")[0] == (3.0, 4.0)
    assert by_node(L.node_features(nodes, edges, L.FeatureConfig(positional=True, onehot=True)), "f") == {0: ([0.0, 1.0],)}
    losses = G.spacing_loss(spark.createDataFrame([("b", 1, 0, 1.0, 0.0)], KEY + "idx int, x double, y double")).first()
    assert math.isnan(losses.spacing_loss)
    metrics = G.layout_metrics(equal.limit(0), equal.limit(0)).first()
    assert all(math.isinf(v) for v in metrics)


def test_force_layout_equals_its_steps_by_joins(spark):
    r = random.Random(2)
    nodes, edges = graph(spark, [(i, j) for i in range(12) for j in range(i + 1, 12) if r.random() < 0.3], 12, weight=2.0)
    coords = L.grid_positions(nodes)
    start = [coords.agg(F.max(c) - F.min(c)).first()[0] for c in "xy"]
    heat, steps = 0.1 * max(start), 4
    for k in range(steps):
        now = spark.createDataFrame([("b", 1, heat - k * heat / (steps + 1))], KEY + "heat double")
        coords = spark.createDataFrame(L.spring_step(coords, edges, now).collect())
    a, b = by_node(coords, "x", "y"), by_node(L.spring_layout(nodes, edges, iterations=steps), "x", "y")
    assert all(np.allclose(a[v], b[v], atol=1e-9) for v in a)
    scaled = by_node(L.spring_layout(nodes, edges, iterations=5, scale=2.0), "x", "y")
    assert math.isclose(max(abs(v) for xy in scaled.values() for v in xy), 2.0)


def drawn(seed, n, p=0.3):
    r = np.random.default_rng(seed)
    pairs = np.array([(i, j) for i in range(n) for j in range(i + 1, n) if r.random() < p] or [(0, 1)])
    return r.uniform(-1, 1, (n, 2)), pairs[:, 0], pairs[:, 1], r.uniform(0.5, 2, len(pairs))


def test_force_layout_of_many_graphs_equals_each_alone(monkeypatch):
    """To the last bit after 50 steps, also where a graph's pairs are taken in several steps."""
    graphs = [drawn(s, 31) for s in range(5)]
    together = L.spring_positions(graphs, 50, 1.5)
    monkeypatch.setattr(L.P, "STEP", 100)
    for got, one in zip(together, graphs, strict=True):
        assert (got == L.spring_positions([one], 50, 1.5)[0]).all()


def test_force_layout_is_the_same_in_every_partitioning(spark):
    edges, nodes = [], []
    for g, n in enumerate([2, 9, 30, 61, 30, 17]):
        nodes += [("b", g, i, i) for i in range(n)]
        edges += [("b", g, int(a), int(b), float(w)) for a, b, w in zip(*drawn(g, n)[1:], strict=True)]
    found = []
    for parts, order in ((1, 1), (5, -1)):
        frames = [spark.createDataFrame(rows[::order], schema).repartition(parts) for rows, schema in ((nodes, NODES), (edges, EDGES))]
        found.append({(r["graph_id"], r["node"]): (r["x"], r["y"]) for r in L.spring_layout(*frames, iterations=50).collect()})
    assert len(found[0]) == 149 and found[0] == found[1]


def test_feature_validation_and_unknown_kinds(spark):
    graphs = spark.createDataFrame([("b", 1, 3), ("b", 2, 4)], KEY + "num_nodes int")
    with pytest.raises(ValueError):
        prep.validate_features({"use_onehot": True}, graphs)
    prep.validate_features({"use_onehot": True}, graphs.limit(1))
    with pytest.raises(ValueError):
        prep.validate_features({"use_initial_position": True}, graphs)
    nodes, edges = graph(spark, [(0, 1)], 2)
    with pytest.raises(ValueError):
        L.layouts_from_config(nodes, edges, {"type": "shell"})
    got, first = L.layouts_from_config(nodes, edges, {"type": "force_directed", "iterations": 2, "save_initial_positions": True})
    assert got.count() == first.count() == 2
    with pytest.raises(ValueError):
        G.graph_loss(nodes, nodes, "other")


def test_samples_round_trip_and_files(spark, tmp_path):
    nodes, edges = graph(spark, [(0, 1), (1, 2)], 3)
    graphs = spark.createDataFrame([("b", 1, "ER", 3)], KEY + "graph_type string, num_nodes int")
    samples = L.build_dataset(graphs, nodes, edges, L.circular_layout(nodes), L.FeatureConfig(degree=True, initial_position=True), L.grid_positions(nodes))
    row = samples.first()
    assert row.initial_position_dims == (1, 3) and row.has_initial_position and [len(f) for f in row.x] == [3, 3, 3]
    assert [(e.src, e.dst) for e in row.edge_index] == [(0, 1), (1, 2), (1, 0), (2, 1)]
    again = L.unpack_samples(samples)
    assert again[0].count() == 3 and again[1].count() == 2
    T.write_results_json(spark.createDataFrame([("r", [1.0, 2.0])], "run string, losses array<double>"), f"{tmp_path}/results")
    assert spark.read.json(f"{tmp_path}/results").first().losses == [1.0, 2.0]
    with pytest.raises(ValueError):
        T.match_layout_bundles(graphs, spark.createDataFrame([("b_spring_layout",)], "bundle string"), "circular")
    assert T.select_bundles(graphs, []).count() == 0


def test_edge_and_community_text(spark, tmp_path):
    (tmp_path / "b1").mkdir()
    (tmp_path / "b1" / "g7.dat").write_text("# u v w\n1 2\n\n 2 1 0.5\n3\n3 x\n4 5 w\n6\t7  2.5 more\n8 8\n")
    (tmp_path / "b1" / "g8.dat").write_text("1 2 9\n")
    rows = T.read_edge_text(spark, f"{tmp_path}/b1").collect()
    assert sorted((r.bundle, r.graph_id, r.src, r.dst, r.weight) for r in rows) == [("b1", "g7", 1, 2, 0.5), ("b1", "g7", 6, 7, 2.5), ("b1", "g7", 8, 8, 1.0), ("b1", "g8", 1, 2, 9.0)]
    (tmp_path / "b2").mkdir()
    (tmp_path / "b2" / "c.dat").write_text("# n c\n1 4 5\n2\nx 1\n1 6\n3 2\n")
    rows = T.read_community_text(spark, f"{tmp_path}/b2").collect()
    assert sorted((r.node, r.community) for r in rows) == [(1, 6), (3, 2)]


def test_refinement_and_stiffness_by_hand(spark):
    nodes, edges = graph(spark, [(0, 1)], 2)
    feat = spark.createDataFrame([("b", 1, 0, [1.0]), ("b", 1, 1, [3.0])], KEY + "node long, f array<double>")
    coords = spark.createDataFrame([("b", 1, 0, 0.0, 2.0), ("b", 1, 1, 4.0, 0.0)], KEY + "node long, x double, y double")
    # both nodes see the mean of all: (2, 2, 1)
    layers = [([[1.0, 0.0], [0.0, 1.0], [0.0, -9.0]], [0.0, 1.0]), ([[1.0, 0.0], [1.0, 2.0]], [0.5, 0.0])]
    hidden = np.maximum(np.array([2.0, 2.0 - 9.0 + 1.0]), 0)
    move = hidden @ np.array([[1.0, 0.0], [1.0, 2.0]]) + [0.5, 0.0]
    got = by_node(M.iterative_refine(feat, coords, edges, [0.1], [layers]), "x", "y")
    assert np.allclose(got[0], np.array([0.0, 2.0]) + 0.1 * move) and np.allclose(got[1], np.array([4.0, 0.0]) + 0.1 * move)
    half = by_node(M.blend(coords, coords.withColumn("x", F.lit(8.0)), 0.25), "x", "y")
    assert half[0] == (6.0, 2.0)
    rows = M.edge_stiffness(M.edge_pair_features(feat, edges, False), [([[1.0, -1.0]], [0.5])]).first()
    assert math.isclose(rows.stiffness, math.log1p(math.exp(-1.5)) + 1e-6)


def test_components_counted_without_their_numbers_and_without_broadcasts(spark):
    """Graph 1 is two paths and a node alone, graph 2 one cycle that spans batches; the nodes' roots come by a merge, whatever the files weigh."""
    from graphloom.operators import prep

    n = 30_000
    ends = spark.range(n).selectExpr("'b' AS bundle", "2L AS graph_id", "id AS src", f"(id + 1) % {n} AS dst", "1.0D AS weight")
    paths = spark.createDataFrame([("b", 1, 0, 1, 1.0), ("b", 1, 2, 3, 1.0), ("b", 1, 3, 4, 1.0)], ends.schema)
    edges = paths.unionByName(ends)
    nodes = spark.range(6).selectExpr("'b' AS bundle", "1L AS graph_id", "id AS node").unionByName(ends.selectExpr("bundle", "graph_id", "src AS node"))
    roots = prep.smallest_reached(nodes, edges)
    assert "Broadcast" not in roots._jdf.queryExecution().executedPlan().toString()
    assert {r["graph_id"]: r["n_components"] for r in prep.count_components(nodes, edges).collect()} == {1: 3, 2: 1}


@pytest.mark.parametrize("held", [1 << 20, 40])
def test_links_of_a_large_graph_stay_dealt(spark, held, tmp_path, monkeypatch):
    """Paths, stars whose centre has the largest number, and a random graph, all in one: a task sends no more links
    than nodes, and nothing is joined by graph alone, which would deal all links to one task."""
    r = random.Random(9)
    n = 3000
    path = list(range(800))
    r.shuffle(path)
    pairs = list(zip(path, path[1:])) + [(800 + i, 1599) for i in range(799)] + [(1600 + r.randrange(1400), 1600 + r.randrange(1400)) for _ in range(1500)]
    r.shuffle(pairs)
    nodes, edges = graph(spark, pairs, n)
    kept, made = [], prep.kept_by_graph
    monkeypatch.setattr(prep, "kept_by_graph", lambda *a: kept.append(made(*a)) or kept[-1])
    joins, join = [], type(edges).join
    monkeypatch.setattr(type(edges), "join", lambda self, other, on=None, how=None: joins.append((on, how)) or join(self, other, on, how))
    got = prep.smallest_reached(nodes, edges, large=True, held=held).collect()
    assert {x.node: x.root for x in got} == dict(enumerate(roots(n, pairs)))
    assert [how for on, how in joins if on == prep.K] == ["left_semi"] and "Broadcast" not in kept[0]._jdf.queryExecution().executedPlan().toString()
    assert kept[0].count() <= (4 * n if held > n else 2 * len(pairs))


def test_forces_are_the_same_in_steps_of_any_size(monkeypatch):
    """To the last bit those of the plain formula, with arrays that are used again for steps, graphs and rows that don't come out even."""
    draw = np.random.default_rng(5)
    for g, n in ((1, 1), (7, 2), (5, 38), (2, 201)):
        x, y = draw.random((2, g, n))
        dx, dy = x[:, :, None] - x[:, None], y[:, :, None] - y[:, None]
        by = 1 / (n * np.maximum(dx * dx + dy * dy, 0.01**2))
        want = [np.add.reduceat((d * by).ravel(), np.arange(0, d.size, n)).reshape(g, n) for d in (dx, dy)]
        for most in (1, 300, 3 * n * n + 1, 1 << 15):
            monkeypatch.setattr(L, "PUSHED", most)
            assert all((a == b).all() for a, b in zip(L._push(x, y), want, strict=True))


@pytest.mark.parametrize("held", [400, 30])
def test_tasks_of_more_links_than_they_hold(spark, held, monkeypatch):
    """Contracted links meet later batches, which come without nulls after a filter; a graph is split by the end of a task or its own size only."""
    rng, kept = random.Random(5), []
    pairs = {g: [tuple(sorted(rng.sample(range(12), 2))) for _ in range(40)] for g in range(60)}
    rows = [("ab"[g % 2], g // 2, a, b, 1.0) for g, p in pairs.items() for a, b in p]
    nodes = spark.createDataFrame([("ab"[g % 2], g // 2, i, i) for g in pairs for i in range(12)], NODES)
    monkeypatch.setattr(prep, "kept_by_graph", lambda df, *more, own=prep.kept_by_graph: kept.append(own(df, *more)) or kept[-1])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        got = prep.smallest_reached(nodes, prep.stored(spark.createDataFrame(rows, EDGES)), held=held).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {g: roots(12, p) for g, p in pairs.items()}
    assert len(got) == 60 * 12 and all(r["root"] == want[2 * r["graph_id"] + (r["bundle"] == "b")][r["node"]] for r in got)
    if held == 400:
        assert kept[0].count() == kept[0].select("bundle", "graph_id", "node").distinct().count()


@pytest.mark.parametrize("size", [structure.LIST, 4])
def test_lists_go_once_to_a_block_of_nodes(spark, size):
    """Numbers that are dense, sparse and below zero; copies for each node are made behind the exchange, and none is sorted."""
    rng = random.Random(3)
    dense = {tuple(sorted(rng.sample(range(300), 2))) for _ in range(3000)}
    rows = {(g, a, b) for a, b in dense for g in (1, 2)} if size > 4 else {(1, a, b) for a, b in dense}
    at = lambda g, v: v if g == 1 else (v - 150) * 1_000_003
    edges = spark.createDataFrame([("b", g, at(g, a), at(g, b), 1.0) for g, a, b in rows], EDGES)
    got = structure.triangles(edges, size=size)
    plan = got._jdf.queryExecution().executedPlan().toString()
    join = plan[plan.index("ShuffledHashJoin") :]
    assert "BuildRight" in join.splitlines()[0] and join.index("explode(filter" if size > 4 else "explode(to") < join.index("REPARTITION_BY_NUM")
    if size > 4:
        assert "ENSURE_REQUIREMENTS" not in join and "Sort " not in join
    near = {v: {x for e in dense if v in e for x in e} - {v} for v in range(300)}
    want = {v: sum(1 for a, b in dense if a in near[v] and b in near[v]) for v in range(300)}
    rows = got.collect()
    for g in (1, 2) if size > 4 else (1,):
        assert {r.node: r.triangles for r in rows if r.graph_id == g} == {at(g, v): n for v, n in want.items() if n}
