"""Synthetic families, splits and run names: rules and edge cases."""

import collections
import hashlib

import pytest
from pyspark.sql import functions as F

from graphloom.functions import runs as R
from graphloom.operators import split, synth

SPECS = "bundle string, graph_id long, num_nodes int"


def by_graph(edges):
    found = collections.defaultdict(list)
    for e in edges.collect():
        found[e.graph_id].append((e.src, e.dst))
    return found


def pieces(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[find(a)] = find(b)
    return len({find(x) for x in range(n)})


@pytest.fixture(scope="module")
def specs(spark):
    return spark.createDataFrame([("b", i, n) for i, n in enumerate([1, 2, 3, 7, 12, 30, 30])], SPECS)


def test_node_ranges():
    assert synth.parse_node_range(5) == (5, 5) and synth.parse_node_range("3-9") == (3, 9) and synth.parse_node_range({"min": 2, "max": 4}) == (2, 4)
    for bad in (None, 2.5, True, {"min": 1}):
        with pytest.raises(ValueError):
            synth.parse_node_range(bad)


def test_random_graphs_are_connected(specs):
    graphs, nodes, edges = synth.er_graphs(specs, 0.4)
    found = by_graph(edges)
    for g in graphs.collect():
        pairs = found[g.graph_id]
        assert len(set(pairs)) == len(pairs) and all(0 <= a < b < g.num_nodes for a, b in pairs)
        assert pieces(g.num_nodes, pairs) == 1
    assert nodes.count() == sum(g.num_nodes for g in graphs.collect())


def test_random_graphs_that_cannot_be_connected_raise(specs):
    with pytest.raises(RuntimeError):
        synth.er_graphs(specs, 0.0, max_attempts=2)


@pytest.mark.parametrize("p", [0.0, 0.02, 0.5, 0.97, 1.0])
def test_gaps_give_each_pair_its_chance(spark, p):
    """Edge counts within three deviations, all pairs in range and none twice; every pair has its turn."""
    sizes = [2, 3, 40, 301, 301]
    specs = spark.createDataFrame([("b", i, n) for i, n in enumerate(sizes)], SPECS)
    found = by_graph(synth.er_edges(specs, p))
    assert {g: sorted(e) for g, e in by_graph(synth.er_edges(specs.repartition(3), p)).items()} == {g: sorted(e) for g, e in found.items()}
    for g, n in enumerate(sizes):
        pairs, total = found[g], n * (n - 1) // 2
        assert len(set(pairs)) == len(pairs) and all(0 <= a < b < n for a, b in pairs)
        assert abs(len(pairs) - p * total) <= 3 * (p * (1 - p) * total) ** 0.5 + (1 if 0 < p < 1 else 0)
    if p == 0.5:
        by_end = collections.Counter(a for a, _ in found[3])
        assert all(abs(by_end[a] - p * (300 - a)) <= 5 * (p * p * (300 - a)) ** 0.5 + 2 for a in range(300))
        assert found[3] != found[4]


def test_few_draws_are_followed_by_all(specs, monkeypatch):
    """A stretch whose first draws don't reach its end goes on."""
    want = {g: sorted(e) for g, e in by_graph(synth.er_edges(specs, 0.5)).items()}
    monkeypatch.setattr(synth, "DRAWS", 2)
    assert {g: sorted(e) for g, e in by_graph(synth.er_edges(specs, 0.5)).items()} == want


def test_preferential_attachment(specs):
    graphs, _, edges = synth.ba_graphs(specs, 3)
    found = by_graph(edges)
    again = by_graph(synth.ba_graphs(specs.repartition(5), 3)[2])
    assert again == found
    for g in graphs.collect():
        n, m = g.num_nodes, min(3, g.num_nodes - 1)
        assert len(set(found[g.graph_id])) == len(found[g.graph_id]) == (m + (n - m - 1) * m if n > 1 else 0)
        assert pieces(n, found[g.graph_id]) == 1


def grown(graph, n, m, seed=42):
    """Node by node, with the same draws."""
    m = min(m, n - 1)
    pairs = [(0, i) for i in range(1, m + 1)]
    ends = [x for _, i in pairs for x in (i, 0)]
    for new in range(m + 1, n):
        found, t = [], 0
        while len(found) < m:
            u = int(hashlib.md5(f"{seed}|end|b|{graph}|{new}|{t}".encode()).hexdigest()[:13], 16) / 2**52
            end, t = ends[int(u * len(ends))], t + 1
            found += [end] if end not in found else []
        pairs += [(old, new) for old in found]
        ends += [x for old in found for x in (new, old)]
    return pairs


@pytest.mark.parametrize(("m", "first", "head"), [(1, 2, 0), (4, 1, 0), (3, 4, 12), (5, 2, 1024)])
def test_attachment_in_rounds_equals_growth_by_nodes(spark, m, first, head, monkeypatch):
    """With few draws at first, nodes draw again; graphs are cut into blocks, and where the rounds begin changes nothing."""
    monkeypatch.setattr(synth, "HEAD", head)
    monkeypatch.setattr(synth, "FIRST_DRAWS", first)
    monkeypatch.setattr(synth, "BLOCK", 7)
    sizes = [1, 2, 3, 4, 6, 7, 40, 40]
    specs = spark.createDataFrame([("b", i, n) for i, n in enumerate(sizes)], SPECS)
    found = by_graph(synth.ba_edges(specs, m))
    assert {g: sorted(p) for g, p in found.items()} == {g: sorted(grown(g, n, m)) for g, n in enumerate(sizes) if n > 1}
    assert synth.ba_edges(specs, 0).count() == synth.ba_edges(specs.limit(0), m).count() == 0


def test_attachment_follows_degrees(spark):
    """Of all nodes 2 / (m + 2) have m links, 2 m / ((m + 2) (m + 3)) one more, in the limit; node 0 has m of
    the 2 m link ends when the star is made, so some m sqrt(n / (m + 1)) at last. Most of these nodes settle in rounds."""
    n, m = 4000, 3
    pairs = by_graph(synth.ba_edges(spark.createDataFrame([("b", 0, n)], SPECS), m))[0]
    degree = collections.Counter(x for pair in pairs for x in pair)
    share = collections.Counter(degree.values())
    assert len(pairs) == len(set(pairs)) == m + (n - m - 1) * m and pieces(n, pairs) == 1
    assert abs(share[m] / n - 2 / (m + 2)) < 0.025 and abs(share[m + 1] / n - 2 * m / ((m + 2) * (m + 3))) < 0.025
    assert 0.4 < degree[0] / (m * (n / (m + 1)) ** 0.5) < 2.5


def test_small_worlds_keep_the_ring_without_rewiring(specs):
    lattice = {g: sorted(p) for g, p in by_graph(synth.ws_lattice(specs)).items()}
    assert {g: sorted(p) for g, p in by_graph(synth.ws_graphs(specs, p=0.0)[2]).items()} == lattice
    assert len(lattice[5]) == 30 * 3
    drawn = by_graph(synth.ws_graphs(specs, p=0.5)[2])
    assert {g: len(p) for g, p in drawn.items()} == {g: len(p) for g, p in lattice.items()}
    assert drawn[5] != drawn[6] and sorted(drawn[5]) != lattice[5]


@pytest.mark.parametrize("p", [0.3, 1.0])
def test_rewired_links_keep_their_number_and_near_ends(spark, p, monkeypatch):
    """In graphs of 8 and 9 nodes there are too few free pairs, so links stay."""
    monkeypatch.setattr(synth, "MAX_DRAWS", 6)
    sizes = [2, 7, 8, 9, 40, 400]
    specs = spark.createDataFrame([("b", i, n) for i, n in enumerate(sizes)], SPECS)
    lattice, drawn = by_graph(synth.ws_lattice(specs)), by_graph(synth.ws_graphs(specs, p=p)[2])
    assert {g: sorted(e) for g, e in drawn.items()} == {g: sorted(e) for g, e in by_graph(synth.ws_graphs(specs.repartition(3), p=p)[2]).items()}
    for g, n in enumerate(sizes):
        pairs = drawn[g]
        assert len(set(pairs)) == len(pairs) == len(lattice[g]) and all(0 <= a < b < n for a, b in pairs)
        kept = len(set(pairs) & set(lattice[g])) / len(pairs)
        if n == 400:
            assert abs(kept - (1 - p)) < 0.05
        if n <= 7:
            assert kept == 1  # all nodes are neighbours already


def test_families_by_config(spark):
    graphs, _, _ = synth.graphs_from_config(spark, {"type": "WS", "num_graphs": 4, "num_nodes": "8-9", "k": 2})
    assert {g.num_nodes for g in graphs.collect()} <= {8, 9} and graphs.count() == 4
    with pytest.raises(ValueError):
        synth.graphs_from_config(spark, {"type": "LFR", "num_graphs": 1})


def test_split_sizes_and_edge_cases(spark):
    df = spark.range(23).select(F.lit("b").alias("bundle"), F.col("id").alias("graph_id"))
    rows = split.split_dataset(df).collect()
    assert collections.Counter(r.split for r in rows) == {"train": 18, "val": 2, "test": 3}
    assert sorted(r.position for r in rows if r.split == "train") == list(range(18))
    assert rows and {(r.graph_id, r.split) for r in rows} == {(r.graph_id, r.split) for r in split.split_dataset(df.repartition(7)).collect()}
    batches = split.assign_batches(split.split_dataset(df), 5, epoch=1).filter("split = 'train'").groupBy("batch").count().collect()
    assert sorted(r["count"] for r in batches) == [3, 5, 5, 5]
    with pytest.raises(ValueError):
        split.split_dataset(df, (0.8, 0.1, 0.2))
    assert split.split_dataset(df.limit(0)).count() == 0
    assert split.sample_graphs(df, 99).count() == 23


def test_run_names(spark):
    params = [{"hidden_dim": "64", "dropout": "0.10", "use_residual": "True", "K": "3"}, {}, None, {"learning_rate": "1e-05", "x": "2.0", "name": "v1.2.3"}]
    keys = [r.k for r in spark.createDataFrame([(i, p) for i, p in enumerate(params)], "i int, p map<string,string>").orderBy("i").select(R.run_key(F.col("p")).alias("k")).collect()]
    assert keys == ["k3_d0.1_h64_use_residualTrue", "default", "default", "lr0_namev1.2.3_x2"]
    paths = ["/m/GAT_d0.1_h64_l3.pt", "x/plain", "/a/forcegnn_topk16_use_input_mlpFalse.pt", None]
    told = spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "i int, p string").orderBy("i").select(R.parse_run_name(F.col("p")).alias("t"), R.detect_model(F.col("p")).alias("m")).collect()
    assert [t.m for t in told] == ["GAT", "GCN", "ForceGNN", "GCN"]
    assert (told[0].t.dropout, told[0].t.hidden_dim, told[0].t.num_layers, told[0].t.top_k) == (0.1, 64, 3, None)
    assert told[1].t is None and told[3].t is None
    assert told[2].t.top_k == 16 and told[2].t.use_input_mlp is False
    names = spark.range(1).select(R.graph_name(F.lit("ER"), F.lit(7)).alias("g"), R.bundle_name(F.lit("er"), F.lit(10), F.lit(20), F.lit(50), F.lit("t")).alias("b")).first()
    assert names.g == "ER_0007" and names.b == "er_10graphs_20-50nodes_t"


def test_specs_of_one_task_are_dealt_out(spark, monkeypatch):
    """A table of a few bytes is one split; what comes of its rows is many tasks' work."""
    monkeypatch.setattr(synth, "PART", 500)
    specs = spark.range(100).coalesce(1).selectExpr("'b' AS bundle", "id AS graph_id", "IF(id = 0, 2, 50) AS num_nodes")
    lattice = synth.ws_lattice(specs, 6)
    assert lattice.rdd.getNumPartitions() == 10
    assert lattice._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 0
    ends = [(r.graph_id, r.src, r.dst) for r in lattice.collect()]
    assert len(ends) == len(set(ends)) == 99 * 150 + 1 and all(a < b for _, a, b in ends)


def test_small_worlds_that_are_settled_take_no_part_in_later_rounds(spark, monkeypatch):
    """Equal to rounds over all links, in any size of blocks; graphs drop out as their links find pairs."""
    kept, stored = [], synth.shared.stored
    monkeypatch.setattr(synth.shared, "stored", lambda df: kept.append(stored(df)) or kept[-1])
    specs = spark.range(40).selectExpr("'b' AS bundle", "id AS graph_id", "IF(id = 0, 300, 24) AS num_nodes")
    small = by_graph(synth.ws_graphs(specs, 6, 0.5)[2])
    rounds = [t.filter("graph_id > 0").count() for t in kept[1:]]
    assert len(rounds) > 2 and rounds[-1] < rounds[0] / 4 and rounds == sorted(rounds, reverse=True)
    monkeypatch.setattr(synth, "BLOCK", 20)
    blocks = by_graph(synth.ws_graphs(specs, 6, 0.5)[2])
    assert {g: sorted(p) for g, p in small.items()} == {g: sorted(p) for g, p in blocks.items()}
    for g, n in enumerate([300, 24, 24]):
        u = lambda *parts: int(hashlib.md5("|".join(map(str, (42, *parts))).encode()).hexdigest()[:13], 16) / (1 << 52)  # noqa: B023, E731
        ring = [(step, v) for step in (1, 2, 3) for v in range(n)]
        draw = {link: 0 for link in ring if u("move", "b", g, *link) < 0.5}
        while True:
            at = {(s, v): tuple(sorted((v, (v + 4 + int(u("to", "b", g, s, v, d) * (n - 7))) % n))) for (s, v), d in draw.items()}
            first = {}
            for link in sorted(at):
                first.setdefault(at[link], link)
            lost = [link for link in at if first[at[link]] != link]
            if not lost:
                break
            for link in lost:
                draw[link] += 1
        assert sorted(small[g]) == sorted([*at.values(), *(tuple(sorted((v, (v + s) % n))) for s, v in ring if (s, v) not in draw)])
