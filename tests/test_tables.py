"""Tables on disk, text in splits, and the dataset job on tables that are bucketed by graph."""

import pytest
from pyspark.sql import functions as F

from graphloom import shared
from graphloom.operators import layouts as L
from graphloom.operators import prep, structure
from graphloom.sources import tables as D
from graphloom.sources import text as T

NAMES = ["007", "01", "1e3", "2024-01-01", "a b/c=d", "null", "true", "", None]


@pytest.fixture(scope="module")
def parts(spark):
    """(graphs, nodes, edges): a path of three nodes for every odd name of a bundle; graph ids are texts."""
    graphs = spark.createDataFrame([(b, f"0{i}", None if i == 2 else "ER", 3) for i, b in enumerate(NAMES)], "bundle string, graph_id string, graph_type string, num_nodes int")
    nodes = graphs.select("bundle", "graph_id", F.explode(F.array(*(F.lit(i).cast("long") for i in range(3)))).alias("node")).withColumn("idx", F.col("node").cast("int"))
    edges = nodes.filter("node < 2").select("bundle", "graph_id", F.col("node").alias("src"), (F.col("node") + 1).alias("dst"), F.lit(1.0).alias("weight"))
    return graphs, nodes, edges


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_names_come_back_as_written(spark, parts, tmp_path):
    graphs, nodes, edges = parts
    layouts = L.circular_layout(nodes)
    for kind, df in (("graphs", graphs), ("nodes", nodes), ("edges", edges), ("layouts", layouts), ("initial_positions", layouts)):
        D.write_table(df, f"{tmp_path}/{kind}", kind)
        back = D.read_table(spark, f"{tmp_path}/{kind}", kind)
        shared_columns = [c for c in back.columns if c in df.columns]
        assert rows(back, *shared_columns) == rows(df, *shared_columns)
    assert rows(D.read_table(spark, f"{tmp_path}/graphs", "graphs", ["007", "1e3"]), "bundle") == [("007",), ("1e3",)]
    named = layouts.filter("bundle = '007'").withColumn("bundle", F.concat("bundle", F.lit("_circular_layout")))
    D.write_table(named, f"{tmp_path}/named", "layouts")
    matched = T.match_layout_bundles(graphs.filter("bundle = '007'"), D.read_table(spark, f"{tmp_path}/named", "layouts"), "circular")
    assert matched.first().layout_bundle == "007_circular_layout"


def test_wrong_kinds_raise(spark, parts, tmp_path):
    graphs, nodes, _ = parts
    layouts = L.circular_layout(nodes)
    D.write_table(layouts, f"{tmp_path}/layouts", "layouts")
    for kind in ("graphs", "nodes", "edges", "samples", "initial_positions"):
        with pytest.raises(ValueError, match="layouts|lacks"):
            D.read_table(spark, f"{tmp_path}/layouts", kind)
    with pytest.raises(ValueError, match="unknown kind"):
        D.read_table(spark, f"{tmp_path}/layouts", "pictures")
    with pytest.raises(ValueError, match="x is absent"):
        D.write_table(nodes, f"{tmp_path}/no", "layouts")
    with pytest.raises(ValueError, match="x is string"):
        D.write_table(layouts.withColumn("x", F.lit("1")), f"{tmp_path}/no", "layouts")
    nodes.write.parquet(f"{tmp_path}/foreign")  # without the mark of its kind
    with pytest.raises(ValueError, match="lacks"):
        D.read_table(spark, f"{tmp_path}/foreign", "edges")


def test_samples_with_communities_and_unknown_types(spark, parts, tmp_path):
    graphs, nodes, edges = parts
    odd = nodes.withColumn("community", F.when((F.col("graph_id") == "00") & (F.col("idx") != 1), 4).when((F.col("graph_id") == "01") & (F.col("idx") > 0), 5).cast("int"))
    layouts = L.circular_layout(nodes).withColumn("layout_type", F.when(F.col("graph_id") != "03", F.col("layout_type")))
    named = F.col("bundle").isNotNull()
    made = L.build_dataset(graphs.filter(named), odd.filter(named), edges.filter(named), layouts.filter(named), L.FeatureConfig(positional=True))
    D.write_table(made, f"{tmp_path}/samples", "samples")
    back = {r.graph_id: r for r in D.read_table(spark, f"{tmp_path}/samples", "samples").collect()}
    assert back["00"].community == [4, 0, 4] and back["00"].num_communities == 2
    assert back["01"].community is None and back["01"].num_communities is None  # its first node has none
    assert back["02"].graph_type == "unknown" and back["03"].layout_type == "unknown"
    packed = L.pack_samples(graphs, L.node_features(nodes, edges, L.FeatureConfig(positional=True)), edges, layouts, odd)
    assert {r.graph_id: r.community for r in packed.filter("graph_id < '02'").collect()} == {"00": [4, 0, 4], "01": None}
    stats = {(r.level, r.graph_type, r.layout_type): (r.num_graphs, r.with_communities) for r in structure.dataset_statistics(made).collect()}
    assert stats == {("graph_type", "ER", None): (7, 1), ("graph_type", "unknown", None): (1, 0), ("layout_type", None, "circular"): (7, 1), ("layout_type", None, "unknown"): (1, 0), ("all", None, None): (8, 1)}


def test_initial_positions_that_lack(spark, parts):
    graphs, nodes, _ = parts
    nodes = nodes.filter("bundle IS NOT NULL")
    initial = L.grid_positions(nodes).filter("NOT (graph_id = '01' AND node = 2) AND graph_id <> '04'").withColumn("x", F.when((F.col("graph_id") == "03") & (F.col("node") == 0), float("nan")).otherwise(F.col("x")))
    assert rows(prep.missing_initial(nodes, initial), "graph_id", "lacking") == [("01", 1), ("03", 3), ("04", 3)]
    support = prep.feature_support(graphs.withColumn("num_nodes", F.when(F.col("graph_id") == "00", 4).otherwise(3)).withColumn("bundle", F.lit("b")), initial.withColumn("bundle", F.lit("b")))
    assert rows(support, "bundle", "one_size", "has_initial") == [("b", False, True)]


def test_seed_zero_is_no_seed(spark):
    got = structure.generation_summary(spark.createDataFrame([(True, 0, 1, 1, 1), (True, 0, 1, 1, 1), (True, 7, 1, 1, 1), (True, 7, 3, 1, 1), (False, 9, 9, 9, 9)], "ok boolean, seed long, nodes long, edges long, communities long")).first()
    assert (got.min_seed, got.max_seed, got.repeated_seeds, got.max_nodes, got.success_rate) == (7, 7, 1, 3, 0.8)


def test_last_line_wins_over_splits(spark, tmp_path):
    """A file of many splits: of the repeats of an edge, the last line of the file decides, and every bad line is told."""
    (tmp_path / "b 1").mkdir()
    lines = [f"{i % 7} {i % 7 + 1} {i}" for i in range(5000)]
    lines[10:10] = ["# note", "", "5", "x y", "1 2 heavy"]
    (tmp_path / "b 1" / "g7.dat").write_text("\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        read = T.read_lines(spark, f"{tmp_path}/b 1")
        assert read.rdd.getNumPartitions() > 10
        got = {r.src: (r.bundle, r.graph_id, r.weight) for r in T.parse_edge_lines(read).collect()}
        assert got == {a: ("b 1", "g7", float(max(i for i in range(5000) if i % 7 == a))) for a in range(7)}
        assert rows(T.rejected_lines(read, "edges"), "value", "reason") == [("1 2 heavy", "not a number"), ("5", "short"), ("x y", "not a number")]
        assert rows(T.rejected_lines(read, "communities"), "value", "reason") == [("5", "short"), ("x y", "not a number")]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_bucketed_tables_join_without_an_exchange(spark, parts):
    """What the dataset job knows of a node comes from three bucketed tables without any shuffle."""
    graphs, nodes, edges = (p.filter("bundle <> ''") for p in parts)
    changed = {"spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in changed}
    for k, v in changed.items():
        spark.conf.set(k, v)
    try:
        for name, df in (("nodes", nodes), ("edges", edges), ("layouts", L.circular_layout(nodes))):
            D.save_by_graph(df, f"by_graph_{name}", name, 4, f"{shared.shared_dir(spark)}/by_graph_{name}")
        got = L.known_of_nodes(*(D.open_by_graph(spark, f"by_graph_{n}", n) for n in ("nodes", "edges", "layouts")))
        assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
        assert rows(got, "graph_id", "idx", "degree") == sorted(((f"0{i}", v, 1 + v % 2) for i in range(7) for v in range(3)), key=repr)
        with pytest.raises(ValueError):
            D.open_by_graph(spark, "by_graph_nodes", "edges")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
        for name in ("nodes", "edges", "layouts"):
            spark.sql(f"DROP TABLE IF EXISTS by_graph_{name}")


def test_scratch_removes_what_was_stored(spark, parts):
    import os

    with shared.scratch(spark):
        kept = shared.stored(parts[1])
        table = shared.bucketed(parts[1], ["bundle", "graph_id"], "mine")
        files = [f.removeprefix("file:") for df in (kept, table) for f in df.inputFiles()]
        assert kept.count() == table.count() == 27 and all(os.path.exists(f) for f in files)
    assert files and not any(os.path.exists(f) for f in files)


def test_stored_tables_are_no_broadcast_by_the_size_of_their_files(spark):
    """A million rows whose columns repeat are a small file; a join of it must not pass them through the driver."""
    rows = spark.range(1_000_000).selectExpr("'b' AS bundle", "id div 100000 AS graph_id", "id % 1000 AS node", "0 AS idx")
    with shared.scratch(spark):
        one, two = shared.stored(rows), shared.stored(rows)
        assert int(two._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) < 10 << 20
        for found in (one.join(two, ["bundle", "graph_id", "node"]), one.join(two.groupBy("bundle", "graph_id").count(), ["bundle", "graph_id"], "left_semi")):
            assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_graphs_without_a_common_node_take_no_place_in_a_batch(spark):
    """Graph 2 has two nodes, of which the truth lacks both: 33 graphs are left, the last one alone in its batch."""
    from graphloom.plans import checks

    size = F.when(F.col("graph_id") == 2, 2).otherwise(F.col("graph_id") % 5 + 4)
    nodes = spark.range(2, 36).select(F.lit("b").alias("bundle"), F.col("id").alias("graph_id")).withColumn("idx", F.explode(F.sequence(F.lit(0), (size - 1).cast("int")))).withColumn("node", F.col("idx").cast("long"))
    graphs = nodes.select("bundle", "graph_id").distinct()
    got = dict(rows(checks.loss_per_batch(graphs, nodes, None), "batch_id", "loss"))
    alone = dict(rows(checks.align_lengths(graphs, nodes, None), "graph_id", "mse"))
    assert len(alone) == 33 and set(got) == {0, 1} and got[1] == pytest.approx(alone[35], abs=1e-9)


def test_layouts_of_both_sides_meet_by_a_merge(spark):
    """What a join gives has no hint of its own, and is taken for as small as the files below it."""
    from graphloom.operators import losses as G

    with shared.scratch(spark):
        nodes = shared.stored(spark.range(1000).selectExpr("'b' AS bundle", "id div 50 AS graph_id", "id AS node", "int(id % 50) AS idx"))
        both = [L.normalize_coords(f(nodes)) for f in (L.grid_positions, L.circular_layout)]
        assert "Broadcast" not in G.align_lengths(*both)._jdf.queryExecution().executedPlan().toString()


def test_lines_are_split_once(spark):
    """Filters on tokens went below the split, and each of their conditions split the line again."""
    lines = spark.range(10).selectExpr("'b' AS bundle", "id AS graph_id", "id AS line_no", "concat(' ', id, '\t', id + 1, ' 2.5 ', id) AS value")
    for found in (T.parse_edge_lines(lines), T.rejected_lines(lines, "edges"), T.parse_community_lines(lines)):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("regexp_") == 1 and "split(" not in plan


def test_weights_as_a_cast_reads_them(spark):
    texts = ["2.5", "-1e3", "+.5", "1.", "NaN", "-Infinity", "inf", "-inf", "1d", "0x1p3", "nan", "heavy", "e5", "x1", "--1", "1,5", "i", "ñ", "١"]
    lines = spark.createDataFrame([("b", i, 1, f"1 2 {t}") for i, t in enumerate(texts)], "bundle string, graph_id long, line_no long, value string")
    want = {r.graph_id: str(r.w) for r in lines.selectExpr("graph_id", "try_cast(split(value, ' ')[2] AS double) AS w").collect() if r.w is not None}
    assert {r.graph_id: str(r.weight) for r in T.parse_edge_lines(lines).collect()} == want and 5 < len(want) < len(texts)
    assert {r.graph_id for r in T.rejected_lines(lines, "edges").collect()} == set(range(len(texts))) - set(want)


def test_graphs_of_orders_lie_by_graph(spark):
    """Nodes and edges of the derived graphs meet, and are counted by node, without a further exchange."""
    from graphloom.operators import structure
    from graphloom.plans import fixtures

    before = {k: spark.conf.get(k) for k in ("spark.sql.requireAllClusterKeysForCoPartition", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with shared.scratch(spark):
            _, nodes, edges = fixtures.order_graph(spark, "/root/testdata/sf0.001")
            plan = structure.degrees(nodes, edges)._jdf.queryExecution().executedPlan().toString()
            assert "Exchange" not in plan and plan.count("Bucketed: true") == 2
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_dataset_of_graphs_that_lie_so_exchanges_no_node_or_edge(spark):
    """What the job keeps between its steps lies by graph too, so that after the tables of orders are made only graphs and counts are exchanged."""
    from graphloom.plans import checks, fixtures

    before = {k: spark.conf.get(k) for k in ("spark.sql.requireAllClusterKeysForCoPartition", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with shared.scratch(spark):
            graphs, nodes, edges = fixtures.order_graph(spark, "/root/testdata/sf0.001")
            samples = checks._samples(graphs, nodes, edges)
            plan = samples._jdf.queryExecution().executedPlan().toString()
            moved = [line for line in plan.splitlines() if "Exchange" in line]
            assert len(moved) == 1  # the customers, who bring their graphs' types
            first = min(samples.collect(), key=lambda s: (s.bundle, s.graph_id))
            places = {r.node: r.idx for r in nodes.filter((F.col("bundle") == first.bundle) & (F.col("graph_id") == first.graph_id)).collect()}
            mine = edges.filter((F.col("bundle") == first.bundle) & (F.col("graph_id") == first.graph_id)).collect()
            want = sorted((places[e.src], places[e.dst]) for e in mine)
            assert [(e.src, e.dst) for e in first.edge_index] == want + [(b, a) for a, b in want]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
