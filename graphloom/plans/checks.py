"""More registered queries with their SQL: operators over tables with faults, features, samples, losses, messages and forces.

The faulty tables are the derived graph with loops, reversed repeats, missing and invalid coordinates, and graphs without
edges or layouts, put in by the numbers of graphs and nodes.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import runs as R
from ..keys import K, rounded, uniform_sql
from ..operators import layouts as L
from ..operators import losses as G
from ..operators import messages as M
from ..operators import prep, structure
from ..shared import kept_by_graph, shared_dir, stored
from ..sources import text as T
from .fixtures import BIG as BIG_SQL
from .fixtures import HISTORY, RUNS, big_graph, history, runs
from .registry import _FEAT, _sides, feat, out, query

_KEY = "bundle, graph_id"
_N = "bundle, graph_id, node"
NODE = [*K, "node"]


def r9(name: str):
    return rounded(name, 9).alias(name)


def q9(sql: str, name: str) -> str:
    return f"round({sql}, 9) + 0.0 AS {name}"


def on(a: str, b: str, *more: str) -> str:
    """a join condition on the graph and further pairs "x=y" of columns"""
    return " AND ".join([f"{a}.bundle = {b}.bundle", f"{a}.graph_id = {b}.graph_id", *(f"{a}.{m.split('=')[0]} = {b}.{m.split('=')[1]}" for m in more)])


# ---- edges and labels with faults ----


@query(f"SELECT {_KEY}, src, dst, weight FROM edges")
def drop_self_loops(graphs, nodes, edges):
    loops = nodes.select(*K, F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(1.0).alias("weight"))
    return prep.drop_self_loops(edges.unionByName(loops))


@query(f"SELECT {_KEY}, src, dst, CASE WHEN (src + dst) % 2 = 0 THEN weight ELSE 100 - weight END AS weight FROM edges")
def canonical_edges_last(graphs, nodes, edges):
    """Of an edge and its reversed repeat, the later one decides the weight."""
    first = edges.withColumn("line", F.when((F.col("src") + F.col("dst")) % 2 == 0, 5).otherwise(1))
    again = edges.select(*K, F.col("dst").alias("src"), F.col("src").alias("dst"), (100 - F.col("weight")).alias("weight"), F.lit(3).alias("line"))
    return prep.canonical_edges(first.unionByName(again), "line")


@query(f"SELECT {_KEY}, count(DISTINCT community) AS num_communities FROM nodes WHERE node % 3 > 0 GROUP BY ALL")
def community_counts(graphs, nodes, edges):
    return prep.community_counts(nodes.select(*K, "node", F.when(F.col("node") % 3 > 0, F.col("community")).alias("community")).filter("community IS NOT NULL"))


@query(f"SELECT n.bundle, n.graph_id, node, CASE WHEN node % 3 > 0 THEN community ELSE 0 END AS community, any_value(z.c) AS num_communities FROM nodes n JOIN (SELECT {_KEY}, count(DISTINCT CASE WHEN node % 3 > 0 THEN community ELSE 0 END) AS c FROM nodes GROUP BY ALL HAVING bool_or(idx = 0 AND node % 3 > 0)) z USING ({_KEY}) GROUP BY ALL")
def attach_partial_communities(graphs, nodes, edges):
    """Nodes without a label get 0, and a graph whose first node has none has no communities."""
    labels = nodes.filter("node % 3 > 0").select(*K, "node", "community")
    got, counts = prep.attach_communities(nodes.drop("community"), labels)
    return got.join(counts, K).select(*K, "node", "community", "num_communities")


@query("SELECT DISTINCT bundle, graph_id FROM li SEMI JOIN edges USING (bundle, graph_id)")
def drop_edgeless(graphs, nodes, edges):
    others = graphs.select("bundle", (-1 - F.col("graph_id")).alias("graph_id"))
    return prep.drop_edgeless(graphs.select(*K).unionByName(others), edges)


# ---- layouts with faults ----


def _faulty(nodes: DataFrame) -> DataFrame:
    """Circular layouts: none for every 13th graph, the second node lost in every 11th, no number or infinite in every 7th."""
    bad = F.when((F.col("graph_id") % 14 == 0) & (F.col("idx") == 1), F.lit(float("nan"))).when((F.col("graph_id") % 14 == 7) & (F.col("idx") == 1), F.lit(float("inf")))
    rows = L.circular_layout(nodes).withColumn("x", F.coalesce(bad, F.col("x")))
    return rows.filter("graph_id % 13 <> 0 AND NOT (graph_id % 11 = 0 AND idx = 1)")


_FAULTY = ", lay AS (SELECT * FROM circ WHERE graph_id % 13 <> 0 AND NOT (graph_id % 11 = 0 AND idx = 1)) "


@query(_FAULTY + f"SELECT {_KEY}, count(*) AS n FROM lay WHERE graph_id % 7 <> 0 OR graph_id % 11 = 0 GROUP BY ALL")
def drop_invalid_coords(graphs, nodes, edges):
    """A graph whose bad node is lost besides has no bad coordinate."""
    return prep.drop_invalid_coords(_faulty(nodes)).groupBy(*K).agg(F.count("*").alias("n"))


@query(_FAULTY + f"SELECT {_KEY}, count(*) AS n FROM lay WHERE graph_id % 11 <> 0 GROUP BY ALL")
def drop_incomplete_layouts(graphs, nodes, edges):
    return prep.drop_incomplete_layouts(nodes, _faulty(nodes)).groupBy(*K).agg(F.count("*").alias("n"))


@query(f"SELECT {_KEY}, any_value(graph_type) AS graph_type, count(*) AS n FROM graphs JOIN nodes USING ({_KEY}) WHERE graph_id % 13 <> 0 AND NOT (graph_id % 11 = 0 AND idx = 1) GROUP BY ALL")
def join_layouts(graphs, nodes, edges):
    return prep.join_layouts(graphs.select(*K, "graph_type"), _faulty(nodes)).groupBy(*K).agg(F.first("graph_type").alias("graph_type"), F.count("*").alias("n"))


@query(f"SELECT {_KEY} FROM graphs WHERE graph_id % 13 = 0")
def missing_layouts(graphs, nodes, edges):
    return prep.missing_layouts(graphs.select(*K), _faulty(nodes))


@query(f"SELECT {_N}, CASE WHEN node % 2 = 0 THEN round(gx, 9) END + 0.0 AS x0, CASE WHEN node % 2 = 0 THEN round(gy, 9) END + 0.0 AS y0 FROM grid")
def join_initial(graphs, nodes, edges):
    return prep.join_initial(nodes.select(*NODE), L.grid_positions(nodes).filter("node % 2 = 0")).select(*NODE, r9("x0"), r9("y0"))


@query("SELECT bundle, count(*) AS rows, sum(weight) AS weight FROM (SELECT bundle, weight FROM edges UNION ALL SELECT bundle, weight FROM sym) GROUP BY bundle")
def union_bundles(graphs, nodes, edges):
    return prep.union_bundles(edges, prep.symmetrize(edges)).groupBy("bundle").agg(F.count("*").alias("rows"), F.sum("weight").alias("weight"))


@query(_FAULTY + """, ok AS (SELECT bundle, graph_id FROM graphs WHERE graph_id % 13 <> 0 AND graph_id % 11 <> 0 AND graph_id % 7 <> 0),
s AS (SELECT *, num_edges / (num_nodes * (num_nodes - 1) / 2.0) AS density FROM sizes WHERE graph_id % 13 <> 0)
SELECT bundle, graph_id, num_nodes::INT AS n, num_edges::INT AS e, round((density - (SELECT avg(density) FROM s)) / (SELECT stddev_samp(density) FROM s), 9) + 0.0 AS density_norm FROM s SEMI JOIN ok USING (bundle, graph_id)""")
def dataset_job_with_faults(graphs, nodes, edges):
    """Statistics over all graphs that have a layout, before invalid ones are dropped."""
    config = L.FeatureConfig(density=True, density_norm=True)
    s = L.build_dataset(graphs, nodes, edges, _faulty(nodes), config)
    return s.select(*K, F.size("x").alias("n"), (F.size("edge_index") / 2).cast("int").alias("e"), rounded(F.col("x")[0][1], 9).alias("density_norm"))


# ---- reports ----


@query(", g AS (SELECT bundle, graph_id, count(DISTINCT community) AS c FROM nodes GROUP BY ALL) SELECT count(*) AS num_graphs, min(c) AS min_communities, max(c) AS max_communities, avg(c) AS avg_communities, avg(CASE WHEN graph_id % 2 = 0 THEN c / 10.0 ELSE 0.0 END) AS avg_mixing FROM g WHERE graph_id % 5 > 0")
def community_statistics(graphs, nodes, edges):
    c = nodes.groupBy(*K).agg(F.countDistinct("community").alias("c"))
    rows = c.select(*K, F.when(F.col("graph_id") % 5 > 0, F.col("c")).alias("num_communities"), F.when(F.col("graph_id") % 2 == 0, F.col("c") / 10.0).alias("mixing_parameter"))
    return structure.community_statistics(rows)


def _samples(graphs: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Packed samples with degree and place. A third of the nodes have no community, a fifth of the graphs no type."""
    some = nodes.withColumn("community", F.when(F.col("node") % 3 > 0, F.col("community")))
    typed = graphs.withColumn("graph_type", F.when(F.col("graph_id") % 5 > 0, F.col("graph_type")))
    return L.build_dataset(typed, some, edges, L.circular_layout(nodes), L.FeatureConfig(degree=True, positional=True))


_TYPE = "CASE WHEN graph_id % 5 > 0 THEN graph_type ELSE 'unknown' END"
_SOME = f"told AS (SELECT {_KEY}, list(CASE WHEN node % 3 > 0 THEN community ELSE 0 END ORDER BY idx) AS community FROM nodes GROUP BY ALL HAVING bool_or(idx = 0 AND node % 3 > 0))"


@query(f", {_SOME}, g AS (SELECT {_TYPE} AS graph_type, 'circular' AS layout_type, (community IS NOT NULL)::INT AS c, num_nodes AS n, num_edges AS e FROM graphs JOIN sizes USING ({_KEY}) LEFT JOIN told USING ({_KEY})) SELECT CASE WHEN grouping(graph_type) = 0 THEN 'graph_type' WHEN grouping(layout_type) = 0 THEN 'layout_type' ELSE 'all' END AS level, graph_type, layout_type, count(*) AS num_graphs, sum(c)::BIGINT AS with_communities, 0::BIGINT AS with_initial, min(n)::INT AS min_nodes, max(n)::INT AS max_nodes, avg(n) AS avg_nodes, min(e)::DOUBLE AS min_edges, max(e)::DOUBLE AS max_edges, avg(e) AS avg_edges FROM g GROUP BY GROUPING SETS ((graph_type), (layout_type), ())")
def dataset_statistics(graphs, nodes, edges):
    return structure.dataset_statistics(_samples(graphs, nodes, edges))


@query(f", {_SOME} SELECT {_KEY}, {_TYPE} AS graph_type, array_to_string(community, ' ') AS community, len(list_distinct(community))::INT AS num_communities FROM graphs LEFT JOIN told USING ({_KEY})")
def pack_communities(graphs, nodes, edges):
    """Communities of a sample in the order of its nodes, 0 where a node has none; none if the first node has none."""
    return _samples(graphs, nodes, edges).select(*K, "graph_type", F.array_join("community", " ").alias("community"), "num_communities")


@query("SELECT count(*) AS num_graphs, 2 AS feature_dim, 2 AS output_dim, avg(num_nodes) AS avg_nodes, min(num_nodes)::INT AS min_nodes, max(num_nodes)::INT AS max_nodes, avg(num_edges) AS avg_edges, arg_min(graph_id, (bundle, graph_id)) AS sample_id FROM sizes")
def dataset_info(graphs, nodes, edges):
    return structure.dataset_info(_samples(graphs, nodes, edges))


_ATTEMPTS = "WITH a AS (SELECT o_orderkey % 7 > 1 AS ok, o_custkey % 50 AS seed, o_custkey AS nodes, o_orderkey AS edges, o_custkey % 5 AS communities FROM orders) "


@query("SELECT count(*) AS attempts, avg(ok::INT) AS success_rate, " + ", ".join(f"{f}({c}) FILTER (ok) AS {f}_{c}" for c in ("nodes", "edges", "communities") for f in ("min", "max", "avg")) + ", min(seed) FILTER (ok AND seed <> 0) AS min_seed, max(seed) FILTER (ok AND seed <> 0) AS max_seed, count(seed) FILTER (ok AND seed <> 0) - count(DISTINCT seed) FILTER (ok AND seed <> 0) AS repeated_seeds FROM a", _ATTEMPTS)
def generation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An attempt per order; some have the seed 0, which counts as none."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    seed = F.col("o_custkey") % 50
    return structure.generation_summary(o.select((F.col("o_orderkey") % 7 > 1).alias("ok"), seed.alias("seed"), F.col("o_custkey").alias("nodes"), F.col("o_orderkey").alias("edges"), (F.col("o_custkey") % 5).alias("communities")))


# ---- layouts and features ----


def force_step(coords: str, heat: str) -> str:
    """SQL of one force step from table coords (x, y, n) with the given heat."""
    return f"""
away AS (SELECT a.bundle, a.graph_id, a.node, sum((a.x - b.x) / (a.n * greatest(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), 0.01) ** 2)) AS fx, sum((a.y - b.y) / (a.n * greatest(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), 0.01) ** 2)) AS fy FROM {coords} a JOIN {coords} b ON {on('a', 'b')} GROUP BY ALL),
pull AS (SELECT a.bundle, a.graph_id, a.node, sum((b.x - a.x) * weight * greatest(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), 0.01) * sqrt(a.n)) AS fx, sum((b.y - a.y) * weight * greatest(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), 0.01) * sqrt(a.n)) AS fy
  FROM sym s JOIN {coords} a ON {on('s', 'a', 'src=node')} JOIN {coords} b ON {on('s', 'b', 'dst=node')} GROUP BY ALL),
force AS (SELECT {_N}, sum(fx) AS fx, sum(fy) AS fy FROM (SELECT * FROM away UNION ALL SELECT * FROM pull) GROUP BY ALL),
moved AS (SELECT {_N}, fx * {heat} / CASE WHEN sqrt(fx ** 2 + fy ** 2) < 0.01 THEN 0.1 ELSE sqrt(fx ** 2 + fy ** 2) END AS mx, fy * {heat} / CASE WHEN sqrt(fx ** 2 + fy ** 2) < 0.01 THEN 0.1 ELSE sqrt(fx ** 2 + fy ** 2) END AS my FROM force JOIN heat USING ({_KEY}))"""


@query(f", xy AS (SELECT {_N}, n, gx AS x, gy AS y FROM grid), heat AS (SELECT {_KEY}, 0.1 * greatest(max(x) - min(x), max(y) - min(y)) AS heat FROM xy GROUP BY ALL)," + force_step("xy", "heat") + f" SELECT {_N}, {q9('x + mx', 'x')}, {q9('y + my', 'y')} FROM xy JOIN moved USING ({_N})")
def spring_layout_step(graphs, nodes, edges):
    """The first step of the force-directed layout; later ones amplify last digits."""
    return L.spring_layout(nodes, edges, iterations=1).select(*NODE, r9("x"), r9("y"))


@query(f", xy AS (SELECT {_N}, n, gx AS x, gy AS y FROM grid), heat AS (SELECT {_KEY}, 0.05 AS heat FROM xy GROUP BY ALL)," + force_step("xy", "heat") + f" SELECT {_N}, {q9('x + mx', 'x')}, {q9('y + my', 'y')} FROM xy JOIN moved USING ({_N})")
def spring_step(graphs, nodes, edges):
    """The same step as joins, for graphs beyond a task."""
    heat = graphs.select(*K, F.lit(0.05).alias("heat"))
    return L.spring_step(L.grid_positions(nodes), edges, heat).select(*NODE, r9("x"), r9("y"))


@query(f"SELECT {_N}, 'circular' AS layout_type, {q9('cx', 'x')}, {q9('cy', 'y')} FROM circ")
def layouts_from_config(graphs, nodes, edges):
    return L.layouts_from_config(nodes, edges, {"type": "circular"})[0].select(*NODE, "layout_type", r9("x"), r9("y"))


@query(f"SELECT {_N}, {q9('gx - avg(gx) OVER w', 'x')}, {q9('gy - avg(gy) OVER w', 'y')} FROM grid WINDOW w AS (PARTITION BY {_KEY})")
def center_coords(graphs, nodes, edges):
    return L.normalize_coords(L.grid_positions(nodes), "center").select(*NODE, r9("x"), r9("y"))


@query(f"SELECT {_N}, n::INT AS width, idx::INT AS place, 1.0::DOUBLE AS total FROM nodes")
def onehot_feature(graphs, nodes, edges):
    rows = L.node_features(nodes, edges, L.FeatureConfig(onehot=True))
    place = F.array_position("f", F.lit(1.0)).cast("int") - 1
    return rows.select(*NODE, F.size("f").alias("width"), place.alias("place"), F.aggregate("f", F.lit(0.0), lambda a, b: a + b).alias("total"))


_ID = ("bundle", "graph_id::VARCHAR", "node::VARCHAR")
_NORMAL = f"sqrt(-2 * ln(1 - {uniform_sql(42, chr(39) + 'r' + chr(39), *_ID)})) * {{}}(2 * pi() * {uniform_sql(42, chr(39) + 'a' + chr(39), *_ID)})"


@query(f"SELECT {_N}, {q9(_NORMAL.format('cos'), 'a')}, {q9(_NORMAL.format('sin'), 'b')} FROM nodes")
def random_feature(graphs, nodes, edges):
    rows = L.node_features(nodes, edges, L.FeatureConfig(random=True))
    return rows.select(*NODE, rounded(F.col("f")[0], 9).alias("a"), rounded(F.col("f")[1], 9).alias("b"))


_Z = lambda c: f"({c} - (SELECT avg({c}) FROM z)) / (SELECT stddev_samp({c}) FROM z)"


@query(f""", z AS (SELECT s.*, num_edges / (num_nodes * (num_nodes - 1) / 2.0) AS density, c AS clustering FROM sizes s JOIN (SELECT {_KEY}, avg(clustering) AS c FROM clus GROUP BY ALL) USING ({_KEY})),
zz AS (SELECT *, {_Z('density')} AS dz, {_Z('clustering')} AS cz FROM z)
SELECT n.bundle, n.graph_id, n.node, 11 AS width, """ + ", ".join(q9(c, f"f{i}") for i, c in enumerate(("degree::DOUBLE", "n.idx / (n.n - 1)::DOUBLE", _NORMAL.format("cos").replace("bundle", "n.bundle").replace("graph_id", "n.graph_id").replace("node", "n.node"), _NORMAL.format("sin").replace("bundle", "n.bundle").replace("graph_id", "n.graph_id").replace("node", "n.node"), "n.n::DOUBLE", "density", "dz", "clustering", "cz", "s.px", "s.py"))) + f""" FROM nodes n JOIN deg USING ({_N}) JOIN zz USING ({_KEY}) JOIN std s USING ({_N})""")
def all_node_features(graphs, nodes, edges):
    """Every feature but the one-hot vector, in order, the standardised initial position last."""
    config = L.FeatureConfig(degree=True, positional=True, random=True, graph_size=True, density=True, density_norm=True, clustering=True, clustering_norm=True, initial_position=True)
    rows = L.node_features(nodes, edges, config, initial=L.normalize_coords(L.grid_positions(nodes)))
    return rows.select(*NODE, F.size("f").alias("width"), *(rounded(F.col("f")[i], 9).alias(f"f{i}") for i in range(11)))


@query(f"SELECT {_N.replace('node', 'idx::INT AS idx')}, {q9('degree::DOUBLE', 'f0')}, {q9('idx / (n - 1)::DOUBLE', 'f1')}, {q9('tx', 'x')}, {q9('ty', 'y')} FROM std JOIN deg USING ({_N})")
def unpack_sample_nodes(graphs, nodes, edges):
    rows = L.unpack_samples(_samples(graphs, nodes, edges))[0]
    return rows.select(*K, F.col("idx").cast("int").alias("idx"), rounded(F.col("f")[0], 9).alias("f0"), rounded(F.col("f")[1], 9).alias("f1"), r9("x"), r9("y"))


@query(f"SELECT e.bundle, e.graph_id, a.idx AS src, b.idx AS dst FROM edges e JOIN nodes a ON {on('e', 'a', 'src=node')} JOIN nodes b ON {on('e', 'b', 'dst=node')}")
def unpack_sample_edges(graphs, nodes, edges):
    return L.unpack_samples(_samples(graphs, nodes, edges))[1]


@query(f", e AS (SELECT e.bundle, e.graph_id, a.idx AS s, b.idx AS d, row_number() OVER (PARTITION BY e.bundle, e.graph_id ORDER BY a.idx, b.idx) AS i FROM edges e JOIN nodes a ON {on('e', 'a', 'src=node')} JOIN nodes b ON {on('e', 'b', 'dst=node')}) SELECT {_KEY}, any_value(CASE WHEN graph_id % 5 > 0 THEN t ELSE 'unknown' END) AS graph_type, 'circular' AS layout_type, string_agg(s || '-' || d, ' ' ORDER BY i) || ' ' || string_agg(d || '-' || s, ' ' ORDER BY i) AS edge_index, any_value(ox) AS original_x FROM e JOIN (SELECT {_KEY}, any_value(graph_type) AS t, round(sum((idx + 1) * cx), 9) + 0.0 AS ox FROM circ JOIN graphs USING ({_KEY}) GROUP BY ALL) USING ({_KEY}) GROUP BY ALL")
def pack_samples(graphs, nodes, edges):
    """Edges forward and then reversed, and the coordinates as given, in the order of idx."""
    s = _samples(graphs, nodes, edges)
    total = F.aggregate(F.transform("original_y", lambda p, i: (i + 1) * p["x"]), F.lit(0.0), lambda a, b: a + b)
    pairs = F.array_join(F.transform("edge_index", lambda e: F.concat_ws("-", e["src"], e["dst"])), " ")
    return s.select(*K, "graph_type", "layout_type", pairs.alias("edge_index"), rounded(total, 9).alias("original_x"))


# ---- losses ----


@query(f"SELECT {_KEY}, {q9('avg((sqrt(px * px + py * py) - 1) ** 2)', 'radius_loss')} FROM std GROUP BY ALL")
def radius_loss(graphs, nodes, edges):
    return G.radius_loss(_sides(nodes)[0]).select(*K, r9("radius_loss"))


@query(f", a AS (SELECT *, atan2(ty, tx) - lag(atan2(ty, tx)) OVER (PARTITION BY {_KEY} ORDER BY atan2(ty, tx), idx) AS gap FROM std) SELECT {_KEY}, {q9('avg((gap - 2 * pi() / n) ** 2)', 'spacing_loss')} FROM a GROUP BY ALL")
def spacing_loss(graphs, nodes, edges):
    return G.spacing_loss(_sides(nodes)[1]).select(*K, r9("spacing_loss"))


@query(f"SELECT {_KEY}, {q9('(abs(avg(gx)) + abs(avg(gy))) / 2', 'center_loss')} FROM grid GROUP BY ALL")
def center_loss(graphs, nodes, edges):
    return G.center_loss(L.grid_positions(nodes)).select(*K, r9("center_loss"))


@query(f"SELECT x.bundle, x.graph_id, {q9('sum((sqrt((x.px - y.px) ** 2 + (x.py - y.py) ** 2) - sqrt((x.tx - y.tx) ** 2 + (x.ty - y.ty) ** 2)) ** 2) / any_value(x.n) ** 2', 'pairwise_loss')} FROM std x JOIN std y ON {on('x', 'y')} GROUP BY ALL")
def pairwise_distance_loss(graphs, nodes, edges):
    return G.pairwise_distance_loss(*_sides(nodes)).select(*K, r9("pairwise_loss"))


def _unequal(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Predictions without the first graphs' last nodes, truths without the second graphs' last two."""
    pred, true = _sides(nodes)
    last = nodes.groupBy(*K).agg(F.max("idx").alias("last"))
    cut = lambda df, k, n: df.join(last, K).filter(F.col("idx") <= F.col("last") - F.when(F.col("graph_id") % 3 == k, n).otherwise(0))
    return cut(pred, 1, 1), cut(true, 2, 2)


_UNEQUAL = f", u AS (SELECT *, avg((px - tx) ** 2 + (py - ty) ** 2) OVER (PARTITION BY {_KEY}) / 2 AS mse FROM std WHERE idx <= n - 1 - CASE graph_id % 3 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 0 END), m AS (SELECT {_KEY}, count(*) AS n, any_value(mse) AS mse FROM u GROUP BY ALL)"


@query(_UNEQUAL + f" SELECT {_KEY}, n, {q9('mse', 'mse')} FROM m")
def align_lengths(graphs, nodes, edges):
    """Sides of unequal length: the longer is cut."""
    pred, true = _unequal(nodes)
    n = G.align_lengths(pred, true).groupBy(*K).agg(F.count("*").alias("n"))
    return G.coord_mse(pred, true).join(n, K).select(*K, "n", r9("mse"))


_BATCHED = _UNEQUAL + ", b AS (SELECT *, (row_number() OVER (ORDER BY graph_id, bundle) - 1) // 32 AS batch_id FROM m)"


def _batches(nodes: DataFrame) -> DataFrame:
    """Batches of 32 graphs in order. A graph of which the sides have no node in common has no loss and takes no place in a batch."""
    from ..keys import global_rank

    first = nodes.groupBy(*K).agg(F.max("idx").alias("last")).filter(F.col("last") >= F.when(F.col("graph_id") % 3 == 1, 1).when(F.col("graph_id") % 3 == 2, 2).otherwise(0))
    return global_rank(first.select(*K), "graph_id", "bundle").select(*K, F.floor(F.col("rank") / 32).alias("batch_id"))


@query(_BATCHED + f" SELECT batch_id, {q9('avg(mse)', 'loss')} FROM b GROUP BY batch_id")
def loss_per_batch(graphs, nodes, edges):
    return G.loss_per_batch(*_unequal(nodes), _batches(nodes), "force_directed").select("batch_id", r9("loss"))


@query(_BATCHED + f", l AS (SELECT avg(mse) AS l FROM b GROUP BY batch_id) SELECT {q9('avg(l)', 'loss')} FROM l")
def evaluate(graphs, nodes, edges):
    """A mean of batch means: the short last batch weighs as a full one."""
    return G.evaluate(*_unequal(nodes), _batches(nodes), "force_directed").select(r9("loss"))


@query("SELECT run_id, epoch, train_loss, val_loss FROM h", HISTORY)
def training_curve(spark, sf_dir):
    return G.training_curve(history(spark, sf_dir)).withColumn("epoch", F.col("epoch").cast("long"))


# ---- messages ----


def gcn(source: str, to: str) -> str:
    """SQL of one propagation from a table of (bundle, graph_id, node, degree, a, b)."""
    part = lambda c: f"sum(x.{c} / sqrt((x.degree + 1.0) * (y.degree + 1)))"
    return f"{to}_s AS (SELECT s.bundle, s.graph_id, s.dst AS node, {part('a')} AS a, {part('b')} AS b FROM sym s JOIN {source} x ON {on('s', 'x', 'src=node')} JOIN {source} y ON {on('s', 'y', 'dst=node')} GROUP BY ALL)"


_F0 = f", {_FEAT}, f0 AS (SELECT {_N}, degree, f[1] AS a, f[2] AS b FROM feat), "
_OUT = lambda a, b: f"SELECT {_N}, {q9(a, 'f0')}, {q9(b, 'f1')}"


@query(_F0 + gcn("f0", "h1") + f", h1 AS (SELECT {_N}, degree, f0.a + (s.a + f0.a / (degree + 1)) AS a, f0.b + (s.b + f0.b / (degree + 1)) AS b FROM f0 JOIN h1_s s USING ({_N})), " + gcn("h1", "h2") + f" {_OUT('h1.a + s.a + h1.a / (degree + 1)', 'h1.b + s.b + h1.b / (degree + 1)')} FROM h1 JOIN h2_s s USING ({_N})")
def propagate_hops(graphs, nodes, edges):
    return out(M.propagate_hops(feat(nodes, edges), edges, 2, True, 2))


_LAP = lambda source, to: f"{to}_s AS (SELECT s.bundle, s.graph_id, s.dst AS node, -sum(x.a / sqrt(x.degree::DOUBLE * y.degree)) AS a, -sum(x.b / sqrt(x.degree::DOUBLE * y.degree)) AS b FROM sym s JOIN {source} x ON {on('s', 'x', 'src=node')} JOIN {source} y ON {on('s', 'y', 'dst=node')} GROUP BY ALL), {to} AS (SELECT {_N}, degree, s.a, s.b FROM {source} JOIN {to}_s s USING ({_N}))"


@query(_F0 + _LAP("f0", "t1") + ", " + _LAP("t1", "t2") + f" SELECT {_N}, {q9('f0.a', 't0a')}, {q9('f0.b', 't0b')}, {q9('t1.a', 't1a')}, {q9('t1.b', 't1b')}, {q9('2 * t2.a - f0.a', 't2a')}, {q9('2 * t2.b - f0.b', 't2b')} FROM f0 JOIN t1 USING ({_N}) JOIN t2 USING ({_N})")
def chebyshev_basis(graphs, nodes, edges):
    rows = M.chebyshev_basis(feat(nodes, edges), edges, 3, 2)
    return rows.select(*NODE, *(rounded(F.col(f"t{j}")[i], 9).alias(f"t{j}{c}") for j in range(3) for i, c in enumerate("ab")))


@query(_F0 + f"""m AS (SELECT s.bundle, s.graph_id, s.dst AS node, s.src AS other FROM sym s UNION ALL SELECT {_N}, node FROM f0),
e AS (SELECT m.bundle, m.graph_id, m.node, x.a, x.b, CASE WHEN x.b - y.b > 0 THEN x.b - y.b ELSE 0.2 * (x.b - y.b) END AS e FROM m JOIN f0 x ON {on('m', 'x', 'other=node')} JOIN f0 y ON {on('m', 'y', 'node=node')})
""" + _OUT("sum(exp(e) * a) / sum(exp(e))", "sum(exp(e) * b) / sum(exp(e))") + " FROM e GROUP BY ALL")
def edge_softmax(graphs, nodes, edges):
    return out(M.edge_softmax_aggregate(feat(nodes, edges), edges, lambda a, b: a[1] - b[1], 2))


_NORM = lambda v: f"list_transform({v}, lambda x: (x - list_avg({v})) / sqrt(list_var_pop({v}) + 1e-5))"


@query(_F0 + f"l AS (SELECT {_N}, {_NORM('v')} AS v FROM (SELECT {_N}, [a, b, a * b, a - 3 * b] AS v FROM f0)), g AS (SELECT s.bundle, s.graph_id, s.dst AS node, [avg(v[1]), avg(v[2]), avg(v[3]), avg(v[4])] AS m FROM sym s JOIN l ON {on('s', 'l', 'src=node')} GROUP BY ALL), o AS (SELECT {_N}, {_NORM('v')} AS v FROM (SELECT {_N}, list_transform(range(1, 5), lambda i: v[i] + (v[i] - m[i]) * 0.7) AS v FROM l JOIN g USING ({_N}))) SELECT {_N}, " + ", ".join(q9(f"v[{i + 1}]", f"f{i}") for i in range(4)) + " FROM o")
def force_repulsion(graphs, nodes, edges):
    """Four features: of two the norm is little more than a sign."""
    a, b = F.col("f")[0], F.col("f")[1]
    rows = M.force_repulsion(feat(nodes, edges).select(*NODE, F.array(a, b, a * b, a - 3 * b).alias("f")), edges, 0.7, 4)
    return rows.select(*NODE, *(rounded(F.col("f")[i], 9).alias(f"f{i}") for i in range(4)))


_XY = f", xy AS (SELECT {_N}, n, idx, gx AS x, gy AS y FROM grid)"
_FAR = "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))"


@query(_XY + f", {_FEAT}, p AS (SELECT a.bundle, a.graph_id, a.node, sum(exp(-{_FAR}) * f.f[1]) AS a, sum(exp(-{_FAR}) * f.f[2]) AS b FROM xy a JOIN xy b ON {on('a', 'b')} AND a.node <> b.node JOIN feat f ON {on('b', 'f', 'node=node')} GROUP BY ALL) " + _OUT("f[1] - 0.1 * p.a", "f[2] - 0.1 * p.b") + f" FROM feat JOIN p USING ({_N})")
def distance_repulsion(graphs, nodes, edges):
    return out(M.distance_repulsion(feat(nodes, edges), L.grid_positions(nodes), 0.1, 2))


def _qkv(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Query, key and value of each node from its degree and place."""
    d, p = F.col("f")[0] / 10, F.col("f")[1]
    return feat(nodes, edges).select(*NODE, F.array(p, d).alias("q"), F.array(d - p, p).alias("k"), F.array(d, p).alias("v"))


_QKV = f", {_FEAT}, qkv AS (SELECT {_N}, f[2] AS q1, f[1] / 10 AS q2, f[1] / 10 - f[2] AS k1, f[2] AS k2, f[1] / 10 AS v1, f[2] AS v2 FROM feat)"
_DOT = "(x.q1 * y.k1 + x.q2 * y.k2) / sqrt(2)"


@query(_QKV + f", e AS (SELECT x.bundle, x.graph_id, x.node, y.v1, y.v2, {_DOT} AS e FROM qkv x JOIN qkv y ON {on('x', 'y')}) " + _OUT("sum(exp(e) * v1) / sum(exp(e))", "sum(exp(e) * v2) / sum(exp(e))") + " FROM e GROUP BY ALL")
def dense_attention(graphs, nodes, edges):
    return out(M.dense_attention(_qkv(nodes, edges), 2))


_NEAREST = f", near AS (SELECT a.bundle, a.graph_id, a.node, b.node AS other, {_FAR} AS d FROM xy a JOIN xy b ON {on('a', 'b')} QUALIFY row_number() OVER (PARTITION BY a.bundle, a.graph_id, a.node ORDER BY {_FAR}, (a.node <> b.node)::INT, b.node) <= 5)"


@query(_XY + _NEAREST + f" SELECT {_N}, other, {q9('d', 'd')} FROM near")
def knn_on_grid(graphs, nodes, edges):
    return M.knn_within_graph(L.grid_positions(nodes), 5, buckets=getattr(nodes, "_by_graph", None)).select(*NODE, "other", r9("d"))


@query(_XY + _NEAREST + _QKV + f", e AS (SELECT n.bundle, n.graph_id, n.node, y.v1, y.v2, {_DOT} + 1 / (d + 0.5) AS e FROM near n JOIN qkv x ON {on('n', 'x', 'node=node')} JOIN qkv y ON {on('n', 'y', 'other=node')}) " + _OUT("sum(exp(e) * v1) / sum(exp(e))", "sum(exp(e) * v2) / sum(exp(e))") + " FROM e GROUP BY ALL")
def knn_attention(graphs, nodes, edges):
    """A soft distance bias, so that the node itself is not all that counts."""
    return out(M.knn_attention(_qkv(nodes, edges), L.grid_positions(nodes), 5, 2, 0.5, buckets=getattr(nodes, "_by_graph", None)))


@query(_XY + _NEAREST + _QKV + f", e AS (SELECT n.bundle, n.graph_id, n.node, y.v1, y.v2, {_DOT} + 1 / (d + 1e-6) AS e FROM near n JOIN qkv x ON {on('n', 'x', 'node=node')} JOIN qkv y ON {on('n', 'y', 'other=node')} WHERE n.node <> n.other OR n.graph_id % 2 = 0), t AS (SELECT *, exp(e - max(e) OVER (PARTITION BY {_N})) AS w FROM e) " + _OUT("sum(w * v1) / sum(w)", "sum(w * v2) / sum(w)") + " FROM t GROUP BY ALL")
def knn_attention_sharp(graphs, nodes, edges):
    """The default softening, by which a node attends to itself alone; in every second graph nodes leave themselves out."""
    near = M.knn_within_graph(L.grid_positions(nodes), 5, buckets=getattr(nodes, "_by_graph", None)).filter("node <> other OR graph_id % 2 = 0")
    return out(M.knn_attention(_qkv(nodes, edges), None, 5, 2, near=near))


# ---- forces ----


_K = f", kk AS (SELECT {_KEY}, component, 1 / sqrt(count(*)) AS k FROM comp GROUP BY ALL)"


@query(_K + f" SELECT {_KEY}, component, {q9('k', 'k')} FROM kk")
def ideal_length(graphs, nodes, edges):
    return M.ideal_length(prep.connected_components(nodes, edges)).select(*K, "component", r9("k"))


def _component_lengths(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    kept = lambda df: kept_by_graph(df, "force", getattr(edges, "_by_graph", None))
    parts = kept(prep.connected_components(nodes.select(*NODE), edges))
    return parts, kept(parts.join(M.ideal_length(parts), [*K, "component"]).select(*NODE, "k"))


def fr(coords: str, tag: str) -> str:
    """SQL of the forces at coords (bundle, graph_id, node, x, y): {tag}pull, {tag}push and, clamped, {tag}."""
    d = "(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) + 0.01)"
    return f"""{tag}pull AS (SELECT a.bundle, a.graph_id, a.node, sum(-2 * {d} / k * weight * (a.x - b.x)) AS fx, sum(-2 * {d} / k * weight * (a.y - b.y)) AS fy FROM sym s JOIN {coords} a ON {on('s', 'a', 'src=node')} JOIN {coords} b ON {on('s', 'b', 'dst=node')} JOIN kn ON {on('s', 'kn', 'src=node')} GROUP BY ALL),
{tag}push AS (SELECT a.bundle, a.graph_id, a.node, sum(p.k * p.k / {d} ** 2 * (a.x - b.x)) AS fx, sum(p.k * p.k / {d} ** 2 * (a.y - b.y)) AS fy FROM {coords} a JOIN {coords} b ON {on('a', 'b')} AND a.node <> b.node JOIN kn p ON {on('a', 'p', 'node=node')} JOIN kn o ON {on('b', 'o', 'node=node')} AND p.component = o.component GROUP BY ALL),
{tag}sum AS (SELECT {_N}, sum(fx) AS fx, sum(fy) AS fy FROM (SELECT * FROM {tag}pull UNION ALL SELECT * FROM {tag}push) GROUP BY ALL),
{tag} AS (SELECT {_N}, x + fx * least(1, 0.05 / (sqrt(fx ** 2 + fy ** 2) + 1e-9)) AS x, y + fy * least(1, 0.05 / (sqrt(fx ** 2 + fy ** 2) + 1e-9)) AS y FROM {coords} JOIN {tag}sum USING ({_N}))"""


_FR = _K + _XY + f", kn AS (SELECT {_N}, component, k FROM comp JOIN kk USING ({_KEY}, component)), "


@query(_FR + fr("xy", "s1") + f" SELECT {_N}, {q9('fx', 'fx')}, {q9('fy', 'fy')} FROM s1pull")
def fr_attraction(graphs, nodes, edges):
    return M.fr_attraction(L.grid_positions(nodes), edges, _component_lengths(nodes, edges)[1]).select(*NODE, r9("fx"), r9("fy"))


@query(_FR + fr("xy", "s1") + f" SELECT {_N}, {q9('fx', 'fx')}, {q9('fy', 'fy')} FROM s1push")
def fr_repulsion(graphs, nodes, edges):
    parts, k = _component_lengths(nodes, edges)
    return M.fr_repulsion(L.grid_positions(nodes), parts, k).select(*NODE, r9("fx"), r9("fy"))


@query(_FR + fr("xy", "s1") + f" SELECT {_N}, {q9('x', 'x')}, {q9('y', 'y')} FROM s1")
def clamped_step(graphs, nodes, edges):
    parts, k = _component_lengths(nodes, edges)
    at = L.grid_positions(nodes)
    return M.clamped_step(at, M.fr_attraction(at, edges, k).unionByName(M.fr_repulsion(at, parts, k))).select(*NODE, r9("x"), r9("y"))


@query(_FR + fr("xy", "s1") + ", " + fr("s1", "s2") + ", " + fr("s2", "s3") + f" SELECT {_N}, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y FROM s3")
def fr_unrolled(graphs, nodes, edges):
    return M.fr_unrolled(L.grid_positions(nodes), edges, 3).select(*NODE, rounded("x").alias("x"), rounded("y").alias("y"))


_W1, _B1 = [[0.1, -0.2, 0.3, 0.4, -0.05, 0.02], [-0.3, 0.1, 0.05, -0.1, 0.01, 0.03]], [0.1, -0.2]
_W2, _B2 = [[0.7, -0.9]], [0.05]


def _unit(weights: list[float], bias: float, values: list[str]) -> str:
    return f"({bias} + " + " + ".join(f"{w} * {v}" for w, v in zip(weights, values)) + ")"


@query(f", {_FEAT}, p AS (SELECT s.bundle, s.graph_id, s.src, s.dst, a.f[1] AS e1, a.f[2] AS e2, b.f[1] AS e3, b.f[2] AS e4, a.degree AS e5, b.degree AS e6 FROM edges s JOIN feat a ON {on('s', 'a', 'src=node')} JOIN feat b ON {on('s', 'b', 'dst=node')}), h AS (SELECT *, " + ", ".join(f"greatest({_unit(w, c, [f'e{i}' for i in range(1, 7)])}, 0) AS h{j}" for j, (w, c) in enumerate(zip(_W1, _B1))) + f" FROM p), o AS (SELECT *, {_unit(_W2[0], _B2[0], ['h0', 'h1'])} AS o FROM h) SELECT {_KEY}, src, dst, {q9('ln(1 + exp(-abs(o))) + greatest(o, 0) + 1e-6', 'stiffness')} FROM o")
def edge_stiffness(graphs, nodes, edges):
    rows = M.edge_stiffness(M.edge_pair_features(feat(nodes, edges), edges), [(_W1, _B1), (_W2, _B2)])
    return rows.select(*K, "src", "dst", r9("stiffness"))


_STEP = ([[0.0237, -0.1013], [0.0311, 0.1171], [-0.1973, 0.0531], [0.1033, 0.1517]], [0.0107, -0.0203])


def refine_sql(source: str, to: str) -> str:
    """SQL of one refinement: coordinates move by a share of a dense layer over propagated features and coordinates."""
    s = lambda c: f"sum(x.{c} / sqrt((x.degree + 1.0) * (y.degree + 1)))"
    cols = ("a", "b", "x", "y")
    own = lambda c: f"(g.{c} + {source}.{c} / (degree + 1))"
    move = lambda j: " + ".join([str(_STEP[1][j]), *(f"{_STEP[0][i][j]} * {own(c)}" for i, c in enumerate(cols))])
    return f"{to}_g AS (SELECT s.bundle, s.graph_id, s.dst AS node, " + ", ".join(f"{s(c)} AS {c}" for c in cols) + f" FROM sym s JOIN {source} x ON {on('s', 'x', 'src=node')} JOIN {source} y ON {on('s', 'y', 'dst=node')} GROUP BY ALL), {to} AS (SELECT {_N}, degree, {source}.a, {source}.b, {source}.x + 0.0973 * ({move(0)}) AS x, {source}.y + 0.0973 * ({move(1)}) AS y FROM {source} JOIN {to}_g g USING ({_N}))"


@query(f", {_FEAT}, r0 AS (SELECT {_N}, degree, f[1] AS a, f[2] AS b, gx AS x, gy AS y FROM feat JOIN grid USING ({_N})), " + refine_sql("r0", "r1") + ", " + refine_sql("r1", "r2") + f" SELECT {_N}, {q9('x', 'x')}, {q9('y', 'y')} FROM r2")
def iterative_refine(graphs, nodes, edges):
    rows = M.iterative_refine(feat(nodes, edges), L.grid_positions(nodes), edges, [0.0973, 0.0973], [[_STEP], [_STEP]], 2)
    return rows.select(*NODE, r9("x"), r9("y"))


# ---- bundles, names and text ----


@query(f"SELECT bundle, count(DISTINCT num_nodes) = 1 AS one_size, bool_or(graph_id % 200 = 0) AS has_initial FROM sizes GROUP BY bundle")
def feature_support(graphs, nodes, edges):
    return prep.feature_support(graphs, L.grid_positions(nodes.filter("graph_id % 200 = 0")))


@query(f"SELECT {_KEY}, count(*) AS lacking FROM nodes WHERE (graph_id + node) % 9 = 0 OR graph_id % 14 = 0 GROUP BY ALL")
def missing_initial(graphs, nodes, edges):
    """Graphs that lack an initial position of some node, or have a wrong one of any."""
    initial = L.grid_positions(nodes).filter("(graph_id + node) % 9 <> 0")
    wrong = L.grid_positions(nodes).filter("graph_id % 14 = 0").withColumn("x", F.lit(float("nan")))
    return prep.missing_initial(nodes, initial.filter("graph_id % 14 <> 0").unionByName(wrong))


@query("SELECT run_id, hidden_dim, dropout::DOUBLE AS dropout, round(top_k * 0.5 + num_layers, 9) AS last_loss, 2 AS epochs FROM runs", RUNS)
def write_results_json(spark, sf_dir):
    """Nested results of runs, as lines of JSON and back."""
    p = F.col("params")
    rows = runs(spark, sf_dir).select("run_id", F.struct(p["hidden_dim"].cast("int").alias("hidden_dim"), p["dropout"].cast("double").alias("dropout")).alias("params"), F.array(p["num_layers"].cast("double"), p["top_k"].cast("double") * 0.5 + p["num_layers"].cast("double")).alias("losses"))
    path = f"{shared_dir(spark)}/results-{uuid.uuid4().hex}"
    T.write_results_json(rows, path)
    back = spark.read.schema(rows.schema).json(path)
    return back.select("run_id", "params.hidden_dim", "params.dropout", rounded(F.element_at("losses", -1), 9).alias("last_loss"), F.size("losses").alias("epochs"))


@query(f"SELECT {_KEY}, src % 4 AS kind, CASE WHEN src % 4 = 1 THEN 'short' ELSE 'not a number' END AS reason, count(*) AS n FROM edges WHERE src % 4 > 0 GROUP BY ALL")
def rejected_lines(graphs, nodes, edges):
    """An edge's line is whole, cut, or has letters in place of an end or of the weight."""
    a, b = F.col("src").cast("string"), F.col("dst").cast("string")
    value = F.when(F.col("src") % 4 == 0, F.concat_ws(" ", a, b, F.lit("2.5"))).when(F.col("src") % 4 == 1, F.concat(F.lit(" "), a)).when(F.col("src") % 4 == 2, F.concat_ws("\t", F.lit("x"), b)).otherwise(F.concat_ws(" ", a, b, F.lit("w")))
    lines = edges.select(*K, (F.col("src") * 100_000 + F.col("dst")).alias("line_no"), value.alias("value")).unionByName(edges.select(*K, F.lit(-1).cast("long").alias("line_no"), F.lit("# note").alias("value")))
    told = T.rejected_lines(lines, "edges").withColumn("kind", F.floor(F.col("line_no") / 100_000) % 4)
    return told.groupBy(*K, F.col("kind").alias("kind"), "reason").agg(F.count("*").alias("n"))


@query(""", be AS (SELECT bundle, src, dst, sum(weight) AS w FROM edges GROUP BY ALL), bs AS (SELECT bundle, src, dst FROM be UNION ALL SELECT bundle, dst, src FROM be), bn AS (SELECT DISTINCT bundle, src AS node FROM bs),
br AS (SELECT bundle, node, node AS to_node FROM bn UNION SELECT r.bundle, r.node, s.dst FROM br r JOIN bs s ON r.bundle = s.bundle AND r.to_node = s.src), bc AS (SELECT bundle, count(DISTINCT root) AS c FROM (SELECT bundle, node, min(to_node) AS root FROM br GROUP BY ALL) GROUP BY bundle)
SELECT bundle, 'all' AS graph_id, (SELECT count(*) FROM bn WHERE bn.bundle = be.bundle)::INT AS n, count(*)::INT AS e, any_value(c) AS components, sum(w) AS weight, 2.0 * count(*) AS degrees FROM be JOIN bc USING (bundle) GROUP BY bundle""")
def bundle_from_text(graphs, nodes, edges):
    """A graph per bundle, all of its graphs laid over each other: written as lines of text, read, numbered, laid out and packed."""
    spark = edges.sparkSession
    path = f"{shared_dir(spark)}/text-{uuid.uuid4().hex}"
    lines = edges.groupBy("bundle", "src", "dst").agg(F.sum("weight").alias("w")).select("bundle", F.lit("all").alias("graph"), F.concat_ws(" ", "src", "dst", "w").alias("value"))
    lines.write.partitionBy("bundle", "graph").text(path)
    read = stored(T.read_edge_text(spark, path, r"bundle=([^/]*)/graph=([^/]*)/"))
    numbered, mapped = prep.remap_nodes(read)
    mapped = stored(mapped)
    found = numbered.select(*K, F.col("idx").cast("long").alias("node"), "idx")
    kinds = found.groupBy(*K).agg(F.count("*").cast("int").alias("num_nodes")).withColumn("graph_type", F.lit("text"))
    samples = L.build_dataset(kinds, found, mapped, L.circular_layout(found), L.FeatureConfig(degree=True))
    counts = prep.component_counts(prep.connected_components(found, mapped)).withColumnRenamed("n_components", "components")
    weights = mapped.groupBy(*K).agg(F.sum("weight").alias("weight"))
    degrees = F.aggregate("x", F.lit(0.0), lambda a, x: a + x[0])
    rows = samples.select(*K, F.size("x").alias("n"), (F.size("edge_index") / 2).cast("int").alias("e"), degrees.alias("degrees"))
    return rows.join(counts, K).join(weights, K)


@query("SELECT bundle, count(*) AS n FROM graphs WHERE bundle LIKE '1%' OR bundle LIKE '_' AND bundle <> '7' OR bundle = '22' GROUP BY bundle")
def select_bundles(graphs, nodes, edges):
    return T.select_bundles(graphs, ["1*", "[!7]", "22"]).groupBy("bundle").agg(F.count("*").alias("n"))


@query("SELECT bundle, count(*) AS n FROM graphs WHERE bundle LIKE '2%' GROUP BY bundle")
def select_bundles_by_prefix(graphs, nodes, edges):
    return T.select_bundles_by_prefix(graphs, "2").groupBy("bundle").agg(F.count("*").alias("n"))


@query("SELECT bundle, graph_id, bundle || '_spring_layout' AS layout_bundle FROM graphs")
def match_layout_bundles(graphs, nodes, edges):
    layouts = graphs.select(F.concat("bundle", F.lit("_spring_layout")).alias("bundle"))
    return T.match_layout_bundles(graphs.select(*K), layouts, "spring")


@query("SELECT run_id, printf('GAT_%04d', run_id) AS graph_name, 'b_' || hidden_dim || 'graphs_' || CASE WHEN num_layers = top_k THEN num_layers::VARCHAR ELSE num_layers || '-' || top_k END || 'nodes_t' AS bundle_name FROM runs", RUNS)
def names(spark, sf_dir):
    rows = runs(spark, sf_dir).select("run_id", *(F.col("params")[c].alias(c) for c in ("hidden_dim", "num_layers", "top_k")))
    name = R.bundle_name(F.lit("b"), F.col("hidden_dim"), F.col("num_layers"), F.col("top_k"), F.lit("t"))
    return rows.select("run_id", R.graph_name(F.lit("GAT"), F.col("run_id")).alias("graph_name"), name.alias("bundle_name"))


@query(f"SELECT {_KEY}, src, dst, CASE WHEN src % 3 = 0 THEN 9.5 ELSE 1.0 END::DOUBLE AS weight FROM edges")
def parse_edge_lines(graphs, nodes, edges):
    """Lines of edges with comments, blank, short and wrong ones; a third of the edges come again, reversed and weighted."""
    line = lambda no, *parts: F.struct(F.lit(no).alias("line_no"), F.concat(*parts).alias("value"))
    a, b = F.col("src").cast("string"), F.col("dst").cast("string")
    many = F.array(line(1, F.lit("  "), a, F.lit(" \t "), b), line(2, F.lit("# "), a, F.lit(" "), b, F.lit(" 7")), line(3, F.lit("   ")), line(4, a), line(5, a, F.lit(" x"), b), line(6, a, F.lit(" "), b, F.lit(" w")), line(7, F.when(F.col("src") % 3 == 0, F.concat(b, F.lit(" "), a, F.lit(" 9.5"))).otherwise(F.lit("#"))))
    return T.parse_edge_lines(edges.select(*K, F.explode(many).alias("l")).select(*K, "l.line_no", "l.value"))


@query(f"SELECT {_N}, CASE WHEN node % 4 = 0 THEN 77 ELSE community END AS community FROM nodes")
def parse_community_lines(graphs, nodes, edges):
    line = lambda no, *parts: F.struct(F.lit(no).alias("line_no"), F.concat(*parts).alias("value"))
    n, c = F.col("node").cast("string"), F.col("community").cast("string")
    many = F.array(line(1, n, F.lit(" "), c, F.lit(" 5 6")), line(2, F.lit("# "), n), line(3, n), line(4, F.lit("x 1")), line(5, F.when(F.col("node") % 4 == 0, F.concat(n, F.lit("\t77"))).otherwise(F.lit(" "))))
    return T.parse_community_lines(nodes.select(*K, F.explode(many).alias("l")).select(*K, "l.line_no", "l.value"))


# ---- one large graph ----


@query("SELECT bundle, graph_id, node, count(*) AS degree FROM (SELECT bundle, graph_id, src AS node FROM bsym) GROUP BY ALL", BIG_SQL)
def big_degrees(spark, sf_dir):
    nodes, edges = big_graph(spark, sf_dir)
    return structure.degrees(nodes, edges)


@query(f"SELECT {_N}, {q9('CASE WHEN degree > 1 THEN 2.0 * coalesce(t, 0) / (degree * (degree - 1)) ELSE 0.0 END', 'clustering')} FROM bdeg LEFT JOIN (SELECT {_N}, count(*) AS t FROM (SELECT bundle, graph_id, unnest([a, b, c]) AS node FROM btri) GROUP BY ALL) USING ({_N})", BIG_SQL)
def big_clustering(spark, sf_dir):
    nodes, edges = big_graph(spark, sf_dir)
    return structure.local_clustering(nodes, edges).select(*NODE, r9("clustering"))


@query(f"SELECT {_N}, dense_rank() OVER (ORDER BY root) - 1 AS component FROM b12", BIG_SQL)
def big_components(spark, sf_dir):
    return prep.connected_components(*big_graph(spark, sf_dir), large=True)


@query(f", g AS (SELECT s.bundle, s.graph_id, s.dst AS node, sum(x.degree / sqrt((x.degree + 1.0) * (y.degree + 1))) AS s FROM bsym s JOIN bdeg x ON s.src = x.node JOIN bdeg y ON s.dst = y.node GROUP BY ALL) SELECT {_N}, {q9('s + degree / (degree + 1)', 'f0')} FROM g JOIN bdeg USING ({_N})", BIG_SQL)
def big_propagate(spark, sf_dir):
    nodes, edges = big_graph(spark, sf_dir)
    rows = structure.degrees(nodes, edges).select(*NODE, F.array(F.col("degree").cast("double")).alias("f"))
    return M.gcn_propagate(rows, edges, 1).select(*NODE, rounded(F.col("f")[0], 9).alias("f0"))
