"""Registered queries over graphs derived from the test tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import runs as R
from ..keys import K, rounded, uniform_sql
from ..operators import layouts as L
from ..operators import losses as G
from ..operators import messages as M
from ..operators import prep, split, structure, synth
from .fixtures import BASE, HISTORY, RUNS, SPECS, customer_specs, history, order_graph, runs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
FLAGSHIP = "dataset_job"


def query(sql: str | None = None, base: str = BASE):
    """Registers a function of (graphs, nodes, edges), or of (spark, sf_dir) for another base."""

    def add(f):
        QUERIES[f.__name__] = f if base != BASE else lambda spark, sf_dir: f(*order_graph(spark, sf_dir))
        if sql:
            ORACLE_SQL[f.__name__] = base + sql
        return f

    return add


def r(c: str | Column, name: str) -> Column:
    return rounded(c).alias(name)


def feat(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Two features per node: its degree and its place."""
    return L.node_features(nodes, edges, L.FeatureConfig(degree=True, positional=True))


_FEAT = "feat AS (SELECT bundle, graph_id, node, degree, [degree::DOUBLE, CASE WHEN n > 1 THEN idx / (n - 1)::DOUBLE ELSE 0.0 END] AS f FROM nodes JOIN deg USING (bundle, graph_id, node))"
_F = lambda a, b: f"SELECT bundle, graph_id, node, round({a}, 9) + 0.0 AS f0, round({b}, 9) + 0.0 AS f1"


def out(df: DataFrame) -> DataFrame:
    """Both features. Sums in another order differ in their last digits; at six digits the means of 2^k nodes lie on a half,
    where that would show."""
    return df.select(*K, "node", rounded(F.col("f")[0], 9).alias("f0"), rounded(F.col("f")[1], 9).alias("f1"))


@query("SELECT bundle, graph_id, src, dst, weight FROM sym")
def symmetrize(graphs, nodes, edges):
    return prep.symmetrize(edges)


@query("SELECT bundle, graph_id, src, dst, weight FROM edges")
def canonical_edges(graphs, nodes, edges):
    return prep.canonical_edges(prep.symmetrize(edges))


@query("SELECT e.bundle, e.graph_id, a.idx AS src, b.idx AS dst, weight FROM edges e JOIN nodes a ON a.bundle = e.bundle AND a.graph_id = e.graph_id AND a.node = src JOIN nodes b ON b.bundle = e.bundle AND b.graph_id = e.graph_id AND b.node = dst")
def remap_nodes(graphs, nodes, edges):
    return prep.remap_nodes(edges)[1]


@query("SELECT bundle, graph_id, count(DISTINCT community) AS num_communities FROM nodes GROUP BY ALL")
def attach_communities(graphs, nodes, edges):
    return prep.attach_communities(nodes.drop("community"), nodes.select(*K, "node", "community"))[1]


@query("SELECT bundle, graph_id, node, component FROM comp")
def connected_components(graphs, nodes, edges):
    return prep.connected_components(nodes, edges)


@query("SELECT bundle, graph_id FROM comp GROUP BY ALL HAVING max(component) = 0")
def keep_connected(graphs, nodes, edges):
    return prep.keep_connected(graphs, nodes, edges).select(*K)


@query("SELECT bundle, graph_id, node, degree FROM deg")
def degrees(graphs, nodes, edges):
    return structure.degrees(nodes, edges)


@query("SELECT bundle, graph_id, num_nodes, num_edges, round(num_edges / (num_nodes * (num_nodes - 1) / 2.0), 6) + 0.0 AS density FROM sizes")
def density(graphs, nodes, edges):
    return structure.density(structure.graph_sizes(nodes, edges)).withColumn("density", rounded("density"))


@query("SELECT bundle, graph_id, node, triangles, round(clustering, 6) + 0.0 AS clustering FROM clus")
def local_clustering(graphs, nodes, edges):
    return structure.local_clustering(nodes, edges).withColumn("clustering", rounded("clustering"))


@query("SELECT bundle, graph_id, round(avg(clustering), 6) + 0.0 AS avg_clustering FROM clus GROUP BY ALL")
def average_clustering(graphs, nodes, edges):
    return structure.average_clustering(nodes, edges).withColumn("avg_clustering", rounded("avg_clustering"))


@query(", d AS (SELECT *, num_edges / (num_nodes * (num_nodes - 1) / 2.0) AS density FROM sizes) SELECT bundle, graph_id, round((density - (SELECT avg(density) FROM d)) / (SELECT stddev_samp(density) FROM d), 6) + 0.0 AS density_norm FROM d")
def zscore(graphs, nodes, edges):
    return structure.zscore(structure.density(structure.graph_sizes(nodes, edges)), ["density"]).select(*K, r("density_norm", "density_norm"))


@query("SELECT bundle, count(*) AS num_graphs, min(num_nodes) AS min_nodes, max(num_nodes) AS max_nodes, round(avg(num_nodes), 6) AS avg_nodes, min(num_edges) AS min_edges, max(num_edges) AS max_edges, round(avg(num_edges), 6) AS avg_edges, round(min(2.0 * num_edges / num_nodes), 6) AS min_degree, round(max(2.0 * num_edges / num_nodes), 6) AS max_degree, round(avg(2.0 * num_edges / num_nodes), 6) AS avg_degree FROM sizes GROUP BY bundle")
def bundle_statistics(graphs, nodes, edges):
    s = structure.bundle_statistics(structure.graph_sizes(nodes, edges))
    return s.withColumns({c: rounded(c) for c in ("avg_nodes", "avg_edges", "min_degree", "max_degree", "avg_degree")})


@query("SELECT bundle, count(*) AS num_graphs, array_to_string(list_sort(list(DISTINCT graph_type)), ',') AS graph_types FROM graphs GROUP BY bundle")
def bundle_metadata(graphs, nodes, edges):
    return structure.bundle_metadata(graphs).withColumn("graph_types", F.array_join("graph_types", ","))


@query("SELECT graph_type, count(*) AS num_graphs FROM graphs GROUP BY graph_type")
def type_counts(graphs, nodes, edges):
    return structure.type_counts(graphs)


@query("SELECT sum((c = 0)::INT)::BIGINT AS connected, count(*) AS num_graphs, round(100.0 * avg((c = 0)::INT), 6) AS percent FROM (SELECT max(component) AS c FROM comp GROUP BY bundle, graph_id)")
def connectivity_rate(graphs, nodes, edges):
    return structure.connectivity_rate(prep.component_counts(prep.connected_components(nodes, edges))).withColumn("percent", rounded("percent"))


@query("SELECT bundle, graph_id, node, round(cx, 6) + 0.0 AS x, round(cy, 6) + 0.0 AS y FROM circ")
def circular_layout(graphs, nodes, edges):
    return L.circular_layout(nodes).select(*K, "node", r("x", "x"), r("y", "y"))


@query("SELECT bundle, graph_id, node, round(gx, 6) + 0.0 AS x, round(gy, 6) + 0.0 AS y FROM grid")
def grid_positions(graphs, nodes, edges):
    return L.grid_positions(nodes).select(*K, "node", r("x", "x"), r("y", "y"))


@query("SELECT bundle, graph_id, node, round(px, 6) + 0.0 AS x, round(py, 6) + 0.0 AS y FROM std")
def normalize_coords(graphs, nodes, edges):
    return L.normalize_coords(L.grid_positions(nodes)).select(*K, "node", r("x", "x"), r("y", "y"))


@query()
def spring_layout(graphs, nodes, edges):
    """Chaotic beyond a few iterations, so tests hold it against its own step by joins."""
    return L.spring_layout(nodes, edges).select(*K, "node", "x", "y")


@query(f", {_FEAT} {_F('f[1]', 'f[2]')} FROM feat")
def node_features(graphs, nodes, edges):
    return out(feat(nodes, edges))


@query("SELECT bundle, graph_id, any_value(graph_type) AS graph_type, num_nodes::INT AS n, num_edges::INT AS e, 5 AS width, round(sum(tx * tx), 6) + 0.0 AS yy, round(avg(density), 6) + 0.0 AS density FROM (SELECT *, num_edges / (num_nodes * (num_nodes - 1) / 2.0) AS density FROM sizes) JOIN std USING (bundle, graph_id) JOIN graphs USING (bundle, graph_id) GROUP BY bundle, graph_id, num_nodes, num_edges")
def dataset_job(graphs, nodes, edges):
    """The whole dataset job, and a digest of each packed sample."""
    config = L.FeatureConfig(degree=True, positional=True, graph_size=True, density=True, clustering=True)
    s = L.build_dataset(graphs, nodes, edges, L.circular_layout(nodes), config)
    yy = F.aggregate("y", F.lit(0.0), lambda a, p: a + p["x"] * p["x"])
    return s.select(*K, "graph_type", F.size("x").alias("n"), (F.size("edge_index") / 2).cast("int").alias("e"), F.size(F.col("x")[0]).alias("width"), r(yy, "yy"), r(F.col("x")[0][3], "density"))


def _sides(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Predicted layout: the standardised grid; true: the standardised circle."""
    return L.normalize_coords(L.grid_positions(nodes)), L.normalize_coords(L.circular_layout(nodes))


@query("SELECT bundle, graph_id, round(avg((px - tx) ** 2 + (py - ty) ** 2) / 2, 6) + 0.0 AS mse FROM std GROUP BY ALL")
def coord_mse(graphs, nodes, edges):
    return G.coord_mse(*_sides(nodes)).withColumn("mse", rounded("mse"))


@query(""", a AS (SELECT *, atan2(py, px) - lag(atan2(py, px)) OVER (PARTITION BY bundle, graph_id ORDER BY atan2(py, px), idx) AS gap FROM std),
q AS (SELECT x.bundle, x.graph_id, sum((sqrt((x.px - y.px) ** 2 + (x.py - y.py) ** 2) - sqrt((x.tx - y.tx) ** 2 + (x.ty - y.ty) ** 2)) ** 2) / any_value(x.n) ** 2 AS l FROM std x JOIN std y ON x.bundle = y.bundle AND x.graph_id = y.graph_id GROUP BY ALL)
SELECT bundle, graph_id, round(0.1 * avg((px - tx) ** 2 + (py - ty) ** 2) / 2 + 0.3 * avg((sqrt(px * px + py * py) - 1) ** 2) + 0.3 * avg((gap - 2 * pi() / n) ** 2) + 0.2 * (abs(avg(px)) + abs(avg(py))) / 2 + 0.1 * any_value(l), 6) + 0.0 AS loss
FROM a JOIN q USING (bundle, graph_id) GROUP BY bundle, graph_id""")
def circular_layout_loss(graphs, nodes, edges):
    return G.circular_layout_loss(*_sides(nodes)).withColumn("loss", rounded("loss"))


@query(", g AS (SELECT avg((px - tx) ** 2 + (py - ty) ** 2) / 2 AS a, avg(abs(px - tx) + abs(py - ty)) / 2 AS b FROM std GROUP BY bundle, graph_id) SELECT round(avg(a), 6) AS mse_mean, round(stddev_samp(a), 6) AS mse_std, round(avg(b), 6) AS mae_mean, round(stddev_samp(b), 6) AS mae_std FROM g")
def layout_metrics(graphs, nodes, edges):
    m = G.layout_metrics(*_sides(nodes))
    return m.select(*(r(c, c) for c in m.columns))


@query("SELECT run_id, epoch, best FROM k", HISTORY)
def early_stopping(spark, sf_dir):
    return G.early_stopping(history(spark, sf_dir), 10, 5).select("run_id", F.col("epoch").cast("long").alias("epoch"), "best")


@query("SELECT run_id, arg_min(epoch, (val_loss, epoch)) AS best_epoch, min(val_loss) AS best_val_loss, count(*) AS total_epochs FROM k GROUP BY run_id", HISTORY)
def best_epoch(spark, sf_dir):
    return G.best_epoch(history(spark, sf_dir), 10, 5).withColumn("best_epoch", F.col("best_epoch").cast("long"))


_NEAR = f", {_FEAT}, g AS (SELECT s.bundle, s.graph_id, s.dst AS node, avg(f[1]) AS a0, avg(f[2]) AS a1, sum(f[1]) AS s0, sum(f[2]) AS s1 FROM sym s JOIN feat ON feat.bundle = s.bundle AND feat.graph_id = s.graph_id AND feat.node = s.src GROUP BY ALL) "


@query(_NEAR + _F("a0", "a1") + " FROM g")
def neighbor_mean(graphs, nodes, edges):
    return out(M.neighbor_mean(feat(nodes, edges), edges, 2))


@query(_NEAR + _F("s0 + f[1]", "s1 + f[2]") + " FROM g JOIN feat USING (bundle, graph_id, node)")
def neighbor_sum(graphs, nodes, edges):
    return out(M.neighbor_sum(feat(nodes, edges), edges, 0.0, 2))


@query(_NEAR + _F("f[1] - exp(0.5) * a0", "f[2] - exp(0.5) * a1") + " FROM g JOIN feat USING (bundle, graph_id, node)")
def anti_smooth(graphs, nodes, edges):
    return out(M.anti_smooth(feat(nodes, edges), edges, 0.5, 2))


@query(f", {_FEAT}, g AS (SELECT s.bundle, s.graph_id, s.dst AS node, sum(a.f[1] / sqrt((a.degree + 1.0) * (b.degree + 1))) AS s0, sum(a.f[2] / sqrt((a.degree + 1.0) * (b.degree + 1))) AS s1 FROM sym s JOIN feat a ON a.bundle = s.bundle AND a.graph_id = s.graph_id AND a.node = s.src JOIN feat b ON b.bundle = s.bundle AND b.graph_id = s.graph_id AND b.node = s.dst GROUP BY ALL) " + _F("s0 + f[1] / (degree + 1)", "s1 + f[2] / (degree + 1)") + " FROM g JOIN feat USING (bundle, graph_id, node)")
def gcn_propagate(graphs, nodes, edges):
    return out(M.gcn_propagate(feat(nodes, edges), edges, 2))


@query("SELECT x.bundle, x.graph_id, x.node, y.node AS other FROM circ x JOIN circ y ON x.bundle = y.bundle AND x.graph_id = y.graph_id QUALIFY row_number() OVER (PARTITION BY x.bundle, x.graph_id, x.node ORDER BY round((x.idx - y.idx) ** 2 + (x.n - x.n), 6), (x.node <> y.node)::INT, y.node) <= 3")
def knn_within_graph(graphs, nodes, edges):
    line = nodes.select(*K, "node", F.col("idx").cast("double").alias("x"), F.lit(0.0).alias("y"))
    return M.knn_within_graph(line, 3).select(*K, "node", "other")


@query(f", {_FEAT} SELECT s.bundle, s.graph_id, s.src, s.dst, round(a.f[1] + a.f[2] * 2 + b.f[1] * 3 + b.f[2] * 4 + a.degree * 5 + b.degree * 6, 6) + 0.0 AS digest FROM edges s JOIN feat a ON a.bundle = s.bundle AND a.graph_id = s.graph_id AND a.node = s.src JOIN feat b ON b.bundle = s.bundle AND b.graph_id = s.graph_id AND b.node = s.dst")
def edge_pair_features(graphs, nodes, edges):
    rows = M.edge_pair_features(feat(nodes, edges), edges)
    return rows.select(*K, "src", "dst", r(sum((F.col("e")[i] * (i + 1) for i in range(1, 6)), F.col("e")[0]), "digest"))


_ID = ("bundle", "graph_id::VARCHAR")
_SPLIT = f""", r AS (SELECT bundle, graph_id, row_number() OVER (ORDER BY {uniform_sql(42, *_ID)}, bundle, graph_id) - 1 AS rank, count(*) OVER () AS n FROM graphs),
k AS (SELECT *, floor(n * 0.8::DOUBLE)::BIGINT AS a, floor(n * 0.8::DOUBLE)::BIGINT + floor(n * 0.1::DOUBLE)::BIGINT AS b FROM r),
s AS (SELECT bundle, graph_id, CASE WHEN rank < a THEN 'train' WHEN rank < b THEN 'val' ELSE 'test' END AS split, CASE WHEN rank < a THEN rank WHEN rank < b THEN rank - a ELSE rank - b END AS position FROM k)
"""


@query(_SPLIT + "SELECT * FROM s")
def split_dataset(graphs, nodes, edges):
    return split.split_dataset(graphs.select(*K))


@query(_SPLIT + f", e AS (SELECT bundle, graph_id, split, CASE WHEN split = 'train' THEN row_number() OVER (PARTITION BY split ORDER BY {uniform_sql(42, chr(39) + 'epoch 3' + chr(39), *_ID)}, bundle, graph_id) - 1 ELSE position END AS position FROM s) SELECT *, position // 32 AS batch FROM e")
def assign_batches(graphs, nodes, edges):
    return split.assign_batches(split.split_dataset(graphs.select(*K)), 32, epoch=3)


@query("SELECT bundle, graph_id FROM graphs ORDER BY bundle, graph_id LIMIT 2")
def monitor_samples(graphs, nodes, edges):
    """A limit is the feature."""
    return split.monitor_samples(graphs.select(*K))


@query(f"SELECT bundle, graph_id FROM graphs ORDER BY {uniform_sql(42, chr(39) + 'sample' + chr(39), *_ID)}, bundle, graph_id LIMIT 5")
def sample_graphs(graphs, nodes, edges):
    """A limit is the feature."""
    return split.sample_graphs(graphs.select(*K))


@query("SELECT bundle, graph_id, node, ((dense_rank() OVER (PARTITION BY bundle, graph_id ORDER BY community) - 1) % 10)::INT AS colour FROM nodes")
def community_palette(graphs, nodes, edges):
    return split.community_palette(nodes).select(*K, "node", "colour")


@query("SELECT bundle, graph_id, num_nodes, round(0.1 + " + uniform_sql(42, "'mixing_parameter'", *_ID) + " * (0.5::DOUBLE - 0.1::DOUBLE), 6) AS mixing_parameter FROM specs", SPECS)
def sample_params(spark, sf_dir):
    return synth.sample_params(customer_specs(spark, sf_dir), {"mixing_parameter": "0.1-0.5"}).withColumn("mixing_parameter", rounded("mixing_parameter"))


def er_sql(p: float, attempts: int) -> str:
    """CTE e (t, src, dst): the edges of every attempt t, by the gaps between them in stretches of the row of pairs."""
    length, before = synth.stretch_length(p), lambda a: f"(({a}) * (2 * n - ({a}) - 1) // 2)"
    return f""", st AS (SELECT bundle, graph_id, n, t, pairs, unnest(range((pairs - 1) // {length} + 1)) AS s FROM (SELECT bundle, graph_id, num_nodes::BIGINT AS n, num_nodes::BIGINT * (num_nodes - 1) // 2 AS pairs FROM specs WHERE num_nodes > 1), (SELECT unnest(range({attempts})) AS t)),
dr AS (SELECT *, unnest(range(1, 121)) AS k FROM st),
ps AS (SELECT *, (sum(1 + floor(ln(1 - {uniform_sql(42, 't::VARCHAR', *_ID, 's::VARCHAR', 'k::VARCHAR')}) / ln(1 - {p}::DOUBLE))) OVER (PARTITION BY bundle, graph_id, t, s ORDER BY k))::BIGINT - 1 AS place FROM dr),
en AS (SELECT *, s * {length} + place AS e, floor(n - 0.5 - sqrt((n - 0.5) ** 2 - 2 * (s * {length} + place)))::BIGINT AS a FROM ps WHERE place < least({length}, pairs - s * {length})),
eg AS (SELECT *, CASE WHEN {before('a')} > e THEN a - 1 WHEN {before('a + 1')} <= e THEN a + 1 ELSE a END AS src FROM en),
e AS (SELECT bundle, graph_id, t, n, src, src + 1 + e - {before('src')} AS dst FROM eg)
"""


@query(er_sql(0.1, 1) + "SELECT bundle, graph_id, src, dst FROM e", SPECS)
def er_edges(spark, sf_dir):
    return synth.er_edges(customer_specs(spark, sf_dir), 0.1).drop("weight")


@query("SELECT DISTINCT bundle, graph_id, least(node, other) AS src, greatest(node, other) AS dst FROM (SELECT bundle, graph_id, node, (node + unnest(range(1, greatest(1, least(6, num_nodes - 1) // 2) + 1))) % num_nodes AS other FROM first)", SPECS)
def ws_lattice(spark, sf_dir):
    return synth.ws_lattice(customer_specs(spark, sf_dir)).drop("weight")


def _drawn(family: synth.Family) -> DataFrame:
    return family[2].drop("weight")


@query(er_sql(0.1, 10) + """, es AS (SELECT bundle, graph_id, t, src AS a, dst AS b FROM e UNION ALL SELECT bundle, graph_id, t, dst, src FROM e),
rc AS (SELECT DISTINCT bundle, graph_id, t, 0::BIGINT AS node FROM e UNION SELECT r.bundle, r.graph_id, r.t, b FROM rc r JOIN es ON es.bundle = r.bundle AND es.graph_id = r.graph_id AND es.t = r.t AND a = node),
ok AS (SELECT bundle, graph_id, min(t) AS t FROM (SELECT bundle, graph_id, t FROM rc JOIN specs USING (bundle, graph_id) GROUP BY ALL HAVING count(*) = any_value(num_nodes)) GROUP BY ALL)
SELECT bundle, graph_id, src, dst FROM e JOIN ok USING (bundle, graph_id, t)""", SPECS.replace("WITH", "WITH RECURSIVE", 1))
def er_graphs(spark, sf_dir):
    """Graphs are drawn again until they are connected."""
    return _drawn(synth.er_graphs(customer_specs(spark, sf_dir), 0.1))


def ba_sql(m: int, draws: int) -> str:
    """One node after the other: the first m different ends among its draws from the list of all link ends."""
    u = uniform_sql(42, "'end'", *_ID, "(node + 1)::VARCHAR", "t::VARCHAR")
    return f""", ba AS (SELECT bundle, graph_id, num_nodes::BIGINT AS n, least({m}, num_nodes - 1)::BIGINT AS node, flatten(list_transform(range(least({m}, num_nodes - 1)), lambda l: [l + 1, 0])) AS ends, list_transform(range(least({m}, num_nodes - 1)), lambda l: [0, l + 1]) AS links FROM specs WHERE num_nodes > 1
UNION ALL SELECT bundle, graph_id, n, node + 1, list_concat(ends, flatten(list_transform(found, lambda x: [node + 1, x]))), list_transform(found, lambda x: [x, node + 1])
FROM (SELECT *, list_filter(c, lambda x, i: list_position(c, x) = i)[1:{m}] AS found FROM (SELECT *, list_transform(range({draws}), lambda t: ends[1 + floor({u} * len(ends))::BIGINT]) AS c FROM ba WHERE node + 1 < n)))
SELECT bundle, graph_id, link[1] AS src, link[2] AS dst FROM (SELECT bundle, graph_id, unnest(links) AS link FROM ba)"""


@query(ba_sql(3, 96), SPECS.replace("WITH", "WITH RECURSIVE", 1))
def ba_graphs(spark, sf_dir):
    return _drawn(synth.ba_graphs(customer_specs(spark, sf_dir)))


def ws_sql(k: int, p: float, rounds: int) -> str:
    """The ring with rewired links: in each round the first link that wants a pair has it, the others draw again."""
    u = lambda name, *more: uniform_sql(42, f"'{name}'", *_ID, "step::VARCHAR", "node::VARCHAR", *more)
    ctes = [f"ri AS (SELECT *, unnest(range(1, half + 1)) AS step FROM (SELECT bundle, graph_id, node, num_nodes::BIGINT AS n, greatest(1, least({k}, num_nodes - 1) // 2)::BIGINT AS half FROM first WHERE num_nodes > 1))", f"ring AS (SELECT *, {u('move')} < {p} AND n - 1 > 2 * half AS moves FROM ri WHERE 2 * step <> n OR node < step)", "l0 AS (SELECT bundle, graph_id, n, half, node, step, 0 AS draw FROM ring WHERE moves)"]
    for i in range(rounds):
        ctes.append(f"d{i} AS (SELECT *, (node + half + 1 + floor({u('to', 'draw::VARCHAR')} * (n - 1 - 2 * half))::BIGINT) % n AS o FROM l{i})")
        ctes.append(f"w{i} AS (SELECT *, row_number() OVER (PARTITION BY bundle, graph_id, least(node, o), greatest(node, o) ORDER BY step, node) = 1 AS has FROM d{i})")
        ctes.append(f"l{i + 1} AS (SELECT bundle, graph_id, n, half, node, step, draw + (NOT has)::INT AS draw FROM w{i})")
    last = f"w{rounds - 1}"
    return ", " + ", ".join(ctes) + f" SELECT bundle, graph_id, least(node, (node + step) % n) AS src, greatest(node, (node + step) % n) AS dst FROM ring WHERE NOT moves UNION ALL SELECT bundle, graph_id, least(node, o), greatest(node, o) FROM {last} WHERE has"


@query(ws_sql(6, 0.2, 8), SPECS)
def ws_graphs(spark, sf_dir):
    return _drawn(synth.ws_graphs(customer_specs(spark, sf_dir)))


@query(ws_sql(8, 0.5, 12), SPECS)
def graphs_from_config(spark, sf_dir):
    """Small worlds of a graph per customer, by configuration."""
    config = {"type": "WS", "num_nodes": "50-60", "k": 8, "p": 0.5}
    return _drawn(synth.graphs_from_config(spark, config, customer_specs(spark, sf_dir)))


@query("SELECT run_id, key AS run_key FROM runs", RUNS)
def run_key(spark, sf_dir):
    return runs(spark, sf_dir).select("run_id", R.run_key(F.col("params")).alias("run_key"))


_MODELS = "[" + ", ".join(f"'{m}'" for m in R.MODELS) + "]"


@query(f"SELECT run_id, dropout::DOUBLE AS dropout, hidden_dim, num_layers, top_k, {_MODELS}[model + 1] AS model_name FROM runs", RUNS)
def parse_run_name(spark, sf_dir):
    models = F.array(*map(F.lit, R.MODELS))
    named = runs(spark, sf_dir).select("run_id", F.concat(F.lit("/runs/"), models[F.col("model")], F.lit("_"), R.run_key(F.col("params")), F.lit(".pt")).alias("path"))
    told = named.select("run_id", R.parse_run_name(F.col("path")).alias("p"), R.detect_model(F.col("path")).alias("model_name"))
    return told.select("run_id", "p.dropout", "p.hidden_dim", "p.num_layers", "p.top_k", "model_name")


from . import checks  # noqa: E402, F401  (registers the rest)
