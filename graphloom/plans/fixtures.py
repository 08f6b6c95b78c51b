"""Graph tables derived from the test tables: one graph per customer, its nodes the suppliers of the customer's orders, an
edge for two suppliers of one order; weight counts such orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..keys import K, uniform_sql
from ..operators import synth
from ..shared import bucketed, by_graph, kept_by_graph, stored


#: Items that a bucket holds, about.
BUCKET = 500_000


def buckets_for(items: DataFrame) -> int:
    """Buckets, so that one holds no more where tables are larger."""
    return max(int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-items.count() // BUCKET))


def order_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(graphs, nodes with idx and community, edges), each computed once: what a query does with them is not done again. Nodes and edges
    are bucketed by graph, so that joins and groups by graph, or by graph and node, don't exchange them; no graph here is much of the
    table."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    by_graph(spark)
    customers = read("customer").select(F.col("c_custkey").alias("graph_id"), F.col("c_nationkey").cast("string").alias("bundle"), F.col("c_mktsegment").alias("graph_type"))
    orders = read("orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("graph_id"))
    owned = orders.join(customers.select(*K, "graph_type").hint("merge"), "graph_id").select(*K, "l_orderkey").hint("merge")
    parts = buckets_for(read("lineitem"))
    # an order has a few suppliers, so its pairs are made from one array, without a join of the items with themselves
    items = read("lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_suppkey")).alias("s")).filter(F.size("s") > 1)
    baskets = bucketed(items.join(owned, "l_orderkey").select(*K, "s"), K, "baskets", parts)
    first = baskets.select(*K, "s", F.posexplode("s").alias("i", "src"))
    pairs = first.select(*K, "src", F.explode(F.expr("slice(s, i + 2, size(s))")).alias("dst"))
    edges = kept_by_graph(pairs.groupBy(*K, "src", "dst").agg(F.count("*").cast("double").alias("weight")), "edges", parts)
    ends = baskets.select(*K, F.explode("s").alias("node")).distinct()
    nodes = ends.withColumn("idx", (F.row_number().over(Window.partitionBy(*K).orderBy("node")) - 1).cast("int"))
    nations = read("supplier").join(read("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("node"), F.col("n_regionkey").cast("int").alias("community"))
    nodes = kept_by_graph(nodes.join(nations, "node", "left").select(*K, "node", "idx", "community"), "nodes", parts)
    sizes = nodes.groupBy(*K).agg(F.count("*").cast("int").alias("num_nodes"))
    return customers.join(sizes, K), nodes, edges


#: The same tables as DuckDB CTEs, with symmetric edges, degrees and sizes.
BASE = """
WITH RECURSIVE li AS (SELECT DISTINCT c_nationkey::VARCHAR AS bundle, o_custkey AS graph_id, c_mktsegment AS graph_type, l_orderkey, l_suppkey AS node
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey),
edges AS (SELECT a.bundle, a.graph_id, a.node AS src, b.node AS dst, count(*)::DOUBLE AS weight FROM li a JOIN li b ON a.l_orderkey = b.l_orderkey AND a.node < b.node GROUP BY ALL),
sym AS (SELECT * FROM edges UNION ALL SELECT bundle, graph_id, dst, src, weight FROM edges),
nodes AS (SELECT e.*, row_number() OVER (PARTITION BY bundle, graph_id ORDER BY node) - 1 AS idx, count(*) OVER (PARTITION BY bundle, graph_id) AS n, n_regionkey AS community
  FROM (SELECT DISTINCT bundle, graph_id, src AS node FROM sym) e JOIN supplier ON s_suppkey = node JOIN nation ON s_nationkey = n_nationkey),
deg AS (SELECT bundle, graph_id, src AS node, count(*) AS degree FROM sym GROUP BY ALL),
sizes AS (SELECT v.*, num_edges FROM (SELECT bundle, graph_id, count(*) AS num_nodes FROM nodes GROUP BY ALL) v JOIN (SELECT bundle, graph_id, count(*) AS num_edges FROM edges GROUP BY ALL) e USING (bundle, graph_id)),
graphs AS (SELECT DISTINCT bundle, graph_id, graph_type FROM li SEMI JOIN nodes USING (bundle, graph_id)),
tri AS (SELECT bundle, graph_id, unnest([a, b, c]) AS node FROM (SELECT x.bundle, x.graph_id, x.src AS a, x.dst AS b, y.dst AS c FROM edges x JOIN edges y ON x.bundle = y.bundle AND x.graph_id = y.graph_id AND x.dst = y.src
  JOIN edges z ON z.bundle = x.bundle AND z.graph_id = x.graph_id AND z.src = x.src AND z.dst = y.dst)),
clus AS (SELECT bundle, graph_id, d.node, coalesce(t, 0) AS triangles, CASE WHEN degree > 1 THEN 2.0 * coalesce(t, 0) / (degree * (degree - 1)) ELSE 0.0 END AS clustering
  FROM deg d LEFT JOIN (SELECT bundle, graph_id, node, count(*) AS t FROM tri GROUP BY ALL) USING (bundle, graph_id, node)),
circ AS (SELECT *, CASE WHEN n > 1 THEN cos(2 * pi() * idx / n) ELSE 0.0 END AS cx, CASE WHEN n > 1 THEN sin(2 * pi() * idx / n) ELSE 0.0 END AS cy FROM nodes),
grid AS (SELECT *, 2 * ((idx % g) / greatest(g - 1, 1)::DOUBLE) - 1 AS gx, 2 * ((idx // g) / greatest(ceil(n / g::DOUBLE) - 1, 1)::DOUBLE) - 1 AS gy FROM (SELECT *, ceil(sqrt(n))::BIGINT AS g FROM circ)),
std AS (SELECT *, (cx - avg(cx) OVER w) / CASE WHEN stddev_pop(cx) OVER w < 1e-6 THEN 1 ELSE stddev_pop(cx) OVER w END AS tx, (cy - avg(cy) OVER w) / CASE WHEN stddev_pop(cy) OVER w < 1e-6 THEN 1 ELSE stddev_pop(cy) OVER w END AS ty,
  (gx - avg(gx) OVER w) / CASE WHEN stddev_pop(gx) OVER w < 1e-6 THEN 1 ELSE stddev_pop(gx) OVER w END AS px, (gy - avg(gy) OVER w) / CASE WHEN stddev_pop(gy) OVER w < 1e-6 THEN 1 ELSE stddev_pop(gy) OVER w END AS py
  FROM grid WINDOW w AS (PARTITION BY bundle, graph_id)),
reach AS (SELECT bundle, graph_id, node, node AS to_node FROM nodes UNION SELECT r.bundle, r.graph_id, r.node, s.dst FROM reach r JOIN sym s ON r.bundle = s.bundle AND r.graph_id = s.graph_id AND r.to_node = s.src),
comp AS (SELECT bundle, graph_id, node, dense_rank() OVER (PARTITION BY bundle, graph_id ORDER BY root) - 1 AS component FROM (SELECT bundle, graph_id, node, min(to_node) AS root FROM reach GROUP BY ALL))
"""


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run histories from events: a run per user, an epoch per event in order, the losses from the values."""
    order = Window.partitionBy("run_id").orderBy("ts", "event_id")
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("run_id"), "ts", "event_id", F.col("value").alias("val_loss"))
    return rows.withColumns({"epoch": F.row_number().over(order) - 1, "train_loss": F.coalesce(F.lag("val_loss").over(order), "val_loss")}).select("run_id", "epoch", "train_loss", "val_loss")


HISTORY = """WITH h AS (SELECT user_id AS run_id, row_number() OVER w - 1 AS epoch, coalesce(lag(value) OVER w, value) AS train_loss, value AS val_loss FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
b AS (SELECT *, coalesce(val_loss < min(val_loss) OVER (PARTITION BY run_id ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), val_loss IS NOT NULL) AS best FROM h),
s AS (SELECT *, epoch - coalesce(max(CASE WHEN best THEN epoch END) OVER (PARTITION BY run_id ORDER BY epoch), -1) >= 5 AND epoch >= 10 AS stops FROM b),
k AS (SELECT * FROM s QUALIFY coalesce(max(stops::INT) OVER (PARTITION BY run_id ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0)
"""


def customer_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A wanted graph of 50 to 60 nodes per customer."""
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_nationkey").cast("string").alias("bundle"), F.col("c_custkey").cast("long").alias("graph_id"))
    return synth.with_node_counts(rows, "50-60")


_ID = ("bundle", "graph_id::VARCHAR")
SPECS = f"""WITH c AS (SELECT c_nationkey::VARCHAR AS bundle, c_custkey::BIGINT AS graph_id FROM customer),
specs AS (SELECT *, (50 + floor({uniform_sql(42, "'n'", *_ID)} * 11))::INT AS num_nodes FROM c),
first AS (SELECT *, unnest(range(num_nodes))::BIGINT AS node FROM specs)
"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run per order: its hyper-parameters from the order's numbers, its model from the customer's."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("c"))
    text = {"hidden_dim": (F.col("run_id") % 5 + 1) * 16, "dropout": (F.col("run_id") % 40) / 100.0, "num_layers": F.col("c") % 4 + 1, "top_k": F.col("c") % 33}
    return o.select("run_id", (F.col("c") % 9).cast("int").alias("model"), F.create_map(*(x for k, v in text.items() for x in (F.lit(k), v.cast("string")))).alias("params"))


RUNS = """WITH runs AS (SELECT o_orderkey AS run_id, (o_custkey % 9)::INT AS model, 'd' || rtrim(rtrim(printf('%.3f', (o_orderkey % 40) / 100.0), '0'), '.') || '_h' || ((o_orderkey % 5 + 1) * 16) || '_l' || (o_custkey % 4 + 1) || '_topk' || (o_custkey % 33) AS key,
(o_orderkey % 40) / 100.0 AS dropout, ((o_orderkey % 5 + 1) * 16)::INT AS hidden_dim, (o_custkey % 4 + 1)::INT AS num_layers, (o_custkey % 33)::INT AS top_k FROM orders)
"""


def big_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of one large graph: all parts, those of one order linked."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_partkey")).alias("s")).filter(F.size("s") > 1)
    pairs = F.flatten(F.transform("s", lambda a: F.transform(F.filter("s", lambda b: b > a), lambda b: F.struct(a.alias("src"), b.alias("dst")))))
    each = items.select(F.lit("all").alias("bundle"), F.lit(0).alias("graph_id"), F.inline(pairs))
    edges = stored(each.groupBy(*K, "src", "dst").agg(F.count("*").cast("double").alias("weight")))
    return stored(edges.select(*K, F.explode(F.array("src", "dst")).alias("node")).distinct()), edges


#: Labels go to neighbours in rounds: enough for graphs whose nodes are at most 12 steps apart.
BIG = """WITH bl AS (SELECT DISTINCT l_orderkey, l_partkey AS node FROM lineitem),
bedges AS (SELECT DISTINCT 'all' AS bundle, 0 AS graph_id, a.node AS src, b.node AS dst FROM bl a JOIN bl b ON a.l_orderkey = b.l_orderkey AND a.node < b.node),
bsym AS (SELECT * FROM bedges UNION ALL SELECT bundle, graph_id, dst, src FROM bedges),
bdeg AS (SELECT bundle, graph_id, src AS node, count(*) AS degree FROM bsym GROUP BY ALL),
btri AS (SELECT x.bundle, x.graph_id, x.src AS a, x.dst AS b, y.dst AS c FROM bedges x JOIN bedges y ON x.dst = y.src JOIN bedges z ON z.src = x.src AND z.dst = y.dst),
b0 AS (SELECT bundle, graph_id, node, node AS root FROM bdeg), """ + ", ".join(f"b{i + 1} AS (SELECT bundle, graph_id, node, min(root) AS root FROM (SELECT * FROM b{i} UNION ALL SELECT s.bundle, s.graph_id, s.dst, root FROM b{i} JOIN bsym s ON s.src = node) GROUP BY ALL)" for i in range(12)) + "\n"
