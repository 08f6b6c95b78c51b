"""Counts and statistics of graph tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..keys import K
from ..shared import by_graph, stored
from .prep import symmetrize


def degrees_of(edges: DataFrame) -> DataFrame:
    """The degree of each node that an edge has."""
    return symmetrize(edges).groupBy(*K, F.col("src").alias("node")).agg(F.count("*").alias("degree"))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    found = degrees_of(edges)
    return nodes.select(*K, "node").join(found, [*K, "node"], "left").select(*K, "node", F.coalesce("degree", F.lit(0)).alias("degree"))


def graph_sizes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n = nodes.groupBy(*K).agg(F.count("*").alias("num_nodes"))
    e = edges.groupBy(*K).agg(F.count("*").alias("num_edges"))
    return n.join(e, K, "left").select(*K, "num_nodes", F.coalesce("num_edges", F.lit(0)).alias("num_edges"))


def density(sizes: DataFrame) -> DataFrame:
    n = F.col("num_nodes")
    return sizes.withColumn("density", F.when(n > 1, F.col("num_edges") / (n * (n - 1) / 2)).otherwise(F.lit(0.0)))


#: Neighbours that lie together in a row.
LIST = 4096


def _block_bits(nodes: int, parts: int) -> int:
    """Nodes whose numbers agree but for so many last bits are a block: a few blocks a partition where numbers are dense, and no more than 2^16 nodes each."""
    return min(16, max(0, (nodes // (2 * parts)).bit_length()))


def triangles(edges: DataFrame, known: DataFrame | None = None, size: int = LIST) -> DataFrame:
    """Triangles at each corner; known(bundle, graph_id, node, degree) saves counting. Nodes are whole numbers.

    Edges point from the lower to the higher (degree, node), so no list of out-neighbours is longer than the root of twice the
    edges. Lists are rows of at most `size` nodes; each goes to the nodes in its node's list, where it is intersected with theirs:
    a wedge is never a row. Nodes lie in blocks of near numbers, and a list is sent once to a block, however many of its nodes lie there:
    it is copied to them only where they are."""
    spark = edges.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    by_graph(spark)  # else what lies by block would be dealt by node for the join
    deg = stored(degrees_of(edges)) if known is None else known.select(*K, "node", "degree")
    side = lambda c: deg.select(*K, F.col("node").alias(c), F.col("degree").alias(f"d_{c}"))
    rows = edges.select(*K, "src", "dst").join(side("src"), [*K, "src"]).join(side("dst"), [*K, "dst"])
    forward = F.struct("d_src", "src") < F.struct("d_dst", "dst")
    out = rows.select(*K, F.when(forward, F.col("src")).otherwise(F.col("dst")).alias("a"), F.when(forward, F.col("dst")).otherwise(F.col("src")).alias("b"), F.least("d_src", "d_dst").alias("d"))
    part = F.when(F.col("d") > size, F.pmod(F.xxhash64("b"), F.ceil(F.col("d") / size))).otherwise(0)
    lists = stored(out.groupBy(*K, "a", part.alias("part")).agg(F.array_sort(F.collect_list("b")).alias("ends")), merge=False)
    bits = _block_bits(deg.count(), parts)
    of = lambda c: F.shiftright(c.cast("long"), bits)
    if lists.filter("part > 0").limit(1).count():
        to = lists.select(*K, "a", F.explode("ends").alias("b")).groupBy(*K, "a", of(F.col("b")).alias("block")).agg(F.collect_list("b").alias("to"))
        sent = to.join(lists.select(*K, "a", "ends"), [*K, "a"])  # every list of a goes to every b of all its lists
    else:
        # a list of one node that is alone meets nobody
        sent = lists.filter(F.size("ends") > 1).select(*K, "a", "ends", F.explode(F.array_distinct(F.transform("ends", of))).alias("block"))
    sent = sent.repartition(parts, *K, "block")
    to = F.col("to") if "to" in sent.columns else F.filter("ends", lambda b: of(b) == F.col("block"))
    sent = sent.select(*K, "block", "a", "ends", F.explode(to).alias("b"))
    there = lists.select(*K, of(F.col("a")).alias("block"), F.col("a").alias("b"), F.col("ends").alias("theirs")).repartition(parts, *K, "block")
    # the lists of a partition's blocks are held, so that no copy is sorted
    found = sent.join(there.hint("shuffle_hash"), [*K, "block", "b"]).select(*K, "a", "b", F.array_intersect("ends", "theirs").alias("c"))
    one = lambda c, n: F.struct(c.alias("node"), n.cast("long").alias("n"))
    credit = F.concat(F.array(one(F.col("a"), F.size("c")), one(F.col("b"), F.size("c"))), F.transform("c", lambda c: one(c, F.lit(1))))
    # no filter of lists that share no node: it would become a part of the join, which computes what they share once more
    return found.select(*K, F.explode(F.when(F.size("c") > 0, credit)).alias("t")).groupBy(*K, "t.node").agg(F.sum("t.n").alias("triangles"))


#: Edges that corners() takes together, and wedges a numpy step.
TOGETHER, WEDGES = 1 << 16, 1 << 20


def _closed(low: np.ndarray, high: np.ndarray, n: int) -> np.ndarray:
    """Triangles at each of n nodes, of edges from the lower to the higher end by degree: an edge and the next one are closed by a third."""
    key = np.unique(low * n + high)
    a, b = np.divmod(key, n)
    first = np.searchsorted(a, np.arange(n + 1))
    each, found = np.diff(first)[b], np.zeros(n, np.int64)
    before = np.append(0, np.cumsum(each))
    lo = 0
    while lo < len(key):
        hi = max(lo + 1, int(np.searchsorted(before, before[lo] + WEDGES, "right")) - 1)
        edge = np.repeat(np.arange(lo, hi), each[lo:hi])
        c = b[first[b[edge]] + np.arange(before[lo], before[hi]) - before[edge]]
        third = a[edge] * n + c
        closed = key[np.minimum(np.searchsorted(key, third), len(key) - 1)] == third
        for corner in (a[edge[closed]], b[edge[closed]], c[closed]):
            found += np.bincount(corner, minlength=n)
        lo = hi
    return found


def _corner_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of whole graphs to rows of nodes with degree and triangles, some graphs at a time."""
    for batch in batches:
        offsets, lo = batch.column("src").offsets.to_numpy(), 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + TOGETHER, "right")) - 1)
            rows, graph = batch.slice(lo, hi - lo), np.repeat(np.arange(hi - lo), np.diff(offsets[lo : hi + 1]))
            ends = np.concatenate([rows.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("src", "dst")])
            names, at = np.unique(ends, return_inverse=True)
            nodes, at = np.unique(np.concatenate([graph, graph]) * len(names) + at, return_inverse=True)
            degree = np.bincount(at, minlength=len(nodes))
            u, v = at[: len(graph)], at[len(graph) :]
            u, v = u[u != v], v[u != v]
            turned = (degree[u] > degree[v]) | ((degree[u] == degree[v]) & (u > v))
            found = _closed(np.where(turned, v, u), np.where(turned, u, v), len(nodes))
            of, name = np.divmod(nodes, len(names))
            yield pa.RecordBatch.from_arrays([*(rows.column(c).take(pa.array(of)) for c in K), pa.array(names[name]), pa.array(degree), pa.array(found)], [*K, "node", "degree", "triangles"])
            lo = hi


def corners(edges: DataFrame) -> DataFrame:
    """The degree and triangles of each node that an edge has, for edges that lie by graph (shared.kept_by_graph): a graph is one row of
    arrays, and graphs of a task are counted together."""
    kinds = dict(edges.dtypes)
    rows = edges.select(*K, "src", "dst").dropna().groupBy(*K).agg(F.collect_list(F.struct("src", "dst")).alias("e")).select(*K, "e.src", "e.dst")
    return rows.mapInArrow(_corner_rows, f"bundle {kinds['bundle']}, graph_id {kinds['graph_id']}, node {kinds['src']}, degree long, triangles long")


def with_clustering(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """rows of nodes with their degree, triangles and local clustering. What is known of nodes of edges that lie by graph lies so too."""
    node, none = [*K, "node"], F.lit(0)
    if getattr(edges, "_by_graph", None):
        rows = rows.join(corners(edges), node, "left").withColumns({c: F.coalesce(c, none) for c in ("degree", "triangles")})
    else:
        rows = stored(rows.join(degrees_of(edges), node, "left").withColumn("degree", F.coalesce("degree", none)))
        rows = rows.join(triangles(edges, rows), node, "left").withColumn("triangles", F.coalesce("triangles", none))
    k = F.col("degree")
    return rows.withColumn("clustering", F.when(k > 1, 2 * F.col("triangles") / (k * (k - 1))).otherwise(F.lit(0.0)))


def local_clustering(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return with_clustering(nodes.select(*K, "node"), edges).select(*K, "node", "triangles", "clustering")


def average_clustering(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return local_clustering(nodes, edges).groupBy(*K).agg(F.avg("clustering").alias("avg_clustering"))


def zscore(df: DataFrame, cols: list[str], eps: float = 1e-6) -> DataFrame:
    """df with {col}_norm over all rows: sample deviation; under eps it is 0, and of a single row NaN."""
    if not cols:
        return df
    stats = df.agg(*(f(c).alias(f"_{n}_{c}") for c in cols for n, f in (("m", F.avg), ("s", F.stddev_samp))))
    out = df.crossJoin(F.broadcast(stats))  # one row
    for c in cols:
        s = F.col(f"_s_{c}")
        out = out.withColumn(f"{c}_norm", F.when(s.isNull() | F.isnan(s), F.lit(float("nan"))).when(s < eps, F.lit(0.0)).otherwise((F.col(c) - F.col(f"_m_{c}")) / s))
    return out.select(*df.columns, *(f"{c}_norm" for c in cols))


def average_degree(sizes: DataFrame) -> DataFrame:
    return sizes.filter("num_nodes > 0").withColumn("avg_degree", 2 * F.col("num_edges") / F.col("num_nodes"))


def bundle_statistics(sizes: DataFrame) -> DataFrame:
    """One row per bundle: min, max and mean of nodes, edges and average degree."""
    rows = average_degree(sizes)
    of = (("nodes", "num_nodes"), ("edges", "num_edges"), ("degree", "avg_degree"))
    return rows.groupBy("bundle").agg(F.count("*").alias("num_graphs"), *(f(c).alias(f"{p}_{n}") for n, c in of for p, f in (("min", F.min), ("max", F.max), ("avg", F.avg))))


def bundle_metadata(graphs: DataFrame) -> DataFrame:
    kind = F.coalesce("graph_type", F.lit("unknown"))
    return graphs.groupBy("bundle").agg(F.count("*").alias("num_graphs"), F.array_sort(F.collect_set(kind)).alias("graph_types"))


def type_counts(graphs: DataFrame) -> DataFrame:
    return graphs.groupBy(F.coalesce("graph_type", F.lit("unknown")).alias("graph_type")).agg(F.count("*").alias("num_graphs"))


def community_statistics(graphs: DataFrame) -> DataFrame:
    """Over graphs with communities: their number, min, max and mean of num_communities, mean mixing parameter."""
    c = F.col("num_communities")
    return graphs.filter(c > 0).agg(F.count("*").alias("num_graphs"), F.min(c).alias("min_communities"), F.max(c).alias("max_communities"), F.avg(c).alias("avg_communities"), F.avg(F.coalesce("mixing_parameter", F.lit(0.0))).alias("avg_mixing"))


def connectivity_rate(component_counts: DataFrame) -> DataFrame:
    one = F.when(F.col("n_components") == 1, 1).otherwise(0)
    return component_counts.agg(F.sum(one).alias("connected"), F.count("*").alias("num_graphs"), (100.0 * F.avg(one)).alias("percent"))


def dataset_statistics(samples: DataFrame) -> DataFrame:
    """One row per graph type, per layout type, and of all (`level` tells which): counts, and ranges of nodes and edges (half of
    edge_index). A missing type is "unknown"."""
    kind = lambda c: F.coalesce(c, F.lit("unknown")).alias(c)
    rows = samples.select(kind("graph_type"), kind("layout_type"), F.col("num_communities").isNotNull().cast("int").alias("c"), F.coalesce("has_initial_position", F.lit(False)).cast("int").alias("i"), F.size("x").alias("n"), (F.size("edge_index") / 2).alias("e"))
    aggs = [F.count("*").alias("num_graphs"), F.sum("c").alias("with_communities"), F.sum("i").alias("with_initial"), F.min("n").alias("min_nodes"), F.max("n").alias("max_nodes"), F.avg("n").alias("avg_nodes"), F.min("e").alias("min_edges"), F.max("e").alias("max_edges"), F.avg("e").alias("avg_edges")]
    level = F.when(F.grouping("graph_type") == 0, "graph_type").when(F.grouping("layout_type") == 0, "layout_type").otherwise("all").alias("level")
    return rows.groupingSets([["graph_type"], ["layout_type"], []], "graph_type", "layout_type").agg(level, *aggs)


def dataset_info(samples: DataFrame) -> DataFrame:
    """One row: graphs, feature and output width, nodes, edges, and the first sample's id. No row has num_graphs 0."""
    rows = samples.select(*K, F.size("x").alias("n"), F.size(F.col("x")[0]).alias("f"), (F.size("edge_index") / 2).alias("e"))
    first = F.min(F.struct(*K, "f"))
    return rows.agg(F.count("*").alias("num_graphs"), first["f"].alias("feature_dim"), F.lit(2).alias("output_dim"), F.avg("n").alias("avg_nodes"), F.min("n").alias("min_nodes"), F.max("n").alias("max_nodes"), F.avg("e").alias("avg_edges"), first["graph_id"].alias("sample_id"))


def generation_summary(attempts: DataFrame) -> DataFrame:
    """One row over attempts(ok, seed, nodes, edges, communities): success rate, ranges, seeds (0 is none) and repeated ones."""
    good = lambda c: F.when(F.col("ok"), F.col(c))
    ranges = [f(good(c)).alias(f"{p}_{c}") for c in ("nodes", "edges", "communities") for p, f in (("min", F.min), ("max", F.max), ("avg", F.avg))]
    seed = F.when(F.col("ok") & (F.col("seed") != 0), F.col("seed"))
    return attempts.agg(F.count("*").alias("attempts"), F.avg(F.col("ok").cast("int")).alias("success_rate"), *ranges, F.min(seed).alias("min_seed"), F.max(seed).alias("max_seed"), (F.count(seed) - F.countDistinct(seed)).alias("repeated_seeds"))
