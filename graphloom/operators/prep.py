"""Cleaning and joining graph tables, and connected components.

Tables: edges(bundle, graph_id, src, dst, weight) with one row per undirected edge; nodes(bundle, graph_id, node, idx).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..keys import K, rank_within
from ..shared import kept_by_graph, stored


def symmetrize(edges: DataFrame) -> DataFrame:
    """Each edge in both directions, by one scan."""
    ends = F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return edges.select(*K, "weight", F.explode(ends).alias("e")).select(*K, "e.src", "e.dst", "weight")


def canonical_edges(edges: DataFrame, order_col: str | None = None) -> DataFrame:
    """src < dst and one row per pair; of repeats the last by order_col decides the weight (else the largest weight)."""
    low, high = F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")
    last = F.max_by("weight", order_col) if order_col else F.max("weight")
    rows = edges.withColumns({"_a": low, "_b": high})
    return rows.groupBy(*K, "_a", "_b").agg(last.alias("weight")).select(*K, F.col("_a").alias("src"), F.col("_b").alias("dst"), "weight")


def drop_self_loops(edges: DataFrame) -> DataFrame:
    return edges.filter("src <> dst")


def remap_nodes(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes with idx 0..n-1 by old id, edges between idx); only nodes that an edge has."""
    ends = edges.select(*K, F.explode(F.array("src", "dst")).alias("node")).distinct()
    nodes = stored(rank_within(ends, K, "node").withColumn("idx", F.col("rank").cast("int")).drop("rank"))
    at = lambda c: nodes.select(*K, F.col("node").alias(c), F.col("idx").alias(f"{c}_idx"))
    mapped = edges.join(at("src"), [*K, "src"]).join(at("dst"), [*K, "dst"])
    return nodes, mapped.select(*K, F.col("src_idx").cast("long").alias("src"), F.col("dst_idx").cast("long").alias("dst"), "weight")


def attach_communities(nodes: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes with community or 0, graphs whose node 0 has one with num_communities); labels(bundle, graph_id, node, community)."""
    rows = nodes.join(labels, [*K, "node"], "left")
    stats = rows.groupBy(*K).agg(F.countDistinct(F.coalesce("community", F.lit(0))).alias("num_communities"), F.max(F.when((F.col("idx") == 0) & F.col("community").isNotNull(), True)).alias("_has"))
    return rows.withColumn("community", F.coalesce("community", F.lit(0))), stats.filter("_has").drop("_has")


def community_counts(labels: DataFrame) -> DataFrame:
    return labels.groupBy(*K).agg(F.countDistinct("community").alias("num_communities"))


#: Links that a task contracts together; of more nodes than half of that its links are sent on.
HELD = 1 << 20

_LINK = [*K, "src", "dst"]


def _star(links: pa.Table) -> pa.Table:
    """A link from each node to the smallest node that the links tie it to."""
    columns = [links.column(c).combine_chunks() for c in _LINK]
    keys = [c.dictionary_encode() for c in columns[:2]]
    graph = keys[0].indices.to_numpy().astype(np.int64) * len(keys[1].dictionary) + keys[1].indices.to_numpy()
    names, at = np.unique(np.concatenate([c.to_numpy() for c in columns[2:]]), return_inverse=True)
    nodes, first, at = np.unique(np.concatenate([graph, graph]) * len(names) + at, return_index=True, return_inverse=True)  # in the order of graph and node
    a, b = at[: len(graph)], at[len(graph) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    row, node = pa.array(first % len(graph)), names[nodes % len(names)]
    return pa.Table.from_arrays([*(c.take(row) for c in columns[:2]), pa.array(node), pa.array(node[root])], _LINK)


def _stars(batches: Iterator[pa.RecordBatch], held: int) -> Iterator[pa.RecordBatch]:
    """Edges of a task to links from its nodes to the smallest node that the edges tie them to. They are contracted as they come, so that
    the task holds some `held` links, and its nodes have one each if they are not too many. Of links that are sent on before the end those of
    the last graph stay, so that a graph whose edges come together is not split (unless it is large itself)."""
    rows, n = [], 0

    def sent(links: pa.Table) -> Iterator[pa.RecordBatch]:
        yield from links.rename_columns([*K, "node", "root"]).to_batches(max_chunksize=1 << 16)

    for batch in batches:
        if not batch.num_rows:
            continue
        # a batch's schema may say "not null", that of contracted links doesn't, and tables of two schemas are not put together
        rows.append(pa.Table.from_arrays(batch.columns, _LINK))
        n += batch.num_rows
        if n >= held:
            links, end = _star(pa.concat_tables(rows)), batch.slice(batch.num_rows - 1)
            rows, n = [links], links.num_rows
            if n > held // 2:
                last = pc.and_(*(pc.equal(links.column(c), end.column(c)[0]) for c in K)).combine_chunks().fill_null(False)
                yield from sent(links.filter(pc.invert(last)))
                rest = links.filter(last)
                if rest.num_rows > held // 2:
                    yield from sent(rest)
                    rest = rest.slice(0, 0)
                rows, n = [rest], rest.num_rows
    if n:
        yield from sent(_star(pa.concat_tables(rows)))


def _at_roots(up: DataFrame) -> DataFrame:
    """(node, root) of a forest in which each node has one that is not larger as its root: pointer jumps, stored."""
    while True:
        jump = up.select(*K, F.col("node").alias("root"), F.col("root").alias("to"))
        step = stored(up.join(jump, [*K, "root"]).select(*K, "node", F.col("root").alias("old"), F.col("to").alias("root")))
        up = step.select(*K, "node", "root").hint("merge")
        if not step.filter("root <> old").limit(1).count():
            return up


def _roots(links: DataFrame) -> DataFrame:
    """(node, root), the smallest node reachable over links (src, dst) in both directions. Each round ties a node to its smallest neighbour
    and contracts the trees of these ties, so at most about half the nodes are left after two rounds, and of the links those between trees."""
    labels = None
    while True:
        both = symmetrize(links.withColumn("weight", F.lit(1.0)))
        up = _at_roots(stored(both.groupBy(*K, F.col("src").alias("node")).agg(F.least(F.first("src"), F.min("dst")).alias("root"))))
        to = up.select(*K, F.col("node").alias("root"), F.col("root").alias("to")).hint("merge")
        labels = up if labels is None else stored(labels.join(to, [*K, "root"], "left").select(*K, "node", F.coalesce("to", "root").alias("root")))
        side = lambda c, up=up: up.select(*K, F.col("node").alias(c), F.col("root").alias(f"r_{c}")).hint("merge")
        met = links.join(side("src"), [*K, "src"]).join(side("dst"), [*K, "dst"]).filter("r_src <> r_dst")
        links = stored(met.select(*K, F.least("r_src", "r_dst").alias("src"), F.greatest("r_src", "r_dst").alias("dst")).distinct())
        if not links.limit(1).count():
            return labels


#: Edges of large graphs that are dealt to a task, about.
DEALT = 1 << 21


def smallest_reached(nodes: DataFrame, edges: DataFrame, large: bool = False, held: int = HELD) -> DataFrame:
    """nodes (whole numbers) with root, the smallest node of their component.

    Edges are first contracted where they are: dealt by graph, those of a task become stars. A small graph lies in
    one task and is done. If a node was given two roots, its graph spans tasks, and the stars of such graphs (no more
    links than nodes a task) go through rounds of joins, so a graph of any size is handled. Edges that lie by graph are not dealt again.
    `large` tells that graphs are much of the table: their edges (which should be at rest) are dealt by ranges of nodes, evenly and so that
    nodes with near numbers meet, and no join is by graph alone."""
    kinds, buckets = dict(edges.dtypes), getattr(edges, "_by_graph", None)
    dealt = drop_self_loops(edges).select(*K, F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))
    if large:
        parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        dealt, buckets = dealt.repartitionByRange(max(parts, edges.count() // DEALT), *K, "src"), None
    else:
        # a rebalance, not a repartition: the edges of a graph that is much of the table are dealt to several tasks
        dealt = (dealt if buckets else dealt.hint("rebalance", *K)).sortWithinPartitions(*K)
    schema = f"bundle {kinds['bundle']}, graph_id {kinds['graph_id']}, node long, root long"
    stars = kept_by_graph(dealt.mapInArrow(lambda it: _stars(it, held), schema), "stars", buckets)
    labels = stars.groupBy(*K, "node").agg(F.min("root").alias("root"), F.max("root").alias("other"))
    split = stored(labels.filter("root <> other").select(*K).distinct())
    labels = labels.select(*K, "node", "root")
    if split.limit(1).count():
        # few graphs are split, as a task has its edges by graph; a join by graph would deal all links of a large one to one task
        links = stars.join(F.broadcast(split), K, "left_semi").select(*K, F.col("node").alias("src"), F.col("root").alias("dst"))
        found = _roots(stored(links)).select(*K, "node", F.col("root").alias("far"))
        labels = labels.join(found, [*K, "node"], "left").select(*K, "node", F.coalesce("far", "root").alias("root")).hint("merge")
    return nodes.select(*K, "node").join(labels, [*K, "node"], "left").select(*K, "node", F.coalesce("root", "node").alias("root")).hint("merge")


def connected_components(nodes: DataFrame, edges: DataFrame, large: bool = False) -> DataFrame:
    """nodes with component 0..G-1 in the order of smallest nodes; large: as for smallest_reached()."""
    labels = smallest_reached(nodes, edges, large)
    roots = rank_within(labels.filter("root = node").select(*K, "root"), K, "root")
    return labels.join(roots, [*K, "root"]).select(*K, "node", F.col("rank").alias("component"))


def count_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """component_counts() without the components' numbers: a component is a node that is its own root."""
    return smallest_reached(nodes, edges).groupBy(*K).agg(F.count_if(F.col("root") == F.col("node")).alias("n_components"))


def component_counts(components: DataFrame) -> DataFrame:
    return components.groupBy(*K).agg(F.max("component").alias("_c")).select(*K, (F.col("_c") + 1).cast("long").alias("n_components"))


def keep_connected(graphs: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    one = component_counts(connected_components(nodes, edges)).filter("n_components = 1")
    return graphs.join(one, K, "left_semi")


def drop_edgeless(graphs: DataFrame, edges: DataFrame) -> DataFrame:
    return graphs.join(edges.select(*K), K, "left_semi")


def invalid(c: str) -> Column:
    return F.coalesce(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(True))


def drop_invalid_coords(layouts: DataFrame) -> DataFrame:
    """Layouts of graphs without any NaN or infinite coordinate."""
    bad = layouts.filter(invalid("x") | invalid("y")).select(*K).distinct()
    return layouts.join(bad, K, "left_anti")


def drop_incomplete_layouts(nodes: DataFrame, layouts: DataFrame) -> DataFrame:
    """Layouts of graphs in which every node has a coordinate."""
    lacking = nodes.join(layouts, [*K, "node"], "left_anti").select(*K).distinct()
    return layouts.join(lacking, K, "left_anti")


def join_layouts(graphs: DataFrame, layouts: DataFrame) -> DataFrame:
    return graphs.join(layouts, K)


def missing_layouts(graphs: DataFrame, layouts: DataFrame) -> DataFrame:
    return graphs.join(layouts.select(*K), K, "left_anti")


def join_initial(nodes: DataFrame, initial: DataFrame) -> DataFrame:
    return nodes.join(initial.select(*K, "node", F.col("x").alias("x0"), F.col("y").alias("y0")), [*K, "node"], "left")


def missing_initial(nodes: DataFrame, initial: DataFrame) -> DataFrame:
    """Graphs with a node that has no valid initial position, and how many: those that a dataset with such a feature drops."""
    lacking = nodes.select(*K, "node").join(drop_invalid_coords(initial), [*K, "node"], "left_anti")
    return lacking.groupBy(*K).agg(F.count("*").alias("lacking"))


def feature_support(graphs: DataFrame, initial: DataFrame | None = None) -> DataFrame:
    """Per bundle, whether all its graphs have one size (one-hot features need that) and whether any has initial positions."""
    sizes = graphs.groupBy("bundle").agg((F.countDistinct("num_nodes") <= 1).alias("one_size"))
    if initial is None:
        return sizes.withColumn("has_initial", F.lit(False))
    have = initial.join(graphs.select(*K), K, "left_semi").select("bundle").distinct().withColumn("has_initial", F.lit(True))
    return sizes.join(have, "bundle", "left").withColumn("has_initial", F.coalesce("has_initial", F.lit(False)))


def validate_features(config: dict[str, bool], graphs: DataFrame, initial: DataFrame | None = None) -> None:
    """Raises ValueError if one-hot features meet graphs of several sizes, or initial positions are wanted and absent."""
    if config.get("use_onehot") and graphs.select("num_nodes").distinct().limit(2).count() > 1:
        raise ValueError("one-hot features need graphs of one size")
    if config.get("use_initial_position") and (initial is None or not initial.limit(1).count()):
        raise ValueError("initial positions are wanted but there are none")


def union_bundles(first: DataFrame, *more: DataFrame) -> DataFrame:
    for df in more:
        first = first.unionByName(df)
    return first
