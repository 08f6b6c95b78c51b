"""Layouts, node features, and packing one sample per graph."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..keys import K, uniform
from ..shared import kept_by_graph, stored
from . import pairs as P
from . import prep, structure, tree


def _sized(nodes: DataFrame) -> DataFrame:
    """nodes with n, their graph's number of nodes: grouped counts are joined, so a large graph is no single task."""
    return nodes.join(nodes.groupBy(*K).agg(F.count("*").alias("n")), K).hint("merge")  # joins of joins are taken for small too


def circular_layout(nodes: DataFrame, scale: float = 1.0) -> DataFrame:
    """Node idx at angle 2 pi idx / n; a single node at the origin."""
    a = 2 * F.lit(np.pi) * F.col("idx") / F.col("n")
    at = lambda f: F.when(F.col("n") > 1, f(a) * scale).otherwise(F.lit(0.0))
    return _sized(nodes).select(*K, "node", "idx", F.lit("circular").alias("layout_type"), at(F.cos).alias("x"), at(F.sin).alias("y"))


def grid_positions(nodes: DataFrame) -> DataFrame:
    """A near-square grid of ceil(sqrt n) columns in [-1, 1]."""
    g = F.ceil(F.sqrt("n"))
    rows = F.ceil(F.col("n") / g)
    u = (F.col("idx") % g) / F.greatest(g - 1, F.lit(1))
    v = F.floor(F.col("idx") / g) / F.greatest(rows - 1, F.lit(1))
    return _sized(nodes).select(*K, "node", "idx", (2 * u - 1).alias("x"), (2 * v - 1).alias("y"))


def _scaled(pos: np.ndarray, scale: float) -> np.ndarray:
    pos = pos - pos.mean(0)
    return pos * (scale / max(np.abs(pos).max(), 1e-300))


#: Pairs of a step of _push(): its arrays stay in a core's cache.
PUSHED = 1 << 15


def _push(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forces between all nodes of each graph (graphs x nodes), by steps of at most PUSHED pairs or one node's partners, in the same few
    arrays. A node's sum runs over its own graph in order, whatever else is in the step."""
    g, n = x.shape
    fx, fy = np.empty((g, n)), np.empty((g, n))
    graphs, rows = max(1, PUSHED // (n * n)), min(n, max(1, PUSHED // n))
    space = np.empty((4, min(g, graphs) * rows * n))
    starts = np.arange(0, space.shape[1], n)
    for lo in range(0, g, graphs):
        for at in range(0, n, rows):
            cut = (slice(lo, lo + graphs), slice(at, at + rows))
            shape = (*fx[cut].shape, n)
            size = shape[0] * shape[1] * n
            dx, dy, by, part = (s[:size].reshape(shape) for s in space)
            np.subtract(x[cut][:, :, None], x[lo : lo + graphs, None], out=dx)
            np.subtract(y[cut][:, :, None], y[lo : lo + graphs, None], out=dy)
            np.multiply(dx, dx, out=by)
            by += np.multiply(dy, dy, out=part)
            np.maximum(by, 0.01**2, out=by)
            by *= n
            np.divide(1, by, out=by)
            first = starts[: size // n]
            for f, d in ((fx, dx), (fy, dy)):
                d *= by
                f[cut] = np.add.reduceat(d.reshape(-1), first).reshape(shape[:2])
    return fx, fy


def spring_positions(graphs: list[tuple[np.ndarray, ...]], iterations: int, scale: float | None) -> list[np.ndarray]:
    """Force-directed positions of graphs (xy, src, dst, weight) of one size, from xy on; each as if it were alone."""
    g, n = len(graphs), len(graphs[0][0])
    if n == 1:
        return [np.zeros((1, 2)) for _ in graphs]
    x, y = (np.stack([xy[:, i] for xy, *_ in graphs]).astype(float) for i in (0, 1))
    of = np.repeat(np.arange(g), [len(e[1]) for e in graphs])
    src, dst, weight = (np.concatenate([e[j] for e in graphs]) for j in (1, 2, 3))
    a, b, stiff = of * n + src, of * n + dst, weight * np.sqrt(n)
    heat = 0.1 * np.maximum(np.ptp(x, axis=1), np.ptp(y, axis=1))
    cool, live, first = heat / (iterations + 1), np.ones(g, bool), np.arange(0, g * n, n)
    for _ in range(iterations):
        fx, fy = (f.ravel() for f in _push(x, y))
        ex, ey = x.ravel()[a] - x.ravel()[b], y.ravel()[a] - y.ravel()[b]
        pull = stiff * np.maximum(np.sqrt(ex * ex + ey * ey), 0.01)
        for f, e in ((fx, ex * pull), (fy, ey * pull)):
            f += np.bincount(b, e, g * n) - np.bincount(a, e, g * n)
        size = np.sqrt(fx * fx + fy * fy)
        by = np.repeat(heat * live, n) / np.where(size < 0.01, 0.1, size)
        mx, my = fx * by, fy * by
        x, y, heat = x + mx.reshape(g, n), y + my.reshape(g, n), heat - cool
        live = live & (np.sqrt(np.add.reduceat(mx * mx + my * my, first)) / n >= 1e-4)
        if not live.any():
            break
    out = [np.stack([x[i], y[i]], 1) for i in range(g)]
    return out if scale is None else [_scaled(pos, scale) for pos in out]


def _spring_rows(batches: Iterator[pa.RecordBatch], iterations: int, scale: float | None) -> Iterator[pa.RecordBatch]:
    """Rows of whole graphs to rows of nodes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        cut = {c: (batch.column(c).offsets.to_numpy(), batch.column(c).values.to_numpy(zero_copy_only=False)) for c in ("node", "x", "y", "src", "dst", "weight")}
        part = lambda c, i, cut=cut: cut[c][1][cut[c][0][i] : cut[c][0][i + 1]]
        graphs = []
        for i in range(batch.num_rows):
            names = part("node", i)  # in order
            graphs.append((np.stack([part("x", i), part("y", i)], 1), np.searchsorted(names, part("src", i)), np.searchsorted(names, part("dst", i)), part("weight", i)))
        sizes = np.array([len(x[0]) for x in graphs])
        done = {}
        for n in np.unique(sizes):
            same = np.flatnonzero(sizes == n)
            done |= dict(zip(same.tolist(), spring_positions([graphs[i] for i in same], iterations, scale), strict=True))
        xy, at = np.concatenate([done[i] for i in range(len(graphs))]), pa.array(np.repeat(np.arange(len(graphs)), sizes))
        names, idx = batch.column("node").flatten(), batch.column("idx").flatten()
        yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in K), names, idx, pa.array(["spring"] * len(xy)), pa.array(xy[:, 0]), pa.array(xy[:, 1])], [*K, "node", "idx", "layout_type", "x", "y"])


def spring_layout(nodes: DataFrame, edges: DataFrame, initial: DataFrame | None = None, iterations: int = 50, scale: float | None = None, tree_above: int = 20_000) -> DataFrame:
    """Force-directed layout, from the grid or `initial`. A graph of up to tree_above nodes is one row of arrays and laid out exactly;
    graphs of a task are laid out together. Larger ones go by joins, far nodes taken together by cells (see tree; over even clouds of 3,000 and
    30,000 nodes the forces were 0.05 and 0.02 % off by root mean square)."""
    start = grid_positions(nodes) if initial is None else nodes.select(*K, "node", "idx").join(initial.select(*K, "node", "x", "y"), [*K, "node"])
    large = nodes.groupBy(*K).agg(F.count("*").alias("_n")).filter(F.col("_n") > tree_above).select(*K)
    if large.limit(1).count():
        large = stored(large)
        small = spring_layout(nodes.join(large, K, "left_anti"), edges.join(large, K, "left_anti"), initial, iterations, scale, tree_above)
        return small.unionByName(tree.spring_layout_tree(start.join(large, K, "left_semi"), edges.join(large, K, "left_semi"), iterations, scale))
    kinds = dict(start.dtypes)
    points = start.groupBy(*K).agg(F.sort_array(F.collect_list(F.struct("node", "idx", "x", "y"))).alias("c"))
    pulls = edges.groupBy(*K).agg(F.sort_array(F.collect_list(F.struct("src", "dst", F.col("weight").cast("double").alias("weight")))).alias("e"))
    none = F.array().cast(dict(pulls.dtypes)["e"])
    rows = points.join(pulls, K, "left").withColumn("e", F.coalesce("e", none)).select(*K, *(F.col(f"c.{c}").alias(c) for c in ("node", "idx", "x", "y")), *(F.col(f"e.{c}").alias(c) for c in ("src", "dst", "weight")))
    schema = ", ".join(f"{c} {kinds[c]}" for c in [*K, "node", "idx"]) + ", layout_type string, x double, y double"
    return rows.mapInArrow(lambda it: _spring_rows(it, iterations, scale), schema)


def spring_step(coords: DataFrame, edges: DataFrame, heat: DataFrame) -> DataFrame:
    """One step of spring_layout() by joins: coords(idx, x, y) and heat(bundle, graph_id, heat) to moved coords."""
    def push(p: P.Pairs) -> dict:
        dx, dy, r = P.distance(p)
        r = np.maximum(r, 0.01)
        by = 1 / (p.left("n_all") * r * r)
        return {"fx": p.sum(dx * by), "fy": p.sum(dy * by)}

    sized = _sized(coords)
    away = P.over_pairs(sized.select(*K, "node", "x", "y", F.col("n").cast("double").alias("n_all")), ["x", "y", "n_all"], push, {"fx": "double", "fy": "double"}).select(*K, "node", "fx", "fy")
    other = sized.select(*K, F.col("node").alias("m"), F.col("x").alias("mx"), F.col("y").alias("my"))
    dx, dy = F.col("x") - F.col("mx"), F.col("y") - F.col("my")
    r = F.greatest(F.sqrt(dx * dx + dy * dy), F.lit(0.01))
    sym = prep.symmetrize(edges).withColumnRenamed("src", "node").withColumnRenamed("dst", "m")
    pull = -F.col("weight") * r * F.sqrt("n")
    near = sized.join(sym, [*K, "node"]).join(other, [*K, "m"]).select(*K, "node", (dx * pull).alias("fx"), (dy * pull).alias("fy"))
    force = away.unionByName(near).groupBy(*K, "node").agg(F.sum("fx").alias("fx"), F.sum("fy").alias("fy"))
    size = F.sqrt(F.col("fx") * F.col("fx") + F.col("fy") * F.col("fy"))
    by = F.col("heat") / F.when(size < 0.01, F.lit(0.1)).otherwise(size)
    return coords.join(force, [*K, "node"]).join(heat, K).select(*K, "node", "idx", (F.col("x") + F.col("fx") * by).alias("x"), (F.col("y") + F.col("fy") * by).alias("y"))


def layouts_from_config(nodes: DataFrame, edges: DataFrame, config: dict) -> tuple[DataFrame, DataFrame | None]:
    """(layouts, initial positions if they are to be kept) by config: type "circular" or "force_directed"."""
    kind = config.get("type")
    if kind == "circular":
        return circular_layout(nodes), None
    if kind == "force_directed":
        first = grid_positions(nodes) if config.get("save_initial_positions") else None
        return spring_layout(nodes, edges, iterations=config.get("iterations", 50), scale=config.get("scale")), first
    raise ValueError(f"unknown layout type {kind!r}: circular, force_directed")


def normalize_coords(df: DataFrame, method: str = "standard") -> DataFrame:
    """x, y per graph: "standard" (population deviation, one under 1e-6 counts as 1), "center", or as they are."""
    if method not in ("standard", "center"):
        return df
    sums = df.groupBy(*K).agg(*(f(c).alias(f"_{n}{c}") for c in "xy" for n, f in (("m", F.avg), ("s", F.stddev_pop))))

    def of(c: str) -> Column:
        moved, s = F.col(c) - F.col(f"_m{c}"), F.col(f"_s{c}")
        return moved if method == "center" else moved / F.when(s < 1e-6, F.lit(1.0)).otherwise(s)

    return df.join(sums, K).hint("merge").withColumns({"x": of("x"), "y": of("y")}).select(*df.columns)


@dataclass
class FeatureConfig:
    """Which features a node gets, in the order in which they are put together."""

    degree: bool = False
    positional: bool = False
    onehot: bool = False
    random: bool = False
    graph_size: bool = False
    density: bool = False
    density_norm: bool = False
    clustering: bool = False
    clustering_norm: bool = False
    initial_position: bool = False

    def chosen(self) -> list[str]:
        on = {f.name for f in fields(self) if getattr(self, f.name)}
        for base in ("density", "clustering"):
            if base not in on:
                on.discard(f"{base}_norm")
        return [f.name for f in fields(self) if f.name in on] or ["degree"]


def positional_feature(n: Column, idx: Column) -> Column:
    return F.when(n > 1, idx / (n - 1)).otherwise(F.lit(0.0))


def onehot_feature(n: Column, idx: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), (n - 1).cast("int")), lambda j: (j == idx).cast("double"))


def random_feature(seed: int, *parts: str) -> Column:
    """Two normal numbers by Box-Muller from seeded draws."""
    r = F.sqrt(-2 * F.log(1 - uniform(seed, F.lit("r"), *parts)))
    a = 2 * F.lit(np.pi) * uniform(seed, F.lit("a"), *parts)
    return F.array(r * F.cos(a), r * F.sin(a))


def graph_features(nodes: DataFrame, edges: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """num_nodes, density and clustering of each graph, the latter two also as z-scores over all graphs; known: structure.with_clustering(nodes)."""
    known = structure.local_clustering(nodes, edges) if known is None else known
    g = structure.density(structure.graph_sizes(nodes, edges)).join(known.groupBy(*K).agg(F.avg("clustering").alias("clustering")), K)
    return structure.zscore(kept_by_graph(g, "facts", getattr(edges, "_by_graph", None)), ["density", "clustering"])


def node_features(nodes: DataFrame, edges: DataFrame, config: FeatureConfig, graph: DataFrame | None = None, initial: DataFrame | None = None, seed: int = 42) -> DataFrame:
    """nodes with f ARRAY<DOUBLE> by config; graph: graph_features(); initial: standardised positions."""
    chosen, degree = config.chosen(), None
    rows = _sized(nodes.select(*K, "node", "idx"))
    if {"graph_size", "density", "clustering"} & set(chosen):
        if graph is None:  # degrees and triangles are counted once, for the nodes and their graphs
            known = kept_by_graph(structure.with_clustering(nodes.select(*K, "node"), edges), "known", getattr(edges, "_by_graph", None))
            degree, graph = known.select(*K, "node", "degree"), graph_features(nodes, edges, known)
        rows = rows.join(graph, K)  # before the joins by node, which then keep their order
    if "degree" in chosen:
        rows = rows.join(structure.degrees(nodes, edges) if degree is None else degree, [*K, "node"])
    if "initial_position" in chosen:
        rows = rows.join(initial.select(*K, "node", F.col("x").alias("x0"), F.col("y").alias("y0")), [*K, "node"])
    return rows.select(*K, "node", "idx", _vector(chosen, seed).alias("f"))


def _vector(chosen: list[str], seed: int) -> Column:
    """The chosen features in order, of rows that have n, idx and what else they need."""
    one = lambda c: F.array(F.col(c).cast("double"))
    parts = {"positional": lambda: F.array(positional_feature(F.col("n"), F.col("idx"))), "onehot": lambda: onehot_feature(F.col("n"), F.col("idx")), "random": lambda: random_feature(seed, *K, "node"), "graph_size": lambda: one("n"), "initial_position": lambda: F.array("x0", "y0")}
    return F.concat(*(parts[c]() if c in parts else one(c) for c in chosen))


def pack_samples(graphs: DataFrame, features: DataFrame, edges: DataFrame, layouts: DataFrame, communities: DataFrame | None = None) -> DataFrame:
    """One row per graph: arrays in the order of idx, edges forward and then reversed, y standardised and as given, and the communities
    of nodes(bundle, graph_id, node, community), if given."""
    cells = features.join(layouts.select(*K, "node", "layout_type", "x", "y"), [*K, "node"])
    cells = normalize_coords(cells.withColumns({"ox": F.col("x"), "oy": F.col("y")}))
    if communities is not None:
        cells = cells.join(communities.select(*K, "node", "community"), [*K, "node"], "left")
    return _packed(graphs.select(*K, "graph_type"), cells, edges, features)


def _packed(graphs: DataFrame, cells: DataFrame, edges: DataFrame, places: DataFrame) -> DataFrame:
    """Samples of cells (node, idx, f, layout_type, x, y, ox, oy, maybe community); places: the idx of each node. A graph has communities
    if its first node has one; nodes without one count as 0 then. An edge is collected and sorted as one number, both places in it; where edges
    lie by graph, each task holds the places of its nodes, so that edges are not sorted to meet them."""
    if "community" not in cells.columns:
        cells = cells.withColumn("community", F.lit(None).cast("int"))
    sorted_cells = F.sort_array(F.collect_list(F.struct("idx", "f", "x", "y", "ox", "oy", "community")))
    unknown = lambda c: F.coalesce(c, F.lit("unknown"))
    per = cells.groupBy(*K).agg(unknown(F.first("layout_type")).alias("layout_type"), sorted_cells.alias("c"))
    met = "shuffle_hash" if getattr(edges, "_by_graph", None) else "merge"
    at = lambda c: places.select(*K, F.col("node").alias(c), F.col("idx").cast("long").alias(f"{c}_i")).hint(met)
    both = F.shiftleft("src_i", 32).bitwiseOR(F.col("dst_i"))
    pairs = edges.select(*K, "src", "dst").join(at("src"), [*K, "src"]).join(at("dst"), [*K, "dst"]).groupBy(*K).agg(F.sort_array(F.collect_list(both)).alias("e"))
    high, low = lambda p: F.shiftright(p, 32), lambda p: p.bitwiseAND(F.lit((1 << 32) - 1))
    forward = F.transform("e", lambda p: F.struct(high(p).alias("src"), low(p).alias("dst")))
    turned = F.transform("e", lambda p: F.struct(low(p).alias("src"), high(p).alias("dst")))
    xy = lambda a, b: F.transform("c", lambda p: F.struct(p[a].alias("x"), p[b].alias("y")))
    community = F.when(F.col("c")[0]["community"].isNotNull(), F.transform("c", lambda p: F.coalesce(p["community"], F.lit(0)).cast("int"))).alias("community")
    out = graphs.join(per, K).join(pairs, K).select(*K, unknown(F.col("graph_type")).alias("graph_type"), "layout_type", F.transform("c", lambda p: p["f"]).alias("x"), F.concat(forward, turned).alias("edge_index"), xy("x", "y").alias("y"), xy("ox", "oy").alias("original_y"), community)
    return out.withColumn("num_communities", F.when(F.col("community").isNotNull(), F.size(F.array_distinct("community"))))


def unpack_samples(samples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes with idx and coordinates, canonical edges between idx) of packed samples."""
    nodes = samples.select(*K, F.posexplode(F.arrays_zip("x", "y")).alias("idx", "c")).select(*K, "idx", F.col("c.x").alias("f"), F.col("c.y.x").alias("x"), F.col("c.y.y").alias("y"))
    edges = samples.select(*K, F.explode("edge_index").alias("e")).select(*K, "e.src", "e.dst").filter("src < dst")
    return nodes, edges


def _standard(c: str) -> Column:
    """c less its graph's mean mean_c, by its deviation dev_c (one under 1e-6 counts as 1)."""
    s = F.col(f"dev_{c}")
    return (F.col(c) - F.col(f"mean_{c}")) / F.when(s < 1e-6, F.lit(1.0)).otherwise(s)


def known_of_nodes(nodes: DataFrame, edges: DataFrame, layouts: DataFrame) -> DataFrame:
    """nodes with their coordinates, if they have any, and degree (and community, if nodes have one)."""
    return _placed(nodes, layouts).join(structure.degrees_of(edges), [*K, "node"], "left").withColumn("degree", F.coalesce("degree", F.lit(0)))


def _placed(nodes: DataFrame, layouts: DataFrame) -> DataFrame:
    node = [*K, "node"]
    rows = nodes.select(*node, "idx", *(c for c in ["community"] if c in nodes.columns))
    return rows.join(layouts.select(*node, "layout_type", "x", "y"), node, "left")


def build_dataset(graphs: DataFrame, nodes: DataFrame, edges: DataFrame, layouts: DataFrame, config: FeatureConfig, initial: DataFrame | None = None, seed: int = 42) -> DataFrame:
    """Graphs joined to their layouts, features over all of them, invalid ones dropped, one packed sample per graph.

    What is known of a node (coordinates, degree, triangles) is joined once, by graph and node, and kept; one aggregate of
    that has a graph's sizes, statistics and flags, so a graph is dropped by the join that brings its features. A graph goes
    without a layout, with an invalid coordinate, with a node that lacks one (or an initial position, where that is a
    feature; prep.missing_initial() tells which), and without edges. Missing types are "unknown". Of edges that lie by graph
    (shared.kept_by_graph) all tables between lie so too.
    """
    prep.validate_features({"use_onehot": config.onehot, "use_initial_position": config.initial_position}, graphs, initial)
    chosen, node, buckets = config.chosen(), [*K, "node"], getattr(edges, "_by_graph", None)
    cells = structure.with_clustering(_placed(nodes, layouts), edges) if "clustering" in chosen else known_of_nodes(nodes, edges, layouts)
    coords = ["x", "y"]
    if config.initial_position:
        start = prep.drop_invalid_coords(initial).select(*node, F.col("x").alias("x0"), F.col("y").alias("y0"))
        cells, coords = cells.join(start, node, "left"), [*coords, "x0", "y0"]
    cells = kept_by_graph(cells, "cells", buckets)
    facts = [F.count("*").alias("n"), (F.sum("degree") / 2).alias("num_edges"), *(F.count(c).alias(f"have_{c}") for c in coords), *(f(c).alias(f"{k}_{c}") for c in coords for k, f in (("mean", F.avg), ("dev", F.stddev_pop)))]
    if "clustering" in chosen:
        facts.append(F.avg("clustering").alias("graph_clustering"))
    flags = layouts.groupBy(*K).agg(F.max(prep.invalid("x") | prep.invalid("y")).alias("bad"))
    graph = kept_by_graph(cells.groupBy(*K).agg(*facts).join(flags, K).join(graphs.select(*K, "graph_type"), K), "facts", buckets)
    pairs = F.col("n") * (F.col("n") - 1) / 2
    graph = graph.withColumn("density", F.when(F.col("n") > 1, F.col("num_edges") / pairs).otherwise(F.lit(0.0)))
    if "clustering" in chosen:
        graph = graph.withColumnRenamed("graph_clustering", "clustering")
    graph = structure.zscore(graph, [c for c in ("density", "clustering") if f"{c}_norm" in chosen])  # before any drop
    whole = [F.col(f"have_{c}") == F.col("n") for c in coords]
    kept = graph.filter(~F.col("bad") & reduce(and_, whole))
    rows = cells.drop("clustering").join(kept, K)
    if config.initial_position:
        rows = rows.withColumns({"x0": _standard("x0"), "y0": _standard("y0")})
    community = [c for c in ["community"] if c in rows.columns]
    rows = rows.select(*node, "idx", "layout_type", *community, _vector(chosen, seed).alias("f"), _standard("x").alias("x"), _standard("y").alias("y"), F.col("x").alias("ox"), F.col("y").alias("oy"))
    has, width = F.lit(config.initial_position), F.size(F.col("x")[0])
    packed = _packed(graphs.select(*K, "graph_type"), rows, edges, cells)
    return packed.withColumns({"has_initial_position": has, "initial_position_dims": F.when(has, F.struct((width - 2).alias("lo"), width.alias("hi")))})
