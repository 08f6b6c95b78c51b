"""Message passing and force operators on node tables.

feat is (bundle, graph_id, node, f ARRAY<DOUBLE>) with one width; coords is (bundle, graph_id, node, x, y). Vectors are
summed per dimension inside one aggregate, so a message is one row and hubs are combined before the shuffle.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..keys import K
from ..shared import kept_by_graph
from . import pairs as P
from . import prep, structure
from .neighbours import knn_within_graph
from .routes import Routes

NODE = [*K, "node"]


def _vector(width: int, of) -> Column:
    return F.array(*(of(i) for i in range(width)))


def _messages(feat: DataFrame, edges: DataFrame) -> DataFrame:
    """One row (node = receiver, m = sender's vector, weight) per direction of an edge."""
    sym = prep.symmetrize(edges).withColumnRenamed("dst", "node")
    return sym.join(feat.select(*K, F.col("node").alias("src"), F.col("f").alias("m")), [*K, "src"])


def _width(feat: DataFrame, width: int | None) -> int:
    if width is not None:
        return width
    first = feat.select(F.size("f").alias("w")).limit(1).collect()
    return first[0]["w"] if first else 0


def neighbor_mean(feat: DataFrame, edges: DataFrame, width: int | None = None) -> DataFrame:
    w = _width(feat, width)
    got = _messages(feat, edges).groupBy(*NODE).agg(_vector(w, lambda i: F.avg(F.col("m")[i])).alias("mean"))
    return feat.join(got, NODE, "left").select(*NODE, F.coalesce("mean", _vector(w, lambda i: F.lit(0.0))).alias("f"))


def neighbor_sum(feat: DataFrame, edges: DataFrame, eps: float = 0.0, width: int | None = None) -> DataFrame:
    w = _width(feat, width)
    got = _messages(feat, edges).groupBy(*NODE).agg(_vector(w, lambda i: F.sum(F.col("m")[i])).alias("s"))
    own = lambda i: F.col("f")[i] * (1 + eps) + F.coalesce(F.col("s")[i], F.lit(0.0))
    return feat.join(got, NODE, "left").select(*NODE, _vector(w, own).alias("f"))


def _by(c: Column | float, plus: int) -> Column:
    """c over the root of the degree plus `plus` (1 at least)."""
    return c / F.sqrt(F.greatest(F.col("degree") + plus, F.lit(1)))


def _gcn(routes: Routes, state: DataFrame, width: int, residual: bool = False) -> DataFrame:
    def update(s: Column) -> dict:
        own = lambda i: F.col("f")[i] / (F.col("degree") + 1) + (F.col("f")[i] if residual else F.lit(0.0))
        return {"f": _vector(width, lambda i: _by(s[i], 1) + own(i))}

    return routes.round(state, {"f": width}, _vector(width, lambda i: _by(F.col("f")[i], 1)), width, update)


def gcn_propagate(feat: DataFrame, edges: DataFrame, width: int | None = None) -> DataFrame:
    """D^-1/2 (A + I) D^-1/2 f with D the degree plus one."""
    return propagate_hops(feat, edges, 1, width=width)


def propagate_hops(feat: DataFrame, edges: DataFrame, hops: int, residual: bool = False, width: int | None = None) -> DataFrame:
    """gcn_propagate() `hops` times; residual adds what a hop started from. One plan: a hop exchanges messages only."""
    w = _width(feat, width)
    routes = Routes(feat, edges, hops)
    state = routes.start(feat.select(*NODE, "f"))
    for _ in range(hops):
        state = _gcn(routes, state, w, residual)
    return state.select(*NODE, "f")


def chebyshev_basis(feat: DataFrame, edges: DataFrame, k: int = 3, width: int | None = None) -> DataFrame:
    """(t0, ..., t{k-1}): Chebyshev terms of the Laplacian scaled to -D^-1/2 A D^-1/2."""
    w = _width(feat, width)
    routes = Routes(feat, edges, k - 1)
    state = routes.start(feat.select(*NODE, F.col("f").alias("t0")))
    for j in range(1, k):
        terms = [f"t{i}" for i in range(j)]

        def update(s: Column, j=j, terms=terms) -> dict:
            before = (lambda i: F.col(f"t{j - 2}")[i]) if j > 1 else (lambda i: F.lit(0.0))
            term = _vector(w, lambda i: (2 if j > 1 else 1) * -_by(s[i], 0) - before(i))
            return {t: F.col(t) for t in terms} | {f"t{j}": term}

        state = routes.round(state, {t: w for t in terms}, _vector(w, lambda i, j=j: _by(F.col(f"t{j - 1}")[i], 0)), w, update)
    return state.select(*NODE, *(f"t{j}" for j in range(k)))


def edge_softmax_aggregate(feat: DataFrame, edges: DataFrame, score, width: int | None = None) -> DataFrame:
    """Attention over incoming edges and the node itself: score(sender f, receiver f) through LeakyReLU(0.2)."""
    w = _width(feat, width)
    rows = _messages(feat, edges).select(*NODE, "m").unionByName(feat.select(*NODE, F.col("f").alias("m")))
    rows = rows.join(feat, NODE).withColumn("e", score(F.col("m"), F.col("f")))
    rows = rows.withColumn("e", F.when(F.col("e") > 0, F.col("e")).otherwise(0.2 * F.col("e")))
    rows = rows.join(rows.groupBy(*NODE).agg(F.max("e").alias("top")), NODE).withColumn("a", F.exp(F.col("e") - F.col("top")))
    return rows.groupBy(*NODE).agg(_vector(w, lambda i: F.sum(F.col("a") * F.col("m")[i]) / F.sum("a")).alias("f"))


def _layer_norm(f: Column, w: int, eps: float = 1e-5) -> Column:
    mean = F.aggregate(f, F.lit(0.0), lambda a, x: a + x) / w
    of = lambda s: F.transform(f, lambda x: (x - s["m"]) / F.sqrt(s["v"] + eps))
    var = F.aggregate(f, F.lit(0.0), lambda a, x: a + x * x) / w - mean * mean
    return F.transform(F.array(F.struct(mean.alias("m"), F.greatest(var, F.lit(0.0)).alias("v"))), of)[0]


def force_repulsion(feat: DataFrame, edges: DataFrame, weight: float, width: int | None = None) -> DataFrame:
    """LayerNorm, x + (x - neighbour mean) weight, LayerNorm."""
    w = _width(feat, width)
    normed = feat.select(*NODE, _layer_norm(F.col("f"), w).alias("f"))
    mean = neighbor_mean(normed, edges, w).withColumnRenamed("f", "mean")
    moved = normed.join(mean, NODE).select(*NODE, _vector(w, lambda i: F.col("f")[i] + (F.col("f")[i] - F.col("mean")[i]) * weight).alias("f"))
    return moved.select(*NODE, _layer_norm(F.col("f"), w).alias("f"))


def anti_smooth(feat: DataFrame, edges: DataFrame, alpha: float = 0.5, width: int | None = None) -> DataFrame:
    w = _width(feat, width)
    mean = neighbor_mean(feat, edges, w).withColumnRenamed("f", "mean")
    return feat.join(mean, NODE).select(*NODE, _vector(w, lambda i: F.col("f")[i] - F.exp(F.lit(alpha)) * F.col("mean")[i]).alias("f"))


def _distance() -> Column:
    dx, dy = F.col("x") - F.col("o_x"), F.col("y") - F.col("o_y")
    return F.sqrt(dx * dx + dy * dy)


def _dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _softmax_sum(rows: DataFrame, width: int) -> DataFrame:
    """Sum of o_v weighted by the softmax of `e` per node."""
    rows = rows.join(rows.groupBy(*NODE).agg(F.max("e").alias("top")), NODE).withColumn("a", F.exp(F.col("e") - F.col("top")))
    return rows.groupBy(*NODE).agg(_vector(width, lambda i: F.sum(F.col("a") * F.col("o_v")[i]) / F.sum("a")).alias("f"))


def knn_attention(qkv: DataFrame, coords: DataFrame | None, k: int, width: int, soft: float = 1e-6, near: DataFrame | None = None, buckets: int | None = None) -> DataFrame:
    """Attention over the k nearest (or those of near(bundle, graph_id, node, other, d)): softmax of q.k / sqrt(width) + 1 / (d + soft);
    qkv(bundle, graph_id, node, q, k, v). buckets: of coords that lie by graph (shared.kept_by_graph)."""
    near = knn_within_graph(coords, k, buckets=buckets) if near is None else near
    sent = qkv.select(*K, F.col("node").alias("other"), F.col("k").alias("o_k"), F.col("v").alias("o_v"))
    rows = near.join(sent, [*K, "other"]).join(qkv.select(*NODE, "q"), NODE)
    return _softmax_sum(rows.withColumn("e", _dot("q", "o_k") / width**0.5 + 1 / (F.col("d") + soft)), width)


def dense_attention(qkv: DataFrame, width: int) -> DataFrame:
    """Attention over all nodes of the graph: softmax of q.k / sqrt(width)."""

    def attend(p: P.Pairs) -> dict:
        e = (p.left("q") * p.right("k")).sum(1) / width**0.5
        top = p.max(e)
        a = np.exp(e - p.spread(top))
        return {"top": top, "mass": p.sum(a), "v": p.sum(a[:, None] * p.right("v"))}

    rows = P.over_pairs(qkv.select(*NODE, "q", "k", "v"), ["q", "k", "v"], attend, {"top": "double", "mass": "double", "v": "array<double>"}, merge=P.softmax_merged)
    return rows.select(*NODE, F.transform("v", lambda u: u / F.col("mass")).alias("f"))


def distance_repulsion(feat: DataFrame, coords: DataFrame, strength: float = 0.1, width: int | None = None) -> DataFrame:
    """f - strength times the sum over all other nodes of exp(-distance) times their f."""

    def repel(p: P.Pairs) -> dict:
        a = np.where(p.same, 0.0, np.exp(-P.distance(p)[2]))
        return {"s": p.sum(a[:, None] * p.right("f"))}

    rows = feat.select(*NODE, "f").join(coords.select(*NODE, "x", "y"), NODE)
    got = P.over_pairs(rows, ["x", "y", "f"], repel, {"s": "array<double>"})
    pushed = F.when(F.col("s").isNull(), F.col("f")).otherwise(F.zip_with("f", "s", lambda f, s: f - strength * s))
    return feat.join(got, NODE, "left").select(*NODE, pushed.alias("f"))


# ---- force-directed steps on coordinates ----


def ideal_length(components: DataFrame, mode: str = "sqrt_inv_n", constant: float = 0.1) -> DataFrame:
    """k of each component: 1 / sqrt(n), or the constant."""
    if mode not in ("sqrt_inv_n", "constant"):
        raise ValueError("mode is sqrt_inv_n or constant")
    k = 1 / F.sqrt(F.count("*")) if mode == "sqrt_inv_n" else F.lit(constant) + 0 * F.count("*")
    return components.groupBy(*K, "component").agg(k.alias("k"))


def _pull(rows: DataFrame, eps: float) -> DataFrame:
    """Forces of rows (node, x, y, k, o_x, o_y, weight) along edges."""
    by = -2 * (_distance() + eps) / F.col("k") * F.col("weight")
    return rows.groupBy(*NODE).agg(F.sum((F.col("x") - F.col("o_x")) * by).alias("fx"), F.sum((F.col("y") - F.col("o_y")) * by).alias("fy"))


def fr_attraction(coords: DataFrame, edges: DataFrame, k: DataFrame, eps: float = 1e-2) -> DataFrame:
    """Pull along edges; each undirected edge acts twice, once for either direction. k(bundle, graph_id, node, k)."""
    state = coords.select(*NODE, "x", "y").join(k.select(*NODE, "k"), NODE)
    return _pull(Routes(state, edges, 1).met(state, ["x", "y", "k"]), eps)


def fr_repulsion(coords: DataFrame, components: DataFrame, k: DataFrame, eps: float = 1e-2) -> DataFrame:
    """Push between all ordered pairs of a component."""

    def push(p: P.Pairs) -> dict:
        dx, dy, d = P.distance(p)
        d, by = d + eps, p.left("k") * p.left("k")
        by = by / (d * d)
        return {"fx": p.sum(dx * by), "fy": p.sum(dy * by)}

    rows = coords.select(*NODE, "x", "y").join(components, NODE).join(k.select(*NODE, "k"), NODE)
    got = P.over_pairs(rows, ["x", "y", "k"], push, {"fx": "double", "fy": "double"}, keys=[*K, "component"])
    return got.filter("n > 1").select(*NODE, "fx", "fy")


def clamped_step(coords: DataFrame, forces: DataFrame, alpha: float = 1.0, clamp: float = 0.05) -> DataFrame:
    f = forces.groupBy(*NODE).agg(F.sum("fx").alias("fx"), F.sum("fy").alias("fy"))
    fx, fy = alpha * F.coalesce("fx", F.lit(0.0)), alpha * F.coalesce("fy", F.lit(0.0))
    by = F.least(F.lit(1.0), clamp / (F.sqrt(fx * fx + fy * fy) + 1e-9))
    return coords.join(f, NODE, "left").select(*NODE, (F.col("x") + fx * by).alias("x"), (F.col("y") + fy * by).alias("y"))


def fr_unrolled(coords: DataFrame, edges: DataFrame, steps: int = 3, clamp: float = 0.05) -> DataFrame:
    """`steps` clamped force steps within connected components."""
    kept = lambda df: kept_by_graph(df, "force", getattr(edges, "_by_graph", None))
    parts = kept(prep.connected_components(coords.select(*NODE), edges))
    k = kept(parts.join(ideal_length(parts), [*K, "component"]).select(*NODE, "k"))
    routes = Routes(coords, edges, steps)
    for _ in range(steps):
        state = coords.select(*NODE, "x", "y").join(k, NODE).join(routes.known, NODE)
        forces = _pull(routes.met(state, ["x", "y", "k"]), 1e-2).unionByName(fr_repulsion(coords, parts, k))
        coords = kept(clamped_step(coords, forces, clamp=clamp))
    return coords


def edge_pair_features(feat: DataFrame, edges: DataFrame, include_degree: bool = True) -> DataFrame:
    """One row per undirected edge: both vectors and, include_degree, both degrees."""
    rows = feat
    if include_degree:
        rows = feat.join(structure.degrees(feat, edges), NODE).select(*NODE, "f", F.col("degree").cast("double").alias("d"))
    side = lambda c: rows.select(*K, F.col("node").alias(c), F.col("f").alias(f"f_{c}"), *([F.col("d").alias(f"d_{c}")] if include_degree else []))
    both = edges.select(*K, "src", "dst").join(side("src"), [*K, "src"]).join(side("dst"), [*K, "dst"])
    parts = ["f_src", "f_dst"] + ([F.array("d_src", "d_dst")] if include_degree else [])
    return both.select(*K, "src", "dst", F.concat(*parts).alias("e"))


def edge_stiffness(edge_feat: DataFrame, layers: list[tuple[list[list[float]], list[float]]]) -> DataFrame:
    """softplus(MLP(e)) + 1e-6 for given layers (rows of weights, biases), ReLU between them; the last has one row."""
    value: Column = F.col("e")
    for n, (rows, biases) in enumerate(layers):
        by_input = [list(r) for r in zip(*rows)]
        # the layer before is computed once and used by every unit
        value = F.transform(F.array(value), _layer((by_input, biases), n < len(layers) - 1))[0]
    return edge_feat.withColumn("_s", value[0]).select(*edge_feat.columns, (F.log1p(F.exp(-F.abs("_s"))) + F.greatest(F.col("_s"), F.lit(0.0)) + 1e-6).alias("stiffness"))


Dense = tuple[list[list[float]], list[float]]


def dense(f: Column, layer: Dense, relu: bool = False) -> Column:
    """f times the layer's weights (a row per input) plus its biases; a layer is a short literal."""
    rows, biases = layer
    units = [sum((f[i] * float(row[j]) for i, row in enumerate(rows)), F.lit(float(b))) for j, b in enumerate(biases)]
    return F.array(*(F.greatest(u, F.lit(0.0)) if relu else u for u in units))


def _layer(layer: Dense, relu: bool):
    return lambda v: dense(v, layer, relu)


def iterative_refine(feat: DataFrame, coords: DataFrame, edges: DataFrame, step_sizes: list[float], layers: list[list[Dense]], width: int | None = None) -> DataFrame:
    """coords moved in steps: features and coordinates are propagated together, go through the step's dense layers (ReLU
    between them, the last gives two numbers), and a step size of that is added."""
    w = _width(feat, width)
    routes = Routes(feat, edges, len(step_sizes))
    state = routes.start(feat.select(*NODE, "f").join(coords.select(*NODE, "x", "y"), NODE))
    both = F.concat("f", F.array("x", "y"))
    for size, own in zip(step_sizes, layers, strict=True):

        def update(s: Column, size=size, own=own) -> dict:
            value = _vector(w + 2, lambda i: _by(s[i], 1) + both[i] / (F.col("degree") + 1))
            for i, layer in enumerate(own):
                # what a layer takes is computed once and used by every unit
                value = F.transform(F.array(value), _layer(layer, i < len(own) - 1))[0]
            return {"f": F.col("f"), "_m": value, "x": F.col("x"), "y": F.col("y"), "_size": F.lit(size)}

        state = routes.round(state, {"f": w, "x": None, "y": None}, _vector(w + 2, lambda i: _by(both[i], 1)), w + 2, update)
        state = state.withColumns({c: F.col(c) + F.col("_size") * F.col("_m")[i] for i, c in enumerate("xy")}).drop("_m", "_size")
    return state.select(*NODE, "x", "y")


def blend(first: DataFrame, second: DataFrame, share: float) -> DataFrame:
    """share of the first coordinates and the rest of the second."""
    other = second.select(*NODE, F.col("x").alias("x2"), F.col("y").alias("y2"))
    return first.join(other, NODE).select(*NODE, *((share * F.col(c) + (1 - share) * F.col(f"{c}2")).alias(c) for c in "xy"))
