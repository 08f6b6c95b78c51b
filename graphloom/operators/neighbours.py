"""Nearest nodes within a graph, by cells of a grid and rings that grow until the k-th distance is certain.

A graph of n nodes gets about 2 n / BLOCK square cells. Every cell first meets the cells around it; a node is done once its k-th
distance is less than the way to the border of what it has met, and the others go on to rings of twice the radius, until
the square covers the grid. A cell's nodes are dealt into blocks, so no row holds more than about BLOCK of them, and of nodes on
one spot only the k smallest are candidates (ties go by node), so a spot that many nodes share stays cheap. Coordinates are finite.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..keys import K
from ..shared import kept_by_graph
from .pairs import BLOCK, flat

NODE = [*K, "node"]
CELL = [*K, "cx", "cy"]


def _in_cells(coords: DataFrame, block: int) -> DataFrame:
    """coords with their graph's cells a side g and their width, the cell (cx, cy), and the place (ux, uy) from the corner."""
    box = coords.groupBy(*K).agg(F.count("*").alias("n"), *(f(c).alias(f"{m}_{c}") for c in "xy" for m, f in (("low", F.min), ("high", F.max))))
    g = F.greatest(F.floor(F.sqrt(2 * F.col("n") / block)), F.lit(1)).cast("int")
    g = F.when(F.col("n") <= block, 1).otherwise(g)
    width = F.greatest(F.col("high_x") - F.col("low_x"), F.col("high_y") - F.col("low_y")) / F.col("g")
    box = box.withColumn("g", g).withColumn("width", F.when(width > 0, width).otherwise(F.lit(1.0))).select(*K, "g", "width", "low_x", "low_y")
    rows = coords.select(*NODE, "x", "y").join(box, K).withColumns({"ux": F.col("x") - F.col("low_x"), "uy": F.col("y") - F.col("low_y")})
    cell = lambda u: F.least(F.floor(F.col(u) / F.col("width")), F.col("g") - 1).cast("int")
    return rows.withColumns({"cx": cell("ux"), "cy": cell("uy")}).drop("low_x", "low_y")


def _blocks(rows: DataFrame, block: int, *more: str) -> DataFrame:
    """The nodes of each cell in blocks: (K, cx, cy, more..., node, x, y as arrays)."""
    nb = rows.groupBy(*CELL).agg(F.ceil(F.count("*") / block).cast("int").alias("nb"))
    dealt = rows.join(nb, CELL).withColumn("b", F.pmod(F.xxhash64("node"), F.col("nb")))
    got = dealt.groupBy(*CELL, *more, "b").agg(F.array_sort(F.collect_list(F.struct("node", "x", "y"))).alias("c"))
    return got.select(*CELL, *more, *(F.col(f"c.{c}").alias(c) for c in ("node", "x", "y")))


def _nearest(k: int):
    """Of each left node of a pair of blocks its k nearest other nodes on the right; ties by node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            left, right = ({c: flat(batch.column(f"{s}_{c}")) for c in ("node", "x", "y")} for s in "lr")
            ends = [np.append(0, np.cumsum(np.asarray(batch.column(f"{s}_node").value_lengths(), np.int64))) for s in "lr"]
            for t in range(batch.num_rows):
                (a, b), (c, d) = ((int(e[t]), int(e[t + 1])) for e in ends)
                dx, dy = left["x"][a:b, None] - right["x"][None, c:d], left["y"][a:b, None] - right["y"][None, c:d]
                far = np.sqrt(dx * dx + dy * dy)
                far[left["node"][a:b, None] == right["node"][None, c:d]] = np.inf
                most = np.partition(far, min(k, d - c) - 1, axis=1)[:, min(k, d - c) - 1]
                at = np.nonzero((far <= most[:, None]) & (far < np.inf))
                found.append((at[0] + a, at[1] + c, far[at], np.full(len(at[0]), t)))
            if not found:
                continue
            row, other, far, tile = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.lexsort((right["node"][other], far, row))
            begin = np.searchsorted(row[order], row[order], "left")
            order = order[np.arange(len(order)) - begin < k]
            keys = pa.array(tile[order])
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(keys) for c in K), pa.array(left["node"][row[order]]), pa.array(far[order]), pa.array(right["node"][other[order]])], names=[*NODE, "d", "other"])

    return run


def _met(rows: DataFrame, others: DataFrame, inner: int, outer: int, k: int, block: int) -> DataFrame:
    """(node, near): the k nearest of each node of `rows` among `others` in cells of a distance in (inner, outer]."""
    left = _blocks(rows, block, "g").select(*K, "cx", "cy", "g", *(F.col(c).alias(f"l_{c}") for c in ("node", "x", "y")))
    for c in ("cx", "cy"):
        reach = F.sequence(F.greatest(F.col(c) - outer, F.lit(0)), F.least(F.col(c) + outer, F.col("g") - 1))
        left = left.withColumn(f"t{c}", F.explode(reach))
    away = F.greatest(F.abs(F.col("tcx") - F.col("cx")), F.abs(F.col("tcy") - F.col("cy")))
    left = left.filter(away > inner).drop("cx", "cy").withColumnsRenamed({"tcx": "cx", "tcy": "cy"})
    kind = dict(rows.dtypes)
    schema = ", ".join(f"{c} {kind[c]}" for c in NODE) + f", d double, other {kind['node']}"
    tiles = left.join(others, CELL).select(*K, *(f"{s}_{c}" for s in "lr" for c in ("node", "x", "y")))
    near = tiles.mapInArrow(_nearest(k), schema)
    return near.groupBy(*NODE).agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "other"))), 1, k).alias("near"))


def knn_within_graph(coords: DataFrame, k: int, block: int = BLOCK, buckets: int | None = None) -> DataFrame:
    """(node, other, d, rank): the k nearest nodes of each node in its graph, itself the first; ties by node. buckets: of coords that lie by
    graph (shared.kept_by_graph), as then do the tables between."""
    kept = lambda df: kept_by_graph(df, "near", buckets)
    own = F.struct(F.lit(0.0).alias("d"), F.col("node").alias("other"))
    if k < 2:
        return coords.select(*NODE, F.col("node").alias("other"), F.lit(0.0).alias("d"), F.lit(1).alias("rank")).filter(F.lit(k > 0))
    rows = kept(_in_cells(coords, block))
    spot = Window.partitionBy(*K, "x", "y").orderBy("node")
    few = rows.withColumn("_r", F.row_number().over(spot)).filter(F.col("_r") <= k)
    others = kept(_blocks(few, block).select(*CELL, *(F.col(c).alias(f"r_{c}") for c in ("node", "x", "y"))))
    done, inner, outer = None, -1, 1
    kind = f"array<struct<d:double,other:{dict(coords.dtypes)['node']}>>"
    rows = rows.withColumn("near", F.array().cast(kind))
    while True:
        got = _met(rows, others, inner, outer, k - 1, block).withColumnRenamed("near", "more")
        near = F.slice(F.array_sort(F.concat("near", F.coalesce("more", F.array().cast(kind)))), 1, k - 1)
        step = rows.join(got, NODE, "left").withColumn("near", near).drop("more")
        # the way to the nearest border of the square behind which there are more cells
        low = lambda c, u: F.when(F.col(c) - outer > 0, F.col(u) - (F.col(c) - outer) * F.col("width"))
        high = lambda c, u: F.when(F.col(c) + outer < F.col("g") - 1, (F.col(c) + outer + 1) * F.col("width") - F.col(u))
        border = F.least(low("cx", "ux"), high("cx", "ux"), low("cy", "uy"), high("cy", "uy"))
        certain = border.isNull() | ((F.size("near") == k - 1) & (F.col("near")[k - 2]["d"] < border * (1 - 1e-9)))
        step = kept(step.withColumn("certain", F.coalesce(certain, F.lit(False))))
        settled = step.filter("certain").select(*NODE, "near")
        done = settled if done is None else done.unionByName(settled)
        rows = step.filter("NOT certain").drop("certain")
        if not rows.limit(1).count():
            break
        inner, outer = outer, 2 * outer
    out = done.select(*NODE, F.posexplode(F.concat(F.array(own), "near")).alias("rank", "p"))
    return out.select(*NODE, "p.other", "p.d", (F.col("rank") + 1).alias("rank"))
