"""Work over all ordered pairs of nodes of a graph, in tiles.

A graph's nodes are dealt into blocks of about BLOCK; a tile is a pair of blocks, keyed by (graph, other block), so the n x n pairs
of one large graph are spread over as many tasks as it has blocks, and no row or task holds a whole large graph. Within a
task pairs are flat numpy arrays of at most STEP elements (or one node's partners in a tile). What a node gets from its tiles
is merged in the order of the blocks, so results don't depend on the partitioning. A graph of one block is one tile.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..keys import K
from ..shared import stored

#: Nodes a block, and pairs a numpy step.
BLOCK, STEP = 512, 1 << 18


class Pairs:
    """Some nodes (left), each with all nodes of the other block (right), flat."""

    def __init__(self, left: dict, right: dict, at_left: np.ndarray, at_right: np.ndarray, first: np.ndarray, diagonal: np.ndarray, ahead: np.ndarray):
        self._left, self._right, self.at_left, self.at_right, self.first = left, right, at_left, at_right, first
        self._diagonal, self._ahead = diagonal, ahead

    def left(self, name: str) -> np.ndarray:
        return self._left[name][self.at_left]

    def right(self, name: str) -> np.ndarray:
        return self._right[name][self.at_right]

    @property
    def same(self) -> np.ndarray:
        """Whether both are one node."""
        return self._diagonal & (self._ahead == 0)

    @property
    def before(self) -> np.ndarray:
        """Whether left comes before right in their block; true for all pairs of two blocks."""
        return ~self._diagonal | (self._ahead > 0)

    def sum(self, values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values, self.first, axis=0)

    def max(self, values: np.ndarray) -> np.ndarray:
        return np.maximum.reduceat(values, self.first, axis=0)

    def spread(self, per_left: np.ndarray) -> np.ndarray:
        return np.repeat(per_left, np.diff(np.append(self.first, len(self.at_left))), axis=0)


Kernel = Callable[[Pairs], dict[str, np.ndarray]]


def flat(column: pa.Array) -> np.ndarray:
    """The values of a list column: a row per item, of vectors a matrix."""
    items = column.flatten()
    if not pa.types.is_list(items.type):
        return items.to_numpy(zero_copy_only=False)
    return items.flatten().to_numpy(zero_copy_only=False).reshape(len(items), -1)


def _arrow_type(kind: str) -> pa.DataType:
    return pa.list_(pa.float64()) if kind.startswith("array") else {"double": pa.float64(), "long": pa.int64()}[kind]


def to_arrow(values: np.ndarray, kind: str) -> pa.Array:
    if kind.startswith("array"):
        n, w = values.shape
        return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * w), pa.array(np.ascontiguousarray(values, np.float64).ravel()))
    return pa.array(values, _arrow_type(kind))


def _tiles(keys: list[str], columns: list[str], kernel: Kernel, result: dict[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            left = {c: flat(batch.column(f"l_{c}")) for c in columns}
            right = {c: flat(batch.column(f"r_{c}")) for c in columns}
            n_left, n_right = (np.asarray(batch.column(f"{s}_node").value_lengths(), np.int64) for s in "lr")
            tile = np.repeat(np.arange(batch.num_rows), n_left)  # of each left node
            begin = np.cumsum(n_right) - n_right
            place = np.arange(len(tile)) - (np.cumsum(n_left) - n_left)[tile]
            count = n_right[tile]
            ends = np.cumsum(count)
            diagonal = (batch.column("i").to_numpy() == batch.column("j").to_numpy())[tile]
            nodes, lo = batch.column("l_node").flatten(), 0
            while lo < len(tile):
                hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + STEP, "right")))
                n = count[lo:hi]
                first = np.cumsum(n) - n
                at_left = np.repeat(np.arange(lo, hi), n)
                within = np.arange(len(at_left)) - np.repeat(first, n)
                found = kernel(Pairs(left, right, at_left, within + begin[tile[at_left]], first, diagonal[at_left], within - place[at_left]))
                rows = pa.array(tile[lo:hi])
                own = [batch.column(c).take(rows) for c in [*keys, "i", "j", "n"]]
                yield pa.RecordBatch.from_arrays([*own, nodes.slice(lo, hi - lo), *(to_arrow(found[c], kind) for c, kind in result.items())], names=[*keys, "i", "j", "n", "node", *result])
                lo = hi

    return run


def _blocks(rows: DataFrame, keys: list[str], columns: list[str], block: int) -> DataFrame:
    """(keys, b, nb, n, c): the nodes of each block in order; n is the graph's number of nodes."""
    sized = rows.join(rows.groupBy(*keys).agg(F.count("*").alias("n")), keys)
    nb = F.ceil(F.col("n") / block).cast("int")
    dealt = sized.select(*keys, "n", nb.alias("nb"), F.pmod(F.xxhash64("node"), nb).cast("int").alias("b"), F.struct("node", *columns).alias("_c"))
    return stored(dealt.groupBy(*keys, "n", "nb", "b").agg(F.array_sort(F.collect_list("_c")).alias("c")))


def _folded(p: str, name: str, kind: str) -> Column:
    """The sum of a column of the array of structs `p`, in its order."""
    values = F.transform(p, lambda x: x[name])
    add = (lambda a, x: F.zip_with(a, x, lambda u, v: u + v)) if kind.startswith("array") else (lambda a, x: a + x)
    return F.aggregate(F.slice(values, 2, F.size(values)), values[0], add)


def summed(parts: DataFrame, keys: list[str], result: dict[str, str]) -> DataFrame:
    """Partial sums per node, added in the order of the blocks."""
    rows = parts.groupBy(*keys, "n", "node").agg(F.array_sort(F.collect_list(F.struct("j", *result))).alias("p"))
    return rows.select(*keys, "n", "node", *(_folded("p", c, kind).alias(c) for c, kind in result.items()))


def softmax_merged(parts: DataFrame, keys: list[str], result: dict[str, str]) -> DataFrame:
    """Partial softmax sums (top, the greatest score; mass and v, summed with weights exp(score - top)) to those of all tiles."""
    rows = parts.groupBy(*keys, "n", "node").agg(F.array_sort(F.collect_list(F.struct("j", "top", "mass", "v"))).alias("q"))
    top = F.array_max(F.transform("q", lambda x: x["top"]))

    def scaled(x: Column) -> Column:
        by = F.exp(x["top"] - F.col("top"))
        return F.struct((x["mass"] * by).alias("mass"), F.transform(x["v"], lambda u: u * by).alias("v"))

    rows = rows.withColumn("top", top).withColumn("p", F.transform("q", scaled))
    return rows.select(*keys, "n", "node", "top", _folded("p", "mass", "double").alias("mass"), _folded("p", "v", "array").alias("v"))


def over_pairs(rows: DataFrame, columns: list[str], kernel: Kernel, result: dict[str, str], keys: list[str] = K, merge=summed, block: int = BLOCK, half: bool = False) -> DataFrame:
    """(keys, n, node, result...) of kernel over each node of `rows` (keys, node, columns: doubles or arrays of them) with all nodes
    of its group of `keys`, itself included. half: each unordered pair of blocks once, for kernels that take `before` pairs."""
    kinds = dict(rows.dtypes)
    blocks = _blocks(rows, keys, columns, block)
    cells = lambda side, c="c": [F.col(f"{c}.{x}").alias(f"{side}_{x}") for x in ["node", *columns]]
    schema = ", ".join(f"{c} {kinds[c]}" for c in keys) + f", i int, j int, n bigint, node {kinds['node']}, " + ", ".join(f"{c} {k}" for c, k in result.items())
    run = _tiles(keys, columns, kernel, result)
    one = blocks.filter("nb = 1").select(*keys, "n", F.col("b").alias("i"), F.col("b").alias("j"), *cells("l"), *cells("r")).mapInArrow(run, schema)
    if not blocks.filter("nb > 1").limit(1).count():
        return one.select(*keys, "n", "node", *result)
    many = blocks.filter("nb > 1")
    others = F.sequence(F.col("b") if half else F.lit(0), F.col("nb") - 1)
    left = many.select(*keys, "n", F.col("b").alias("i"), F.explode(others).alias("j"), *cells("l"))
    tiles = left.join(many.select(*keys, F.col("b").alias("j"), *cells("r")), [*keys, "j"]).select(*keys, "n", "i", "j", *(f"{s}_{c}" for s in "lr" for c in ["node", *columns]))
    return one.select(*keys, "n", "node", *result).unionByName(merge(tiles.mapInArrow(run, schema), keys, result))


def distance(p: Pairs, x: str = "x", y: str = "y") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(dx, dy, d) of left less right."""
    dx, dy = p.left(x) - p.right(x), p.left(y) - p.right(y)
    return dx, dy, np.sqrt(dx * dx + dy * dy)
