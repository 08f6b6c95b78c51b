"""Exact top-k search by inner product over a sharded index of posting lists, by MaxScore.

Terms are the components of the vectors (floored at 256 steps to one). A shard holds one posting list a term: what each of its
vectors has there, with the list's least and greatest value. For a query the greatest product with either bounds what the term can
add in that shard. Terms are split by these bounds: those of the smallest bounds, whose sum stays below the query's k-th best score so
far, are non-essential, since no vector gets in by them alone. The essential postings are traversed for a block of queries together;
the others are probed in order of their bounds for the vectors that can still reach the k-th best score. Shards and blocks of queries
meet in tiles; a tile takes one shard after the other, and what tiles found is merged by query.

Equal vectors are one entry with the k + 1 smallest ids, and equal query vectors one query, so a vector that a third of all rows
share costs no more than another; a query's own row is taken out of k + 1 results at the end.

Defined results: a vector that is null, or holds a null or non-finite component, takes no part. Shorter vectors count as zero in the
components they lack; an empty one scores 0 with all. A row without vec_id is no query, and ranks after all ids of its score. Rows of one
vec_id are candidates each, and queries each. Results are exact while sums of products stay below 2**62. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from . import common as C

#: Vectors a shard, queries a block, and blocks whose queries a tile holds at once.
SHARD, BLOCK, HELD = 8192, 512, 8
#: Vectors that give a query its first threshold.
WARM = 256
#: The threshold of a query that has met fewer than k rows.
NONE = np.iinfo(np.int64).min // 2
SHARD_SCHEMA = "n int, dims int, ids array<array<bigint>>, low array<bigint>, high array<bigint>, postings binary"
BLOCK_SCHEMA = "n int, dims int, keys array<binary>, queries binary"
FOUND = "vkey binary, vec_id bigint, score bigint"


def quantised(vector: Column, steps: int = 256) -> Column:
    """floor(steps * x) of every component; null if the vector takes no part."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(vector.isNotNull() & F.coalesce(finite, F.lit(False)), F.transform(vector, lambda x: F.floor(x.cast("double") * steps)))


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column as rows of int64, short ones filled with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    length = np.asarray(column.value_lengths(), np.int64)
    flat, dims = np.asarray(column.flatten(), np.int64), int(length.max(initial=0))
    out = np.zeros((len(length), dims), np.int64)
    out[np.arange(dims) < length[:, None]] = flat
    return out


def _pieces(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """The rows of a task in tables of `size`."""
    held, n = [], 0
    for batch in batches:
        held, n = [*held, batch], n + len(batch)
        while n >= size:
            table = pa.Table.from_batches(held)
            yield table.slice(0, size)
            held, n = table.slice(size).to_batches(), n - size
    if n:
        yield pa.Table.from_batches(held)


def _index(size: int):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _pieces(batches, size):
            v = _matrix(table["v"])
            low, high = v.min(0), v.max(0)
            small = np.min_scalar_type(min(low.min(initial=-1), -1 - high.max(initial=0)))  # the least signed type for both
            row = {"n": [len(v)], "dims": [v.shape[1]], "ids": [table["ids"].to_pylist()], "low": [low.tolist()], "high": [high.tolist()], "postings": [np.ascontiguousarray(v.T.astype(small)).tobytes()]}
            kinds = [pa.int32(), pa.int32(), pa.list_(pa.list_(pa.int64())), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(row.values(), kinds, strict=True)], names=list(row))

    return build


def _blocks(size: int):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _pieces(batches, size):
            v = _matrix(table["v"])
            columns = [pa.array([len(v)], pa.int32()), pa.array([v.shape[1]], pa.int32()), pa.array([table["vkey"].to_pylist()], pa.list_(pa.binary())), pa.array([v.tobytes()], pa.binary())]
            yield pa.record_batch(columns, names=["n", "dims", "keys", "queries"])

    return build


def _width(a: np.ndarray, dims: int) -> np.ndarray:
    """The first `dims` columns, filled with zeros."""
    return a[:, :dims] if a.shape[1] >= dims else np.pad(a, ((0, 0), (0, dims - a.shape[1])))


def _exact_type(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> type:
    """The fastest type whose sums of products are exact here."""
    most = float((np.abs(queries).max(0, initial=0).astype(float) * np.maximum(np.abs(low.astype(float)), np.abs(high.astype(float)))).sum())
    return np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64


def competitive(queries: np.ndarray, postings: np.ndarray, low: np.ndarray, high: np.ndarray, threshold: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector, score) of all vectors of a shard that reach a query's threshold, exactly; postings is terms x vectors."""
    kind = _exact_type(queries, low, high)
    q, p = queries.astype(kind), postings.astype(kind)
    bound = np.maximum(queries * low, queries * high)
    order = np.argsort(bound, axis=1, kind="stable")  # ascending
    sums = np.cumsum(np.take_along_axis(bound, order, 1), axis=1)
    # the longest prefix whose sum stays below the threshold; sums first fall (a term may only take away), then rise
    below = sums < threshold[:, None]
    n_rest = np.where(below.any(1), below.shape[1] - np.argmax(below[:, ::-1], axis=1), 0)
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(order.shape[1])[None, :], 1)
    essential = rank >= n_rest[:, None]
    terms = np.flatnonzero(essential.any(0))
    partial = (q * essential)[:, terms] @ p[terms] if len(terms) else np.zeros((len(q), p.shape[1]), kind)
    rest = np.where(n_rest > 0, np.take_along_axis(sums, np.maximum(n_rest - 1, 0)[:, None], 1)[:, 0], 0)
    at_query, at_vector = np.nonzero(partial >= (threshold - rest)[:, None])
    score = partial[at_query, at_vector].astype(np.int64)
    # probing: the term of the greatest bound first
    left = n_rest[at_query]
    done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(score):
        over = left == 0
        if over.any():
            done.append((at_query[over], at_vector[over], score[over]))
            at_query, at_vector, score, left = (a[~over] for a in (at_query, at_vector, score, left))
            continue
        left = left - 1
        term = order[at_query, left]
        score = score + queries[at_query, term] * postings[term, at_vector].astype(np.int64)
        more = np.where(left > 0, sums[at_query, np.maximum(left - 1, 0)], 0)
        keep = score + more >= threshold[at_query]
        at_query, at_vector, score, left = (a[keep] for a in (at_query, at_vector, score, left))
    if not done:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(c) for c in zip(*done, strict=True))


class _Held:
    """A block of queries with the best rows that each has met: (score, id), id None last."""

    def __init__(self, keys: list[bytes], queries: np.ndarray, k: int):
        self.keys, self.queries, self.k = keys, queries, k
        self.threshold = np.full(len(keys), NONE)
        self.best: tuple[np.ndarray, ...] = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))  # query, score, id, no id

    def meet(self, postings: np.ndarray, low: np.ndarray, high: np.ndarray, ids: pa.ListArray) -> None:
        dims = max(self.queries.shape[1], postings.shape[0])
        queries = _width(self.queries, dims)
        postings, low, high = _width(postings.T, dims).T, _width(low[None], dims)[0], _width(high[None], dims)[0]
        warm = postings[:, :WARM]
        if warm.shape[1] >= self.k and (self.threshold == NONE).any():
            kind = _exact_type(queries, low, high)
            some = queries.astype(kind) @ warm.astype(kind)
            self.threshold = np.maximum(self.threshold, np.partition(some, -self.k, axis=1)[:, -self.k].astype(np.int64))
        at_query, at_vector, score = competitive(queries, postings, low, high, self.threshold)
        length = np.asarray(ids.value_lengths(), np.int64)
        n = length[at_vector]
        hit = np.repeat(np.arange(len(n)), n)
        within = np.arange(len(hit)) - np.repeat(np.cumsum(n) - n, n)
        flat = ids.flatten()
        start = np.cumsum(length) - length
        place = start[at_vector[hit]] + within
        no_id = np.asarray(flat.is_null())[place]
        new = (at_query[hit], score[hit], np.asarray(flat.fill_null(0), np.int64)[place], no_id)
        query, value, row_id, none = (np.concatenate(c) for c in zip(self.best, new, strict=True))
        order = np.lexsort((row_id, none, -value, query))
        rank = np.arange(len(order)) - np.searchsorted(query[order], query[order], "left")
        order = order[rank < self.k]
        self.best = (query[order], value[order], row_id[order], none[order])
        full = np.flatnonzero(np.bincount(self.best[0], minlength=len(self.keys)) == self.k)
        last = np.searchsorted(self.best[0], full, "right") - 1
        self.threshold[full] = np.maximum(self.threshold[full], self.best[1][last])

    def found(self) -> pa.RecordBatch:
        query, value, row_id, none = self.best
        return pa.record_batch([pa.array([self.keys[i] for i in query], pa.binary()), pa.array(row_id, pa.int64(), mask=none), pa.array(value, pa.int64())], names=["vkey", "vec_id", "score"])


def _tiles(k: int):
    """Rows come by tile, a tile's blocks of queries before its shards."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, held = None, []
        for batch in batches:
            for i in range(len(batch)):
                row = batch.slice(i, 1)
                at = row.column("tile")[0].as_py()
                if at != tile:
                    yield from (h.found() for h in held)
                    tile, held = at, []
                n, dims = row.column("n")[0].as_py(), row.column("dims")[0].as_py()
                if row.column("queries")[0].is_valid:
                    held.append(_Held(row.column("keys")[0].as_py(), np.frombuffer(row.column("queries")[0].as_buffer(), np.int64).reshape(n, dims), k))
                    continue
                data = row.column("postings")[0].as_buffer()
                postings = np.frombuffer(data, f"i{data.size // max(1, n * dims) or 1}").reshape(dims, n)
                low, high = (np.asarray(row.column(c)[0].as_py(), np.int64) for c in ("low", "high"))
                for h in held:
                    h.meet(postings, low, high, row.column("ids")[0].values)
        yield from (h.found() for h in held)

    return search


def index(vectors: DataFrame, k: int, size: int = SHARD) -> DataFrame:
    """Shards of the vectors (vec_id, vkey, v), each distinct one with its k smallest ids."""
    first = Window.partitionBy("vkey").orderBy(F.col("vec_id").asc_nulls_last())
    few = vectors.withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= k)
    entries = few.groupBy("vkey").agg(F.first("v").alias("v"), F.transform(F.array_sort(F.collect_list(F.struct("_r", "vec_id"))), lambda x: x["vec_id"]).alias("ids"))
    return C.written(entries.select("v", "ids").mapInArrow(_index(size), SHARD_SCHEMA).withColumn("no", F.monotonically_increasing_id()), "postings")


def search(queries: DataFrame, shards: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """(vkey, best): the k best rows, array of (score, vec_id), of every distinct query vector (vkey, v)."""
    spark = queries.sparkSession
    blocks = C.written(queries.mapInArrow(_blocks(block), BLOCK_SCHEMA).withColumn("no", F.monotonically_increasing_id()), "queries")
    parts, n_blocks, n_shards = int(spark.conf.get("spark.sql.shuffle.partitions")), blocks.count(), shards.count()
    columns = max(1, -(-n_blocks // HELD))
    strips = max(1, min(n_shards, -(-2 * parts // columns)))
    # a block's queries go to every strip of shards, a shard to every column of blocks; a tile has the queries of one and the shards of the other
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda n: (F.shiftright("no", 33) + F.col("no").bitwiseAND((1 << 33) - 1)) % n
    left = blocks.select("n", "dims", "keys", "queries", dealt(columns).alias("c"), every(strips).alias("s"))
    right = shards.select("n", "dims", "ids", "low", "high", "postings", dealt(strips).alias("s"), every(columns).alias("c"))
    tile = (F.col("c") * strips + F.col("s")).alias("tile")
    rows = left.select("*", tile).drop("c", "s").unionByName(right.select("*", tile).drop("c", "s"), allowMissingColumns=True)
    rows = rows.repartition(max(parts, min(columns * strips, 4 * parts)), "tile").sortWithinPartitions("tile", F.col("queries").isNull())
    found = rows.mapInArrow(_tiles(k), FOUND)
    best = Window.partitionBy("vkey").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    merged = found.withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= k)
    return merged.groupBy("vkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "score", "vec_id"))), lambda x: F.struct(x["score"].alias("score"), x["vec_id"].alias("vec_id"))).alias("best"))


def top_k(table: DataFrame, k: int = 5, every: int = 50, size: int = SHARD, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose vec_id is divisible by `every`, the k other rows of the greatest inner
    product, ties to the smaller vec_id."""
    v = table.select(F.col("vec_id").cast("long").alias("vec_id"), quantised(F.col("embedding")).alias("v")).filter("v IS NOT NULL")
    v = v.withColumn("vkey", F.unhex(F.sha2(F.concat_ws(",", "v"), 256)))
    asked = v.filter(F.col("vec_id") % every == 0)
    found = search(asked.select("vkey", "v").dropDuplicates(["vkey"]), index(v, k + 1, size), k + 1, block)
    norm = F.aggregate("v", F.lit(0).cast("long"), lambda s, x: s + x * x)
    rows = asked.select("vkey", F.col("vec_id").alias("query_id"), norm.alias("norm")).join(found, "vkey")
    own = F.array_position(F.transform("best", lambda b: b["vec_id"].eqNullSafe(F.col("query_id")) & (b["score"] == F.col("norm"))), F.lit(True))
    others = F.slice(F.filter("best", lambda b, i: i != own - 1), 1, k)
    return rows.select("query_id", F.posexplode(others).alias("at", "b")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "b.vec_id", "b.score")


ORACLE_SQL = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 50 = 0),
k AS (SELECT query_id, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST)::INT AS rank, vec_id, score FROM s)
SELECT * FROM k WHERE rank <= 5"""
