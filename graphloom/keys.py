"""The key of a graph, and random draws that do not depend on partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A graph is known by its bundle and its id.
K = ["bundle", "graph_id"]


def uniform(seed: int, *parts: Column | str) -> Column:
    """A number in [0, 1) from the md5 of the seed and the parts: the same in any engine and partitioning."""
    text = F.concat_ws("|", F.lit(str(seed)), *(F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def uniform_sql(seed: int, *parts: str) -> str:
    """The same draw as DuckDB SQL."""
    return f"(('0x' || substr(md5('{seed}|' || {" || '|' || ".join(parts)}), 1, 13))::BIGINT / {1 << 52}::DOUBLE)"


def rounded(c: Column | str, digits: int = 6) -> Column:
    """Rounded, with no negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)


def global_rank(df: DataFrame, *order: str) -> DataFrame:
    """df with `rank` (from 0) by a total order, without a one-task window: range partitions, their sizes (one row per partition
    on the driver), and a count within each."""
    from . import shared

    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = shared.stored(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = {r["p"]: r["n"] for r in dealt.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
    offset, entries = 0, []
    for p in sorted(sizes):
        entries += [F.lit(p), F.lit(offset)]
        offset += sizes[p]
    if not entries:
        return dealt.withColumn("rank", F.lit(0).cast("long")).drop("_at")
    return dealt.withColumn("rank", (F.create_map(*entries)[part] + F.col("_at").bitwiseAND((1 << 33) - 1)).cast("long")).drop("_at")


def rank_within(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """df with `rank` (from 0) by `order` within each group of `keys`, however large a group is: rows are sorted over range
    partitions, and a row's rank is its place in the partition plus the group's rows in earlier ones (a group has one row per
    partition at most in the window)."""
    from . import shared

    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [*keys, *order]
    dealt = shared.stored(df.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()))
    dealt = dealt.withColumn("_range", F.shiftright("_at", 33))
    runs = dealt.groupBy(*keys, "_range").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    earlier = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select(*keys, "_range", (F.col("_first") - F.coalesce(earlier, F.lit(0))).alias("_zero"))
    return dealt.join(runs, [*keys, "_range"]).withColumn("rank", F.col("_at") - F.col("_zero")).drop("_at", "_range", "_zero")
