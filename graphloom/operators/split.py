"""Splits, batches and samples of graphs, by hashes of their keys: the same in any partitioning."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..keys import K, global_rank, uniform

SPLITS = ("train", "val", "test")


def split_dataset(df: DataFrame, splits: tuple[float, float, float] = (0.8, 0.1, 0.1), seed: int = 42) -> DataFrame:
    """df with its split and its position there: exact counts, the rest of the rounding goes to test."""
    if len(splits) != 3 or abs(sum(splits) - 1) > 1e-6:
        raise ValueError("three splits sum to 1")
    ranked = global_rank(df.withColumn("_draw", uniform(seed, *K)), "_draw", *K)
    n = ranked.count()
    first = int(n * splits[0])
    second = first + int(n * splits[1])
    rank = F.col("rank")
    split = F.when(rank < first, "train").when(rank < second, "val").otherwise("test")
    start = F.when(rank < first, 0).when(rank < second, first).otherwise(second)
    return ranked.withColumns({"split": split, "position": (rank - start).cast("long")}).drop("rank", "_draw")


def assign_batches(df: DataFrame, batch_size: int = 32, epoch: int | None = None, seed: int = 42) -> DataFrame:
    """df of split_dataset() with `batch`, consecutive runs of batch_size rows of a split; the last one is short. With an
    epoch, train is ordered anew for it."""
    if batch_size < 1:
        raise ValueError("a batch has one graph at least")
    place = F.col("position")
    if epoch is None:
        return df.withColumn("batch", F.floor(place / batch_size).cast("long"))
    train = global_rank(df.filter("split = 'train'").withColumn("_draw", uniform(seed, F.lit(f"epoch {epoch}"), *K)), "_draw", *K)
    again = train.withColumn("position", F.col("rank")).drop("rank", "_draw")
    return again.unionByName(df.filter("split <> 'train'")).withColumn("batch", F.floor(place / batch_size).cast("long"))


def monitor_samples(df: DataFrame, k: int = 2) -> DataFrame:
    """The first k graphs in the order of their keys."""
    return df.orderBy(*K).limit(k)


def sample_graphs(df: DataFrame, k: int = 5, seed: int = 42) -> DataFrame:
    """k graphs (all, if fewer) without replacement."""
    return df.withColumn("_draw", uniform(seed, F.lit("sample"), *K)).orderBy("_draw", *K).limit(k).drop("_draw")


def community_palette(nodes: DataFrame, colours: int = 10) -> DataFrame:
    """nodes with `colour`: the place of the community among the graph's distinct ones, modulo the palette. Only the distinct
    communities of a graph are sorted in one task; a node without one has no colour."""
    known = nodes.filter("community IS NOT NULL").select(*K, "community").distinct()
    place = F.row_number().over(Window.partitionBy(*K).orderBy("community")) - 1
    return nodes.join(known.withColumn("colour", (place % colours).cast("int")), [*K, "community"], "left")
