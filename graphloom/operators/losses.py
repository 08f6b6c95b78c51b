"""Losses and metrics of predicted layouts: pred and true are (bundle, graph_id, idx, x, y)."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..keys import K
from ..shared import stored
from . import pairs as P


def align_lengths(pred: DataFrame, true: DataFrame) -> DataFrame:
    """(x, y, tx, ty) of the nodes that both have, by idx: the longer side is cut."""
    return pred.select(*K, "idx", "x", "y").join(true.select(*K, "idx", F.col("x").alias("tx"), F.col("y").alias("ty")).hint("merge"), [*K, "idx"])


def _mse() -> Column:
    dx, dy = F.col("x") - F.col("tx"), F.col("y") - F.col("ty")
    return F.avg(dx * dx + dy * dy) / 2


def _radius() -> Column:
    r = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y")) - 1
    return F.avg(r * r)


def _center() -> Column:
    return (F.abs(F.avg("x")) + F.abs(F.avg("y"))) / 2


def coord_mse(pred: DataFrame, true: DataFrame) -> DataFrame:
    return align_lengths(pred, true).groupBy(*K).agg(_mse().alias("mse"))


def radius_loss(pred: DataFrame) -> DataFrame:
    return pred.groupBy(*K).agg(_radius().alias("radius_loss"))


def _angles(rows: DataFrame) -> DataFrame:
    """rows with `gap`, the angle less that of the node before it in the order of angles, and `n`."""
    rows = rows.withColumn("angle", F.atan2("y", "x"))
    order = Window.partitionBy(*K).orderBy("angle", "idx")
    return rows.withColumns({"gap": F.col("angle") - F.lag("angle").over(order), "n": F.count("*").over(Window.partitionBy(*K))})


def _spacing() -> Column:
    e = F.col("gap") - 2 * math.pi / F.col("n")
    return F.coalesce(F.avg(e * e), F.lit(float("nan")))


def spacing_loss(pred: DataFrame) -> DataFrame:
    """Squared error of the gaps between angles in order against 2 pi / n, without the closing gap; NaN for one node."""
    return _angles(pred).groupBy(*K).agg(_spacing().alias("spacing_loss"))


def center_loss(pred: DataFrame) -> DataFrame:
    return pred.groupBy(*K).agg(_center().alias("center_loss"))


def _pair_sums(rows: DataFrame) -> DataFrame:
    """(n, s): per graph its nodes and the sum over unordered pairs of the squared difference of both distances."""

    def differ(p: P.Pairs) -> dict:
        d = P.distance(p)[2] - P.distance(p, "tx", "ty")[2]
        return {"s": p.sum(np.where(p.before, d * d, 0.0))}

    each = P.over_pairs(rows.select(*K, F.col("idx").alias("node"), "x", "y", "tx", "ty"), ["x", "y", "tx", "ty"], differ, {"s": "double"}, half=True)
    return each.groupBy(*K).agg(F.count("*").alias("n"), F.sum("s").alias("s"))


def pairwise_distance_loss(pred: DataFrame, true: DataFrame) -> DataFrame:
    """Mean squared difference of the distances over all n x n ordered pairs."""
    return _pair_sums(align_lengths(pred, true)).select(*K, (2 * F.col("s") / (F.col("n") * F.col("n"))).alias("pairwise_loss"))


def circular_layout_loss(pred: DataFrame, true: DataFrame) -> DataFrame:
    rows = stored(align_lengths(pred, true))
    parts = _angles(rows).groupBy(*K).agg(_mse().alias("mse"), _radius().alias("radius"), _spacing().alias("spacing"), _center().alias("center"))
    parts = parts.join(_pair_sums(rows), K)
    pairwise = 2 * F.col("s") / (F.col("n") * F.col("n"))
    return parts.select(*K, (0.1 * F.col("mse") + 0.3 * F.col("radius") + 0.3 * F.col("spacing") + 0.2 * F.col("center") + 0.1 * pairwise).alias("loss"))


def graph_loss(pred: DataFrame, true: DataFrame, loss_type: str) -> DataFrame:
    if loss_type == "circular":
        return circular_layout_loss(pred, true)
    if loss_type == "force_directed":
        return coord_mse(pred, true).withColumnRenamed("mse", "loss")
    raise ValueError(f"unknown loss type {loss_type!r}: circular, force_directed")


def loss_per_batch(pred: DataFrame, true: DataFrame, batches: DataFrame, loss_type: str) -> DataFrame:
    """Mean over the graphs of each batch; batches(bundle, graph_id, batch_id)."""
    return graph_loss(pred, true, loss_type).join(batches, K).groupBy("batch_id").agg(F.avg("loss").alias("loss"))


def evaluate(pred: DataFrame, true: DataFrame, batches: DataFrame, loss_type: str) -> DataFrame:
    """One row: the mean of the batches' means, infinite without a batch."""
    return loss_per_batch(pred, true, batches, loss_type).agg(F.coalesce(F.avg("loss"), F.lit(float("inf"))).alias("loss"))


def layout_metrics(pred: DataFrame, true: DataFrame) -> DataFrame:
    """One row: mean and sample deviation over graphs of the squared and the absolute error; infinite without a graph."""
    dx, dy = F.col("x") - F.col("tx"), F.col("y") - F.col("ty")
    per = align_lengths(pred, true).groupBy(*K).agg((F.avg(dx * dx + dy * dy) / 2).alias("mse"), (F.avg(F.abs(dx) + F.abs(dy)) / 2).alias("mae"))
    inf, nan = F.lit(float("inf")), F.lit(float("nan"))
    spread = lambda c: F.when(F.count("*") == 0, inf).otherwise(F.coalesce(F.stddev_samp(c), nan))
    return per.agg(F.coalesce(F.avg("mse"), inf).alias("mse_mean"), spread("mse").alias("mse_std"), F.coalesce(F.avg("mae"), inf).alias("mae_mean"), spread("mae").alias("mae_std"))


def early_stopping(history: DataFrame, min_epochs: int = 100, max_patience: int = 50) -> DataFrame:
    """The rows of each run up to the first epoch, from min_epochs on, that is max_patience epochs past the last strict
    improvement of val_loss; with `best`, whether the row improved."""
    order = Window.partitionBy("run_id").orderBy("epoch")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = history.withColumn("best", F.coalesce(F.col("val_loss") < F.min("val_loss").over(before), F.col("val_loss").isNotNull()))
    waited = F.col("epoch") - F.coalesce(F.max(F.when(F.col("best"), F.col("epoch"))).over(order), F.lit(-1))
    rows = rows.withColumn("stops", (waited >= max_patience) & (F.col("epoch") >= min_epochs))
    earlier = F.coalesce(F.max(F.col("stops").cast("int")).over(before), F.lit(0))
    return rows.withColumn("_over", earlier).filter("_over = 0").drop("_over")


def best_epoch(history: DataFrame, min_epochs: int = 100, max_patience: int = 50) -> DataFrame:
    """Per run, before it stops: the earliest epoch of the least val_loss, that loss, and the number of epochs."""
    rows = early_stopping(history, min_epochs, max_patience)
    return rows.groupBy("run_id").agg(F.min(F.struct("val_loss", "epoch"))["epoch"].alias("best_epoch"), F.min("val_loss").alias("best_val_loss"), F.count("*").alias("total_epochs"))


def training_curve(history: DataFrame) -> DataFrame:
    return history.select("run_id", "epoch", "train_loss", "val_loss")
