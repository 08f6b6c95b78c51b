"""Edge and community text, bundle selection, JSON results."""

from __future__ import annotations

import fnmatch
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..keys import K

def _tokens(lines: DataFrame) -> DataFrame:
    """Lines (..., line_no, value) that are neither blank nor comments, with `t`, their tokens. What a generator gives is computed
    once: filters on it would otherwise split each line again in every condition."""
    one = F.array(F.regexp_extract_all("value", F.lit(r"\S+"), F.lit(0)))
    return lines.filter(F.col("value").rlike(r"^\s*[^\s#]")).select("*", F.explode(one).alias("t"))


def _number(c: Column) -> Column:
    """c as a double, or null. Text that can't be one is told by its first letter: a failing cast costs as much as a hundred lines."""
    return F.when(c.rlike("^[-+]?[0-9.iInN]"), c.try_cast("double"))


def _fields(lines: DataFrame) -> DataFrame:
    return _tokens(lines).filter(F.size("t") >= 2)


def _whole(c: Column) -> Column:
    return c.try_cast("bigint")


def parse_edge_lines(lines: DataFrame) -> DataFrame:
    """lines(bundle, graph_id, line_no, value) "u v [weight]" to canonical edges. Short and non-numeric lines are skipped, the
    weight is 1 if absent, and of repeats in either direction the last line decides."""
    t = _fields(lines)
    weight = F.when(F.size("t") > 2, _number(F.col("t")[2])).otherwise(F.lit(1.0))
    rows = t.select(*K, "line_no", _whole(F.col("t")[0]).alias("u"), _whole(F.col("t")[1]).alias("v"), weight.alias("w"))
    rows = rows.filter("u IS NOT NULL AND v IS NOT NULL AND w IS NOT NULL")
    return rows.groupBy(*K, F.least("u", "v").alias("src"), F.greatest("u", "v").alias("dst")).agg(F.max_by("w", "line_no").alias("weight"))


def parse_community_lines(lines: DataFrame) -> DataFrame:
    """lines(bundle, graph_id, line_no, value) "node community [more]" to (node, community): the first membership, the last line."""
    t = _fields(lines).select(*K, "line_no", _whole(F.col("t")[0]).alias("node"), F.col("t")[1].try_cast("int").alias("c"))
    return t.filter("node IS NOT NULL AND c IS NOT NULL").groupBy(*K, "node").agg(F.max_by("c", "line_no").alias("community"))


#: Folder and file without its ending, of a path.
NAMES = r"([^/]*)/([^/]*?)(?:\.[^./]*)?$"


def read_lines(spark: SparkSession, path: str, names: str = NAMES) -> DataFrame:
    """(bundle, graph_id, line_no, value) of text files; the bundle is the folder, the graph the file (groups 1 and 2 of `names`). line_no orders the lines of a file, also
    where it is read in several splits: the first byte of the split, and a number that ascends within the split."""
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"))
    rows = spark.read.text(path).select("value", place.alias("line_no"), F.url_decode("_metadata.file_path").alias("file"))
    return rows.select(F.regexp_extract("file", names, 1).alias("bundle"), F.regexp_extract("file", names, 2).alias("graph_id"), "line_no", "value")


def rejected_lines(lines: DataFrame, kind: str) -> DataFrame:
    """The lines (bundle, graph_id, line_no, value) that parse_edge_lines() ("edges") or parse_community_lines() ("communities") skip
    although they are neither blank nor comments, with the reason: "short" or "not a number"."""
    if kind not in ("edges", "communities"):
        raise ValueError(f"unknown kind of lines {kind!r}: edges, communities")
    t = _tokens(lines)
    whole = [F.col("t")[0].try_cast("bigint"), F.col("t")[1].try_cast("bigint" if kind == "edges" else "int")]
    bad = whole[0].isNull() | whole[1].isNull()
    if kind == "edges":
        bad = bad | ((F.size("t") > 2) & _number(F.col("t")[2]).isNull())
    reason = F.when(F.size("t") < 2, "short").when(bad, "not a number")
    return t.withColumn("reason", reason).filter("reason IS NOT NULL").select(*K, "line_no", "value", "reason")


def read_edge_text(spark: SparkSession, path: str, names: str = NAMES) -> DataFrame:
    return parse_edge_lines(read_lines(spark, path, names))


def read_community_text(spark: SparkSession, path: str, names: str = NAMES) -> DataFrame:
    return parse_community_lines(read_lines(spark, path, names))


def select_bundles(df: DataFrame, patterns: list[str]) -> DataFrame:
    """Rows whose bundle matches any of the glob patterns."""
    if not patterns:
        return df.filter(F.lit(False))
    return df.filter(F.col("bundle").rlike("|".join(f"(?:{re.sub(r'\\Z$|\\z$', '$', '^' + fnmatch.translate(p))})" for p in patterns)))


def select_bundles_by_prefix(df: DataFrame, prefix: str) -> DataFrame:
    return df.filter(F.col("bundle").startswith(prefix))


def match_layout_bundles(graphs: DataFrame, layouts: DataFrame, layout_type: str) -> DataFrame:
    """graphs whose bundle has a layout bundle "{bundle}_{layout_type}_layout"; ValueError if one has none."""
    named = F.concat(F.col("bundle"), F.lit(f"_{layout_type}_layout"))
    have = layouts.select(F.col("bundle").alias("_l")).distinct()
    without = graphs.select(named.alias("_l")).distinct().join(have, "_l", "left_anti").limit(1).collect()
    if without:
        raise ValueError(f"no layout bundle {without[0][0]}")
    return graphs.withColumn("layout_bundle", named)


def write_results_json(df: DataFrame, path: str) -> None:
    """A line of JSON per run; nested columns stay nested, and null fields are written as such."""
    df.write.option("ignoreNullFields", "false").json(path)
