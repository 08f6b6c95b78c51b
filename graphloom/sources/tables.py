"""Graph, layout and sample tables on disk, each kind with a declared schema.

`bundle` is a text and `graph_id` a whole number or a text, exactly as written: "007" stays "007". Files carry the name of their kind, and
reading one as another kind raises ValueError, as does writing a table that lacks a column or has one of another type.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..keys import K

_KEY = {"bundle": "string", "graph_id": "bigint|string"}
_XY = "array<struct<x:double,y:double>>"
#: Of each kind the columns it must have, and those it may lack (null then).
KINDS: dict[str, tuple[dict[str, str], dict[str, str]]] = {
    "graphs": (_KEY | {"graph_type": "string", "num_nodes": "int"}, {"params": "map<string,double>", "seed": "bigint", "has_communities": "boolean", "num_communities": "int"}),
    "nodes": (_KEY | {"node": "bigint", "idx": "int"}, {"community": "int"}),
    "edges": (_KEY | {"src": "bigint", "dst": "bigint", "weight": "double"}, {}),
    "layouts": (_KEY | {"layout_type": "string", "node": "bigint", "x": "double", "y": "double"}, {}),
    "initial_positions": (_KEY | {"node": "bigint", "x": "double", "y": "double"}, {}),
    "samples": (
        _KEY | {"graph_type": "string", "layout_type": "string", "x": "array<array<double>>", "edge_index": "array<struct<src:bigint,dst:bigint>>", "y": _XY, "original_y": _XY},
        {"has_initial_position": "boolean", "initial_position_dims": "struct<lo:int,hi:int>", "community": "array<int>", "num_communities": "int"},
    ),
}
#: Types that widen without loss.
_WIDER = {("tinyint", "int"), ("smallint", "int"), ("tinyint", "bigint"), ("smallint", "bigint"), ("int", "bigint"), ("float", "double"), ("int", "double")}
_MARK = "graphloom_kind"


def _columns(kind: str) -> tuple[dict[str, str], dict[str, str]]:
    if kind not in KINDS:
        raise ValueError(f"unknown kind of table {kind!r}: {', '.join(KINDS)}")
    return KINDS[kind]


def conformed(df: DataFrame, kind: str) -> DataFrame:
    """df with the columns of its kind, in order; ValueError if one is absent or of another type. Other columns are left out."""
    need, may = _columns(kind)
    have, wrong, out = dict(df.dtypes), [], []
    for name, types in {**need, **may}.items():
        if name not in have:
            if name in need:
                wrong.append(f"{name} is absent")
            out.append(F.lit(None).cast(types.split("|")[0]).alias(name))
            continue
        to = next((t for t in types.split("|") if t == have[name]), None) or next((t for t in types.split("|") if (have[name], t) in _WIDER), None)
        if to is None and name in may and have[name] == "void":
            to = types
        if to is None:
            wrong.append(f"{name} is {have[name]}, not {types.replace('|', ' or ')}")
            continue
        out.append(F.col(name).cast(to).alias(name))
    if wrong:
        raise ValueError(f"no table of {kind}: {'; '.join(wrong)}")
    return df.select(*out)


def write_table(df: DataFrame, path: str, kind: str) -> None:
    """Parquet, a folder per bundle; the bundle is also in the files, where nothing guesses its type."""
    rows = conformed(df, kind)
    rows = rows.withMetadata("graph_id", {_MARK: kind}).withColumn("bundle_dir", F.col("bundle"))
    rows.write.partitionBy("bundle_dir").parquet(path)


def _checked(found: StructType, path: str, kind: str) -> StructType:
    need, may = _columns(kind)
    names = set(found.fieldNames())
    mark = found["graph_id"].metadata.get(_MARK) if "graph_id" in names else None
    if mark is not None and mark != kind:
        raise ValueError(f"{path} is a table of {mark}, not of {kind}")
    lacking = [c for c in [*need, *may] if c not in names]
    if lacking:
        raise ValueError(f"{path} is no table of {kind}: it lacks {', '.join(lacking)}")
    for c, types in {**need, **may}.items():
        if found[c].dataType.simpleString() not in types.split("|"):
            raise ValueError(f"{path} is no table of {kind}: {c} is {found[c].dataType.simpleString()}, not {types.replace('|', ' or ')}")
    return StructType([found[c] for c in [*need, *may]])


def read_table(spark: SparkSession, path: str, kind: str, bundles: list[str] | None = None) -> DataFrame:
    """A table that write_table() wrote, of all bundles or of those named (other folders are not read)."""
    schema = _checked(spark.read.parquet(path).schema, path, kind)
    df = spark.read.schema(StructType(schema.fields).add("bundle_dir", "string")).parquet(path)
    if bundles is not None:
        df = df.filter(F.col("bundle_dir").isin(bundles) & F.col("bundle").isin(bundles))
    return df.drop("bundle_dir")


def save_by_graph(df: DataFrame, table: str, kind: str, buckets: int, path: str | None = None) -> None:
    """A catalog table bucketed and sorted by graph: for many graphs none of which is much of the table. Joins and groups by graph, or
    by graph and node, read such tables without an exchange if spark.sql.requireAllClusterKeysForCoPartition is false and they have
    the same number of buckets."""
    rows = conformed(df, kind).withMetadata("graph_id", {_MARK: kind}).repartition(buckets, *K)
    out = rows.write.format("parquet").bucketBy(buckets, *K).sortBy(*K)
    (out.option("path", path) if path else out).saveAsTable(table)


def open_by_graph(spark: SparkSession, table: str, kind: str) -> DataFrame:
    df = spark.table(table)
    return df.select(_checked(df.schema, table, kind).fieldNames())
