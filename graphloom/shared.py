"""Cutting lineage in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []
#: Tables that stored() and bucketed() wrote and no scratch() has removed: (path, name in the catalog or None).
_tables: list[tuple[str, str | None]] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; in local mode without that setting, a folder of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return _own[0]


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed and kept in the shared folder; its lineage is cut. Spark removes the files once nothing refers to them if
    spark.cleaner.referenceTracking.cleanCheckpoints is set."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def stored(df: DataFrame, merge: bool = True) -> DataFrame:
    """df as a Parquet table in the shared folder: it is computed once (a checkpoint without a cache computes its last stage twice), and
    later reads take only the columns they need. The table stays until the scratch() around it ends.

    Spark takes the size of its files for its size. Columns that repeat shrink there to a hundredth, so that joins would send millions of rows
    through the driver as a broadcast; hence the hint that its joins go by a merge. merge=False leaves it out, for a table whose joins say
    how they go themselves."""
    path = f"{shared_dir(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _tables.append((path, None))
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out = out.hint("merge") if merge else out
    out._stored_path = path
    return out


def _remove(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def drop(df: DataFrame) -> None:
    """Removes a table of stored(): what was made of it has been stored in turn."""
    _tables.remove((df._stored_path, None))
    _remove(df.sparkSession, df._stored_path)


def by_graph(spark: SparkSession) -> None:
    """From now on joins by graph and node read tables bucketed by graph as they lie."""
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")


def bucketed(df: DataFrame, keys: list[str], name: str, buckets: int | None = None) -> DataFrame:
    """df as a table in the shared folder, bucketed and sorted by keys: joins by exactly these keys (after by_graph() by more than them, too)
    don't exchange it."""
    spark = df.sparkSession
    parts, table = buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), f"{name}_{uuid.uuid4().hex}"
    rows, path = df.repartition(parts, *keys), f"{shared_dir(spark)}/{table}"  # a file a bucket
    rows.write.format("parquet").bucketBy(parts, *keys).sortBy(*keys).option("path", path).saveAsTable(table)
    _tables.append((path, table))
    return spark.table(table)


def kept_by_graph(df: DataFrame, name: str, buckets: int | None) -> DataFrame:
    """stored(), but bucketed by graph if `buckets` is given: for many graphs none of which is much of the table. What is made of such
    a table says so by `_by_graph`, if it is kept in turn."""
    if buckets is None:
        return stored(df)
    out = bucketed(df, ["bundle", "graph_id"], name, buckets).hint("merge")
    out._by_graph = buckets
    return out


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes at its end what stored() and bucketed() wrote meanwhile. Results have to be written or collected inside."""
    start = len(_tables)
    try:
        yield
    finally:
        for path, table in _tables[start:]:
            if table:
                spark.sql(f"DROP TABLE IF EXISTS {table}")
            _remove(spark, path)
        del _tables[start:]
