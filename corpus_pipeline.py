"""The corpus pipeline: quality rules, exact dedup, near dedup, substring dedup, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next one's docs.
All but the last return the columns of `documents` (n_chars follows the text where a stage changes it). Decisions are joined
to rows by a key of the row, so that rows with a null or shared doc_id are judged, kept and cut each by itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import exact_dedup, hyperminhash, packing, quality, substring_dedup
from graphloom.llm import common as C

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with `row_key`, a long that is unique to the row, never null and in the order of doc_id (nulls last): doc_id
    itself if it is all that. Otherwise the rows are numbered and written once, as numbers could change in another scan."""
    rows = docs.select(*COLUMNS)
    if not rows.groupBy("doc_id").count().filter("count > 1 OR doc_id IS NULL").limit(1).count():
        return rows.withColumn("row_key", F.col("doc_id").cast("long"))
    # the place in the scan splits a doc_id that many rows share
    rows = rows.withColumn("place", F.monotonically_increasing_id())
    order, parts = [F.col("doc_id").asc_nulls_last(), F.col("place")], int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("place")
    return C.written(rows.withColumn("row_key", F.monotonically_increasing_id()), "rows")


def _by_key(rows: DataFrame) -> DataFrame:
    """What the operators take, with the row's key as doc_id."""
    return rows.select(F.col("row_key").alias("doc_id"), "text", "lang")


def _those_kept(rows: DataFrame, verdicts: DataFrame) -> DataFrame:
    kept = verdicts.filter("kept").select(F.col("doc_id").alias("row_key"))
    return rows.join(kept, "row_key", "left_semi").select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the base rules or the divergence from their language reject go: among them rows with null or empty text.
    Equal rows get one verdict; rows that share a doc_id or have none are judged each by itself; an empty table stays empty,
    as in every stage."""
    rows = _keyed(docs)
    return _those_kept(rows, quality.judge(_by_key(rows)))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (null counts as empty), one row of the smallest doc_id stays; a row without doc_id only if the group has
    no other."""
    rows = _keyed(docs)
    return _those_kept(rows, exact_dedup.deduplicate_split(_by_key(rows), F.xxhash64("doc_id") % 2 == 0))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays, that of the smallest doc_id; a document without words (null and empty texts
    among them) is in no group and stays."""
    rows = _keyed(docs)
    return _those_kept(rows, hyperminhash.near_duplicates(_by_key(rows)))


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of repeated passages go; what is left of a changed text is joined by one space, and may be empty. A text of
    which nothing goes, null among them, stays as it is. No row goes."""
    rows = _keyed(docs)
    cut = substring_dedup.remove_repeats(_by_key(rows), with_text=True).select(F.col("doc_id").alias("row_key"), "n_removed", "kept_text")
    changed = F.col("n_removed") > 0
    text = F.when(changed, F.col("kept_text")).otherwise(F.col("text"))
    out = rows.join(cut, "row_key").withColumn("text", text)
    return out.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences of lexical neighbours: every row is packed, one without text as its end id alone; rows that share a
    doc_id or have none are packed each, under that id."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [("quality_rules", quality_rules), ("exact_dedup", exact), ("near_dedup", near), ("substring_dedup", substrings), ("packing", pack)]

#: The near-dedup and packing stages can't be said in SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table. What a stage needed is dropped once its result is written; the tables that the last
    one reads stay, as its result is not computed yet."""
    docs, start = spark.read.parquet(f"{sf_dir}/documents.parquet"), len(C.paths)
    for name, stage in STAGES[:-1]:
        docs = C.written(stage(spark, docs, sf_dir), name)
        C.drop_since(spark, start, len(C.paths) - 1)
    return STAGES[-1][1](spark, docs, sf_dir)
