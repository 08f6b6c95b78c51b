"""Line dedup by overlapping three-line windows, with DataFrame functions only.

Each three consecutive lines (of those that have a word) of a document are hashed; a window found more than once in the
corpus stays where it comes first, by (doc_id, place), and the lines that its later occurrences cover are removed.
Overlapping windows are merged by the positions that they cover.

Counts per window are summed before the shuffle, and the join of windows to the repeated ones is an equi-join that
adaptive execution can split, so a window in a third of all documents stays off one task.

Inputs: null text counts as empty; a long text is one row with all its lines; doc_id may be a text; lines without a word are never counted nor removed; a document of fewer than three
such lines has no window; equal rows are separate documents (of one doc_id, the one that is read first comes first, nulls before
all); extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

LINES = 3


def _let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.transform(F.array(value), use)[0]


def _windows(text: Column, lines: int) -> Column:
    """array<struct<h binary, lines array<int>>>: a window's digest and the places of its lines in the text."""
    worded = F.filter(F.transform(F.split(text, "\n"), lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: s["x"].rlike(r"[^\x20\x09-\x0D]"))

    def of(kept: Column) -> Column:
        def window(k: Column) -> Column:
            part = [kept[k + j] for j in range(lines)]
            return F.struct(F.unhex(F.md5(F.concat_ws("\n", *(p["x"] for p in part)))).alias("h"), F.array(*(p["i"] for p in part)).alias("lines"))

        return F.when(F.size(kept) >= lines, F.transform(F.sequence(F.lit(0), F.size(kept) - lines), window))

    return _let(worded, of)


def remove_repeated_lines(docs: DataFrame, lines: int = LINES) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_lines, n_removed, kept_text."""
    rows = C.keyed(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    windows = rows.select("row_key", "doc_id", F.posexplode(_windows(F.col("text"), lines)).alias("at", "w")).select("row_key", "doc_id", "at", "w.h", "w.lines")
    repeated = windows.groupBy("h").agg(F.min(F.struct("doc_id", "row_key", "at")).alias("first"), F.count("*").alias("n")).filter("n > 1").select("h", "first")
    later = windows.join(repeated, "h").filter((F.col("row_key") != F.col("first.row_key")) | (F.col("at") != F.col("first.at")))
    gone = later.groupBy("row_key").agg(F.array_distinct(F.flatten(F.collect_list("lines"))).alias("gone"))
    out = rows.join(gone, "row_key", "left").withColumn("gone", F.coalesce("gone", F.array().cast("array<int>")))

    def kept(all_lines: Column) -> Column:
        return F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(all_lines) - 1), F.col("gone")), lambda i: all_lines[i]), "\n")

    split = F.split("text", "\n")
    return out.select("doc_id", F.size(split).cast("long").alias("n_lines"), F.size("gone").cast("long").alias("n_removed"), _let(split, kept).alias("kept_text"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, i, lines[i] AS line FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM d)),
w AS (SELECT doc_id, i AS a, lead(i, 1) OVER o AS b, lead(i, 2) OVER o AS c, md5(concat_ws(chr(10), line, lead(line, 1) OVER o, lead(line, 2) OVER o)) AS h
      FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
later AS (SELECT doc_id, a, b, c FROM w WHERE c IS NOT NULL QUALIFY row_number() OVER (PARTITION BY h ORDER BY doc_id, a) > 1),
gone AS (SELECT DISTINCT doc_id, unnest([a, b, c]) AS i FROM later),
kept AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS t, count(*) AS n FROM l ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, len(lines)::BIGINT AS n_lines, (len(lines) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)"""
