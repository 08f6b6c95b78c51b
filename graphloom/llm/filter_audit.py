"""Audit of how filters interact: what each removes, in every order of application.

A document's verdicts are five bits (fails A..E). Spark counts documents by part and verdicts, which leaves one row of at most 32
counts per part; that row, reshaped to 2x2x2x2x2, is contracted by einsum with (1, 0), (0, 1) or (1, 1) along each axis: pass,
fail or either. `redundant` is what fails a filter less what the filter removes.

Defined results: a null text is empty, a null lang is the part ''. A row without doc_id comes after every id: it repeats an equal
text that has one; rows of one doc_id, or without, don't repeat each other. Several label rows of a document count as good (toxic)
if one of them says so; labels without doc_id or value say nothing. Repeated rows count each. An empty table gives no rows, every
other part 120 x 5. Other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT, MAX_UPPER, SYMBOLS = 200, 50, 3, r"[#$%&*|]"
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
SCHEMA = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS)

PASS, FAIL, EITHER = np.array([1, 0]), np.array([0, 1]), np.array([1, 1])


def verdicts(text: Column) -> Column:
    """The bits of A, B, C and D (1, 2, 4, 8): what a text fails by itself."""
    bare = F.btrim(text, F.lit(" \t\n\v\f\r"))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, C.SPACE))
    upper = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    fails = [F.size(words) < MIN_WORDS, 100 * F.size(F.array_distinct(words)) < MIN_DISTINCT * F.size(words), 100 * upper > MAX_UPPER * F.length(text), text.rlike(SYMBOLS)]
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, cell, n, good, toxic): documents, good and toxic ones by the verdicts of all five filters. Repeats are told without
    a join of rows: equal texts of a part and label are one row that knows its smallest doc_id and how many rows have it."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("h"), verdicts(text).alias("own"))
    rows = rows.groupBy("doc_id", "part", "h", "own").agg(F.count("*").alias("n"))
    says = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(c)
    known = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(says("quality"), says("toxic"))
    rows = rows.join(known, "doc_id", "left").fillna(False, ["quality", "toxic"])
    rows = rows.groupBy("h", "part", "own", "quality", "toxic").agg(F.sum("n").alias("n"), F.min(F.struct(F.isnull("doc_id").alias("no_id"), "doc_id", "n")).alias("least"))
    first = rows.groupBy("h").agg(F.min(F.struct("least.no_id", "least.doc_id")).alias("first"))
    rows = rows.join(first, "h")  # a few rows per distinct text on one side, one on the other
    firsts = F.when(F.struct("least.no_id", "least.doc_id").eqNullSafe(F.col("first")), F.col("least.n")).otherwise(0)
    rows = rows.withColumn("firsts", firsts)
    both = F.explode(F.array(F.struct(F.col("own").alias("cell"), F.col("firsts").alias("n")), F.struct((F.col("own") + 16).alias("cell"), (F.col("n") - F.col("firsts")).alias("n")))).alias("c")
    rows = rows.select("part", "quality", "toxic", both)
    return rows.groupBy("part", "c.cell").agg(F.sum("c.n").alias("n"), *(F.sum(F.when(F.col(label), F.col("c.n")).otherwise(0)).alias(name) for label, name in (("quality", "good"), ("toxic", "toxic"))))


def _contract(tensor: np.ndarray, earlier: str, name: str, passed: bool, rest: np.ndarray = EITHER) -> np.ndarray:
    """(n, good, toxic) of the documents that pass the filters in `earlier` and pass or fail the filter `name`."""
    by = [PASS if f in earlier else ((PASS if passed else FAIL) if f == name else rest) for f in FILTERS]
    return np.einsum("wabcde,a,b,c,d,e->w", tensor, *by)


def contractions(tensor: np.ndarray) -> list[tuple]:
    """(filter_order, step, counts...) of every order and step; tensor[w, a, b, c, d, e] has the weights n, good and toxic, and
    index 1 of an axis where that filter fails."""
    orders = ["".join(p) for p in permutations(FILTERS)]
    removed: dict[tuple[frozenset, str], np.ndarray] = {}
    kept: dict[frozenset, int] = {}
    for order in orders:
        for i, f in enumerate(order):
            key = (frozenset(order[:i]), f)
            if key not in removed:
                removed[key] = _contract(tensor, order[:i], f, passed=False)
                kept[key[0] | {f}] = int(_contract(tensor, order[:i], f, passed=True)[0])
    fails = {f: int(_contract(tensor, "", f, passed=False)[0]) for f in FILTERS}
    alone = {f: int(_contract(tensor, "", f, passed=False, rest=PASS)[0]) for f in FILTERS}
    shapley = {f: sum(int(removed[frozenset(o[: o.index(f)]), f][0]) for o in orders) for f in FILTERS}
    out = []
    for order in orders:
        for i, f in enumerate(order):
            gone, good, toxic = map(int, removed[frozenset(order[:i]), f])
            out.append((order, i + 1, kept[frozenset(order[: i + 1])], gone, fails[f] - gone, alone[f], good, toxic, shapley[f]))
    return out


def _audit_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row of counts per part in, 600 rows per part out."""
    for batch in batches:
        for part, counts in zip(batch.column("part").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            tensor = np.zeros((3, 32), np.int64)
            for c in counts:
                tensor[:, c["cell"]] = c["n"], c["good"], c["toxic"]
            rows = contractions(tensor.reshape(3, 2, 2, 2, 2, 2).transpose(0, 5, 4, 3, 2, 1))  # bit 0 (A) is the last axis of a reshape
            columns = list(zip(*rows, strict=True))
            kinds = [pa.string(), pa.int32(), *[pa.int64()] * len(COUNTS)]
            yield pa.record_batch([pa.array([part] * len(rows), pa.string()), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["part", "filter_order", "step", *COUNTS])


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """SCHEMA: for every part, order of the five filters and step, what the step's filter keeps, removes and duplicates."""
    one = cells(docs, labels).groupBy("part").agg(F.collect_list(F.struct("cell", "n", "good", "toxic")).alias("counts"))
    return one.mapInArrow(_audit_parts, SCHEMA)


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM d),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT w.doc_id, part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    [len(words) < 200, 100 * len(list_distinct(words)) < 50 * len(words), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t),
     regexp_matches(t, '[#$%&*|]'), w.doc_id > min(w.doc_id) OVER (PARTITION BY t)] AS fails FROM w LEFT JOIN l USING (doc_id)),
n AS (SELECT unnest([1, 2, 3, 4, 5]) AS i),
o AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS p FROM n a, n b, n c, n d, n e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s AS (SELECT array_to_string(list_transform(p, lambda x: chr(64 + x)), '') AS filter_order, n.i::INT AS step, p[n.i] AS own, p[1:n.i - 1] AS earlier FROM o, n),
x AS (SELECT part, filter_order, step, own, good, toxic, fails[own] AS fail, len(list_filter(fails, lambda v: v)) AS n_fails,
    len(list_filter(earlier, lambda e: fails[e])) > 0 AS gone FROM f, s),
r AS (SELECT part, filter_order, step, own, count(*) FILTER (NOT gone AND NOT fail) AS kept, count(*) FILTER (NOT gone AND fail) AS removed,
    count(*) FILTER (gone AND fail) AS redundant, count(*) FILTER (fail AND n_fails = 1) AS unique_fails,
    count(*) FILTER (NOT gone AND fail AND good) AS good_lost, count(*) FILTER (NOT gone AND fail AND toxic) AS toxic_lost FROM x GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM r"""
