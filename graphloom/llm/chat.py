"""Multi-party perspective rotation of conversations, with DataFrame functions only.

For every participant (each role but "system") the dialogue is rendered with that speaker as the assistant and all others
as named users; system turns stay. The mask lists the spans [from, to) of code points that the assistant wrote, end marker
included. A rendering comes in parts of PART turns, so that no conversation, however long, meets in one row: turns are
sorted over the whole table by range partitions, and a turn's place in its conversation is its place in the partition plus
the turns of the conversation in earlier partitions. The rows that come out are turns times participants of their
conversation, which is what the rotation asks for.

Inputs: a null role is the participant "unknown"; null text is empty; a null turn comes first; turns that share a number
are ordered by role and text; equal rows count once; rows without conv_id form one conversation. No text can forge a
marker: "<|" is written "< |", and in a role also "|>" is "| >" and a line break a space (roles that are equal then are one
participant). A long text is never cut, so its part is as long. A conversation of system turns alone has no participant
and no row; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

PART = 256
END = "<|end|>"
#: Groups that the parts of a long conversation are dealt into when its participants are joined to them.
SALTS = 64


def _safe(c: Column) -> Column:
    return F.replace(c, F.lit("<|"), F.lit("< |"))


def _placed(turns: DataFrame) -> DataFrame:
    """Distinct turns with `place`, from 0 within the conversation, and `total`, its number of turns."""
    role = F.regexp_replace(F.replace(_safe(F.coalesce("role", F.lit("unknown"))), F.lit("|>"), F.lit("| >")), r"[\r\n]", " ")
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), _safe(F.coalesce("text", F.lit(""))).alias("text")).distinct()
    order = ["conv_id", "turn", "role", "text"]  # nulls first
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    rows = C.written(rows, "turns").withColumn("range", F.shiftright("at", 33))
    # one row per conversation and partition: a conversation has as many as there are partitions at most
    runs = rows.groupBy("conv_id", "range").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    of_conv = Window.partitionBy("conv_id")
    earlier = of_conv.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(F.col("conv_id").alias("of_conv"), F.col("range").alias("of_range"), (F.col("first") - F.coalesce(F.sum("n").over(earlier), F.lit(0))).alias("zero"), F.sum("n").over(of_conv).alias("total"))
    same = F.col("conv_id").eqNullSafe(F.col("of_conv")) & (F.col("range") == F.col("of_range"))
    return rows.join(runs, same).select("conv_id", "role", "text", (F.col("at") - F.col("zero")).alias("place"), "total")


def perspectives(turns: DataFrame, part: int = PART) -> DataFrame:
    """One row per conversation, participant and part: conv_id, perspective, part, n_turns, text, mask ("from-to" joined
    by commas), mask_chars."""
    rows = _placed(turns).withColumn("part", F.floor(F.col("place") / part))
    salts = F.least(F.lit(SALTS), F.ceil(F.col("total") / part)).cast("int")
    speakers = rows.filter("role <> 'system'").select(F.col("conv_id").alias("of_conv"), F.col("role").alias("perspective"), salts.alias("salts")).distinct()
    speakers = speakers.select("of_conv", "perspective", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    parts = rows.groupBy("conv_id", "part").agg(F.array_sort(F.collect_list(F.struct("place", "role", "text"))).alias("turns"), F.first(salts).alias("salts"))
    each = parts.join(speakers, F.col("conv_id").eqNullSafe(F.col("of_conv")) & (F.col("part") % F.col("salts") == F.col("salt")))

    def head(t: Column) -> Column:
        named = F.concat(F.lit("<|user name="), t["role"], F.lit("|>\n"))
        return F.when(t["role"] == "system", F.lit("<|system|>\n")).when(t["role"] == F.col("perspective"), F.lit("<|assistant|>\n")).otherwise(named)

    pieces = F.transform("turns", lambda t: F.struct(head(t).alias("head"), F.concat(t["text"], F.lit(END)).alias("body"), (t["role"] == F.col("perspective")).alias("own")))
    each = each.withColumn("pieces", pieces)
    sizes = F.transform("pieces", lambda p: F.struct(F.length(p["head"]).cast("long").alias("head"), F.length(p["body"]).cast("long").alias("body"), p["own"].alias("own")))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("spans"), F.lit(0).cast("long").alias("chars"))

    def step(acc: Column, p: Column) -> Column:
        begin = acc["at"] + p["head"]
        end = begin + p["body"]
        span = F.concat(begin.cast("string"), F.lit("-"), end.cast("string"))
        return F.struct((end + 1).alias("at"), F.when(p["own"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"), (acc["chars"] + F.when(p["own"], p["body"]).otherwise(F.lit(0).cast("long"))).alias("chars"))

    each = each.withColumn("m", F.aggregate(sizes, zero, step))
    text = F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit("\n"))), "")
    return each.select("conv_id", "perspective", F.col("part").cast("long").alias("part"), F.size("turns").cast("long").alias("n_turns"), text.alias("text"), F.array_join("m.spans", ",").alias("mask"), F.col("m.chars").alias("mask_chars"))


ORACLE_SQL = r"""
WITH r AS (SELECT DISTINCT conv_id, turn, regexp_replace(replace(replace(coalesce(role, 'unknown'), '<|', '< |'), '|>', '| >'), '[\r\n]', ' ', 'g') AS role, replace(coalesce(text, ''), '<|', '< |') AS text FROM conversations),
p AS (SELECT *, (row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1) AS place FROM r),
s AS (SELECT DISTINCT conv_id, role AS perspective FROM p WHERE role <> 'system'),
e AS (SELECT p.conv_id, perspective, place // 256 AS part, place, text || '<|end|>' AS body, role = perspective AS own,
             CASE WHEN role = 'system' THEN '<|system|>' WHEN role = perspective THEN '<|assistant|>' ELSE '<|user name=' || role || '|>' END || chr(10) AS head
      FROM p JOIN s ON p.conv_id IS NOT DISTINCT FROM s.conv_id),
a AS (SELECT *, sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, perspective, part ORDER BY place ROWS UNBOUNDED PRECEDING) - length(body) - 1 AS b FROM e)
SELECT conv_id, perspective, part::BIGINT AS part, count(*) AS n_turns, string_agg(head || body || chr(10), '' ORDER BY place) AS text,
       string_agg(CASE WHEN own THEN b::BIGINT::VARCHAR || '-' || (b + length(body))::BIGINT::VARCHAR END, ',' ORDER BY place) AS mask,
       sum(CASE WHEN own THEN length(body) ELSE 0 END)::BIGINT AS mask_chars
FROM a GROUP BY conv_id, perspective, part"""
