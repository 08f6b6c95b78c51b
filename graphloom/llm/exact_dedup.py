"""Exact dedup of an incoming batch against an immutable snapshot, screened by static binary-fuse filters.

The snapshot's distinct digests are dealt into shards by their first bits; one binary-fuse filter (8-bit fingerprints,
9 to 10 bits a key) is built per shard and never changes. Duplicates within the new batch are grouped by digest first, so
each distinct incoming digest is screened once, whatever its number of copies. Negatives cannot be in the snapshot;
positives are joined to the snapshot's exact buckets by digest, and their texts compared byte for byte.

Digest: SHA-256 of the normalised text (each run of [\\x20\\x09-\\x0D] is one space).

Inputs: null text counts as empty; a long text is digested whole; the smallest doc_id of a group stays (of a shared doc_id
every row, of null ids only if the group has no other: keep_id is null then); doc_id may be a text; extra columns are
ignored; an empty batch or snapshot is allowed.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Snapshot digests that one filter should hold.
SHARD_KEYS = 1_000_000
_MASK = (1 << 64) - 1


def normalised(text: Column | str) -> Column:
    return F.regexp_replace(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), C.SPACE, " ")


# ---- binary-fuse filter: three cells in neighbouring segments ----


def _layout(n: int) -> tuple[int, int]:
    """(segment length, number of start segments) for n keys."""
    length = 1 << min(18, int(np.floor(np.log(max(n, 2)) / np.log(3.33) + 2.25)))
    factor = max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 2)))
    return length, max(1, int(np.ceil(n * factor / length)) - 2 + 1)


def _cells(keys: np.ndarray, seed: int, length: int, starts: int) -> tuple[np.ndarray, np.ndarray]:
    """The three cells and the 8-bit fingerprint of each key."""
    with np.errstate(over="ignore"):
        h = C.mix(keys + np.uint64(seed))
        g = C.mix(h ^ np.uint64(0xA0761D6478BD642F))
    first = ((h >> np.uint64(32)) * np.uint64(starts) >> np.uint64(32)).astype(np.int64)
    m = np.uint64(length - 1)
    low = np.stack([(g & m), (g >> np.uint64(20)) & m, (g >> np.uint64(40)) & m]).astype(np.int64)
    return (first + np.arange(3)[:, None]) * length + low, (h & np.uint64(255)).astype(np.uint8)


def build_filter(keys: np.ndarray) -> tuple[int, int, int, bytes]:
    """(seed, segment length, start segments, fingerprints) for distinct uint64 keys. Cells with one key left are peeled
    in rounds; fingerprints are set in reverse order, so that the three cells of a key XOR to its fingerprint."""
    length, starts = _layout(len(keys))
    size = (starts + 2) * length
    for seed in range(1, 200):
        cells, prints = _cells(keys, (seed * 0x9E3779B97F4A7C15) & _MASK, length, starts)
        count = np.bincount(cells.ravel(), minlength=size)
        total = np.zeros(size, np.int64)
        for c in cells:
            np.add.at(total, c, np.arange(len(keys)))
        gone, rounds = np.zeros(len(keys), bool), []
        while True:
            alone = np.flatnonzero(count == 1)
            if not len(alone):
                break
            key, where = np.unique(total[alone], return_index=True)
            at = alone[where]
            gone[key] = True
            rounds.append((key, at))
            for c in cells[:, key]:
                np.subtract.at(count, c, 1)
                np.subtract.at(total, c, key)
        if gone.all():
            table = np.zeros(size, np.uint8)
            for key, at in reversed(rounds):
                c = cells[:, key]
                table[at] = 0
                table[at] = prints[key] ^ table[c[0]] ^ table[c[1]] ^ table[c[2]]
            return seed, length, starts, table.tobytes()
        length, starts = (length, starts + 1) if seed % 8 else (length * 2, max(1, starts // 2))
        size = (starts + 2) * length
    raise RuntimeError("no filter found; are the keys distinct?")


def screen(keys: np.ndarray, seed: int, length: int, starts: int, table: bytes) -> np.ndarray:
    """Whether each key may be in the filter: never false for one that is."""
    cells, prints = _cells(keys, (seed * 0x9E3779B97F4A7C15) & _MASK, length, starts)
    t = np.frombuffer(table, np.uint8)
    return (t[cells[0]] ^ t[cells[1]] ^ t[cells[2]]) == prints


def _filter_of(shard: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    seed, length, starts, table = build_filter(np.unique(rows["head"].to_numpy().view(np.uint64)))
    return pd.DataFrame({"shard": [shard[0]], "seed": [seed], "length": [length], "starts": [starts], "cells": [table]})


def _screened(incoming: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
    if not len(incoming) or not len(filters):
        return incoming[["digest"]].iloc[:0]
    f = filters.iloc[0]
    ok = screen(incoming["head"].to_numpy().view(np.uint64), int(f["seed"]), int(f["length"]), int(f["starts"]), f["cells"])
    return incoming.loc[ok, ["digest"]]


def snapshot_filters(snapshot: DataFrame, shards: int) -> DataFrame:
    """(shard, seed, length, starts, cells): one filter per shard of snapshot (digest, head), head being its first long."""
    keys = snapshot.select(F.pmod(F.shiftrightunsigned("head", 20), F.lit(shards)).cast("int").alias("shard"), "head")
    return keys.groupBy("shard").applyInPandas(_filter_of, "shard int, seed long, length long, starts long, cells binary")


def deduplicate(incoming: DataFrame, snapshot: DataFrame | None = None, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """One row per row of both inputs (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256."""
    if snapshot is None:
        snapshot = incoming.limit(0)
    both = incoming.select("doc_id", "text", F.lit(True).alias("new")).unionByName(snapshot.select("doc_id", "text", F.lit(False).alias("new")))
    return _deduplicate(both, shard_keys)


def deduplicate_split(docs: DataFrame, is_new: Column, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """As deduplicate(), with snapshot and batch in one table: rows with is_new are the batch. The table is read once for
    the digests."""
    return _deduplicate(docs.select("doc_id", "text", F.coalesce(is_new, F.lit(True)).alias("new")), shard_keys)


def _deduplicate(both: DataFrame, shard_keys: int) -> DataFrame:
    kind = dict(both.dtypes)["doc_id"]
    text = both.select("doc_id", "new", normalised("text").alias("norm"))
    digests = text.select("doc_id", "new", F.unhex(F.sha2("norm", 256)).alias("digest"), F.octet_length("norm").alias("n"))
    digests = C.written(digests, "digests")  # 32 bytes a document; read several times
    # Copies within each side are grouped by digest (and length) first: partial sums keep a hot group off one task.
    groups = C.checkpointed(digests.groupBy("digest", "n", "new").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies")))
    groups = groups.withColumn("head", F.conv(F.hex(F.substring("digest", 1, 8)), 16, -10).cast("long"))
    old, new = groups.filter("NOT new"), groups.filter("new")
    shards = max(1, -(-old.count() // shard_keys))
    filters = snapshot_filters(old, shards)
    # A group of incoming digests is screened by one copy of its shard's filter: as many copies as keep a group small,
    # however small the snapshot is.
    copies = max(1, -(-new.count() // (shards * shard_keys)))
    filters = filters.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    shard, salt = F.pmod(F.shiftrightunsigned("head", 20), F.lit(shards)), F.pmod(F.shiftrightunsigned("head", 44), F.lit(copies))
    keys = new.select(shard.cast("int").alias("shard"), salt.cast("int").alias("salt"), "head", "digest")
    may = keys.groupBy("shard", "salt").cogroup(filters.groupBy("shard", "salt")).applyInPandas(_screened, "digest binary")
    hit = may.join(new.select("digest", "n", F.col("first_id").alias("new_id")), "digest").join(old.select("digest", "n", F.col("first_id").alias("old_id")), ["digest", "n"])
    hit = C.checkpointed(hit)
    # Byte check of each positive's two texts, one for either side, whatever the number of copies.
    wanted = hit.select("digest", F.col("new_id").alias("doc_id"), F.lit(True).alias("new")).unionByName(hit.select("digest", F.col("old_id").alias("doc_id"), F.lit(False).alias("new")))
    texts = text.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "new", "norm", F.unhex(F.sha2("norm", 256)).alias("digest"))
    texts = texts.join(wanted, ["digest", "doc_id", "new"], "left_semi").groupBy("digest", "new").agg(F.min("norm").alias("lo"), F.max("norm").alias("hi"))
    same = texts.groupBy("digest").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).select("digest", (F.col("lo") == F.col("hi")).alias("equal"))
    # A text under a null doc_id cannot be fetched by id; its digest and length decide.
    merged = hit.join(same, "digest", "left").filter(F.coalesce("equal", F.lit(True))).select("digest", "n", F.lit(True).alias("merged"))
    placed = groups.join(merged, ["digest", "n"], "left").withColumn("side", F.when(F.coalesce("merged", F.lit(False)), F.lit(False)).otherwise(F.col("new")))
    totals = placed.groupBy("digest", "n", "side").agg(F.min("first_id").alias("keep_id"), F.sum("copies").alias("group_size"))
    of_group = placed.select("digest", "n", "new", "side").join(totals, ["digest", "n", "side"]).select("digest", "n", "new", "keep_id", "group_size")
    out = digests.join(of_group, ["digest", "n", "new"])
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return out.select("doc_id", F.col("keep_id").cast(kind).alias("keep_id"), F.col("group_size").cast("long").alias("group_size"), kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
