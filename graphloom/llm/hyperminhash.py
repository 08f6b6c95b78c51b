"""MinHash near-dedup with HyperMinHash registers.

A document's set is its distinct SHINGLE-word shingles (A-Z lower-cased). Each shingle is hashed once: its top bits choose
one of REGISTERS buckets, and the smallest rest in a bucket is stored as its number of leading zeros and MANTISSA bits.
An empty bucket borrows a filled one by a fixed random order (the same for all documents). BANDS bands of registers make
candidate groups; within a group pairs are proposed from hubs, never all pairs: first the member that stands in the most
crowded groups; then, where a group is still spread over several components, its members outside the hub's component,
against those whose shingles leave a similarity at the threshold possible. A proposal is dropped if the collision-
corrected Jaccard estimate is far below the threshold; the rest are confirmed on the full sets.

A pair at similarity 0.8 misses all 32 bands of 4 registers with probability (1 - 0.8**4)**32 = 5e-8.

Inputs: a row without words has an empty set and is linked with nothing; one with fewer than SHINGLE words has its whole
sequence as its one shingle; a text of any length is one set, hashed whole. Rows of equal sets form a class and are never
paired with each other. doc_id may be a text, null or shared (rows are numbered then): the smallest non-null doc_id reachable
names the component (null if there is none), and each row that has it is kept. Extra columns are ignored. An empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

REGISTERS, BANDS, MANTISSA = 128, 32, 10
BITS = REGISTERS.bit_length() - 1
#: Attempts to fill an empty register by the random order before the next filled one to the right is taken.
DENSIFY = 128
#: An estimate this far under the threshold cannot belong to a similar pair: over eight standard deviations at 128 registers.
SLACK = 0.3
#: Bits that bound a difference from below.
PARITY = 1024

_order = np.random.default_rng(7).integers(0, REGISTERS, (DENSIFY, REGISTERS))


def _lower(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def _sets(batch: pa.RecordBatch, shingle: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row of the text column (column 1)."""
    data, off = C.text_buffers(batch.column(1))
    for lo, hi in C.steps(off):
        part, starts, ends, row = C.word_spans(data, off, lo, hi)
        words = C.word_hashes(_lower(part), starts, ends)
        at, counts = C.at_in_row(row, hi - lo, lo)
        begins = np.concatenate([[0], np.cumsum(counts)])
        n = counts[row - lo]
        whole = np.flatnonzero((n < shingle) & (at == 0))
        full = np.flatnonzero(at + shingle <= n)
        hashes = np.zeros(len(row), np.uint64)
        if len(full):
            hashes[full] = C.run_hashes(words, full, shingle)
        for i in whole:
            hashes[i] = C.run_hashes(words[i : i + n[i]], np.zeros(1, np.int64), int(n[i]))[0]
        for r in range(hi - lo):
            yield np.unique(hashes[begins[r] : begins[r] + (max(counts[r] - shingle + 1, 1) if counts[r] else 0)])


def _registers(sets: list[np.ndarray]) -> np.ndarray:
    """(len(sets), REGISTERS) uint16: leading zeros and mantissa of each bucket's smallest rest, empty buckets filled."""
    rest_bits = 64 - BITS
    edges = np.arange(REGISTERS, dtype=np.uint64) << np.uint64(rest_bits)
    rest = np.zeros((len(sets), REGISTERS), np.uint64)
    filled = np.zeros((len(sets), REGISTERS), bool)
    for i, s in enumerate(sets):
        if len(s):
            first = np.searchsorted(s, edges)
            last = np.concatenate([first[1:], [len(s)]])
            filled[i] = first < last
            rest[i] = s[np.minimum(first, len(s) - 1)]
    mask = np.uint64((1 << rest_bits) - 1)
    rest &= mask
    value = np.maximum(rest, 1)
    length = np.floor(np.log2(value.astype(np.float64))).astype(np.int64)
    length = np.where(value >> length.clip(0, 63).astype(np.uint64) == 0, length - 1, length)  # a double may round up
    zeros = rest_bits - 1 - length
    up = (rest_bits - 1 - length).astype(np.uint64)
    mantissa = ((value << up) & np.uint64((1 << (rest_bits - 1)) - 1)) >> np.uint64(rest_bits - 1 - MANTISSA)
    out = (zeros.astype(np.uint16) << np.uint16(MANTISSA)) | mantissa.astype(np.uint16)
    rows = np.flatnonzero(filled.any(1) & ~filled.all(1))
    have, source, block = filled[rows], out[rows], out[rows]
    need = ~have
    for order in _order:
        if not len(rows):
            break
        take = need & have[:, order]
        block = np.where(take, source[:, order], block)
        need &= ~take
        more = need.any(1)
        out[rows[~more]] = block[~more]
        rows, have, source, block, need = rows[more], have[more], source[more], block[more], need[more]
    for i, row in enumerate(rows):
        at = np.flatnonzero(have[i])
        right = at[np.searchsorted(at, np.arange(REGISTERS)) % len(at)]
        out[row] = np.where(need[i], source[i][right], block[i])
    return out


def _sign(batches: Iterator[pa.RecordBatch], shingle: int, least: int) -> Iterator[pa.RecordBatch]:
    """(row_key, text) to the set's size, a 128-bit digest of it and its bands, a long of four registers each."""
    for batch in batches:
        sizes, d1, d2, bands = [], [], [], [np.zeros((0, REGISTERS), np.uint16)]
        held: list[np.ndarray] = []
        for s in _sets(batch, shingle):
            sizes.append(len(s))
            a, b = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64)
            d1.append(a)
            d2.append(b)
            held.append(s if len(s) >= least else s[:0])  # a smaller set is similar to equal ones only
            if len(held) == 512:
                bands.append(_registers(held))
                held = []
        bands.append(_registers(held))
        flat = np.ascontiguousarray(np.concatenate(bands)).view(np.int64).ravel()
        offsets = np.arange(0, len(flat) + 1, BANDS, dtype=np.int32)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["row_key", "n_shingles", "d1", "d2", "bands"])


def _set_rows(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    """The set of each row, and for each of PARITY residues of the hashes whether an odd number of members has it: two
    sets differ in at least as many members as these bits differ."""
    for batch in batches:
        sets = list(_sets(batch, shingle))
        odd = [np.packbits(np.bincount((s % np.uint64(PARITY)).astype(np.int64), minlength=PARITY) & 1).view(np.int64).tolist() for s in sets]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array(odd, pa.list_(pa.int64()))], ["cls", "members", "odd"])


def _each_shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [np.frombuffer(x.as_py(), np.int64) for x in batch.column("members")]
        sizes = [len(x) for x in sets]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*sets, np.zeros(0, np.int64)])), pa.array(np.repeat(batch.column("cls").to_numpy(), sizes))], ["h", "cls"])


def chance_of_collision(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """How often two different minima of sets of n and m members give one register: over the leading zeros k, the chance
    that both minima have k of them, by 2**-MANTISSA for the mantissa."""
    k = np.arange(1, 58)
    out = np.zeros(len(n))
    per = [np.maximum(x / REGISTERS, 1.0)[:, None] for x in (n, m)]
    p = [np.exp(-x * 2.0**-k) - np.exp(-x * 2.0 ** -(k - 1.0)) for x in per]
    out = (p[0] * p[1]).sum(1)
    return out / (1 << MANTISSA)


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The Jaccard similarity by register rows a and b (uint16) of sets of n and m members, less chance collisions."""
    same = (a == b).mean(1)
    c = chance_of_collision(n, m)
    return (same - c) / (1 - c)


def _likely(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b, their sizes and bands) whose sizes and estimate leave a similarity of `threshold` possible."""
    for batch in batches:
        a, b = (batch.column(c).flatten().to_numpy().view(np.uint16).reshape(-1, REGISTERS) for c in ("bands_a", "bands_b"))
        n, m = (batch.column(c).to_numpy() for c in ("n_a", "n_b"))
        ok = (np.minimum(n, m) >= threshold * np.maximum(n, m) - 1e-9) & (estimate(a, b, n, m) >= threshold - SLACK)
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(ok)), batch.column("b").filter(pa.array(ok))], ["a", "b"])


def _confirmed(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Pairs with both full sets whose exact similarity reaches the threshold (in whole hundredths of it)."""
    percent = round(threshold * 100)
    for batch in batches:
        ok = []
        for x, y in zip(batch.column("set_a"), batch.column("set_b")):
            x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
            both = np.concatenate([x, y])
            both.sort()
            shared = int((both[1:] == both[:-1]).sum())
            ok.append(100 * shared >= percent * (len(both) - shared))
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(ok, pa.bool_())), batch.column("b").filter(pa.array(ok, pa.bool_()))], ["a", "b"])


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(cls, comp): the smallest cls reachable over links (a, b), a table that is read once a round and may hold a pair twice.

    A round takes the least label of the neighbours, a written step, and is the last if that changes nothing. Otherwise each
    label is followed to the least label that its own members took, so that a long chain takes logarithmically many rounds.
    A lost executor costs one step."""
    ends = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    both = links.select(F.inline(ends).alias("a", "b"))
    # before the first round each class is its own label
    step = both.groupBy(F.col("a").alias("cls")).agg(F.min("b").alias("near")).select("cls", F.col("cls").alias("old"), F.least("cls", "near").alias("comp"))
    while True:
        step = C.checkpointed(step)
        if not step.filter("comp < old").limit(1).count():
            break
        to = step.groupBy(F.col("old").alias("root")).agg(F.min("comp").alias("jump"))
        labels = C.checkpointed(step.join(to, step["comp"] == to["root"], "left").select("cls", F.least("comp", F.coalesce("jump", "comp")).alias("comp")))
        near = both.join(labels, both["b"] == labels["cls"]).groupBy("a").agg(F.min("comp").alias("near"))
        step = labels.join(near, labels["cls"] == near["a"]).select("cls", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
    labels = step.select("cls", "comp")
    return nodes.join(labels, "cls", "left").select("cls", F.coalesce("comp", "cls").alias("comp"))


def near_duplicates(docs: DataFrame, shingle: int = 5, threshold: float = 0.8) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_shingles, component_id, kept (doc_id = component_id)."""
    if not 0.5 <= threshold < 1:
        raise ValueError("the threshold lies in [0.5, 1)")
    least = int(np.ceil(threshold / (1 - threshold) - 1e-9))
    by_id = C.unique_ids(docs)
    rows = docs.select("doc_id", "text")
    rows = rows.withColumn("row_key", F.col("doc_id").cast("long")) if by_id else C.numbered(rows)
    kind = dict(rows.dtypes)["doc_id"]
    signed = rows.select("row_key", "text").mapInArrow(lambda it: _sign(it, shingle, least), "row_key long, n_shingles long, d1 long, d2 long, bands array<long>")
    signed = C.written(signed, "signatures")
    classes = C.checkpointed(signed.filter("n_shingles > 0").groupBy("d1", "d2").agg(F.min("row_key").alias("cls"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")))
    bands = classes.filter(F.col("n") >= least).select("cls", F.posexplode("bands").alias("band", "value"))
    crowded = bands.groupBy("band", "value").agg(F.count("*").alias("crowd")).filter("crowd > 1")
    members = C.checkpointed(bands.join(crowded, ["band", "value"]))
    crowd = members.groupBy("cls").agg(F.sum("crowd").alias("pop"))
    nodes = C.checkpointed(crowd.join(classes, "cls").select("cls", "pop", "n", "bands"))
    members = members.join(nodes.select("cls", "pop"), "cls").select("band", "value", "cls", "pop")
    texts = rows.select("row_key", "text").join(nodes.select(F.col("cls").alias("row_key")), "row_key", "left_semi")
    sets = C.written(texts.mapInArrow(lambda it: _set_rows(it, shingle), "cls long, members binary, odd array<long>"), "sets")

    def confirmed(pairs: DataFrame) -> DataFrame:
        side = lambda x: nodes.select(F.col("cls").alias(x), F.col("n").alias(f"n_{x}"), F.col("bands").alias(f"bands_{x}"))
        likely = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "bands_a", "bands_b").mapInArrow(lambda it: _likely(it, threshold), "a long, b long")
        whole = lambda x: sets.select(F.col("cls").alias(x), F.col("members").alias(f"set_{x}"))
        return likely.join(whole("a"), "a").join(whole("b"), "b").mapInArrow(lambda it: _confirmed(it, threshold), "a long, b long")

    def proposed(hubs: DataFrame, others: DataFrame) -> DataFrame:
        return others.join(hubs, ["band", "value"]).filter("cls <> hub").select(F.least("cls", "hub").alias("a"), F.greatest("cls", "hub").alias("b")).distinct()

    hubs = members.groupBy("band", "value").agg(F.max_by("cls", F.struct("pop", -F.col("cls"))).alias("hub"))
    links = C.checkpointed(confirmed(proposed(hubs, members.select("band", "value", "cls"))))
    labels = C.checkpointed(components(nodes.select("cls"), links))
    # Groups that are still spread over several components. Any pair that could join two of them has a member outside the
    # hub's component. A shingle that no other open class has cannot be shared: with `rest` shared ones at most, a class
    # of n shingles reaches rest / n, and a pair I / (n + m - I) with I the smaller rest. That bound is exact and leaves
    # few: an outsider of a large family is one because of edits of its own.
    best = F.struct("pop", -F.col("cls"))
    now = members.join(labels, "cls")
    spread = now.groupBy("band", "value").agg(F.max_by("comp", best).alias("main"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("band", "value", "main")
    still = C.checkpointed(now.join(spread, ["band", "value"]).select("band", "value", "cls", "comp", "main"))
    ids = still.select("cls").distinct()
    each = sets.join(ids, "cls", "left_semi").mapInArrow(_each_shingle, "h long, cls long")
    own = each.groupBy("h").agg(F.count("*").alias("k"), F.min("cls").alias("cls")).filter("k = 1").groupBy("cls").agg(F.count("*").alias("own"))
    facts = nodes.select("cls", "n").join(ids, "cls", "left_semi").join(own, "cls", "left").select("cls", "n", (F.col("n") - F.coalesce("own", F.lit(0))).alias("rest"))
    percent = round(threshold * 100)
    facts = facts.filter(F.col("rest") * 100 >= F.col("n") * percent).join(sets.select("cls", "odd"), "cls")
    able = C.checkpointed(still.join(facts, "cls"))
    outside = able.filter("comp <> main").select("band", "value", *(F.col(c).alias(f"o_{c}") for c in ("cls", "comp", "n", "rest", "odd")))
    apart = sum((F.bit_count(F.col("odd")[i].bitwiseXOR(F.col("o_odd")[i])) for i in range(1, PARITY // 64)), F.bit_count(F.col("odd")[0].bitwiseXOR(F.col("o_odd")[0])))
    shared, both = F.least("rest", "o_rest"), F.col("n") + F.col("o_n")
    fits = (F.col("comp") != F.col("o_comp")) & ((F.col("comp") == F.col("main")) | (F.col("o_cls") < F.col("cls"))) & (shared * (100 + percent) >= both * percent)
    # the difference has n + m - 2 I members, `apart` at least
    fits = fits & (apart * (100 + percent) <= both * (100 - percent))
    pairs = able.join(outside, ["band", "value"]).filter(fits).select(F.least("cls", "o_cls").alias("a"), F.greatest("cls", "o_cls").alias("b")).distinct()
    more = C.checkpointed(confirmed(pairs))
    if more.limit(1).count():
        labels = components(nodes.select("cls"), links.unionByName(more))

    has = F.col("n_shingles") > 0
    of_class = classes.select("d1", "d2", "cls").join(labels, "cls", "left").select("d1", "d2", F.coalesce("comp", "cls").alias("comp"))
    placed = signed.select("row_key", "n_shingles", "d1", "d2").join(of_class, ["d1", "d2"], "left")
    if by_id:  # the key is doc_id, so the smallest of a component is its name already
        placed = placed.select(F.col("row_key").alias("doc_id"), "n_shingles", F.when(has, F.col("comp")).otherwise(F.col("row_key")).alias("name"))
        return placed.select(F.col("doc_id").cast(kind).alias("doc_id"), "n_shingles", F.col("name").cast(kind).alias("component_id"), (F.col("doc_id") == F.col("name")).alias("kept"))
    # the smallest doc_id of each class first, so that a component is joined by its classes and not by its rows
    ids = signed.select("row_key", "d1", "d2").join(rows.select("row_key", "doc_id"), "row_key")
    of_class = of_class.join(ids.groupBy("d1", "d2").agg(F.min("doc_id").alias("class_id")), ["d1", "d2"])
    first = of_class.groupBy("comp").agg(F.min("class_id").alias("first_id"))
    names = of_class.join(first, "comp").select("d1", "d2", "first_id")
    out = signed.select("row_key", "n_shingles", "d1", "d2").join(names, ["d1", "d2"], "left").join(rows.select("row_key", "doc_id"), "row_key")
    component = F.when(has, F.col("first_id")).otherwise(F.col("doc_id")).cast(kind)
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))
