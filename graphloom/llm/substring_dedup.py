"""Substring dedup: runs of words that repeat anywhere, found by difference-cover anchors.

A window is WINDOW consecutive words of one document. Residues COVER modulo PERIOD form a difference cover: for any two
positions i and j there is a shift below PERIOD that brings both onto covered positions. Two equal windows therefore
share an anchor of ANCHOR = WINDOW - PERIOD + 1 words that starts at a covered position in both, so hashing 5 of 21
positions finds every repeat. The windows round a repeated anchor are then hashed in full (the extension), and those
that occur twice mark the words that they cover.

Documents are read in blocks of some megabytes. Hashes are sent as packed rows of a block and a bucket (each hash of a
block once, with a mark if the block has it twice), and what comes back is a bit for each. So a passage in a third of all
documents sends one hash per block, and nothing is paired. The texts themselves are shuffled once, by block.

Both scans of the texts must give a partition's rows in the same order, as files do; a checksum of each block's hashes
goes along, and a block that differs is an error.

Inputs: a row without text or with fewer than WINDOW words keeps all its words; equal rows are two documents, so their
windows repeat; a text beyond a block's size is a block of its own; null, shared or text doc_ids are allowed (rows are known by block and place); extra columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common as C

WINDOW = 35
#: A perfect difference set; every residue modulo 21 is a difference of two of its members.
PERIOD = 21
COVER = (3, 6, 7, 12, 14)
#: Bytes of text in a block.
BLOCK_BYTES = 8 << 20
#: Buckets of hashes, at least and for each shuffle partition; a task holds one bucket at a time.
LEAST_BUCKETS, BUCKETS_A_PART = 64, 4
SALTS = (0x5851F42D4C957F2D, 0x14057B7EF767814F)


#: A hash as it is sent: 64 bits for anchors, 96 for windows.
ANCHOR_KIND, WINDOW_KIND = np.dtype([("h", "<u8")]), np.dtype([("h", "<u8"), ("g", "<u4")])


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) with the block of each row and its place there: the same in each scan, as the rows of a partition
    come in the same order."""
    from pyspark import TaskContext

    part, block, place, size = TaskContext.get().partitionId() << 31, 0, 0, 0
    for batch in batches:
        _, off = C.text_buffers(batch.column(1))
        blocks, places = [], []
        for n in np.diff(off).tolist():
            if size and size + n > BLOCK_BYTES:
                block, place, size = block + 1, 0, 0
            blocks.append(part + block)
            places.append(place)
            place, size = place + 1, size + n
        yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(places, pa.int32()), *batch.columns], ["block", "place", *batch.schema.names])


def _whole_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Array]]:
    """(block, texts) from numbered rows in order."""
    now, held = None, []
    for batch in batches:
        ids = batch.column("block").to_numpy()
        edges = np.concatenate([[0], np.flatnonzero(np.diff(ids)) + 1, [len(ids)]]) if len(ids) else []
        for lo, hi in zip(edges[:-1], edges[1:]):
            if now is not None and ids[lo] != now:
                yield now, pa.concat_arrays(held)
                held = []
            now = int(ids[lo])
            held.append(batch.column("text").slice(lo, hi - lo))
    if held:
        yield now, pa.concat_arrays(held)


def _anchor_hashes(texts: pa.Array, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, position) of the anchors of a block."""
    length, covered = window - PERIOD + 1, np.isin(np.arange(PERIOD), COVER)
    data, off = C.text_buffers(texts)
    found = [(np.zeros(0, ANCHOR_KIND), np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for lo, hi in C.steps(off):
        part, starts, ends, row = C.word_spans(data, off, lo, hi)
        at, counts = C.at_in_row(row, hi - lo, lo)
        n = counts[row - lo]
        use = np.flatnonzero(covered[at % PERIOD] & (at + length <= n) & (n >= window))
        if len(use):
            found.append((C.run_hashes(C.word_hashes(part, starts, ends), use, length).view(ANCHOR_KIND), row[use], at[use]))
    return tuple(np.concatenate(x) for x in zip(*found))


def _window_hashes(texts: pa.Array, window: int, marked: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, position) of the windows of a block that hold a repeated anchor; marked: their rows and positions."""
    data, off = C.text_buffers(texts)
    found = [(np.zeros(0, WINDOW_KIND), np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for lo, hi in C.steps(off):
        mine = (marked[0] >= lo) & (marked[0] < hi)
        if not mine.any():
            continue
        part, starts, ends, row = C.word_spans(data, off, lo, hi)
        at, counts = C.at_in_row(row, hi - lo, lo)
        begins = np.concatenate([[0], np.cumsum(counts)])
        hit = np.zeros(len(at) + PERIOD + 1, np.int64)
        hit[begins[marked[0][mine] - lo] + marked[1][mine]] = 1
        total = np.concatenate([[0], np.cumsum(hit)])
        here = np.arange(len(at))
        use = np.flatnonzero((at + window <= counts[row - lo]) & (total[here + PERIOD] > total[here]))
        if len(use):
            words = C.word_hashes(part, starts, ends)
            h = np.empty(len(use), WINDOW_KIND)
            h["h"], h["g"] = C.run_hashes(words, use, window, SALTS[0]), C.run_hashes(words, use, window, SALTS[1]) & np.uint64(0xFFFFFFFF)
            found.append((h, row[use], at[use]))
    return tuple(np.concatenate(x) for x in zip(*found))


def _by_bucket(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes in the order of bucket and value, their counts, where each bucket begins, and each row's place."""
    distinct, inverse, counts = np.unique(hashes, return_inverse=True, return_counts=True)
    bucket = (C.mix(distinct["h"]) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return distinct[order], counts[order], np.searchsorted(bucket[order], np.arange(buckets + 1)), place[inverse]


def _sent(block: int, hashes: np.ndarray, buckets: int) -> pa.RecordBatch:
    distinct, counts, begins, _ = _by_bucket(hashes, buckets)
    use = [b for b in range(buckets) if begins[b] < begins[b + 1]]
    rows = [distinct[begins[b] : begins[b + 1]].tobytes() for b in use]
    twice = [np.packbits(counts[begins[b] : begins[b + 1]] > 1).tobytes() for b in use]
    return pa.RecordBatch.from_arrays([pa.array([block] * len(use), pa.int64()), pa.array(use, pa.int32()), pa.array(rows, pa.binary()), pa.array(twice, pa.binary())], ["block", "bucket", "hashes", "twice"])


_SENT = "block long, bucket int, hashes binary, twice binary"


def _send_anchors(batches: Iterator[pa.RecordBatch], window: int, buckets: int) -> Iterator[pa.RecordBatch]:
    for block, texts in _whole_blocks(_numbered(batches)):
        yield _sent(block, _anchor_hashes(texts, window)[0], buckets)


def _answered(rows: list[tuple], kind: np.dtype) -> pa.RecordBatch:
    """All rows of one bucket to a bit for each hash: whether another block has it, or its own block twice. A checksum of
    the hashes goes back with the bits."""
    parts = [np.frombuffer(r[2], kind) for r in rows]
    _, inverse, counts = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
    more, lo = counts[inverse] > 1, 0
    out = []
    for r, p in zip(rows, parts):
        own = np.unpackbits(np.frombuffer(r[3], np.uint8), count=len(p)).astype(bool)
        out.append(_stamp(r[2]) + zlib.compress(np.packbits(own | more[lo : lo + len(p)]).tobytes(), 1))
        lo += len(p)
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array(out, pa.binary())], ["of_block", "bucket", "bits"])


def _repeats(batches: Iterator[pa.RecordBatch], kind: np.dtype) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket to their answers, one bucket at a time; a block's note (its bucket is negative) passes through."""
    now, rows = None, []
    for batch in batches:
        notes = pa.array(batch.column("bucket").to_numpy() < 0)
        passed = batch.filter(notes)
        if passed.num_rows:
            yield pa.RecordBatch.from_arrays([passed.column("block"), passed.column("bucket"), passed.column("hashes")], ["of_block", "bucket", "bits"])
        columns = [batch.column(c) for c in ("block", "bucket", "hashes", "twice")]
        for i in range(passed.num_rows, batch.num_rows):
            row = tuple(c[i].as_py() for c in columns)
            if row[1] != now and rows:
                yield _answered(rows, kind)
                rows = []
            now = row[1]
            rows.append(row)
    if rows:
        yield _answered(rows, kind)


def _stamp(hashes: bytes) -> bytes:
    return zlib.crc32(hashes).to_bytes(4, "little")


def _marks(hashes: np.ndarray, row: np.ndarray, at: np.ndarray, answers: pa.Table, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, position) of the hashes that the answers mark."""
    distinct, _, begins, place = _by_bucket(hashes, buckets)
    bits = np.zeros(len(distinct), bool)
    for b, raw in zip(answers.column("bucket").to_pylist(), answers.column("bits").to_pylist()):
        n = int(begins[b + 1] - begins[b])
        if raw[:4] != _stamp(distinct[begins[b] : begins[b + 1]].tobytes()):
            raise RuntimeError("a block differs between scans: the rows of a partition must come in the same order")
        bits[begins[b] : begins[b + 1]] = np.unpackbits(np.frombuffer(zlib.decompress(raw[4:]), np.uint8), count=n)
    return row[bits[place]], at[bits[place]]


def _in_order(docs: pa.Table) -> pa.Table:
    return docs.take(pa.array(np.argsort(docs.column("place").to_numpy(), kind="stable")))


def _send_windows(docs: pa.Table, answers: pa.Table, window: int, buckets: int) -> pa.Table:
    docs = _in_order(docs)
    if not docs.num_rows:
        return pa.Table.from_batches([_sent(0, np.zeros(0, WINDOW_KIND), buckets)])
    texts = docs.column("text").combine_chunks()
    found = _marks(*_anchor_hashes(texts, window), answers, buckets)
    hashes, row, at = _window_hashes(texts, window, found)
    # what the last step needs to know of the first comes back with the answers: the marked anchors
    sent = _sent(docs.column("block")[0].as_py(), hashes, buckets)
    packed = zlib.compress(np.stack(found).astype("<u4").tobytes(), 1)
    note = pa.RecordBatch.from_arrays([pa.array([docs.column("block")[0].as_py()], pa.int64()), pa.array([-1 - docs.column("block")[0].as_py() % buckets], pa.int32()), pa.array([packed], pa.binary()), pa.array([b""], pa.binary())], sent.schema.names)
    return pa.Table.from_batches([sent, note])


def _finish(docs: pa.Table, answers: pa.Table, window: int, buckets: int, with_text: bool) -> pa.Table:
    docs = _in_order(docs)
    own = answers.column("bucket").to_numpy() < 0
    texts = docs.column("text").combine_chunks()
    note = answers.filter(pa.array(own))
    found = np.frombuffer(zlib.decompress(note.column("bits")[0].as_py()), "<u4").reshape(2, -1).astype(np.int64)
    row, at = _marks(*_window_hashes(texts, window, (found[0], found[1])), answers.filter(pa.array(~own)), buckets)
    order = np.argsort(row, kind="stable")
    moff = np.searchsorted(row[order], np.arange(docs.num_rows + 1))
    return pa.Table.from_batches([_cut(docs.column("doc_id").combine_chunks(), texts, at[order], moff, window, with_text)])


def _cut(ids: pa.Array, texts: pa.Array, marks: np.ndarray, moff: np.ndarray, window: int, with_text: bool) -> pa.RecordBatch:
    """Documents and the starts of their repeated windows to counts, the kept words' hash and, if asked for, the kept text."""
    data, off = C.text_buffers(texts)
    n_words, n_removed, digests, kept_texts, lows, highs = [], [], [], [], [], []
    for lo, hi in C.steps(off):
        part, starts, ends, row = C.word_spans(data, off, lo, hi)
        _, counts = C.at_in_row(row, hi - lo, lo)
        begins = np.concatenate([[0], np.cumsum(counts)])
        raw = part.tobytes()
        for r in range(lo, hi):
            b, n = begins[r - lo], int(counts[r - lo])
            step = np.zeros(n + 1, np.int64)
            at = marks[moff[r] : moff[r + 1]]
            np.add.at(step, at, 1)
            np.add.at(step, np.minimum(at + window, n), -1)
            gone = np.cumsum(step[:-1]) > 0
            edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]])))
            spans = edges.reshape(-1, 2)
            if len(spans):
                pieces, have = [], 0
                for x, y in [*spans.tolist(), (n, n)]:
                    pieces += raw[starts[b + have] : ends[b + x - 1]].split() if x > have else []
                    have = y
                kept = b" ".join(pieces)
            else:
                kept = b" ".join(raw[starts[b] : ends[b + n - 1]].split()) if n else b""
            n_words.append(n)
            n_removed.append(int(gone.sum()))
            digests.append(hashlib.sha256(kept).hexdigest())
            lows.append(spans[:, 0].tolist())
            highs.append(spans[:, 1].tolist())
            if with_text:
                kept_texts.append(kept.decode())
    out = [ids, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string()), pa.array(lows, pa.list_(pa.int32())), pa.array(highs, pa.list_(pa.int32()))]
    names = ["doc_id", "n_words", "n_removed", "kept_sha256", "removed_from", "removed_to"]
    if with_text:
        out, names = [*out, pa.array(kept_texts, pa.string())], [*names, "kept_text"]
    return pa.RecordBatch.from_arrays(out, names)


def remove_repeats(docs: DataFrame, window: int = WINDOW, with_text: bool = False) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_words, n_removed, kept_sha256, the removed word spans
    [removed_from, removed_to) and, with_text, kept_text: the kept words joined by one space."""
    if window < PERIOD:
        raise ValueError(f"a window has at least {PERIOD} words")
    rows = docs.select("doc_id", "text")
    kind = dict(rows.dtypes)["doc_id"]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(LEAST_BUCKETS, BUCKETS_A_PART * parts)
    bits = "of_block long, bucket int, bits binary"
    anchors = rows.mapInArrow(lambda it: _send_anchors(it, window, buckets), _SENT).repartition(parts, "bucket").sortWithinPartitions("bucket")
    near = anchors.mapInArrow(lambda it: _repeats(it, ANCHOR_KIND), bits)
    # Both steps group the same rows by block: the texts are shuffled once, and that exchange is used again.
    blocks = rows.mapInArrow(_numbered, f"block long, place int, doc_id {kind}, text string")
    windows = blocks.groupBy("block").cogroup(near.groupBy("of_block")).applyInArrow(lambda a, b: _send_windows(a, b, window, buckets), _SENT)
    repeats = windows.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(lambda it: _repeats(it, WINDOW_KIND), bits)
    out = f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string, removed_from array<int>, removed_to array<int>" + (", kept_text string" if with_text else "")
    return blocks.groupBy("block").cogroup(repeats.groupBy("of_block")).applyInArrow(lambda a, b: _finish(a, b, window, buckets, with_text), out)
