"""Byte-level BPE over a whole corpus: each distinct pre-token is encoded once.

Documents are exploded, a block of them at a time, into their pre-tokens by position, kept as codes into the block's own
word list. One pass over the texts gives both: the codes are dealt by block and the word lists (not the occurrences) by a
hash of the word, in packed rows of a block and a bucket. Each distinct word is encoded once, and its ids are joined back
to the blocks' codes, where every document is put together by position. What crosses the network grows with the distinct
words of the blocks, not with the rows that an exploded table would have: one very common word is sent at most once from
each block.

Decoding joins the token-byte table (one row per token of the vocabulary file: 50,256, so it is broadcast) to the distinct
ids of each block; the documents' ids then become bytes by what was joined. decode() is the same join for tables of ids
from elsewhere.

Inputs: null text counts as empty (no tokens); repeated rows and null or shared doc_ids give one result row each, and a
doc_id that is no whole number becomes null; extra columns are ignored; an empty table gives an empty result. A very long
text is a block of its own. A block whose word list and codes stem from different runs of a task (a lost executor, and a
source that gives its rows in another order) is an error, told by a checksum.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of text in a block.
BLOCK_CHARS = 4_000_000
#: Unicode's White_Space property.
WHITE = "\t-\r \x85\xa0" + "".join(map(chr, (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
#: The pre-token pattern never lets a match run on over these pieces: white space, but for a last space, ends a match.
PIECES = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")


#: Least number of buckets that a block's word list is dealt into by a hash of the word; as many as shuffle partitions.
BUCKETS = 64


class _Codes(dict):
    """Within one block: piece of text -> the codes of its pre-tokens as little-endian uint32."""

    def __init__(self, find):
        self.find, self.words = find, {}

    def code(self, word: str) -> bytes:
        return self.words.setdefault(word, len(self.words)).to_bytes(4, "little")

    def __missing__(self, piece: str) -> bytes:
        core = piece[1:] if piece[0] == " " else piece
        if core.isalpha():
            out = self.code(piece)
        elif core[-1:] in (",", ".") and core[:-1].isalpha():
            out = self.code(piece[:-1]) + self.code(piece[-1])
        else:
            out = b"".join(map(self.code, self.find(piece)))
        self[piece] = out
        return out


def _packed(*parts: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(b"".join(parts))


def _unpacked(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _pack_words(words: list[str], codes: np.ndarray, stamp: int) -> bytes:
    raw = [w.encode() for w in words]
    head = np.array([len(raw), stamp], "<u4").tobytes() + np.diff(codes, prepend=0).astype("<u4").tobytes() + np.array([len(r) for r in raw], "<u4").tobytes()
    return _packed(head, *raw)


def _unpack_words(packed: bytes) -> tuple[list[bytes], np.ndarray, int]:
    """(words, steps of their codes, stamp of the block)"""
    data = _unpacked(packed)
    n, stamp = np.frombuffer(data, "<u4", 2).tolist()
    codes, ends = np.frombuffer(data, "<u4", n, 8), np.cumsum(np.frombuffer(data, "<u4", n, 8 + 4 * n)).tolist()
    text, at, out = data[8 + 8 * n :], 0, []
    for e in ends:
        out.append(text[at:e])
        at = e
    return out, codes, stamp


#: A row of codes (key: its block) or of words (key: -1 - bucket).
_BLOCKS = "key long, block long, ids array<long>, lengths array<int>, data binary"


def _blocks(batches: Iterator[pa.RecordBatch], pattern: str, n_buckets: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to a row per block with the codes of its documents by position, and rows with its word list dealt
    into buckets."""
    import regex
    from pyspark import TaskContext

    part, number, find = TaskContext.get().partitionId(), 0, regex.compile(pattern).findall

    def out(ids: list, lengths: list, texts: list, codes: _Codes) -> pa.RecordBatch:
        nonlocal number
        block = (part << 31) + number
        number += 1
        stamp = zlib.crc32("\n".join(codes.words).encode())
        buckets: list[list] = [[] for _ in range(n_buckets)]
        for w in codes.words:
            buckets[zlib.crc32(w.encode()) % n_buckets].append(w)
        use = [b for b in range(n_buckets) if buckets[b]]
        words = [_pack_words(buckets[b], np.array([codes.words[w] for w in buckets[b]], np.int64), stamp) for b in use]
        flat = np.frombuffer(b"".join(texts), "<u4")
        wide = 4 if len(codes.words) > 65536 else 2
        planes = np.concatenate([flat & 255, *(flat >> 8 * k & 255 for k in range(1, wide))]).astype(np.uint8)  # byte planes pack well
        head = np.array([wide, len(codes.words), stamp], "<u4").tobytes()
        none = [None] * len(use)
        return pa.RecordBatch.from_arrays([pa.array([block, *(-1 - b for b in use)], pa.int64()), pa.array([block] * (1 + len(use)), pa.int64()), pa.array([ids, *none], pa.list_(pa.int64())), pa.array([lengths, *none], pa.list_(pa.int32())), pa.array([head + _packed(planes.tobytes()), *words], pa.binary())], ["key", "block", "ids", "lengths", "data"])

    ids, lengths, texts, size, codes = [], [], [], 0, _Codes(find)
    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            text = text or ""
            if size and size + len(text) > BLOCK_CHARS:
                yield out(ids, lengths, texts, codes)
                ids, lengths, texts, size, codes = [], [], [], 0, _Codes(find)
            mine = b"".join(map(codes.__getitem__, PIECES.findall(text)))
            ids.append(doc)
            lengths.append(len(mine) // 4)
            texts.append(mine)
            size += len(text)
    if ids:
        yield out(ids, lengths, texts, codes)


@lru_cache(maxsize=2)
def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=2)
def _encoding(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=_ranks(path), special_tokens={})


_ENCODED = "of_block long, packed binary, tokens array<int>"


def _encode(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    """Word lists of whole buckets from all blocks to their ids, and the distinct ids of each list. Each distinct word of the
    task is encoded once."""
    encode, known = _encoding(path, pattern)._core_bpe.encode_single_piece, {}
    for batch in batches:
        rows, tokens = [], []
        for packed in batch.column("data").to_pylist():
            words, codes, stamp = _unpack_words(packed)
            out = []
            for w in words:
                ids = known.get(w)
                if ids is None:
                    ids = known[w] = array("I", encode(w)).tobytes()
                out.append(ids)
            sizes = np.array([len(x) // 4 for x in out], "<u4").tobytes()
            flat = np.frombuffer(b"".join(out), "<u4")
            wide = 4 if len(flat) and flat.max() > 65535 else 2
            head = np.array([len(words), wide, stamp], "<u4").tobytes()
            rows.append(_packed(head, np.asarray(codes).astype("<u4").tobytes(), sizes, flat.astype(f"<u{wide}").tobytes()))
            tokens.append(np.unique(flat).astype(np.int32))
        yield pa.RecordBatch.from_arrays([batch.column("block"), pa.array(rows, pa.binary()), pa.array(tokens, pa.list_(pa.int32()))], ["of_block", "packed", "tokens"])


def token_bytes(spark: SparkSession, path: str) -> DataFrame:
    """(id, bytes) of the vocabulary file: one row per token."""
    ranks = _ranks(path)
    return spark.createDataFrame(pa.table({"id": pa.array(ranks.values(), pa.int32()), "bytes": pa.array(ranks.keys(), pa.binary())}))


def _dictionary(packed: list[bytes], n_words: int, stamp: int) -> list[list[int]]:
    """ids by code, from the buckets' rows."""
    out: list = [None] * n_words
    for x in packed:
        data = _unpacked(x)
        n, wide, mine = np.frombuffer(data, "<u4", 3).tolist()
        if mine != stamp:
            break
        codes = np.cumsum(np.frombuffer(data, "<u4", n, 12)).tolist()
        sizes = np.frombuffer(data, "<u4", n, 12 + 4 * n).tolist()
        ids, at = np.frombuffer(data, f"<u{wide}", -1, 12 + 8 * n).tolist(), 0
        for c, k in zip(codes, sizes):
            out[c] = ids[at : at + k]
            at += k
    if None in out:
        raise RuntimeError("a block's word list and codes differ: the rows of a partition must come in the same order in each run")
    return out


def _documents(block: pa.Table, words: pa.Table) -> Iterator[tuple[list[list[int]], list[tuple[int, np.ndarray]]]]:
    packed = [x for row in words.column("packed").to_pylist() for x in row]
    for ids, lengths, codes in zip(*(block.column(c).to_pylist() for c in ("ids", "lengths", "data"))):
        wide, n_words, stamp = np.frombuffer(codes, "<u4", 3).tolist()
        planes = np.frombuffer(_unpacked(codes[12:]), np.uint8).reshape(wide, -1).astype(np.uint32)
        flat = sum(planes[k] << np.uint32(8 * k) for k in range(wide))
        ends = np.cumsum([0, *lengths])
        yield _dictionary(packed, n_words, stamp), [(i, flat[ends[k] : ends[k + 1]]) for k, i in enumerate(ids)]


def _digests(block: pa.Table, words: pa.Table) -> pa.Table:
    """Each document's ids by position, then the bytes that the token-byte table, joined for the block, has for them."""
    joined = [pair for row in words.column("joined").to_pylist() for pair in row or ()]
    table = {pair["id"]: pair["bytes"] for pair in joined}
    doc, n_tokens, h_ids, h_raw = [], [], [], []
    for ids, documents in _documents(block, words):
        said = [" ".join(map(str, x)) for x in ids]
        raw = [b"".join([table[t] for t in x]) for x in ids]
        sizes = np.array([len(x) for x in ids], np.int64)
        for i, mine in documents:
            listed = mine.tolist()
            doc.append(i)
            n_tokens.append(int(sizes[mine].sum()))
            h_ids.append(hashlib.sha256(" ".join([said[c] for c in listed]).encode()).hexdigest())
            h_raw.append(hashlib.sha256(b"".join([raw[c] for c in listed])).hexdigest())
    return pa.table([pa.array(doc, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array(h_ids, pa.string()), pa.array(h_raw, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def _id_lists(block: pa.Table, words: pa.Table) -> pa.Table:
    doc, out = [], []
    for ids, documents in _documents(block, words):
        for i, mine in documents:
            doc.append(i)
            out.append([t for c in mine.tolist() for t in ids[c]])
    return pa.table([pa.array(doc, pa.int64()), pa.array(out, pa.list_(pa.int32()))], ["doc_id", "ids"])


def _joined(docs: DataFrame, path: str, pattern: str, together, schema: str, with_bytes: bool) -> DataFrame:
    rows = docs.select(F.col("doc_id").try_cast("long").alias("doc_id"), "text")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(parts, BUCKETS)
    # one exchange for both kinds of rows; the condition that tells them apart must stay above it, or each would cut the texts
    dealt = rows.mapInArrow(lambda it: _blocks(it, pattern, buckets), _BLOCKS).repartition(parts, "key")
    above = lambda c: F.when(F.monotonically_increasing_id() >= 0, c)
    codes, words = dealt.filter(above(F.col("key") >= 0)), dealt.filter(above(F.col("key") < 0))
    ids = words.mapInArrow(lambda it: _encode(it, path, pattern), _ENCODED).repartition(parts, "of_block")
    of_block = ids.groupBy("of_block").agg(F.collect_list("packed").alias("packed"))
    if with_bytes:
        used = ids.groupBy("of_block").agg(F.array_distinct(F.flatten(F.collect_list("tokens"))).alias("tokens")).select("of_block", F.explode("tokens").alias("id"))
        known = used.join(F.broadcast(token_bytes(docs.sparkSession, path)), "id").groupBy("of_block").agg(F.collect_list(F.struct("id", "bytes")).alias("joined"))
        of_block = of_block.join(known, "of_block", "left")
    return codes.groupBy("key").cogroup(of_block.groupBy("of_block")).applyInArrow(together, schema)


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids array<int>) of docs (doc_id, text) by the ranks in `path`, each match of `pattern` by itself."""
    return _joined(docs, path, pattern, _id_lists, "doc_id long, ids array<int>", False)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, decoded binary) of (doc_id, ids): ids joined to the token-byte table and put together by position.
    doc_id is unique here; an id outside the table fails; empty ids give empty bytes."""
    tokens = F.broadcast(token_bytes(encoded.sparkSession, path))
    each = encoded.select("doc_id", F.posexplode_outer("ids").alias("at", "id")).join(tokens, "id", "left")
    each = each.withColumn("bytes", F.when(F.col("id").isNotNull() & F.col("bytes").isNull(), F.raise_error(F.lit("unknown token id"))).otherwise(F.col("bytes")))
    parts = each.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.when(F.col("at").isNotNull(), F.struct("at", "bytes")))).alias("p"))
    return parts.select("doc_id", F.aggregate(F.col("p.bytes"), F.lit(b"").cast("binary"), lambda a, b: F.concat(a, b)).alias("decoded"))


def round_trip_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, ids_sha256 (of the decimal ids joined by a space), decoded_sha256 (of
    the bytes that the ids decode to)."""
    return _joined(docs, path, pattern, _digests, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", True)
