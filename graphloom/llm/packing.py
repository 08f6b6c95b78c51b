"""Packing by lexical retrieval: BM25 neighbours fill each training window.

Documents are tokenised once into a written table. Document frequencies, the number of documents and their mean length are
counted over all of them; the terms are token ids, so the counts have at most as many rows as the vocabulary and go to
every task. Documents are range-partitioned by their most telling tokens (ties by a hash, so that a hot key is split), and
each partition is read as a run of shards of SHARD_TOKENS tokens. A shard has its own inverted index: for each window, the
document that starts it is the query, and unused documents are taken in order of their BM25 score until the window is full.
The last one is cut there; what is left of it starts the next window. So a seed meets the documents of its own shard, not
those of all shards: README has how many of its best neighbours over all documents these are. Only the end of a partition leaves a window
unfilled, and that rest is cut into sequences whose lengths are powers of two, which need no padding.

Ids are those of the tokenizers library for the whole text with the file as it is: the name of an added token in a text
is that token.

Inputs: null text counts as empty (its one id is the end id); equal and repeated rows are packed each, and so are rows
with a null or shared doc_id, under that id; doc_id is a whole number or text of one, else it becomes null; a text of any length
is cut into windows; equal scores are taken in the order of the shard; extra columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .byte_bpe import WHITE

LENGTH, END_ID = 2048, 1
SHARD_TOKENS = 1 << 17
#: The usual constants of BM25.
K1, B = 1.2, 0.75
#: Text below this code point is in normal form C.
COMBINING = chr(0x300)
#: Numerals below U+0300 that are not decimal digits.
_NUMERALS = "²³¹¼½¾"
_PRETOKENS = re.compile(rf"[^\W\d_{_NUMERALS}]+|[\d{_NUMERALS}]|'(?:s|t|re|ve|m|ll|d)|(?:[^\s\w]|_)+")
_ODD_WHITE = re.compile("[\x1c-\x1f]")
_WHITE = re.compile(f"[{WHITE}]+")


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def _added(path: str) -> re.Pattern:
    """What the tokenizer's file says to take out of a text whole, before all else. Case counts there; here it does not, as
    lower-casing pieces must not make one."""
    names = [t["content"] for t in json.load(open(path, encoding="utf-8"))["added_tokens"]]
    return re.compile("|".join(map(re.escape, names)) or r"(?!)", re.I)


@lru_cache(maxsize=2)
def _word_encoder(path: str):
    """bytes of one lower-case pre-token -> ids, by the file's own vocabulary: a byte that no UTF-8 text has stands for its
    mark of a word's end, so that the end joins the last byte before any merge."""
    import tiktoken

    model = json.load(open(path, encoding="utf-8"))["model"]
    suffix = model["end_of_word_suffix"]
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    ranks = {}
    for token, rank in model["vocab"].items():
        stem, end = (token[: -len(suffix)], b"\xff") if token.endswith(suffix) else (token, b"")
        if all(c in chars for c in stem) and not (token.startswith("<|") and token.endswith("|>")):
            ranks[bytes(chars[c] for c in stem) + end] = rank
    return tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece


class _Ids(dict):
    """Lower-case piece between white space -> its ids as little-endian uint16; forgotten when it grows large. A piece with
    characters of which this module's patterns and the tokenizer could think differently goes through the tokenizer."""

    def __init__(self, path: str, most: int = 600_000):
        self.whole, self.piece, self.most = _tokenizer(path), _word_encoder(path), most

    def word(self, w: str) -> bytes:
        return array("H", self.piece(w.encode() + b"\xff")).tobytes()

    def __missing__(self, text: str) -> bytes:
        if text.isalpha() and (text.isascii() or max(text) < COMBINING):
            out = self.word(text)
        elif (text.isascii() or max(text) < COMBINING) and not _ODD_WHITE.search(text):
            stem = text[:-1]
            if stem.isalpha() and text[-1] in ",.":
                out = (self.get(stem) or self.word(stem)) + self.word(text[-1])
            else:
                out = b"".join(map(self.word, _PRETOKENS.findall(text)))
        else:
            out = array("H", self.whole.encode(text, add_special_tokens=False).ids).tobytes()
        if len(self) >= self.most:
            self.clear()
        if len(text) <= 32:
            self[text] = out
        return out


def _pieces(text: str) -> list[str]:
    if text and max(text) >= COMBINING:
        text = unicodedata.normalize("NFC", text)
        # a piece beyond COMBINING is lower-cased by the tokenizer itself
        return [p.lower() if max(p) < COMBINING else p for p in _WHITE.split(text) if p]
    text = text.lower()
    return [p for p in _WHITE.split(text) if p] if _ODD_WHITE.search(text) else text.split()


_held: dict[str, _Ids] = {}


def _tokenise(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to its ids with the end id, and a key near which documents with the same telling tokens sort."""
    ids_of, added = _held.setdefault(path, _Ids(path)), _added(path).search
    get = ids_of.__getitem__
    for batch in batches:
        out, keys = [], []
        for text in batch.column(1).to_pylist():
            if text and added(text):
                raw = array("H", ids_of.whole.encode(text, add_special_tokens=False).ids).tobytes()
            else:
                raw = b"".join(map(get, _pieces(text))) if text else b""
            out.append(raw + END_ID.to_bytes(2, "little"))
            ids = np.frombuffer(raw, np.uint16)
            if len(ids):
                # later ids are rarer ones: the two ids with the highest sum of their ranks over the text
                own, times = np.unique(ids, return_counts=True)
                weight = own * times
                first = int(weight.argmax())
                weight[first] = -1
                keys.append(int(own[first]) << 16 | int(own[weight.argmax()]))
            else:
                keys.append(-1)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.int64()), pa.array(out, pa.binary())], ["doc_id", "near", "ids"])


def tokenised(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, near, ids): ids as little-endian uint16 with the end id, a written table."""
    rows = docs.select(F.col("doc_id").try_cast("long").alias("doc_id"), "text").mapInArrow(lambda it: _tokenise(it, path), "doc_id long, near long, ids binary")
    return C.written(rows, "tokens")


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task: in how many documents each id occurs; at -1 the documents, at -2 their tokens."""
    total, n, tokens = np.zeros(1 << 16, np.int64), 0, 0
    for batch in batches:
        for raw in batch.column(0):
            ids = np.frombuffer(raw.as_buffer(), np.uint16)
            total[np.unique(ids)] += 1
            n, tokens = n + 1, tokens + len(ids)
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([seen, [-1, -2]]), pa.int64()), pa.array(np.concatenate([total[seen], [n, tokens]]), pa.int64())], ["id", "n"])


def statistics(tokens: DataFrame) -> tuple[np.ndarray, float]:
    """(idf by id, mean length) over all documents; at most one number per id of the vocabulary comes to the driver."""
    rows = tokens.select("ids").mapInArrow(_frequencies, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    by = {r["id"]: r["n"] for r in rows}
    n, total = by.pop(-1, 0), by.pop(-2, 0)
    df = np.zeros(1 << 16)
    df[list(by)] = list(by.values())
    return np.log1p((n - df + 0.5) / (df + 0.5)).astype(np.float32), total / max(n, 1)


class Index:
    """A shard's inverted index: postings by id, weighted by BM25."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean: float):
        terms, owner, weight = [], [], []
        for i, ids in enumerate(docs):
            t, tf = np.unique(ids, return_counts=True)
            terms.append(t)
            owner.append(np.full(len(t), i, np.int32))
            weight.append(idf[t] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(ids) / mean)))
        self.terms = terms
        all_terms = np.concatenate(terms)
        order = np.argsort(all_terms, kind="stable")
        self.owner, self.weight = np.concatenate(owner)[order], np.concatenate(weight)[order]
        self.begin = np.concatenate([[0], np.cumsum(np.bincount(all_terms, minlength=1 << 16))])
        self.n = len(docs)

    def scores(self, query: int) -> np.ndarray:
        """BM25 of every document of the shard for the distinct ids of document `query`."""
        t = self.terms[query].astype(np.int64)
        first, size = self.begin[t], self.begin[t + 1] - self.begin[t]
        at = np.arange(size.sum()) + np.repeat(first - np.cumsum(size) + size, size)
        return np.bincount(self.owner[at], weights=self.weight[at], minlength=self.n)


class _Packer:
    def __init__(self, part: int, length: int):
        self.next, self.length = part << 31, length
        self.window: list[tuple] = []  # (doc_id, start, ids, tokens of the document)
        self.filled = 0
        self.rows: list[tuple] = []

    def add(self, doc: int, ids: np.ndarray, start: int) -> int:
        """Takes what fits of ids from start on; the number taken."""
        n = min(len(ids) - start, self.length - self.filled)
        self.window.append((doc, start, ids[start : start + n], len(ids)))
        self.filled += n
        if self.filled == self.length:
            self.close(self.length)
        return n

    def close(self, size: int) -> None:
        """Emits the first `size` tokens of the window as one sequence."""
        at, rest = 0, []
        for doc, start, ids, total in self.window:
            n = min(len(ids), size - at)
            if n:
                self.rows.append((doc, start, n, zlib.crc32(ids[:n].astype("<u4").tobytes()), total, self.next, at))
                at += n
            if n < len(ids):
                rest.append((doc, start + n, ids[n:], total))
        self.window, self.next, self.filled = rest, self.next + 1, self.filled - size

    def shard(self, names: list, docs: list[np.ndarray], idf: np.ndarray, mean: float) -> None:
        """All documents of a shard; an open window goes on with the next shard."""
        index = Index(docs, idf, mean)
        unused, first = np.ones(len(docs), bool), 0
        while True:
            while first < len(docs) and not unused[first]:
                first += 1
            if first == len(docs):
                return
            seed, start = first, 0
            while seed is not None:  # one window or more: the seed, then its neighbours
                unused[seed] = False
                start += self.add(names[seed], docs[seed], start)
                if start < len(docs[seed]):
                    continue
                query, seed = seed, None
                if not self.filled or not unused.any():
                    break
                score = self.scores_of(index, query, unused)
                for i in score:
                    unused[i] = False
                    took = self.add(names[i], docs[i], 0)
                    if not self.filled:
                        seed, start = (int(i), took) if took < len(docs[i]) else (None, 0)
                        break

    @staticmethod
    def scores_of(index: Index, query: int, unused: np.ndarray) -> np.ndarray:
        """Unused documents, best first; equal scores in the order of the shard."""
        s = index.scores(query)
        left = np.flatnonzero(unused)
        return left[np.argsort(-s[left], kind="stable")]

    def finish(self) -> None:
        while self.filled:
            self.close(1 << (self.filled.bit_length() - 1))

    def batch(self) -> pa.RecordBatch:
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        columns = list(zip(*self.rows)) or [[]] * len(names)
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)


def _pack(batches: Iterator[pa.RecordBatch], idf: np.ndarray, mean: float, length: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    packer, names, docs, size = _Packer(TaskContext.get().partitionId(), length), [], [], 0
    for batch in batches:
        for doc, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            names.append(doc)
            docs.append(np.frombuffer(raw, np.uint16))
            size += len(docs[-1])
            if size >= SHARD_TOKENS:
                packer.shard(names, docs, idf, mean)
                names, docs, size = [], [], 0
                yield packer.batch()
    if docs:
        packer.shard(names, docs, idf, mean)
    packer.finish()
    yield packer.batch()


def pack(docs: DataFrame, path: str, length: int = LENGTH) -> DataFrame:
    """One row per piece of docs (doc_id, text): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    if length < 2 or length & (length - 1):
        raise ValueError("the length of a sequence is a power of two")
    tokens = tokenised(docs, path)
    idf, mean = statistics(tokens)
    parts = int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["near", F.xxhash64("doc_id", F.octet_length("ids")), "doc_id"]
    dealt = tokens.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "ids")
    return dealt.mapInArrow(lambda it: _pack(it, idf, mean, length), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
