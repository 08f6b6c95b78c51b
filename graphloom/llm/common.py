"""Pieces that the training-data operators share: row keys, written tables, word hashes over Arrow buffers."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import checkpointed, shared_dir  # noqa: F401  (the operators take both from here)

#: White space of the word and text rules: space and U+0009..U+000D.
SPACE = r"[\x20\x09-\x0D]+"
#: Bytes of text that one numpy step takes together (a longer document is a step of its own).
STEP_BYTES = 1 << 19
#: Powers that a worker keeps between steps; more (a document beyond STEP_BYTES) are made for the step alone.
KEPT_POWERS = 1 << 19

#: Paths of the tables that written() made and drop_since() has not removed.
paths: list[str] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: columns stay compressed and can be pruned when read again."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    paths.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_since(spark: SparkSession, first: int, last: int) -> None:
    """Removes the tables paths[first:last]: what was made from them has been written."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths[first:last]:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)
    del paths[first:last]


def unique_ids(docs: DataFrame) -> bool:
    """Whether doc_id is a whole number that no row lacks and no two rows share."""
    if dict(docs.dtypes)["doc_id"] not in ("tinyint", "smallint", "int", "bigint"):
        return False
    return not docs.select("doc_id").groupBy("doc_id").count().filter("count > 1 OR doc_id IS NULL").limit(1).count()


def numbered(rows: DataFrame) -> DataFrame:
    """rows with `row_key`, a long that is unique to the row, written once: a number given while reading could change when a
    lost task runs again."""
    return written(rows.withColumn("row_key", F.monotonically_increasing_id()), "keyed")


def keyed(docs: DataFrame, *columns: str) -> DataFrame:
    """docs with only `columns`, and `row_key`: a long that is unique to the row and the same in every scan. doc_id is the
    key if it can be; otherwise (a text, null or shared) the rows are numbered."""
    rows = docs.select(*columns)
    return rows.withColumn("row_key", docs["doc_id"].cast("long")) if unique_ids(docs) else numbered(rows)


def words_column(text: Column | str) -> Column:
    """array<string> of the words `[^\\x20\\x09-\\x0D]+`; null gives none."""
    return F.filter(F.split(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), SPACE), lambda w: w != "")


# ---- numpy over the text buffers of an Arrow batch ----

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_pow_tables: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**n modulo 2**64; the table grows by doubling and stays up to KEPT_POWERS."""
    have = _pow_tables.get(base)
    if have is None or len(have) <= n:
        size = max(1024, 1 << int(n - 1).bit_length()) if n <= KEPT_POWERS else n
        have = np.full(size + 1, base, np.uint64)
        have[0] = 1
        with np.errstate(over="ignore"):
            np.cumprod(have, out=have)
        if size <= KEPT_POWERS:
            _pow_tables[base] = have
    return have[: n + 1]


_P_INV, _Q_INV = pow(int(_P), -1, 2**64), pow(int(_Q), -1, 2**64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the n + 1 offsets of a string column; a null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), off


def steps(off: np.ndarray, limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most `limit` bytes together; each has one row at least."""
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def word_spans(data: np.ndarray, off: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends, row) of the words in the rows lo..hi-1; starts and ends count within bytes."""
    part = data[off[lo] : off[hi]]
    word = ~((part == 32) | ((part >= 9) & (part <= 13)))
    first = np.zeros(len(part) + 1, bool)
    first[np.minimum(off[lo:hi] - off[lo], len(part))] = True
    start = word.copy()
    start[1:] &= ~word[:-1] | first[1:-1]
    end = word.copy()
    end[:-1] &= ~word[1:] | first[1:-1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    row = np.searchsorted(off[lo : hi + 1] - off[lo], starts, "right") - 1 + lo
    return part, starts, ends, row


def word_hashes(part: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    n = len(part)
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[part] * _powers(int(_P), n)[:n], out=total[1:])
        return mix((total[ends] - total[starts]) * _powers(_P_INV, n)[starts] + (ends - starts).astype(np.uint64))


def run_hashes(words: np.ndarray, at: np.ndarray, length: int, salt: int = 0) -> np.ndarray:
    """A 64-bit hash of the `length` words from each position in `at`."""
    n = len(words)
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(mix(words ^ np.uint64(salt)) * _powers(int(_Q), n)[:n], out=total[1:])
        return mix((total[at + length] - total[at]) * _powers(_Q_INV, n)[at])


def at_in_row(row: np.ndarray, n_rows: int, lo: int) -> tuple[np.ndarray, np.ndarray]:
    """Each word's position in its row, and the words of each of the n_rows rows from lo."""
    counts = np.bincount(row - lo, minlength=n_rows)
    begins = np.concatenate([[0], np.cumsum(counts)[:-1]])
    return np.arange(len(row)) - begins[row - lo], counts
