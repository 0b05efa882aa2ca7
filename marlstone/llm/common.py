"""What the operators share: files, Arrow buffers and hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone import session
from marlstone.session import cut, delete, drop_cut, scratch, ship

__all__ = [
    "BLOCK_BYTES", "Memo", "blocks", "cut", "delete", "drop_cut", "filesystem", "mix64", "packed", "partitions", "powers", "prefix_hash", "rows_of", "scratch", "ship", "span_hash",
    "table", "text_buffer", "unpacked",
]

#: Bytes of text that numpy code expands at a time; arrays of eight bytes a
#: character follow from it, so this bounds a worker's memory.
BLOCK_BYTES = 1 << 20


#: Entries of a memo's generation; two are kept, which bounds memory.
MEMO_ENTRIES, MEMO_LENGTH = 300_000, 64


class Memo(dict):
    """Makes what it lacks; when full, it keeps what was asked for lately. Keys
    over MEMO_LENGTH characters are made anew each time."""

    def __init__(self, make, entries: int = MEMO_ENTRIES):
        super().__init__()
        self.make, self.entries, self.old = make, entries, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= MEMO_LENGTH:
            if len(self) >= self.entries:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table that Python stages read: one of fewer parts than there are cores,
    as a single small file is, is dealt to all of them first."""
    rows = session.table(spark, sf_dir, name)
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def packed(docs: DataFrame) -> DataFrame:
    """doc_id, text and the other columns as one, so that no name can clash."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.struct(*rest).alias("_row"))


def unpacked(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """``packed``'s rows with the columns of ``docs``."""
    return rows.select(*[F.col("text") if c == "text" else F.col("_row").getField(c).alias(c) for c in docs.columns])


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The Arrow file system and path of a URI or plain local path."""
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n + 1 offsets of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    col = col.cast(pa.large_string())
    _, offs, data = col.buffers()
    offs = np.frombuffer(offs, np.int64)[col.offset : col.offset + len(col) + 1]
    if data is None or len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offs[0] : offs[-1]], offs - offs[0]


def blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes; a longer row has a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j
        i = j


def rows_of(batch: pa.RecordBatch, limit: int = 4 * BLOCK_BYTES, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices of a batch that hold about ``limit`` bytes of text each."""
    _, offs = text_buffer(batch.column(column))
    for i, j in blocks(offs, limit):
        yield batch.slice(i, j - i)


_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX1
    x ^= x >> np.uint64(27)
    x *= _MIX2
    x ^= x >> np.uint64(31)
    return x


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_BASE = 0x9E3779B97F4A7C15 | 1


def _chain(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    size = 1 << max(16, (n - 1).bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        _POWERS[size] = _chain(_BASE, size), _chain(pow(_BASE, -1, 1 << 64), size)
    a, b = _POWERS[size]
    return a[:n], b[:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial modulo 2**64 over bytes, n + 1 of them."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data))[0], out=out[1:], dtype=np.uint64)
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans [start, stop): equal bytes, equal hash."""
    inverse = powers(len(prefix))[1]
    return mix64((prefix[stop] - prefix[start]) * inverse[start] + (stop - start).astype(np.uint64))
