"""Token-id files with Elias-Fano document boundaries.

A shard holds the ids of consecutive documents in one array, then the document
borders and the document ids as Elias-Fano sequences: about two bits plus
log2(mean gap) an entry, and any border is read by one select. A shard ends in
a JSON footer, so it is written and read as a stream, and is closed at SHARD_BYTES:
a task writes as many as its documents need, in memory of one shard's borders.

Defined results: null text is the empty text (its end id alone); null ids come
first; rows that share an id follow the hash of their text; an empty table
gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.common import cut, filesystem, partitions, rows_of, scratch, ship
from marlstone.llm.encode import encoder

MAGIC = b"MLTOKEN1"
#: A select sample is kept for every so many ones.
SAMPLE = 256
#: Bytes of ids after which a shard is closed, and the documents of it; a longer
#: document is a shard of its own.
SHARD_BYTES, SHARD_DOCS = 64 << 20, 1 << 20
#: Documents a result batch of the reader holds, and ids it reads at once.
READ_DOCS, READ_IDS = 4096, 1 << 20
_POP = np.array([bin(i).count("1") for i in range(256)], np.uint8)


#: Entries whose lower bits are packed at a time, a multiple of eight.
_PACK = 1 << 13


class EliasFano:
    """A non-decreasing sequence of unsigned integers with ``select``."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray):
        self.n, self.low_bits, self.low, self.high = n, low_bits, low, high
        counts = np.cumsum(_POP[high], dtype=np.int64)
        #: byte that holds each SAMPLE-th one, and the ones before it
        self.byte = np.searchsorted(counts, np.arange(0, n, SAMPLE), "right")
        self.before = counts[self.byte] - _POP[high[self.byte]]

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        bits = max(0, (top // n).bit_length() - 1) if n else 0
        upper = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(upper[-1]) // 8 + 1 if n else 1, np.uint8)
        np.bitwise_or.at(high, upper >> 3, np.left_shift(np.uint8(1), (upper & 7).astype(np.uint8)))
        # Whole bytes of lower bits at a time: no matrix of all of them.
        low = [np.packbits(((values[i : i + _PACK, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little") for i in range(0, n, _PACK)]
        return cls(n, bits, np.concatenate(low) if low else np.zeros(0, np.uint8), high)

    def to_bytes(self) -> bytes:
        return struct.pack("<qqqq", self.n, self.low_bits, len(self.low), len(self.high)) + self.low.tobytes() + self.high.tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> EliasFano:
        n, bits, a, b = struct.unpack_from("<qqqq", raw)
        if len(raw) != 32 + a + b:
            raise ValueError("Elias-Fano block has a wrong length")
        data = np.frombuffer(raw, np.uint8, offset=32)
        return cls(n, bits, data[:a], data[a:])

    def _lower(self, i: np.ndarray) -> np.ndarray:
        at = i[:, None] * self.low_bits + np.arange(self.low_bits)
        bit = (self.low[at >> 3] >> (at & 7).astype(np.uint8)) & 1
        return (bit.astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(1, dtype=np.uint64)

    def select(self, start: int, stop: int) -> np.ndarray:
        """The values at positions start to stop, from the nearest sample on."""
        if stop <= start:
            return np.zeros(0, np.uint64)
        k = start // SAMPLE
        first, last = int(self.byte[k]), len(self.high)
        if (stop - 1) // SAMPLE + 1 < len(self.byte):
            last = int(self.byte[(stop - 1) // SAMPLE + 1]) + 1
        ones = np.flatnonzero(np.unpackbits(self.high[first:last], bitorder="little")) + 8 * first
        i = np.arange(start, stop)
        return ((ones[i - int(self.before[k])] - i).astype(np.uint64) << np.uint64(self.low_bits)) | self._lower(i)


def write_shard(out, parts, dtype: np.dtype) -> dict:
    """Write a shard to the stream ``out``: ``parts`` are pairs of doc_ids (an
    Arrow array) and the documents' ids (bytes, with their end id)."""
    out.write(MAGIC)
    sizes, ids, nulls = [np.zeros(1, np.int64)], [np.zeros(0, np.int64)], 0
    for keys, found in parts:
        out.write(b"".join(found))
        sizes.append(np.fromiter(map(len, found), np.int64, len(found)) // dtype.itemsize)
        nulls += keys.null_count
        ids.append(keys.drop_null().to_numpy(zero_copy_only=False).astype(np.int64))
    starts, keys = np.cumsum(np.concatenate(sizes)), np.concatenate(ids)
    least = int(keys[0]) if len(keys) else 0
    blocks = [EliasFano.encode(starts).to_bytes(), EliasFano.encode(keys.view(np.uint64) - np.uint64(least & (1 << 64) - 1)).to_bytes()]
    for b in blocks:
        out.write(b)
    info = {"n_docs": len(starts) - 1, "n_ids": int(starts[-1]), "null_ids": nulls, "least_id": least, "dtype": dtype.str, "blocks": [len(b) for b in blocks]}
    raw = json.dumps(info).encode()
    out.write(raw + struct.pack("<q", len(raw)) + MAGIC)
    return info


def encoded(batches, path: str, end_id: int, limit: int):
    """(doc_ids, ids) of the documents of ``batches`` (doc_id, text), and None
    after those that fill a shard."""
    enc = encoder(path)
    end = np.array([end_id], enc.dtype).tobytes()
    size = docs = 0
    for batch in batches:
        for part in rows_of(batch):
            found, first = [], 0
            for i, text in enumerate(part.column("text").to_pylist()):
                found.append(enc.encode(text or "") + end)
                size, docs = size + len(found[-1]), docs + 1
                if size >= limit or docs >= SHARD_DOCS:
                    yield part.column("doc_id").slice(first, len(found)), found
                    yield None
                    found, first, size, docs = [], i + 1, 0, 0
            if found:
                yield part.column("doc_id").slice(first, len(found)), found


class Shard:
    """Random access to a shard's documents."""

    def __init__(self, f):
        self.f = f
        size = f.size()
        tail = f.read_at(16, size - 16)
        (n,) = struct.unpack("<q", tail[:8])
        if tail[8:] != MAGIC or f.read_at(8, 0) != MAGIC:
            raise ValueError("not a token file")
        self.info = json.loads(f.read_at(n, size - 16 - n))
        self.dtype = np.dtype(self.info["dtype"])
        a, b = self.info["blocks"]
        at = size - 16 - n - a - b
        if at != 8 + self.info["n_ids"] * self.dtype.itemsize:
            raise ValueError("token file has a wrong length")
        self.bounds, self.keys = EliasFano.from_bytes(f.read_at(a, at)), EliasFano.from_bytes(f.read_at(b, at + a))

    def ids(self, start: int, stop: int) -> np.ndarray:
        k = self.dtype.itemsize
        return np.frombuffer(self.f.read_at((stop - start) * k, 8 + start * k), self.dtype)

    def doc_ids(self, start: int, stop: int) -> list:
        nulls = self.info["null_ids"]
        found = self.keys.select(max(0, start - nulls), max(0, stop - nulls)) + np.uint64(self.info["least_id"] & (1 << 64) - 1)
        return [None] * max(0, min(stop, nulls) - start) + found.view(np.int64).tolist()

    def documents(self):
        """(doc ids, bounds, ids of them all) for runs of documents."""
        n, i = self.info["n_docs"], 0
        while i < n:
            j = min(n, i + READ_DOCS)
            at = self.bounds.select(i, j + 1).astype(np.int64)
            j = i + max(1, int(np.searchsorted(at, at[0] + READ_IDS, "right")) - 1)
            at = at[: j - i + 1]
            yield self.doc_ids(i, j), at, self.ids(int(at[0]), int(at[-1]))
            i = j


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int = 1, folder: str | None = None, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write all texts in ascending doc_id order; return the shards' manifest.

    The rows are dealt by range of (doc_id, text hash), so neither a large
    table nor a repeated id fills one task; ``shard`` numbers the files in order. A
    shard's name is new for every
    task attempt and only the manifest names it: what a lost executor leaves
    behind is never read.
    """
    spark = docs.sparkSession
    folder = folder or scratch(spark, "tokens")

    def write(batches):
        fs, at = filesystem(folder)
        fs.create_dir(at, recursive=True)
        parts, dtype, task = encoded(batches, tokenizer, end_id, shard_bytes), encoder(tokenizer).dtype, TaskContext.get().partitionId()
        first = next(parts, None)
        count = 0
        while first is not None:

            def rest():
                yield first
                for part in parts:
                    if part is None:
                        return
                    yield part

            path = f"{at}/part-{task:06d}-{count:06d}-{uuid.uuid4().hex}.tok"
            with fs.open_output_stream(path) as out:
                info = write_shard(out, rest(), dtype)
            yield pa.RecordBatch.from_pydict({"shard": pa.array([(task << 32) + count], pa.int64()), "path": [f"{folder}/{path.rsplit('/', 1)[1]}"], "n_docs": pa.array([info["n_docs"]], pa.int64()), "n_ids": pa.array([info["n_ids"]], pa.int64())})
            first, count = next(parts, None), count + 1

    dealt = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .withColumn("tie", F.xxhash64("text"))
        .repartitionByRange(partitions(spark), "doc_id", "tie")
        .sortWithinPartitions("doc_id", "tie", "text")
    )
    return cut(dealt.select("doc_id", "text").mapInArrow(write, "shard long, path string, n_docs long, n_ids long"), "manifest")


def read_tokens(manifest: DataFrame) -> DataFrame:
    """A row per document of the shards: doc_id, start (ids of all documents
    before it), n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit
    integers)."""

    def read(batches):
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
                fs, at = filesystem(path)
                with fs.open_input_file(at) as f:
                    for keys, bounds, ids in Shard(f).documents():
                        wide = ids.astype("<u4")
                        yield pa.RecordBatch.from_pydict(
                            {
                                "doc_id": pa.array(keys, pa.int64()),
                                "start": pa.array(base + bounds[:-1], pa.int64()),
                                "n_tokens": pa.array(np.diff(bounds), pa.int64()),
                                "ids_crc32": pa.array([zlib.crc32(wide[a:b]) for a, b in zip(bounds[:-1] - bounds[0], bounds[1:] - bounds[0], strict=True)], pa.int64()),
                            }
                        )

    ship(manifest.sparkSession)
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.select("path", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("long").alias("base"))
    return placed.repartition(partitions(manifest.sparkSession)).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
