"""Packing along a space-filling curve.

Each document's token ids make a signed, hashed count vector; a fixed random
projection takes it to a few dimensions, whose Hilbert index is the sort key.
Documents are cut into chunks of a sequence's size and dealt by range of (key,
doc_id, text hash, start), so ranges hold about as many ids however long their documents
are, and copies by the thousand split over partitions. Each partition fills
sequences with its chunks in curve order, cutting where one is full; chunks of a
document that stay together are one piece. What a partition has left at its end
goes to sequences whose lengths are powers of two, so none is padded.

Defined results: null text is the empty text (its end id alone); rows with a
null or repeated id are packed as any other; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import cut, mix64, partitions, rows_of, ship
from marlstone.llm.encode import encoder

#: Hashed vector's width, dimensions of the curve, bits of each.
WIDTH, DIMS, BITS = 512, 7, 9


def projection(seed: int = 7) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((WIDTH, DIMS))


#: Documents whose vectors are made at a time.
_GROUP = 256
_HASHED: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _hashed(top: int) -> tuple[np.ndarray, np.ndarray]:
    """Place and sign of each id below a power of two that holds ``top``."""
    size = 1 << max(16, top.bit_length())
    if size not in _HASHED:
        h = mix64(np.arange(size, dtype=np.uint64) + np.uint64(1))
        _HASHED[size] = (h % np.uint64(WIDTH)).astype(np.int64), np.where(h >> np.uint64(63), 1.0, -1.0)
    return _HASHED[size]


def hashed_vectors(docs: list[np.ndarray]) -> np.ndarray:
    """Damped signed counts of each document's hashed ids, of length one (zero if
    it has none)."""
    ids = np.concatenate(docs)
    place, sign = _hashed(int(ids.max(initial=0)))
    at = np.repeat(np.arange(len(docs)) * WIDTH, [len(d) for d in docs]) + place[ids]
    v = np.bincount(at, sign[ids], len(docs) * WIDTH).reshape(len(docs), WIDTH)
    v = np.sign(v) * np.sqrt(np.abs(v))
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    return v / np.where(norm > 0, norm, 1.0)


def hashed_vector(ids: np.ndarray) -> np.ndarray:
    return hashed_vectors([ids])[0]


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert index of each row of integer coordinates (Skilling's transform)."""
    x = [c.astype(np.int64) for c in cells.T]
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            t = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ t)
            if i:
                x[i] = x[i] ^ t
        q >>= 1
    for i in range(1, n):
        x[i] = x[i] ^ x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | (((x[i] ^ t) >> b) & 1)
    return key


def curve_key(vectors: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    # A coordinate is about standard normal; the logistic curve spreads it evenly.
    unit = 1.0 / (1.0 + np.exp(-1.702 * vectors @ matrix))
    return hilbert(np.minimum((unit * (1 << BITS)).astype(np.int64), (1 << BITS) - 1))


_CHUNK = "doc_id long, tie long, start long, total long, ids binary, wide int, curve long"
_CHUNK_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64()]
_CHUNK_NAMES = [x.split()[0] for x in _CHUNK.split(", ")]


def tokenized(docs: DataFrame, tokenizer: str, end_id: int, size: int) -> DataFrame:
    """Chunks of at most ``size`` ids (two or four bytes each, see ``wide``) with
    the ids before them, all of the document, and its curve key."""

    def run(batches):
        enc, matrix = encoder(tokenizer), projection()
        end = np.array([end_id], enc.dtype).tobytes()
        for batch in batches:
            for part in rows_of(batch):
                ids = [enc.encode(t or "") + end for t in part.column("text").to_pylist()]
                found = [np.frombuffer(x, enc.dtype) for x in ids]
                keys = np.concatenate([curve_key(hashed_vectors(found[i : i + _GROUP]), matrix) for i in range(0, len(found), _GROUP)])
                wide = enc.dtype.itemsize
                of = zip(part.column("doc_id").to_pylist(), part.column("tie").to_pylist(), ids, keys.tolist(), strict=True)
                rows = [(d, t, a // wide, len(x) // wide, x[a : a + size * wide], wide, k) for d, t, x, k in of for a in range(0, len(x), size * wide)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _CHUNK_TYPES, strict=True)], _CHUNK_NAMES)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie"))
    return rows.mapInArrow(run, _CHUNK)


class _Filler:
    """Fills sequences of ``size`` ids one after the other."""

    def __init__(self, size: int, base: int):
        self.size, self.sequence, self.used, self.open, self.done = size, base, 0, [], []

    def add(self, doc: tuple, ids: np.ndarray, total: int, start: int = 0) -> None:
        """``doc``: its id and its text's hash."""
        while len(ids):
            take = min(len(ids), self.size - self.used)
            last = self.open[-1] if self.open else None
            if last and start and last[0] == doc and last[3] == total and last[1] + last[2] == start:
                self.open[-1] = (doc, last[1], last[2] + take, total, self.sequence, last[5], np.concatenate([last[6], ids[:take]]))
            else:
                self.open.append((doc, start, take, total, self.sequence, self.used, ids[:take]))
            self.used += take
            start += take
            ids = ids[take:]
            if self.used == self.size:
                self.close()

    def close(self) -> None:
        self.done += self.open
        self.open, self.used, self.sequence = [], 0, self.sequence + 1

    def finish(self) -> None:
        """Cut the open sequence into ones of power-of-two lengths."""
        left, rest = self.used, self.open
        self.open, self.used, full = [], 0, self.size
        while left:
            self.size = 1 << (left.bit_length() - 1)
            left -= self.size
            need, more = self.size, []
            for doc, start, length, total, _, _, ids in rest:
                take = min(length, need)
                need -= take
                self.add(doc, ids[:take], total, start)
                if take < length:
                    more.append((doc, start + take, length - take, total, 0, 0, ids[take:]))
            rest = more
        self.size = full


_OUT = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
_NAMES = [x.split()[0] for x in _OUT.split(", ")]
#: Pieces that a result batch holds at most.
_FLUSH = 512


def pack(docs: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 1) -> DataFrame:
    """A row per piece of a document in a sequence, with its ids (little-endian
    unsigned 32-bit). The token ids are written once before they are dealt, as
    finding the ranges reads them a second time."""

    def fill(batches):
        filler = _Filler(size, TaskContext.get().partitionId() << 36)

        def flush():
            rows, filler.done = filler.done, []
            cols = list(zip(*rows, strict=True))
            data = [[doc for doc, _ in cols[0]], cols[1], cols[2], [x.astype("<u4").tobytes() for x in cols[6]], cols[3], cols[4], cols[5]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(data, _TYPES, strict=True)], _NAMES)

        for batch in batches:
            for doc, tie, start, total, raw, wide in zip(*(batch.column(c).to_pylist() for c in _CHUNK_NAMES[:6]), strict=True):
                filler.add((doc, tie), np.frombuffer(raw, f"<u{wide}"), total, start)
                if len(filler.done) >= _FLUSH:
                    yield flush()
        filler.finish()
        if filler.done:
            yield flush()

    ship(docs.sparkSession)
    rows = cut(tokenized(docs, tokenizer, end_id, size), "token-ids")
    order = ("curve", "doc_id", "tie", "start")
    dealt = rows.repartitionByRange(partitions(docs.sparkSession), *order).sortWithinPartitions(*order)
    return dealt.drop("curve").mapInArrow(fill, _OUT)


def piece_digests(pieces: DataFrame) -> DataFrame:
    """``pack``'s rows with the CRC-32 of each piece in place of its ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
