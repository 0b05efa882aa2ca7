"""Benchmark decontamination by winnowing.

Both sides keep the minimum hash of GRAM consecutive words in every window of
``window - GRAM + 1`` grams, so two texts that share ``window`` consecutive words
share a fingerprint. Fingerprints are joined; the items that a document meets are
then extended on the words themselves, which makes the result exact. A benchmark
of a measured size is joined in every task, so documents stay where they are; a
larger one meets the documents' fingerprints by shuffles. Items shorter than a window keep one fingerprint of all their words
(winnowing with a window of one), and documents keep as many grams of those
lengths.

Defined results: null text has no words; items without words or without an id
are left out; items that share an id count once; documents that share an id are
each compared as a whole; an empty benchmark hits nothing. Other columns are
ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import blocks, cut, drop_cut, mix64, packed, prefix_hash, ship, span_hash, text_buffer, unpacked

#: Words of a fingerprint; the window of grams follows from the shared span.
GRAM = 6
#: Most fingerprints and bytes of the benchmark that are broadcast; more are
#: joined by a shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 1 << 18, 8 << 20
_STEP = np.uint64(0xD1342543DE82EF95)

_WORD = np.zeros(256, bool)
_WORD[0x30:0x3A] = _WORD[0x61:0x7B] = _WORD[0x80:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def words_of(data: np.ndarray, offsets: np.ndarray):
    """Lower-cased bytes, and start, stop, row of each word."""
    low = _LOWER[data]
    # A border after each row keeps words of neighbouring rows apart.
    mask = np.concatenate([[False], _WORD[low], [False]])
    rise, fall = mask[1:-1] & ~mask[:-2], mask[1:-1] & ~mask[2:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    both = inner[mask[inner + 1] & mask[inner]]
    rise[both] = True
    fall[both - 1] = True
    starts, stops = np.flatnonzero(rise), np.flatnonzero(fall) + 1
    return low, starts, stops, np.searchsorted(offsets, starts, "right") - 1


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n words, whatever their rows."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        out = out * _STEP + words[k : k + len(out)]
    return mix64(out + np.uint64(n))


def minima(grams: np.ndarray, n: int) -> np.ndarray:
    """Minimum of each n consecutive grams."""
    if len(grams) < n:
        return np.zeros(0, np.uint64)
    out = grams[: len(grams) - n + 1]
    for k in range(1, n):
        out = np.minimum(out, grams[k : k + len(out)])
    return out


def fingerprints(words: np.ndarray, rows: np.ndarray, lengths: list[int], window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, fingerprint) of ``window`` words by winnowing and of the
    shorter ``lengths`` by all their grams."""
    found = []
    for n in (window, *lengths):
        one = gram_hashes(words, gram if n == window else n)
        one = minima(one, window - gram + 1) if n == window else one
        if len(one):
            whole = rows[: len(one)] == rows[n - 1 : n - 1 + len(one)]
            found.append((rows[: len(one)][whole], one[whole]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    row, value = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return row[new], value[new]


def _short(n_words: int, window: int) -> list[int]:
    return [n_words] if 0 < n_words < window else []


def _hashed(col, i: int, j: int):
    data, offsets = text_buffer(col)
    offsets = offsets[i : j + 1]
    data = data[offsets[0] : offsets[-1]]
    low, starts, stops, rows = words_of(data, offsets - offsets[0])
    return low, starts, stops, rows, span_hash(prefix_hash(low), starts, stops) if len(starts) else np.zeros(0, np.uint64)


def item_fingerprints(items: DataFrame, window: int, gram: int = GRAM) -> DataFrame:
    """item_id (string), text, n_words and fp, a row per fingerprint."""

    def run(batches):
        for batch in batches:
            texts, ids = batch.column("text"), batch.column("item_id").to_pylist()
            out = []
            for i in range(batch.num_rows):
                _, _, _, rows, words = _hashed(texts, i, i + 1)
                short = _short(len(words), window)
                _, fps = fingerprints(words, rows, short, window, gram)
                out += [(ids[i], texts[i].as_py(), len(words), int(x)) for x in fps.view(np.int64)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.string(), pa.int32(), pa.int64()), strict=True)], ["item_id", "text", "n_words", "fp"])

    rows = items.select(F.col("item_id").cast("string").alias("item_id"), "text").filter("item_id IS NOT NULL AND text IS NOT NULL")
    return rows.mapInArrow(run, "item_id string, text string, n_words int, fp long")


def document_fingerprints(docs: DataFrame, lengths: list[int], window: int, gram: int = GRAM) -> DataFrame:
    def run(batches):
        for batch in batches:
            _, offsets = text_buffer(batch.column("text"))
            ids = batch.column("doc_id")
            for i, j in blocks(offsets):
                _, _, _, rows, words = _hashed(batch.column("text"), i, j)
                row, fps = fingerprints(words, rows, lengths, window, gram)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(row + i, pa.int64())), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def spans_of(own: list[bytes], window: int) -> tuple[int, dict[bytes, int], np.ndarray]:
    """Words of an item's windows, the windows by their words, and their hashes."""
    n = min(window, len(own))
    spans = dict.fromkeys(b" ".join(own[k : k + n]) for k in range(len(own) - n + 1)) if n else {}
    return n, spans, np.array([_join_hash(s, n) for s in spans], np.uint64)


def extend(words: list[bytes], hashes: np.ndarray, items: list[tuple[str, list[bytes]]], window: int) -> tuple[np.ndarray, set[str]]:
    """Words hit by the items' windows, and the items that have one."""
    return extended(words, hashes, [(item, spans_of(own, window)) for item, own in items])


def extended(words: list[bytes], hashes: np.ndarray, items: list[tuple[str, tuple]]) -> tuple[np.ndarray, set[str]]:
    """``extend`` with the items' windows at hand."""
    hit, found = np.zeros(len(words) + 1, np.int64), set()
    grams: dict[int, np.ndarray] = {}
    for item, (n, spans, known) in items:
        if not n or len(words) < n:
            continue
        if n not in grams:
            grams[n] = gram_hashes(hashes, n)
        for at in np.flatnonzero(np.isin(grams[n], known)).tolist():
            if b" ".join(words[at : at + n]) in spans:
                found.add(item)
                hit[at] += 1
                hit[at + n] -= 1
    return np.cumsum(hit[:-1]) > 0, found


def _join_hash(span: bytes, n: int) -> int:
    data = np.frombuffer(span, np.uint8)
    _, starts, stops, _ = words_of(data, np.array([0, len(data)]))
    return int(gram_hashes(span_hash(prefix_hash(data), starts, stops), n)[0])


_OUT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, hit_spans array<struct<start:int,stop:int>>"


class Benchmark:
    """A benchmark in memory: its fingerprints with their items, in order, and the
    windows of the items that were met so far."""

    def __init__(self, ids: list[str], texts: list[str], fps: np.ndarray, owners: np.ndarray, window: int, gram: int):
        order = np.argsort(fps, kind="stable")
        self.fps, self.owners = fps[order], owners[order]
        self.ids, self.texts, self.window, self.gram = ids, texts, window, gram
        self.spans: dict[int, tuple] = {}

    @classmethod
    def of(cls, rows: list, window: int, gram: int) -> Benchmark:
        """``rows``: (item_id, text, fp), an item's together or not."""
        place = {k: i for i, k in enumerate(dict.fromkeys((r.item_id, r.text) for r in rows))}
        ids, texts = [k[0] for k in place], [k[1] for k in place]
        fps, owners = np.array([r.fp for r in rows], np.int64).view(np.uint64), np.array([place[r.item_id, r.text] for r in rows], np.int64)
        return cls(ids, texts, fps, owners, window, gram)

    def __getstate__(self):
        return {**self.__dict__, "spans": {}}

    def items(self, some: np.ndarray) -> list[tuple[str, tuple]]:
        out = []
        for i in some.tolist():
            if i not in self.spans:
                self.spans[i] = spans_of(_words(self.texts[i]), self.window)
            out.append((self.ids[i], self.spans[i]))
        return out

    def meet(self, rows: np.ndarray, hashes: np.ndarray, lengths: list[int]) -> dict[int, np.ndarray]:
        """The items that share a fingerprint with each row, by row."""
        row, value = fingerprints(hashes, rows, lengths, self.window, self.gram)
        first, last = np.searchsorted(self.fps, value, "left"), np.searchsorted(self.fps, value, "right")
        some = np.flatnonzero(first < last)
        out: dict[int, list] = {}
        for i in some.tolist():
            out.setdefault(int(row[i]), []).append(self.owners[first[i] : last[i]])
        return {k: np.unique(np.concatenate(v)) for k, v in out.items()}


def _benchmark(items: DataFrame, window: int, gram: int):
    """Fingerprints of the items, the lengths of short ones, and the benchmark
    broadcast if its measured size allows."""
    ship(items.sparkSession)
    fps = cut(item_fingerprints(items, window, gram), "fingerprints")
    bytes_ = fps.groupBy("item_id", F.xxhash64("text").alias("h")).agg(F.max(F.octet_length("text")).alias("n")).agg(F.sum("n").alias("n")).first().n or 0
    count = fps.count()
    # At most window - 1 lengths.
    lengths = [r[0] for r in fps.filter(F.col("n_words") < window).select("n_words").distinct().collect()]
    shared = None
    if count <= BROADCAST_ROWS and bytes_ <= BROADCAST_BYTES:
        shared = items.sparkSession.sparkContext.broadcast(Benchmark.of(fps.select("item_id", "text", "fp").collect(), window, gram))
        drop_cut(fps)
    return fps, lengths, shared


def met_items(docs: DataFrame, fps: DataFrame, items: DataFrame, lengths: list[int], window: int = 10, gram: int = GRAM) -> DataFrame:
    """The rows of ``docs``, with the items that share a fingerprint as _items.

    Only fingerprints are joined; documents then meet the texts of their items.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # Items may share an id, so the hash of the text tells them apart.
    known = fps.select("fp", "item_id", F.xxhash64("text").alias("_hash"))
    pairs = document_fingerprints(own, lengths, window, gram).join(known, "fp").select("doc_id", "item_id", "_hash").distinct()
    texts = items.select(F.col("item_id").cast("string").alias("item_id"), F.xxhash64("text").alias("_hash"), F.col("text").alias("item_text")).distinct()
    pairs = pairs.join(texts, ["item_id", "_hash"]).groupBy(F.col("doc_id").alias("_doc")).agg(F.collect_list(F.struct("item_id", "item_text")).alias("_items"))
    return docs.join(pairs, F.col("doc_id").eqNullSafe(F.col("_doc")), "left").drop("_doc")


def _hits(batch: pa.RecordBatch, window: int, lengths: list[int], shared=None):
    """(row, number of words, flags of hit words, items) of a batch's rows; their
    items are in _items, or found in the broadcast benchmark."""
    texts = batch.column("text")
    _, offsets = text_buffer(texts)
    for i, j in blocks(offsets):
        low, starts, stops, rows, hashes = _hashed(texts, i, j)
        cuts = np.searchsorted(rows, np.arange(j - i + 1))
        met = shared.value.meet(rows, hashes, lengths) if shared else {}
        raw = low.tobytes() if met or not shared else b""
        for k in range(j - i):
            a, b = int(cuts[k]), int(cuts[k + 1])
            hit, found, mine = np.zeros(b - a, bool), set(), []
            if shared and k in met:
                mine = shared.value.items(met[k])
            elif not shared and (own := batch.column("_items")[i + k]).is_valid:
                mine = [(x["item_id"], spans_of(_words(x["item_text"]), window)) for x in own.as_py()]
            if mine:
                words = [raw[s:e] for s, e in zip(starts[a:b].tolist(), stops[a:b].tolist(), strict=True)]
                hit, found = extended(words, hashes[a:b], mine)
            yield i + k, b - a, hit, found


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, gram: int = GRAM) -> DataFrame:
    """A row per document with its hits; hit_spans are runs of hit words."""
    fps, lengths, shared = _benchmark(items, window, gram)

    def run(batches):
        for batch in batches:
            ids, out = batch.column("doc_id").to_pylist(), []
            for i, n, hit, found in _hits(batch, window, lengths, shared):
                edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))).tolist()
                spans = [{"start": s, "stop": e} for s, e in zip(edge[::2], edge[1::2], strict=True)]
                listed = ",".join(sorted(found))
                out.append((ids[i], n, int(hit.sum()), len(found), hashlib.sha256(listed.encode()).hexdigest(), bool(spans), spans))
            if out:
                yield _rows(out)

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return (own if shared else met_items(own, fps, items, lengths, window, gram)).mapInArrow(run, _OUT)


def uncontaminated(docs: DataFrame, items: DataFrame, window: int = 10, gram: int = GRAM) -> DataFrame:
    """The rows of ``docs``, with all their columns, that no item's window hits."""
    fps, lengths, shared = _benchmark(items, window, gram)

    def run(batches):
        for batch in batches:
            good = np.ones(batch.num_rows, bool)
            for i, _, hit, _ in _hits(batch, window, lengths, shared):
                good[i] = not hit.any()
            yield batch.select(["text", "_row"]).filter(pa.array(good))

    own = packed(docs)
    met = (own if shared else met_items(own, fps, items, lengths, window, gram)).drop("doc_id")
    return unpacked(met.mapInArrow(run, met.select("text", "_row").schema), docs)


def _words(text: str) -> list[bytes]:
    data = np.frombuffer(text.encode(), np.uint8)
    low, starts, stops, _ = words_of(data, np.array([0, len(data)]))
    raw = low.tobytes()
    return [raw[s:e] for s, e in zip(starts.tolist(), stops.tolist(), strict=True)]


def _rows(out: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], [x.split()[0] for x in _OUT.split(", ")])
