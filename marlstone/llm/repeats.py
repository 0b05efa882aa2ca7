"""Exact repeated-substring removal with sharded suffix arrays.

A string of ``length`` bytes belongs to the minimum hash of its grams, so all
its occurrences meet in one shard, wherever they are. Consecutive strings with
one minimum form a run. Hashes only say which strings meet; that strings are
equal is found on their bytes:

1. Each document gives its runs as (gram hash, place). Runs of one batch whose
   bytes are equal, compared there, are reduced to the first before the shuffle,
   so a passage in a third of all documents sends a row a batch. They are written
   once, as places without texts.
2. Grams are counted, with partial sums before the shuffle, and joined back by
   a join that adaptive execution splits: runs whose gram occurs once are done.
3. The bytes of the others are fetched and dealt by gram hash; a gram with more
   than SPLIT bytes of different runs is split by the hashes of its strings. Each
   block of shards gets a suffix array by induced sorting and its permuted common
   prefixes; strings that stand together are equal, and all but the first are
   covered. Pieces that are equal as a whole are one text in the array; where all
   pieces of a gram are, or each is a single string, there is nothing to sort. Of
   a shard that is larger than a block equal pieces are reduced as they come, so
   memory follows the different ones, which SPLIT bounds.
4. Each document drops the union of its covered strings.

Defined results: null text is empty; a text shorter than ``length`` bytes loses
nothing; null ids come before all others; rows that share an id but not a text
are documents of their own, ordered by the text's hash; fully repeated rows are
one document and share its result; an empty table gives no rows. Other columns
are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import BLOCK_BYTES, cut, drop_cut, mix64, packed, partitions, powers, prefix_hash, rows_of, ship, span_hash, text_buffer, unpacked
from marlstone.llm.suffix import permuted_common_prefixes, suffix_array

LENGTH, GRAM = 100, 32
#: Bytes of text whose runs are reduced at a time.
REDUCE_BYTES = 1 << 23
#: Bytes of a block of shards that a suffix array is built over, and of a larger
#: shard's pieces beyond which equal ones are reduced.
SHARD_BYTES, ROUND_BYTES = 1 << 19, 4 << 20
#: Bytes of a gram's runs beyond which it is split.
SPLIT = 4 << 20
_NO = np.uint64(0xFFFFFFFFFFFFFFFF)
_STEP = np.uint64(0xD1342543DE82EF95)


def _gram_hashes(data: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all n bytes in a row."""
    prefix = prefix_hash(data)
    inverse = powers(len(prefix))[1]
    return mix64((prefix[n:] - prefix[:-n]) * inverse[: len(prefix) - n])


def _window_minima(keys: np.ndarray, n: int) -> np.ndarray:
    out, k = keys, 1
    while k * 2 <= n:
        out = np.minimum(out[:-k], out[k:])
        k *= 2
    return np.minimum(out[: len(out) - (n - k)], out[n - k :]) if n > k else out


def runs(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """Gram hash, content hash, row, first start in the row and number of
    starts of each run of strings that share their minimal gram."""
    width = length - gram + 1
    out = []
    for i, a, z in _segments(offsets, length):
        part = data[a:z]
        if len(part) < length:
            continue
        grams = _gram_hashes(part, gram)
        # The leftmost of the least: ordered by half the hash, then by place.
        keys = (grams & ~np.uint64(0xFFFFFFFF)) | np.arange(len(grams), dtype=np.uint64)
        least = _window_minima(keys, width)
        starts = np.arange(len(least)) + a
        row = np.searchsorted(offsets, starts, "right") - 1
        least[starts + length > offsets[row + 1]] = _NO
        edge = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1])
        count = np.diff(np.append(edge, len(least)))
        real = least[edge] != _NO
        edge, count = edge[real], count[real]
        at = (least[edge] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        content = span_hash(prefix_hash(part), edge, edge + count + length - 1)
        out.append((grams[at], content, row[edge], edge + a - offsets[row[edge]], count))
    if not out:
        empty = np.zeros(0, np.int64)
        return empty.astype(np.uint64), empty.astype(np.uint64), empty, empty, empty
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _segments(offsets: np.ndarray, length: int):
    """(row, start, stop) of byte ranges of about BLOCK_BYTES that hold each
    string once: whole rows, or overlapping parts of a long one."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + BLOCK_BYTES, "right")) - 1)
        a, z = int(offsets[i]), int(offsets[j])
        if j == i + 1:
            for k in range(a, max(a + 1, z - length + 1), BLOCK_BYTES):
                yield i, k, min(z, k + BLOCK_BYTES + length - 1)
        else:
            yield i, a, z
        i = j


def merged(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of intervals as sorted, disjoint, not touching ones."""
    if not len(start):
        return start, stop
    order = np.argsort(start, kind="stable")
    start, stop = start[order], np.maximum.accumulate(stop[order])
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > stop[:-1]
    first = np.flatnonzero(new)
    return start[first], stop[np.append(first[1:], len(start)) - 1]


def _document_order(ids: np.ndarray, valid: np.ndarray, tie: np.ndarray) -> np.ndarray:
    """Rank of each row's document; equal for fully repeated rows."""
    order = np.lexsort((tie, ids, valid))
    i, v, t = ids[order], valid[order], tie[order]
    new = np.ones(len(order), np.int64)
    new[1:] = (i[1:] != i[:-1]) | (v[1:] != v[:-1]) | (t[1:] != t[:-1])
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new) - 1
    return rank


def _ids(col) -> tuple[np.ndarray, np.ndarray]:
    return col.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), col.is_valid().to_numpy(zero_copy_only=False)


_RUN = "kind int, gram long, content short, often int, doc_id long, tie long, start int, size int"
_RUN_TYPES = [pa.int32(), pa.int64(), pa.int16(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
_RUN_NAMES = [x.split()[0] for x in _RUN.split(", ")]


def _equal_bytes(raw: bytes, at: np.ndarray, lead: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the bytes at ``at`` are those at ``lead``; spans that go on at the
    same distance are compared at once."""
    order = np.argsort(at, kind="stable")
    a, shift, stop = at[order], (lead - at)[order], (at + size)[order]
    new = np.ones(len(a), bool)
    new[1:] = (shift[1:] != shift[:-1]) | (a[1:] > stop[:-1])
    first = np.flatnonzero(new)
    ends = np.maximum.reduceat(stop, first) if len(first) else stop
    same = np.array([raw[i:j] == raw[i + d : j + d] for i, j, d in zip(a[first].tolist(), ends.tolist(), shift[first].tolist(), strict=True)], bool)
    out = np.empty(len(a), bool)
    out[order] = same[np.cumsum(new) - 1]
    return out


class _Reduced:
    """Runs of a batch: the first of each content, how often it is there, and the
    others, whose bytes are those of the first."""

    def __init__(self, batch: pa.RecordBatch, length: int, gram: int):
        ids, valid = _ids(batch.column("doc_id"))
        self.tie = batch.column("tie").to_numpy(zero_copy_only=False)
        rank = _document_order(ids, valid, self.tie)
        _, self.one = np.unique(rank, return_index=True)  # repeated rows count once
        data, offsets = text_buffer(batch.column("text").take(pa.array(self.one)))
        # Runs ascend by place: rows of ``one`` ascend by rank.
        self.grams, self.content, self.row, self.start, self.size = runs(data, offsets, length, gram)
        n = len(self.grams)
        key = self.grams * _STEP + self.content
        order = np.argsort(key)
        new = np.ones(n, bool)
        new[1:] = key[order[1:]] != key[order[:-1]]
        lead = np.empty(n, np.int64)
        lead[order] = np.minimum.reduceat(order, np.flatnonzero(new))[np.cumsum(new) - 1] if n else order
        some = np.flatnonzero(lead != np.arange(n))
        at = offsets[self.row] + self.start
        same = self.size[some] == self.size[lead[some]]
        raw = data.tobytes() if len(some) else b""
        same &= _equal_bytes(raw, at[some], at[lead[some]], self.size[some] + length - 1)
        lead[some[~same]] = some[~same]
        own = lead == np.arange(n)
        self.own, self.other = np.flatnonzero(own), np.flatnonzero(~own)
        self.often = np.bincount(lead, minlength=n)[self.own]


def document_runs(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """kind 0: a run, the batch's first of its content, with some bits of that and
    how often it is there; kind 1: covered bytes."""

    def run(batches):
        for batch in (part for whole in batches for part in rows_of(whole, REDUCE_BYTES)):
            r = _Reduced(batch, length, gram)
            yield _runs_batch(batch, r.one[r.row[r.own]], 0, r.grams[r.own], r.content[r.own] >> np.uint64(49), r.often, r.start[r.own], r.size[r.own])
            if len(r.other):
                # Covered bytes need no meeting: they go where their place says.
                base = r.row[r.other] * (1 << 32)
                a, z = merged(base + r.start[r.other], base + r.start[r.other] + r.size[r.other] + length - 1)
                at, a, z = a >> 32, a & 0xFFFFFFFF, z & 0xFFFFFFFF
                spread = mix64(a.astype(np.uint64) + r.tie.astype(np.int64).view(np.uint64)[r.one[at]])
                none = np.zeros(len(a), np.int64)
                yield _runs_batch(batch, r.one[at], 1, spread, none, none, a, z - a)

    return docs.mapInArrow(run, _RUN)


def _runs_batch(batch, rows, kind, gram, content, often, start, size) -> pa.RecordBatch:
    take = pa.array(rows, pa.int64())
    cols = [np.full(len(rows), kind, np.int32), gram.view(np.int64), content.astype(np.int16), often.astype(np.int32)]
    cols = [*map(pa.array, cols), batch.column("doc_id").take(take), batch.column("tie").take(take), pa.array(start.astype(np.int32)), pa.array(size.astype(np.int32))]
    return pa.RecordBatch.from_arrays(cols, _RUN_NAMES)


def met_grams(found: DataFrame, length: int = LENGTH) -> DataFrame:
    """_gram and _parts of the grams that are the least of several runs."""
    sums = [F.sum("often").alias("n"), F.min("content").alias("a"), F.max("content").alias("b"), F.sum("size").alias("strings")]
    counts = found.filter("kind = 0").groupBy(F.col("gram").alias("_gram")).agg(*sums)
    # Runs of one content make one piece of a block, however many they are; 15 bits
    # tell contents apart well enough to plan by.
    split = (F.col("a") != F.col("b")) & (F.col("strings") + F.col("n") * (length - 1) > SPLIT)
    parts = F.when(split, F.ceil(F.col("strings") * length / SPLIT)).otherwise(1)
    return counts.filter("n > 1").select("_gram", parts.cast("int").alias("_parts"))


def met_runs(found: DataFrame, length: int = LENGTH) -> DataFrame:
    """kind 1: covered bytes; kind 0: runs that other runs share a gram with, and
    the number of parts to split their gram into."""
    rows = found.drop("content", "often")
    met = rows.join(met_grams(found, length), F.col("gram") == F.col("_gram"), "left").filter("kind = 1 OR _parts IS NOT NULL")
    return met.select("kind", "gram", "doc_id", "tie", "start", "size", F.col("_parts").alias("parts"))


_CONTEXT = "shard long, doc_id long, tie long, start int, size int, bytes binary"
_CONTEXT_NAMES = [x.split()[0] for x in _CONTEXT.split(", ")]
#: Runs of a document that a result batch holds at most.
_FLUSH_RUNS = 1 << 13


def run_bytes(wanted: DataFrame, docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The bytes of the wanted runs, with the shard that they are dealt to."""

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                own = batch.column("_runs")[k].values
                raw = batch.column("text")[k].as_py().encode()
                cols = [own.field(c).to_numpy() for c in ("gram", "start", "size", "parts")]
                for i in range(0, len(own), _FLUSH_RUNS):
                    yield _pieces(raw, *(c[i : i + _FLUSH_RUNS] for c in cols), batch.slice(k, 1), length)

    by_doc = wanted.groupBy(F.col("doc_id").alias("_doc"), F.col("tie").alias("_tie")).agg(F.collect_set(F.struct("gram", "start", "size", "parts")).alias("_runs"))
    met = docs.join(by_doc, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("tie") == F.col("_tie")))
    return met.select("doc_id", "tie", "text", "_runs").mapInArrow(run, _CONTEXT)


def _pieces(raw: bytes, gram: np.ndarray, start: np.ndarray, size: np.ndarray, parts: np.ndarray, row: pa.RecordBatch, length: int) -> pa.RecordBatch:
    """Pieces of a document: whole runs, or the strings of those whose gram is split."""
    if (parts > 1).any():
        found = [(gram[parts == 1], start[parts == 1], size[parts == 1])]
        for g, s, n, p in zip(*(c[parts > 1].tolist() for c in (gram, start, size, parts)), strict=True):
            where = _gram_hashes(np.frombuffer(raw[s : s + n + length - 1], np.uint8), length) % np.uint64(p)
            shard = mix64(where + np.uint64(1) + np.uint64(g & 0xFFFFFFFFFFFFFFFF)).view(np.int64)
            found.append((shard, s + np.arange(n), np.ones(n, np.int64)))
        gram, start, size = (np.concatenate(c) for c in zip(*found, strict=True))
    bytes_ = [raw[a:z] for a, z in zip(start.tolist(), (start + size + length - 1).tolist(), strict=True)]
    take = pa.array(np.zeros(len(bytes_), np.int64))
    cols = [pa.array(gram.astype(np.int64)), row.column("doc_id").take(take), row.column("tie").take(take), pa.array(start.astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(bytes_, pa.binary())]
    return pa.RecordBatch.from_arrays(cols, _CONTEXT_NAMES)


def repeated_strings(pieces, rank: np.ndarray, start: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(piece, first, stop) of runs of strings that another piece or place holds
    earlier, where ``rank`` orders the pieces' documents."""
    pieces = pieces if isinstance(pieces, pa.Array) else pa.array(pieces, pa.binary())
    lead, distinct, copies = _distinct(pieces, rank, start, length)
    own, first, stop = _again(distinct, rank[lead], start[lead], length)
    return tuple(np.concatenate(x) for x in zip((lead[own], first, stop), copies, strict=True))


def _distinct(pieces: pa.Array, rank: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, pa.Array, tuple]:
    """The first of each distinct piece, those pieces, and the strings of the others."""
    coded = pieces.dictionary_encode()
    of = coded.indices.to_numpy()
    members = np.lexsort((start, rank, of))
    head = np.ones(len(members), bool)
    head[1:] = of[members[1:]] != of[members[:-1]]
    lead = members[head]
    strings = np.maximum(0, pc.binary_length(coded.dictionary).to_numpy().astype(np.int64) - length + 1)
    at = lead[of]
    more = np.flatnonzero(((rank != rank[at]) | (start != start[at])) & (strings[of] > 0))
    return lead, coded.dictionary, (more, np.zeros(len(more), np.int64), strings[of[more]])


def _several(shard: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Pieces that may share a string with another of their shard: they aren't
    alone there, nor all single strings."""
    _, of, count = np.unique(shard, return_inverse=True, return_counts=True)
    longest = np.zeros(len(count), np.int64)
    np.maximum.at(longest, of, sizes)
    return np.flatnonzero((count[of] > 1) & (longest[of] > 1))


def _again(pieces: pa.Array, rank: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``repeated_strings`` of distinct pieces."""
    empty = np.zeros(0, np.int64)
    if not len(pieces):
        return empty, empty, empty
    sizes, whole = _text(pieces)
    ends = np.cumsum(sizes)
    begin = ends - sizes
    sa = suffix_array(whole, 258)
    piece = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    inside = np.arange(len(piece), dtype=np.int32) - begin.astype(np.int32)[piece]
    full = np.append(inside + length < sizes[piece], False)
    sa = sa[full[sa]]  # what stands between equal strings is long enough itself
    if not len(sa):
        return empty, empty, empty
    # Symbols fit a byte but for the last of the alphabet, which UTF-8 has not.
    common = permuted_common_prefixes(whole.astype(np.uint8), sa, length)
    new = common[sa] < length
    new[0] = True
    place = (rank[piece[sa]] << 32) + start[piece[sa]] + inside[sa]
    least = np.minimum.reduceat(place, np.flatnonzero(new))[np.cumsum(new) - 1]
    again = np.zeros(len(whole), bool)
    again[sa[place != least]] = True
    at = np.flatnonzero(again)
    edge = np.ones(len(at), bool)
    edge[1:] = (at[1:] != at[:-1] + 1) | (piece[at[1:]] != piece[at[:-1]])
    first = np.flatnonzero(edge)
    last = np.append(first[1:], len(at))[: len(first)] - 1
    return piece[at[first]].astype(np.int64), inside[at[first]].astype(np.int64), inside[at[last]].astype(np.int64) + 1


def _text(pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sizes with their separators, and all pieces as the symbols of one text."""
    held = pieces.to_pylist()
    sizes = np.array([len(p) for p in held], np.int64) + 1
    text = np.frombuffer(b"\0".join(held) + b"\0\0", np.uint8).astype(np.int32) + 2
    text[np.cumsum(sizes) - 1] = 1
    text[-1] = 0
    return sizes, text


_COVER = "doc_id long, tie long, start int, size int"


def sorted_shards(contexts: DataFrame, length: int = LENGTH) -> DataFrame:
    """Covered bytes that the shards' suffix arrays show."""

    def block(held: list[pa.RecordBatch], whole: bool) -> tuple[pa.RecordBatch, pa.RecordBatch]:
        """Covered bytes, and a row of each distinct piece; unless ``whole`` only
        of equal pieces."""
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        ids, valid = _ids(rows.column("doc_id"))
        rank = _document_order(ids, valid, rows.column("tie").to_numpy())
        start, size = (rows.column(c).to_numpy().astype(np.int64) for c in ("start", "size"))
        lead, distinct, found = _distinct(rows.column("bytes"), rank, start, length)
        if whole:
            some = _several(rows.column("shard").to_numpy()[lead], size[lead])
            own, a, z = _again(distinct.take(pa.array(some)), rank[lead[some]], start[lead[some]], length)
            found = tuple(np.concatenate(x) for x in zip((lead[some[own]], a, z), found, strict=True))
        piece, a, z = found
        take = pa.array(piece, pa.int64())
        cols = [rows.column("doc_id").take(take), rows.column("tie").take(take), pa.array((start[piece] + a).astype(np.int32)), pa.array((z - a + length - 1).astype(np.int32))]
        return pa.RecordBatch.from_arrays(cols, ["doc_id", "tie", "start", "size"]), rows.take(pa.array(lead))

    def run(batches):
        held, size, limit, now = [], 0, ROUND_BYTES, None
        for batch in batches:
            shard = batch.column("shard").to_numpy()
            lengths = batch.column("size").to_numpy()
            edge = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
            for a, z in zip(edge[:-1], edge[1:], strict=True):
                if a == z:
                    continue
                if shard[a] != now:
                    if size >= SHARD_BYTES:
                        yield block(held, True)[0]
                        held, size = [], 0
                    now, limit = shard[a], ROUND_BYTES
                elif size >= limit:
                    found, left = block(held, False)
                    yield found
                    held, size = [left], int(left.column("size").to_numpy().sum()) + left.num_rows * length
                    limit = max(ROUND_BYTES, 2 * size)
                held.append(batch.slice(a, z - a))
                size += int(lengths[a:z].sum()) + (z - a) * length
        if held:
            yield block(held, True)[0]

    dealt = contexts.repartition(partitions(contexts.sparkSession), "shard").sortWithinPartitions("shard")
    return dealt.mapInArrow(run, _COVER)


def covered_bytes(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """_doc, _tie and _covered: the places of each document's repeated strings.

    ``docs`` has doc_id, text (not null) and tie, the text's hash. What is
    written on the way holds places, never texts.
    """
    ship(docs.sparkSession)
    found = cut(document_runs(docs, length, gram), "runs")
    met = cut(met_runs(found, length), "met")
    drop_cut(found)
    sorted_ = sorted_shards(run_bytes(met.filter("kind = 0"), docs, length), length)
    covered = met.filter("kind = 1").select("doc_id", "tie", "start", "size").unionByName(sorted_)
    return covered.groupBy(F.col("doc_id").alias("_doc"), F.col("tie").alias("_tie")).agg(F.collect_list(F.struct("start", "size")).alias("_covered"))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))


def _stay(raw: bytes, mine) -> tuple[bytes, int, int]:
    """What stays of a text, the bytes that go and their spans."""
    if not mine.is_valid:
        return raw, 0, 0
    start = mine.values.field("start").to_numpy().astype(np.int64)
    a, z = merged(start, start + mine.values.field("size").to_numpy())
    stay = b"".join([raw[i:j] for i, j in zip([0, *z.tolist()], [*a.tolist(), len(raw)], strict=True)])
    return stay, int((z - a).sum()), len(a)


_OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
_OUT_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """A row per document: sizes, and the digest of the bytes that stay."""
    own = _keyed(docs)
    by_doc = covered_bytes(own, length, gram)

    def run(batches):
        for batch in batches:
            out = []
            texts, covers = batch.column("text"), batch.column("_covered")
            for k, doc in enumerate(batch.column("doc_id").to_pylist()):
                raw = texts[k].as_py().encode()
                stay, gone, spans = _stay(raw, covers[k])
                out.append((doc, len(raw), gone, spans, hashlib.sha256(stay).hexdigest()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _OUT_TYPES, strict=True)], [x.split()[0] for x in _OUT.split(", ")])

    met = own.join(by_doc, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("tie") == F.col("_tie")), "left")
    return met.select("doc_id", "text", "_covered").mapInArrow(run, _OUT)


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """The rows of ``docs`` with all their columns, repeated bytes gone from the
    text; a character that lost some of its bytes goes whole. Null text stays
    null. ``n_chars``, if there, is counted anew."""
    by_doc = covered_bytes(_keyed(docs), length, gram)
    own = packed(docs).withColumn("_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    met = own.join(by_doc, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_hash") == F.col("_tie")), "left").select("text", "_row", "_covered")

    def run(batches):
        for batch in batches:
            for part in rows_of(batch):
                covers, texts = part.column("_covered"), part.column("text").to_pylist()
                for k in np.flatnonzero(covers.is_valid().to_numpy(zero_copy_only=False)).tolist():
                    texts[k] = _stay((texts[k] or "").encode(), covers[k])[0].decode("utf-8", "ignore")
                yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), part.column("_row")], ["text", "_row"])

    out = unpacked(met.mapInArrow(run, met.drop("_covered").schema), docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
