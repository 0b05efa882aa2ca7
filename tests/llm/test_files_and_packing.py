"""Token files of several shards a task, and packing along the curve."""

import io
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from marlstone.llm import encode, packing, tokenfile
from tests.llm import brute

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def docs(spark):
    rnd = random.Random(2)
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    rows = [(i, " ".join(rnd.choices(words, k=rnd.choice([3, 50, 400])))) for i in range(200)]
    rows += [(500, " ".join(rnd.choices(words, k=30_000))), (501, None), (None, "no id"), (7, "another text with that id")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string").repartition(5)


@pytest.mark.parametrize("shard_bytes", [100, 5_000, 64 << 20])
def test_shards_are_closed_by_bytes(docs, shard_bytes):
    rows, df = docs
    manifest = tokenfile.write_tokens(df, WORDS, shard_bytes=shard_bytes)
    files = manifest.collect()
    assert sum(r.n_docs for r in files) == len(rows) and len({r.shard for r in files}) == len(files)
    longest = max(len(encode.encoder(WORDS).encode(t or "")) + 2 for _, t in rows)
    assert all(r.n_ids * 2 <= shard_bytes + longest for r in files)
    got = tokenfile.read_tokens(manifest).orderBy("start").collect()
    at = 0
    enc = encode.encoder(WORDS)
    known = {}
    for d, t in rows:
        ids = [*np.frombuffer(enc.encode(t or ""), enc.dtype).tolist(), 1]
        known.setdefault(d, []).append((len(ids), brute.crc_of_ids(ids)))
    for r in got:
        assert r.start == at and (r.n_tokens, r.ids_crc32) in known[r.doc_id]
        at += r.n_tokens
    ids = [r.doc_id for r in got]
    assert ids[0] is None and ids[1:] == sorted(ids[1:])


def test_shard_round_trip():
    enc = encode.encoder(WORDS)
    texts = ["one two", "", "three " * 3000]
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([4, 9, 11]), "text": texts})
    parts = [p for p in tokenfile.encoded([batch], WORDS, 1, 1 << 20) if p]
    out = io.BytesIO()
    tokenfile.write_shard(out, parts, enc.dtype)

    class File:
        def size(self):
            return len(out.getvalue())

        def read_at(self, n, at):
            return out.getvalue()[at : at + n]

    shard = tokenfile.Shard(File())
    assert shard.doc_ids(0, 3) == [4, 9, 11]
    ends = shard.bounds.select(0, 4).tolist()
    for i, t in enumerate(texts):
        assert shard.ids(ends[i], ends[i + 1]).tobytes() == enc.encode(t) + np.array([1], enc.dtype).tobytes()


def test_low_bits_in_parts():
    values = np.cumsum(np.random.default_rng(1).integers(0, 1000, 40_001)).astype(np.uint64)
    ef = tokenfile.EliasFano.from_bytes(tokenfile.EliasFano.encode(values).to_bytes())
    assert (ef.select(0, len(values)) == values).all() and (ef.select(8_190, 8_195) == values[8_190:8_195]).all()


def test_pieces_follow_the_curve(spark, docs):
    """In order of sequence and offset a partition's documents go along the curve,
    and the ranges of partitions don't overlap."""
    rows, df = docs
    keys = {}
    enc, matrix = encode.encoder(BYTES), packing.projection()
    for d, t in rows:
        ids = np.frombuffer(enc.encode(t or "") + np.array([1], enc.dtype).tobytes(), enc.dtype)
        keys.setdefault(d, set()).add((int(packing.curve_key(packing.hashed_vector(ids)[None], matrix)[0]), len(ids)))
    got = packing.pack(df, BYTES).collect()
    parts = {}
    for r in got:
        parts.setdefault(r.sequence_id >> 36, []).append(r)
    ranges = []
    for _, own in sorted(parts.items()):
        found = [{k for k, n in keys[r.doc_id] if n == r.doc_tokens} for r in sorted(own, key=lambda r: (r.sequence_id, r.offset))]
        assert all(len(f) == 1 for f in found)
        order = [f.pop() for f in found]
        assert order == sorted(order)
        ranges.append((order[0], order[-1]))
    assert all(a[1] <= b[0] for a, b in zip(ranges, ranges[1:], strict=False))
    pieces = {}
    for r in got:
        pieces.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, r.length, r.sequence_id, r.offset))
    for (_, total), own in pieces.items():
        assert sum(n for _, n, _, _ in own) == total
    # Chunks of one document that stay together are one piece.
    long = sorted(p for (d, _), own in pieces.items() if d == 500 for p in own)
    for a, b in zip(long, long[1:], strict=False):
        assert a[0] + a[1] == b[0] and not (a[2] == b[2] and a[3] + a[1] == b[3])


def test_similar_documents_are_neighbours(spark):
    """Documents of one vocabulary mostly stand next to one of their own."""
    rnd = random.Random(4)
    kinds = [[f"k{k}w{i}" for i in range(30)] for k in range(6)]
    rows = [(i, " ".join(rnd.choices(kinds[i % 6], k=120))) for i in range(240)]
    got = sorted(packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), BYTES).collect(), key=lambda r: (r.sequence_id, r.offset))
    order = list(dict.fromkeys(r.doc_id for r in got))
    assert np.mean([a % 6 == b % 6 for a, b in zip(order, order[1:], strict=False)]) > 0.5
