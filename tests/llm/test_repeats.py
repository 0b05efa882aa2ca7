"""Repeats: equality is found on bytes, shards go through in rounds."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marlstone.llm import repeats, suffix
from tests.llm import brute


def _batch(texts):
    return pa.RecordBatch.from_pydict({"doc_id": pa.array(range(len(texts)), pa.int64()), "tie": pa.array([hash(t) % (1 << 60) for t in texts], pa.int64()), "text": pa.array(texts)})


def test_equal_hashes_of_different_bytes_cover_nothing(monkeypatch):
    """A batch whose content hashes all collide reduces equal bytes alone."""
    rnd = random.Random(1)
    passage = "".join(rnd.choices("abcdefgh ", k=400))
    texts = [passage + "x" * 30, "y" * 40 + passage, "".join(rnd.choices("abcdefgh ", k=500))]
    plain = repeats._Reduced(_batch(texts), 100, 32)
    assert len(plain.other)
    real = repeats.runs

    def colliding(*args):
        grams, content, row, start, size = real(*args)
        return grams, np.zeros_like(content), row, start, size

    monkeypatch.setattr(repeats, "runs", colliding)
    r = repeats._Reduced(_batch(texts), 100, 32)
    raw = [t.encode() for t in texts]
    for k in r.other:
        i, n = int(r.start[k]), int(r.size[k]) + 99
        piece = raw[r.row[k]][i : i + n]
        assert any(piece in x for x in raw[: r.row[k]]) or piece in raw[r.row[k]][: i + n - 1]
    assert 0 < len(r.other) <= len(plain.other) and len(r.own) + len(r.other) == len(plain.own) + len(plain.other)


def test_equal_bytes():
    raw = b"abcdefabcxefabc"
    at, lead, size = np.array([6, 6, 12, 3]), np.array([0, 0, 0, 3]), np.array([3, 6, 3, 2])
    # Spans at one distance that touch are compared together: both fail or hold.
    assert repeats._equal_bytes(raw, at[[0]], lead[[0]], size[[0]]).tolist() == [True]
    assert repeats._equal_bytes(raw, at[[1]], lead[[1]], size[[1]]).tolist() == [False]
    assert repeats._equal_bytes(raw, at[[2, 3]], lead[[2, 3]], size[[2, 3]]).tolist() == [True, True]
    assert repeats._equal_bytes(raw, at[:0], lead[:0], size[:0]).tolist() == []


@pytest.mark.parametrize("rounds", [60, 1 << 21])
def test_rounds_and_parts(spark, monkeypatch, rounds):
    """Shards larger than a block, whole or split, give the same as brute force."""
    rnd = random.Random(rounds)
    line = "".join(rnd.choices("abcdef", k=60))
    rows = [(i, "".join(rnd.choices("abc", k=rnd.randrange(30))) + line[rnd.randrange(9) :] + "".join(rnd.choices("abc", k=rnd.randrange(30)))) for i in range(60)]
    monkeypatch.setattr(repeats, "ROUND_BYTES", rounds)
    monkeypatch.setattr(repeats, "SHARD_BYTES", rounds)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for split in (1 << 22, 90):
        monkeypatch.setattr(repeats, "SPLIT", split)
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.remove_repeats(docs, 14, 5).collect()}
        assert got == brute.without_repeats(rows, 14)


def test_suffix_arrays_decide(spark, monkeypatch):
    """Without what the suffix arrays show, nothing that spans batches goes."""
    rnd = random.Random(4)
    passage = "".join(rnd.choices("abcdefgh ", k=600))
    docs = spark.createDataFrame([(i, f"{i} {passage} {i}") for i in range(8)], "doc_id long, text string").repartition(8, "doc_id").withColumn("n", F.lit(1))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1)
    try:
        assert sum(r.n_removed for r in repeats.remove_repeats(docs).collect()) >= 7 * 600
        real = repeats.sorted_shards
        monkeypatch.setattr(repeats, "sorted_shards", lambda *a: real(*a).limit(0))
        assert sum(r.n_removed for r in repeats.remove_repeats(docs).collect()) == 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_repeated_rows_by_the_hundred(spark):
    """Rows that share id and text are one document however often they come."""
    text = "".join(random.Random(5).choices("abcdefgh ", k=500))
    docs = spark.createDataFrame([(1, text)] * 300 + [(2, text)] * 300, "doc_id long, text string").repartition(7)
    got = {(r.doc_id, r.n_removed) for r in repeats.remove_repeats(docs).collect()}
    assert got == {(1, 0), (2, 500)}


def test_names_compare_symbols():
    """LMS substrings of one length are told apart by their symbols."""
    s = np.array([3, 1, 2, 3, 1, 2, 3, 1, 3, 3, 1, 2, 0])
    sa = suffix.suffix_array(s, 4)
    assert sa.tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())
    rnd = np.random.default_rng(0)
    old, suffix._COMPARE = suffix._COMPARE, 7
    try:
        for _ in range(40):
            s = np.append(rnd.integers(1, 4, rnd.integers(1, 120)), 0)
            assert suffix.suffix_array(s, 4).tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())
    finally:
        suffix._COMPARE = old
