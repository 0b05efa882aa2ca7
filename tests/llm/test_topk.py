"""MaxScore over several shards and blocks against all inner products."""

import numpy as np
import pytest

from marlstone.llm import topk


def _plain(rows, k=5):
    out = {}
    for i, q in rows:
        if i % 50 == 0:
            found = sorted((-max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(q, v, strict=False)))), j) for j, v in rows if j != i)[:k]
            out[i] = [(n + 1, j, -s) for n, (s, j) in enumerate(found)]
    return out


def _found(spark, rows, scale=1):
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "vec_id long, embedding array<double>").repartition(3)
    vectors = topk.quantised(df, scale)
    out = {}
    for r in topk.top_k(vectors, vectors.filter("vec_id % 50 = 0")).collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize("bound_bytes", [32 << 20, 0])
@pytest.mark.parametrize("kind", ["spread", "clusters", "ties"])
def test_shards_and_blocks(spark, monkeypatch, kind, bound_bytes):
    monkeypatch.setattr(topk, "SHARD_ROWS", 64)
    monkeypatch.setattr(topk, "BLOCK_ROWS", 3)
    monkeypatch.setattr(topk, "BOUND_BYTES", bound_bytes)
    rnd = np.random.default_rng(7)
    n = 600
    v = rnd.integers(-99, 99, (n, 12))
    if kind == "clusters":
        v = rnd.integers(-99, 99, (6, 12))[np.arange(n) % 6] + rnd.integers(-3, 3, (n, 12))
    if kind == "ties":
        v = rnd.integers(0, 2, (n, 4))
    rows = [(i, [int(x) for x in r]) for i, r in enumerate(v)]
    assert _found(spark, rows) == _plain(rows)


def test_scores_beyond_a_long_are_clamped(spark):
    rows = [(0, [10**10, 1]), (1, [10**10, 5]), (2, [-(10**10), 0]), (3, [3, 4]), (50, [10**300, 0]), (4, [1 << 40, 5])]
    real = [(i, [max(-(1 << 63), min((1 << 63) - 1, x)) for x in v]) for i, v in rows]
    assert _found(spark, rows) == _plain(real)


def test_a_floor_never_hides_a_better_vector():
    rnd = np.random.default_rng(1)
    vectors = list(rnd.integers(-50, 50, (300, 16)))
    shard = topk.Shard(np.arange(300), vectors)
    q = rnd.integers(-50, 50, 16)
    every = sorted(((-int(q @ v), i) for i, v in enumerate(vectors) if i != 7))
    for rank in (0, 2, 4, 10, 299):
        floor = -every[min(rank, 298)][0]
        got = shard.search(q, 7, 5, floor)
        assert [x for x in got if x[0] >= floor] == [(-s, i) for s, i in every[:5] if -s >= floor]
