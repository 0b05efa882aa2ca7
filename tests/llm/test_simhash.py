"""Near copies: prefixes grow with the counted fingerprints; hot components."""

import random

import pytest

from marlstone.llm import simhash
from tests.llm import brute


def _clusters(rnd, groups, each, flips):
    base = [rnd.getrandbits(64) for _ in range(groups)]
    return sorted({b ^ sum(1 << x for x in rnd.sample(range(64), rnd.randrange(flips))) for b in base for _ in range(each)})


def _signed(f):
    return f - (1 << 64) if f >> 63 else f


def _plain(fps, radius=4):
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            root[f] = root[root[f]]
            f = root[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= radius:
                root[find(a)] = find(b)
    return {f: find(f) for f in fps}


@pytest.mark.parametrize("load", [1 << 16, 40, 6])
def test_longer_prefixes_lose_no_link(spark, monkeypatch, load):
    rnd = random.Random(load)
    fps = _clusters(rnd, 12, 25, 7)
    monkeypatch.setattr(simhash, "LOAD", load)
    monkeypatch.setattr(simhash, "DEEPEST", 24)
    df = spark.createDataFrame([(_signed(f),) for f in fps], "fp long")
    bits = simhash.prefix_bits(df, 2)
    assert bits == 12 if load == 1 << 16 else bits > 12
    got = simhash.connected(simhash.links(df)).collect()
    root = {r.node: r.root for r in got}
    plain, seen = _plain(fps), {}
    for f in fps:
        found = root.get(_signed(f), _signed(f))
        assert seen.setdefault(plain[f], found) == found
    assert len(set(seen.values())) == len(seen)


def test_prefixes_are_bounded(spark, monkeypatch):
    """As many fingerprints as fill short prefixes get longer ones."""
    monkeypatch.setattr(simhash, "LOAD", 64)
    rnd = random.Random(3)
    df = spark.createDataFrame([(_signed(rnd.getrandbits(64)),) for _ in range(6000)], "fp long")
    bits = simhash.prefix_bits(df, 2)
    most = simhash._spread(df, bits, 2).groupBy("prefix").count().agg({"count": "max"}).first()[0]
    assert bits > 12 and most <= 64


def test_one_large_component(spark):
    """A component with most rows, among its copies and near copies."""
    words = [f"w{i}" for i in range(400)]
    rnd = random.Random(9)
    rows = []
    for i in range(150):
        own = list(words)
        if i % 3:
            own[rnd.randrange(400)] = f"x{i % 50}"
        rows.append((1000 - i, " ".join(own)))
    rows += [(i, " ".join(rnd.choices(words, k=30))) for i in range(20)]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute.components(rows)
    stay = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id for r in stay.collect()} == {c for _, c in brute.components(rows).values()}
