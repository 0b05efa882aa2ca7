"""A broadcast benchmark and a shuffled one give the same, and that of brute force."""

import random

import pytest

from marlstone.llm import decontaminate
from tests.llm import brute


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(6)
    words = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rnd.choices(words, k=rnd.choice([1, 4, 10, 30])))) for i in range(60)] + [(3, "W1, w2; W3"), (99, None), (98, " .. ")]
    docs = [(i, " ".join(rnd.choices(words, k=rnd.randrange(120)))) for i in range(150)]
    docs += [(1000 + i, f"Before {items[i][1].upper()} after") for i in range(60)] + [(2000, None), (2001, "")]
    return docs, items


@pytest.mark.parametrize("size", [8 << 20, 0])
def test_both_ways(spark, monkeypatch, rows, size):
    docs, items = rows
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", size)
    frames = spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, text string")
    plain = brute.decontaminated(docs, [x for x in items if x[1]])
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in decontaminate.decontaminate(*frames).collect()}
    assert got == plain
    clean = {r.doc_id for r in decontaminate.uncontaminated(*frames).collect()}
    assert clean == {d for d, v in plain.items() if not v[1]}


def test_documents_stay_where_they_are(spark, rows):
    """With a small benchmark no document is shuffled."""
    docs, items = rows
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    plan = decontaminate.decontaminate(*frames)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
