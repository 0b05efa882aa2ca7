"""The pipeline's stages on odd rows, one by one, and what it leaves behind."""

import os

import pytest

import corpus_pipeline as cp
from marlstone.llm.common import cut
from marlstone.session import shared_dir
from tests.llm import brute
from tests.llm.test_edges import CLASH, KNOWN, PASSAGE, TEXTS, table

WORDS = "this harmless text says something else in every row of the table"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A folder of tables: odd documents, and labelled ones to learn from."""
    path = str(tmp_path_factory.mktemp("odd"))
    rows = TEXTS + [(1000 + i, f"{WORDS} {i} {'horrid wretch' if i % 2 else 'pleasant day'} " + " ".join(f"u{i}v{k}" for k in range(30))) for i in range(60)]
    table(spark, rows).write.parquet(f"{path}/documents.parquet")
    labels = [(1000 + i, i % 2) for i in range(60)] + [(None, 1), (1001, None), (1001, 1)]
    spark.createDataFrame(labels, "doc_id long, toxic int").selectExpr("doc_id", "0 AS quality", "toxic").write.parquet(f"{path}/labels.parquet")
    items = [(1, "shared38 shared39"), (2, None), (None, "a plain text of more than ten words that nobody else"), (3, "")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


@pytest.fixture(scope="module")
def nothing(spark, folder, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("nothing"))
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{path}/{name}.parquet")
    return path


STAGES = dict(cp.STAGES)


def _rows(df):
    return sorted(((r.doc_id, r.text) for r in df.select("doc_id", "text").collect()), key=repr)


def test_toxicity(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = STAGES["toxicity"](spark, docs, folder)
    assert out.columns == docs.columns
    assert _rows(out) == sorted((r for r in _rows(docs) if "wretch" not in (r[1] or "")), key=repr)


def test_near_copies(spark, folder):
    docs = table(spark, TEXTS)
    out = STAGES["simhash_near_dedup"](spark, docs, folder)
    assert out.columns == docs.columns
    ids = [d for d, _ in _rows(out)]
    plain = {c for _, c in brute.components(KNOWN).values()}
    assert sorted(d for d in ids if d is not None) == sorted(plain)
    # Of the rows without an id one is alone, the other has no words as row 6 has.
    assert ids.count(None) == 1 and 6 in ids and 7 not in ids


def test_repeats(spark, folder):
    docs = table(spark, TEXTS)
    out = STAGES["suffix_array_dedup"](spark, docs, folder)
    assert out.columns == docs.columns
    got = _rows(out)
    assert sorted((d for d, _ in got), key=repr) == sorted((d for d, _ in TEXTS), key=repr)
    assert (7, None) in got and (6, "") in got and (None, None) in got
    assert [len(t) for d, t in got if d == 14] == [1, 1]  # each byte but the first is in an earlier string


def test_leaks(spark, folder):
    docs = table(spark, TEXTS)
    out = STAGES["decontamination"](spark, docs, folder)
    assert out.columns == docs.columns
    assert _rows(out) == sorted(((d, t) for d, t in TEXTS if PASSAGE not in (t or "")), key=repr)


def test_packing(spark, folder):
    docs = table(spark, TEXTS)
    got = STAGES["packing"](spark, docs, folder).collect()
    assert sorted((r.doc_id for r in got if not r.start), key=repr) == sorted((d for d, _ in TEXTS), key=repr)
    assert [r.doc_tokens for r in got if r.doc_id in (6, 7)] == [1, 1]


@pytest.mark.parametrize("stage", [name for name, _ in cp.STAGES])
def test_empty_tables(spark, nothing, stage):
    docs = table(spark, [])
    out = STAGES[stage](spark, docs, nothing)
    assert out.count() == 0 and (stage == "packing" or out.columns == docs.columns)


def test_whole_runs(spark, folder, nothing):
    assert cp.run(spark, nothing).count() == 0
    ids = {r.doc_id for r in cp.run(spark, folder).select("doc_id").collect()}
    # 9 and 10 lost the passage to the row without an id, which then goes as a leak.
    assert ids >= {5, 6, 8, 9, 10, 12, 13, 14} and not ids & {7, 11, None} and {i % 2 for i in ids if i >= 1000} == {0}
    assert set(CLASH) <= set(spark.read.parquet(f"{folder}/documents.parquet").columns)


def test_scratch_goes(spark, folder):
    """Of a run only what its result reads stays, and that goes with the session."""
    cut(spark.range(1), "marker")
    root = shared_dir(spark)
    before = set(os.listdir(root))
    assert cp.run(spark, folder).count()
    left = {x.rsplit("-", 1)[0] for x in set(os.listdir(root)) - before}
    assert left == {"token-ids"}
