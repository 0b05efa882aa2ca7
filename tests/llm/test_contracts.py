"""Each registered query against SQL or a brute-force version on a whole table."""

import numpy as np
import pytest

from marlstone.llm import encode, oracles, queries
from tests.llm import brute
from tests.oracle import check, duck

QUERIES, SQL = queries.queries(), queries.oracle_sql()


@pytest.fixture(scope="module")
def docs(sf):
    return duck(sf).execute("SELECT doc_id, text FROM documents").fetchall()


def rows(spark, sf, name):
    return QUERIES[name](spark, sf).collect()


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, sf, name):
    check(spark, sf, QUERIES[name], SQL[name])


def test_ten_operators():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
    assert oracles.CHAT and oracles.SUFFIXES and len(SQL) == 5


def test_pages(spark, sf):
    import html
    import re

    pages = {r[0]: r[1] for r in duck(sf).execute("SELECT page_id, html FROM pages").fetchall()}
    got = {r.page_id: r for r in rows(spark, sf, "op1_html_template")}
    assert got.keys() == pages.keys()
    for k, source in pages.items():
        body = re.search(r"<article>(.*?)</article>", source, re.S)[1]
        blocks = re.split(r"</?(?:p|h1)>", body)
        lines = [" ".join(html.unescape(re.sub(r"<[^>]*>", " " if "<br>" in b else "", b)).split()) for b in blocks]
        assert got[k].text == "\n".join(x for x in lines if x) and got[k].n_chars == len(got[k].text)


def test_decontaminated(spark, sf, docs):
    items = duck(sf).execute("SELECT item_id, text FROM benchmark").fetchall()
    expected = brute.decontaminated(docs, items)
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in rows(spark, sf, "op3_winnowing")}
    assert got == expected


def _whole(name):
    import public_tokenizers

    enc = encode.TextEncoder(public_tokenizers.path(name))
    return lambda t: [*enc.tok.encode(t or "", add_special_tokens=False).ids, 1]


def test_packed(spark, sf, docs):
    ids = _whole("byte_bpe_50k.json")
    tokens = {d: ids(t) for d, t in docs}
    got = rows(spark, sf, "op4_hilbert_packing")
    pieces, sequences = {}, {}
    for r in got:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    assert pieces.keys() == tokens.keys()
    for d, own in pieces.items():
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(tokens[d])
            assert r.ids_crc32 == brute.crc_of_ids(tokens[d][at : at + r.length])
            at += r.length
        assert at == len(tokens[d])
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048 and at & (at - 1) == 0  # full, or of a power of two


def test_token_files(spark, sf, docs):
    ids = _whole("word_bpe_49k.json")
    at, expected = 0, {}
    for d, t in sorted(docs):
        found = ids(t)
        expected[d] = (at, len(found), brute.crc_of_ids(found))
        at += len(found)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in rows(spark, sf, "op6_token_files")} == expected


def test_components(spark, sf, docs):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in rows(spark, sf, "op7_simhash_ball")}
    assert got == brute.components(docs)


def test_repeats(spark, sf, docs):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows(spark, sf, "op8_suffix_array")}
    assert got == brute.without_repeats(docs)


def test_toxicity(spark, docs):
    """Held-out rows of a larger table: nearly all are told apart."""
    sf = "/root/testdata/sf0.01"
    truth = dict(duck(sf).execute("SELECT doc_id, toxic FROM labels").fetchall())
    got = rows(spark, sf, "op9_deobfuscated_toxicity")
    assert all(r.held_out == brute.held_out(r.doc_id) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    held = [(truth[r.doc_id], r.score) for r in got if r.held_out and r.doc_id in truth]
    good, bad = [s for y, s in held if y], [s for y, s in held if not y]
    assert np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad]) > 0.85
    assert np.mean([(s >= 0.5) == y for y, s in held]) > 0.9


def test_pipeline(spark, sf, docs):
    """Every stage on what the one before kept, against plain versions."""
    import corpus_pipeline as cp
    from marlstone.llm import toxicity
    from marlstone.session import cut, table

    table_ = table(spark, sf, "documents")
    kept = table_
    stages = dict(cp.STAGES)
    assert list(stages) == ["toxicity", "simhash_near_dedup", "suffix_array_dedup", "decontamination", "packing"]

    def step(name):
        out = cut(stages[name](spark, kept, sf), "stage")
        return out, {r.doc_id: r.text for r in kept.select("doc_id", "text").collect()}

    after, before = step("toxicity")
    model = toxicity.fit(table_, table(spark, sf, "labels")).scorer()
    assert {r.doc_id for r in after.collect()} == {d for d, t in before.items() if model(t) < 0.5}
    kept = after
    after, before = step("simhash_near_dedup")
    assert {r.doc_id for r in after.collect()} == {c for _, c in brute.components(list(before.items())).values()}
    kept = after
    after, before = step("suffix_array_dedup")
    assert after.columns == table_.columns
    plain = brute.without_repeats(list(before.items()))
    for r in after.collect():
        assert r.n_chars == len(r.text)
        n, gone = plain[r.doc_id][:2]
        assert n - gone - 6 * plain[r.doc_id][2] <= len(r.text.encode()) <= n - gone
        if not gone:
            assert r.text == before[r.doc_id]
    kept = after
    after, before = step("decontamination")
    items = duck(sf).execute("SELECT item_id, text FROM benchmark").fetchall()
    assert {r.doc_id for r in after.collect()} == {d for d, v in brute.decontaminated(list(before.items()), items).items() if not v[1]}
    kept = after
    last, before = step("packing")
    assert {r.doc_id for r in last.collect()} == set(before)
    ran = cp.run(spark, sf)
    assert {r.doc_id for r in ran.select("doc_id").collect()} == set(before)

