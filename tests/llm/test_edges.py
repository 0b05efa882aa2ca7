"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import io
import random
import struct

import numpy as np
import public_tokenizers
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marlstone.llm import chat, decontaminate, encode, packing, pages, repeats, simhash, suffix, tokenfile, topk, toxicity, warc
from tests.llm import brute

LONG = " ".join(f"word{i % 977} and{i}" for i in range(60_000))
PASSAGE = " ".join(f"shared{i}" for i in range(40))
TEXTS = [
    (5, "A plain text of more than ten words that nobody else in this small table repeats."), (6, ""), (7, None), (8, "short"),
    (9, f"before {PASSAGE} after nine"), (10, f"Quite other words come first {PASSAGE} and others last"), (11, f"before {PASSAGE} after nine"),
    (12, LONG), (13, "é" * 120 + " ü " + "é" * 120), (14, "a" * 1000), (14, "a" * 1000), (15, "\x00\t\n ??"), (None, f"no id {PASSAGE}"), (None, None),
]
CLASH = "_items _doc _tie _of tie fp kind gram score text_ _row _hash _covered shard".split()
BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def table(spark, rows):
    """doc_id and text with other columns whose names the operators use too."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASH)]).repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, TEXTS)


@pytest.fixture(scope="module")
def none(spark):
    return table(spark, [])


KNOWN = [(d, t) for d, t in dict(TEXTS).items() if d is not None]


def test_decontaminate(spark, docs, none):
    items = spark.createDataFrame([(1, PASSAGE), (2, "short"), (3, None), (4, ""), (None, "plain text"), (1, "nobody else in"), (22, PASSAGE + " x")], "item_id long, text string")
    plain = brute.decontaminated(KNOWN, [(1, PASSAGE), (2, "short"), (1, "nobody else in"), (22, PASSAGE + " x")])
    got = decontaminate.decontaminate(docs, items).collect()
    assert len(got) == len(TEXTS)
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in got if r.doc_id is not None} == plain
    assert sorted(r.n_hit for r in got if r.doc_id is None) == [0, 40]
    spans = {r.doc_id: [(s.start, s.stop) for s in r.hit_spans] for r in got}
    assert spans[9] == [(1, 41)]
    clean = decontaminate.uncontaminated(docs, items)
    assert clean.columns == docs.columns
    assert sorted(str(r.doc_id) for r in clean.collect()) == sorted(map(str, [6, 7, 12, 13, 14, 14, 15, None]))
    assert decontaminate.decontaminate(none, items).count() == 0
    assert decontaminate.decontaminate(docs, items.limit(0)).filter("contaminated").count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("a b c d".split()), max_size=40), st.lists(st.sampled_from("a b c d".split()), max_size=25), st.integers(1, 12))
def test_extension(words, item, window):
    raw = " ".join(words)
    data = np.frombuffer(raw.encode(), np.uint8)
    from marlstone.llm.common import prefix_hash, span_hash

    low, starts, stops, _ = decontaminate.words_of(data, np.array([0, len(data)]))
    hashes = span_hash(prefix_hash(low), starts, stops) if len(starts) else np.zeros(0, np.uint64)
    hit, found = decontaminate.extend([w.encode() for w in words], hashes, [("1", [w.encode() for w in item])], window)
    plain = brute.decontaminated([(0, raw)], [(1, " ".join(item))], window)[0]
    assert (int(hit.sum()), len(found)) == plain[1:3]
    if len(item) >= window and len(words) >= window and window > 2:
        a = decontaminate.fingerprints(hashes, np.zeros(len(hashes), np.int64), [], window, 2)[1]
        ih = np.concatenate([hashes[[words.index(w)]] if w in words else [np.uint64(1 << 40)] for w in item])
        b = decontaminate.fingerprints(ih, np.zeros(len(ih), np.int64), [], window, 2)[1]
        assert not plain[1] or set(a.tolist()) & set(b.tolist())  # a shared span shares a fingerprint


def test_simhash(spark, docs, none):
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(TEXTS)
    plain = brute.components(KNOWN)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got if r.doc_id is not None} == plain
    assert simhash.near_duplicates(none).count() == 0
    alone = simhash.near_duplicates(table(spark, [(None, "only this"), (None, "only this")])).collect()
    assert [r.component_id for r in alone] == [None, None]
    stay = simhash.one_of_each(docs)
    assert stay.columns == docs.columns
    ids = sorted((str(r.doc_id) for r in stay.collect()))
    assert ids.count("14") == 1 and "11" not in ids and "7" not in ids and "6" in ids
    with pytest.raises(ValueError):
        simhash.near_duplicates(docs, radius=3)


@pytest.mark.parametrize("depth", [12, 3])
def test_ball_hashing(depth):
    """Near and far fingerprints, and more of a prefix than fit at a time."""
    rnd = random.Random(depth)
    base = [rnd.getrandbits(64) for _ in range(40)]
    fps = sorted({b ^ sum(1 << x for x in rnd.sample(range(64), rnd.randrange(6))) for b in base for _ in range(12)})
    found = np.array(fps, np.uint64)
    root = {}
    for prefix in range(1 << depth):
        dist = np.bitwise_count((found >> np.uint64(64 - depth)) ^ np.uint64(prefix))
        own = dist <= 2
        if own.sum() < 2:
            continue
        index = np.flatnonzero(own)
        for pair in simhash.collisions(found[own] ^ (((found[own] >> np.uint64(64 - depth)) ^ np.uint64(prefix)) << np.uint64(64 - depth)), index, (2 - dist[own]).astype(np.int64), depth):
            for a, b in pair.T.tolist():
                root.setdefault(a, set()).add(b)
    pairs = {(a, b) for a, v in root.items() for b in v}
    assert all((fps[a] ^ fps[b]).bit_count() <= 4 for a, b in pairs)
    a, b = (np.array([p[i] for p in pairs], np.int64) for i in (0, 1))
    label = simhash.local_components(len(fps), a, b)
    near = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4]
    plain = simhash.local_components(len(fps), np.array([i for i, _ in near]), np.array([j for _, j in near]))
    assert label.tolist() == plain.tolist()


def test_connected_chain(spark):
    links = [(i + 1, i) for i in range(40)] + [(100 + i, 100) for i in range(1, 30)]
    got = {r.node: r.root for r in simhash.connected(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {100 + i: 100 for i in range(1, 30)}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 3), min_size=0, max_size=80), st.sampled_from([2, 512]))
def test_suffix_array(values, buckets):
    s = np.array([*values, 0], np.int64)
    old, suffix.BUCKETS = suffix.BUCKETS, buckets
    try:
        sa = suffix.suffix_array(s, 4)
    finally:
        suffix.BUCKETS = old
    plain = s.tolist()
    assert sa.tolist() == sorted(range(len(plain)), key=lambda i: plain[i:])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", max_size=40), min_size=1, max_size=6), st.integers(2, 6))
def test_repeated_strings(texts, length):
    pieces = [t.encode() for t in texts]
    got = set()
    if any(len(p) >= length for p in pieces):
        piece, first, stop = repeats.repeated_strings(pieces, np.arange(len(pieces)), np.zeros(len(pieces), np.int64), length)
        got = {(p, i) for p, a, z in zip(piece.tolist(), first.tolist(), stop.tolist(), strict=True) for i in range(a, z)}
    seen, plain = set(), set()
    for k, p in enumerate(pieces):
        for i in range(len(p) - length + 1):
            if p[i : i + length] in seen:
                plain.add((k, i))
            seen.add(p[i : i + length])
    assert got == plain


def _repeats_match(spark, rows, length=100, gram=32):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.remove_repeats(table(spark, rows), length, gram).collect()}
    assert got == brute.without_repeats(rows, length)


def test_repeats(spark, docs, none, monkeypatch):
    _repeats_match(spark, [(d, t) for d, t in KNOWN if d != 14])
    _repeats_match(spark, [(1, "ab" * 300), (2, "x" + "ab" * 80 + "y"), (3, "b" * 99), (4, "b" * 100), (5, "b" * 101)])
    got = repeats.remove_repeats(docs).collect()
    assert len(got) == len(TEXTS) and repeats.remove_repeats(none).count() == 0
    same = [r for r in got if r.doc_id == 14]
    assert same[0] == same[1] and same[0].n_removed == 999
    rnd = random.Random(3)
    rows = [(i, "".join(rnd.choice(["ab", "ba", "aab", "abcabc", " "]) for _ in range(60))) for i in range(30)]
    monkeypatch.setattr(repeats, "SPLIT", 40)  # every gram is split
    monkeypatch.setattr(repeats, "BLOCK_BYTES", 64)
    assert sum(v[1] > 0 for v in brute.without_repeats(rows, 12).values()) > 10
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.remove_repeats(table(spark, rows), 12, 4).collect()}
    assert got == brute.without_repeats(rows, 12)
    cut = repeats.without_repeats(docs)
    assert cut.columns == docs.columns
    texts = {r.doc_id: r.text for r in cut.collect()}
    assert texts[7] is None and texts[6] == "" and texts[5] == TEXTS[0][1] and PASSAGE not in texts[10]


def test_packing(spark, docs, none):
    got = packing.pack(docs, BYTES).collect()
    ids = encode.encoder(BYTES)
    total = sum(len(ids.encode(t or "")) // 2 + 1 for _, t in TEXTS)
    assert sum(r.length for r in got) == total
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append(r)
        assert len(r.ids) == 4 * r.length
    for own in by.values():
        n = sum(r.length for r in own)
        assert n <= 2048 and n & (n - 1) == 0 and sorted(r.offset for r in own)[0] == 0
    assert packing.pack(none, BYTES).count() == 0


def test_hilbert_curve():
    """Each cell once, and neighbours on the curve are neighbours in space."""
    for dims, bits in ((2, 3), (3, 2)):
        cells = np.array(np.meshgrid(*[range(1 << bits)] * dims)).reshape(dims, -1).T
        key = packing.hilbert(cells, bits)
        assert sorted(key.tolist()) == list(range(1 << bits * dims))
        path = cells[np.argsort(key)]
        assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_token_files(spark, docs, none):
    got = tokenfile.read_tokens(tokenfile.write_tokens(docs, WORDS)).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted([d for d, _ in TEXTS if d is None] + [d for d, _ in TEXTS if d is not None], key=lambda d: (d is not None, d or 0))
    at = 0
    for r in got:
        assert r.start == at and r.n_tokens >= 1
        at += r.n_tokens
    assert tokenfile.read_tokens(tokenfile.write_tokens(none, WORDS)).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 1 << 40), max_size=700), st.data())
def test_elias_fano(gaps, data):
    values = np.cumsum(np.array(gaps, np.uint64), dtype=np.uint64) if gaps else np.zeros(0, np.uint64)
    ef = tokenfile.EliasFano.from_bytes(tokenfile.EliasFano.encode(values).to_bytes())
    a = data.draw(st.integers(0, len(gaps)))
    b = data.draw(st.integers(a, len(gaps)))
    assert ef.select(a, b).tolist() == values[a:b].tolist()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["a", "Éé", " ", "  ", "\n", ".", ",", "'s", "1", "中", "\t", "　", "!", "<|endoftext|>", "word", "\x1c", "́", "İ", "<|startoftext|>", "ß"]), max_size=14), st.sampled_from([BYTES, WORDS]))
def test_encoder(parts, path):
    text = "".join(parts)
    enc = encode.encoder(path)
    assert enc.encode(text) == enc.whole(text)


def test_warc(spark, tmp_path):
    body = "<p>é</p>" * 200
    rows = [(1, "http://a/\r\nX: y", body), (2, None, body), (3, "u", "x" * 10), (4, "u", "x" * 10), (5, "u", None), (None, "u", body), (6, "u", "z" * 300_000), (2, None, body)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1)).withColumn("refers_to", F.lit(1))
    manifest = warc.write_warc(df)
    got = warc.read_warc(manifest).collect()
    assert sorted((str(r.page_id), r.record_type, r.refers_to) for r in got) == sorted([("1", "revisit", 2), ("2", "response", None), ("2", "response", None), ("3", "response", None), ("4", "response", None), ("5", "response", None), ("None", "response", None), ("6", "response", None)], key=lambda r: (r[0], r[1]))
    first = next(r for r in got if r.page_id == 1)
    assert first.url == "http://a/%0D%0AX:%20y" and first.payload is None and first.payload_bytes == len(body.encode())
    assert next(r for r in got if r.page_id == 2).payload.decode() == body
    assert warc.read_warc(warc.write_warc(df.limit(0))).count() == 0


def test_warc_damage():
    raw = warc.record(1, "u", b"payload", __import__("hashlib").sha1(b"payload").hexdigest(), None)
    assert warc.parse(raw)["payload"] == b"payload"
    for bad in (raw[:-1], raw.replace(b"payload\r\n", b"paxload\r\n"), raw.replace(b"WARC/1.1", b"WARC/9.9"), raw.replace(b"WARC-Type", b"WARC Type\x00 "), raw.replace(b"WARC-Date: ", b"WARC-Date ")):
        with pytest.raises(ValueError):
            warc.parse(bad)
    out = io.BytesIO()
    writer = warc.ArchiveWriter(out)
    records = [warc.record(i, "u", b"some words %d" % i * 90, __import__("hashlib").sha1(b"some words %d" % i * 90).hexdigest(), None) for i in range(2000)]
    for r in records:
        writer.add(r)
    writer.close()
    data = out.getvalue()
    magic, size = struct.unpack("<II", data[:8])
    assert magic == warc.SKIPPABLE and size > 0 and list(warc.frames(io.BytesIO(data), 777)) == records
    for bad in (data[:-3], data[: 8 + size // 2], b"", zstandard.compress(b"x")):
        with pytest.raises((ValueError, zstandard.ZstdError)):
            list(warc.frames(io.BytesIO(bad)))


@settings(max_examples=100, deadline=None)
@given(st.text(st.sampled_from("<|\\\nim_startend> é"), max_size=30))
def test_escape(text):
    assert "<|" not in chat.escape(text) and chat.unescape(chat.escape(text)) == text
    assert chat.unescape_role(chat.escape_role(text)) == text and "\n" not in chat.escape_role(text)


def test_chat(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", None), (2, None, None, "x"), (2, 0, "user", "<|im_end|>"), (None, 1, "assistant", "b"), (None, 0, "user", "a"), (3, 0, "user", "q"), (3, 0, "assistant", "q"), (4, 0, "user", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("segment", F.lit(0)).withColumn("loss", F.lit(1))
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    assert {k: (r.n_turns, r.valid, r.loss_chars) for k, r in got.items()} == {1: (2, True, 0), 2: (2, False, 0), None: (2, True, 1), 3: (2, False, 1), 4: (1, False, 0)}
    assert chat.read_back(chat.format_conversations(df.limit(0))).count() == 0
    reader = chat.Reader()
    with pytest.raises(ValueError):
        reader.feed("no turn<|im_end|>\n", False, None)


def _scorer(spark, docs, labels):
    return toxicity.fit(docs, labels).scorer()


def test_toxicity(spark, docs, none):
    rnd = random.Random(2)
    words = [f"{a}{b}{c}" for a in ("ba", "lo", "ti", "ren") for b in ("mo", "la", "ke") for c in ("n", "ra", "st")]
    rows = [(i, " ".join(rnd.choices(words, k=40)) + ((" you horrid one " if i % 2 else " you wretch ") if i % 3 == 0 else " ")) for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    score = _scorer(spark, table(spark, rows), labels)
    clean = " ".join(words)
    assert score(clean) < 0.5 and score(None) == score("") < 0.5
    for bad in ("horrid wretch", "h0rr1d wr3tch", "h o r r i d", "w.r.e.t.c.h", "HORRRRRID", "wr3tchhhhh!!", "(horrid)"):
        assert score(f"{clean} {bad} {clean}") >= 0.5, bad
    # Clean text stays as it is.
    assert toxicity.fit(docs, labels.limit(0)).scorer()("x") < 0.5
    model = toxicity.fit(table(spark, rows), labels)
    assert toxicity.Restorer(model.cost).words("ka'mo 12 %%% good!!") >= {"good"}
    out = toxicity.score(docs, model).collect()
    assert len(out) == len(TEXTS) and not any(r.held_out for r in out if r.doc_id is None)
    assert toxicity.score(none, model).count() == 0 and toxicity.fit(none, labels).scorer()("x") < 0.5
    kept = toxicity.accepted(docs, model)
    assert kept.columns == docs.columns and kept.count() == len(TEXTS)


def test_toxicity_spacing(spark):
    """Spaced letters beside punctuation or with wide gaps, and doubled letters."""
    rnd = random.Random(3)
    words = [f"{a}{b}{c}" for a in ("ba", "lo", "ti", "ren") for b in ("mo", "la", "ke") for c in ("n", "ra", "st")]
    rows = [(i, " ".join(rnd.choices(words, k=40)) + (rnd.choice([" you scum ", " you vug "]) if i % 3 == 0 else " ")) for i in range(300)]
    score = _scorer(spark, table(spark, rows), spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "doc_id long, toxic int"))
    clean = " ".join(words)
    for bad in ("s c u m.", "s c u m?", '"s c u m"', "(s c u m)", "s c u m,", "s   c   u   m", "s / c / u / m", "s\tc\tu\tm", "ssccuumm", "sccum", "v u g", "v u g!"):
        assert score(f"{clean} {bad} {clean}") >= 0.5, bad
    for good in ("a, b, c", "J. R. R.", "baammon", "renn   lo"):
        assert score(f"{clean} {good} {clean}") < 0.5, good


def test_top_k(spark):
    rnd = np.random.default_rng(4)
    rows = [(i, rnd.integers(-40, 40, rnd.integers(3, 6)).astype(float).tolist()) for i in range(400)]
    rows += [(400, None), (401, []), (402, [1.0, None]), (403, [float("nan")]), (404, [float("inf")]), (None, [1.0, 1.0, 1.0]), (7, rows[7][1]), (1000, rows[3][1]), (1001, rows[3][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("shard", F.lit(1)).withColumn("v", F.lit(1))
    vectors = topk.quantised(df, 1)
    got = {}
    for r in topk.top_k(vectors, vectors.filter("vec_id % 50 = 0")).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    real = [(i, [int(x) for x in v]) for i, v in rows if i is not None and i < 400 or i in (1000, 1001)]
    plain = {}
    for i, q in dict(real).items():
        if i % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(q, v, strict=False)), j) for j, v in real if j != i)[:5]
            plain[i] = [(n + 1, j, -s) for n, (s, j) in enumerate(best)]
    assert {k: sorted(v) for k, v in got.items()} == plain
    assert topk.top_k(vectors.limit(0), vectors.limit(0)).count() == 0
    one = vectors.filter("vec_id = 50")
    assert topk.top_k(one, one).count() == 0
    big = topk.Shard(np.array([1, 2]), [np.array([1 << 40, 5]), np.array([1 << 40, 6])])
    assert big.search(np.array([1 << 20, 1]), 9, 1) == [((1 << 60) + 6, 2)]


def _page(body, nav="<nav><a href='/'>home</a></nav>", foot="<footer>&copy; 2020</footer>"):
    return f"<!DOCTYPE html><html><head><title>t</title><script>var x='</p><p>';</script></head><body>{nav}{body}{foot}</body></html>"


def test_main_text():
    def text(source):
        return pages.main_text(source, [])

    assert text(None) == "" and text("") == "" and text("plain") == "plain"
    assert text(_page("<article><h1>T&eacute;</h1><p>a <b>b</b>c\n d&nbsp;e<p>next<br>line</article>")) == "Té\na bc d e\nnext line"
    assert text(_page("<article><p>one</p><aside>no</aside><div class='ad'>buy</div><form>in<input></form><ul><li>x<li>y</ul></article><section id='comments'><article><p>me too</p></article></section>")) == "one\nx\ny"
    assert text(_page("<header>site</header><div class='sidebar'>s</div><div><p>a &lt; b</p><p>5 < 6 & 7</p></div><div class='cookie-notice'>ok?</div>")) == "a < b\n5 < 6 & 7"
    assert text("<article class='post ad-free'><p>a<script>if (a<b) w('</p>')</SCRIPT >b</p><article class='comment'>c</article><p>d<style>x") == "ab\nd"
    assert text("<ARTICLE><TABLE><TR><TD>a</TD><TD>b<TR><TD>c</TABLE><pre> x\n y </pre><figure><figcaption>f</figcaption></figure><footer>by</footer></ARTICLE>") == "a\nb\nc\nx y\nf"
    assert text("<p>cut off <b>in the mid") == "cut off in the mid"
    assert text("<div hidden>x</div><div role=navigation>y</div><div style='display:none'>z</div><p>seen</p><!-- no --><style>p{}</style>") == "seen"


def test_named_parts_of_articles():
    """Headings and sections of an article stay whatever their names say."""
    source = "<article><h1 class='page-header'>T</h1><h2 id='related-work'>Related work</h2><section id='navigation'><p>a</p></section><section class='social'><p>b</p></section><div class='share'>no</div><section class='comments'><p>no</p></section></article>"
    assert pages.main_text(source, []) == "T\nRelated work\na\nb"
    assert pages.main_text("<main><article><p>a</p><section id='comments'><p>no</p></section></article><section id='related'><p>no</p></section></main>", []) == "a"
    assert pages.main_text("<body><section id='related'><p>no</p></section><p>seen</p></body>", []) == "seen"


def test_templates(spark):
    """Constant text without marks goes with the template, however hot the host."""
    def row(i, host):
        return (i, f"https://{host}/p{i}", f"<html><body><div><span>Site name</span></div><div><p>story {i} first</p><p>story {i} second</p></div><div><span>All rights reserved</span></div></body></html>")

    rows = [row(i, "Big.example" if i % 2 else "big.example") for i in range(40)] + [row(100, "lone.example"), (200, None, "<p>x</p>"), (None, "bad url", None), (100, "https://lone.example/p100", "<p>same id</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1)).withColumn("classes", F.lit(1)).repartition(4)
    got = pages.extract(df).collect()
    dealt = pages.extract(df, broadcast_bytes=0).collect()  # the same without a broadcast
    assert sorted(map(repr, dealt)) == sorted(map(repr, got))
    texts = {}
    for r in got:
        texts.setdefault(r.page_id, []).append(r.text)
        assert r.n_chars == len(r.text)
    for i in range(40):
        assert texts[i] == [f"story {i} first\nstory {i} second"]
    assert sorted(texts[100]) == ["Site name\nstory 100 first\nstory 100 second\nAll rights reserved", "same id"]
    assert texts[200] == ["x"] and texts[None] == [""]
    assert pages.extract(df.limit(0)).count() == 0
    copies = spark.createDataFrame([(i, "https://c.example/", _page("<p>all the same</p>")) for i in range(9)], "page_id long, url string, html string")
    assert {r.text for r in pages.extract(copies).collect()} == {"all the same"}


def test_templates_in_articles(spark):
    """Constant text of a host's template goes from articles too; copied and
    repeated paragraphs stay."""
    copied = "".join(f"<p>copied {k}</p>" for k in range(5))

    def row(i):
        own = copied if i < 4 else f"<p>story {i} first</p><p>often said</p><p>story {i} second</p>" if i % 3 else f"<p>story {i}</p>"
        return (i, f"https://big.example/p{i}", f"<html><body><div><span>Site name</span></div><article><h1>Title {i}</h1>{own}<div><a>Read more</a></div><p>All rights reserved</p></article></body></html>")

    df = spark.createDataFrame([row(i) for i in range(40)] + [(i, "https://same.example/", "<html><body><article><h1>One</h1><p>two</p></article></body></html>") for i in range(90, 95)], "page_id long, url string, html string").repartition(4)
    got = {r.page_id: r.text.split("\n") for r in pages.extract(df).collect()}
    for i in range(40):
        own = [f"copied {k}" for k in range(5)] if i < 4 else [f"story {i} first", "often said", f"story {i} second"] if i % 3 else [f"story {i}"]
        assert got[i] == [f"Title {i}", *own]
    assert got[90] == got[94] == ["One", "two"]


def test_rare_templates(spark):
    """Templates of few of a host's pages count too, broadcast or joined; copied
    passages among as few pages stay."""
    def row(i):
        k = i // 4
        own = f"<div class='s{k}'><span>Section {k}</span></div><div><p>story {i}</p></div><div class='e{k}'><span>Rights of {k}</span></div>"
        if k == 7:
            own = f"<div><p>story {i}</p><p>copied a</p><p>copied b</p><p>copied c</p></div>"
        if k == 8:
            own = "<div><p>same</p><p>again</p><p>and again</p></div>"
        return (i, f"https://big.example/p{i}", f"<html><body><div><span>Site name</span></div>{own}</body></html>")

    df = spark.createDataFrame([row(i) for i in range(160)], "page_id long, url string, html string").repartition(4)
    got = pages.extract(df).collect()
    assert sorted(map(repr, pages.extract(df, broadcast_bytes=0).collect())) == sorted(map(repr, got))
    for r in got:
        own = {7: f"story {r.page_id}\ncopied a\ncopied b\ncopied c", 8: "same\nagain\nand again"}
        assert r.text == own.get(r.page_id // 4, f"story {r.page_id}"), r


def test_template_classes_nest():
    page = pages.Page("<div><i>a</i><ul><li>1</li><li>2</li></ul><b>z</b></div>")
    root = [page.tokens[0], page.tokens[1], page.tokens[-1]]
    assert pages.template_tokens(page.tokens, [root]).sum() == 3
    assert pages.template_tokens(page.tokens, [root[::-1]]).sum() == 0


def test_long_conversation(spark):
    """Tens of thousands of turns and a turn of megabytes, read back whole."""
    import hashlib

    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"turn {i} <|im_end|>") for i in range(20_000)]
    rows += [(2, 0, "user", "q"), (2, 1, "assistant", "é<|im_start|>" * 300_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6)
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    for k, r in got.items():
        own = [(role, text) for c, _, role, text in rows if c == k]
        said = "".join(t for role, t in own if role == "assistant")
        assert (r.n_turns, r.loss_chars) == (len(own), len(said))
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in own).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
