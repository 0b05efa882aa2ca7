"""The lattice search against all readings of short strings, and on long ones."""

import itertools
import random
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marlstone.llm import toxicity as T
from tests.oracle import duck

_WORDS = "the of and that idiot moron horrid wretch stupid people often say nothing about letters good little coffee"


def _cost(texts):
    """The character model of some texts, counted plainly."""
    count = np.zeros(T.SYMBOLS**3)
    table = T._symbol_table()
    for t in texts:
        s = [int(table[ord(c)]) if ord(c) < len(table) else 1 for c in f"\n{t.lower()}\n\n"]
        for a, b, c in zip(s, s[1:], s[2:], strict=False):
            count[(a * T.SYMBOLS + b) * T.SYMBOLS + c] += 1
    some = np.flatnonzero(count)
    return T.language_model(some, count[some])


COST = _cost([_WORDS] * 3)


def _price(text, cost):
    """Cost of a text under the character model: a space is a border."""
    a = b = 0
    total = 0.0
    for c in text:
        s = 0 if c == " " else T._SYMBOL.get(c, 1)
        total += cost[a][b][s]
        a, b = b, s
    return total + cost[a][b][0]


def _all_readings(word):
    """(text, channel cost) of every way to read each character."""
    each = []
    for i, c in enumerate(word):
        before, earlier = (word[i - 1] if i else ""), (word[i - 2] if i > 1 else "")
        if c in T._SYMBOL:
            own = [(c, 0.0)]
        else:
            own = [(x, T.COST_LEET) for x in T.LEET.get(c, "")] + [(c, 1.0 if c == " " else T.COST_KEEP)]
        if c in T._SEPARATORS and c not in T._SYMBOL:
            own.append(("", T.COST_DROP))
        elif c == before:
            own.append(("", T.COST_REPEAT if c == earlier else T.COST_SECOND))
        each.append(own)
    for way in itertools.product(*each):
        yield "".join(x for x, _ in way), sum(p for _, p in way)


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("aidorst1!0@$. -x9é中"), min_size=0, max_size=8))
def test_restore_is_the_likeliest_reading(word):
    table = COST.tolist()
    priced = [(price + _price(text, table), text) for text, price in _all_readings(word)]
    least = min(p for p, _ in priced)
    assert T.restore(word, table) in {t for p, t in priced if p < least + 1e-9}


def test_long_strings_are_read_whole():
    table = COST.tolist()
    base = "idiot horrid wretch stupid people".replace(" ", "")
    word = (base * 8)[:200]
    assert T.restore(word, table) == word  # nothing doubled, nothing lost
    hidden = word.replace("i", "1").replace("o", "0")
    assert T.restore(hidden, table) == word
    spaced = ".".join("idiot" * 40)
    assert T.restore(spaced, table) == "idiot" * 40
    assert T.restore("i" * 500 + "diot", table) == "idiot"
    began = time.perf_counter()
    T.restore("1d1" * 5_000, table)
    first = time.perf_counter() - began
    began = time.perf_counter()
    T.restore("1d1" * 40_000, table)
    assert time.perf_counter() - began < 24 * max(first, 0.02)  # in proportion to the length


DISGUISES = {
    "leet": lambda w: w.translate(str.maketrans("aeiost", "4310$7")),
    "one sign": lambda w: w.replace("i", "!").replace("o", "0"),
    "dots": ".".join,
    "spaces": " ".join,
    "dashes": " - ".join,
    "tripled": lambda w: "".join(c * 3 for c in w),
    "long vowel": lambda w: "".join(c * 5 if c in "aeiou" else c for c in w),
    "mixed": lambda w: "-".join(w.translate(str.maketrans("io", "10"))),
    "quoted": lambda w: f"“{w.replace('i', '1')}”!",
}


@pytest.mark.parametrize("kind", sorted(DISGUISES))
def test_disguises_are_undone(kind):
    """Of words that the model knows, nine in ten come back from each disguise."""
    restorer = T.Restorer(COST)
    words = [w for w in _WORDS.split() if len(w) >= 5 and not any(a == b for a, b in zip(w, w[1:], strict=False))]
    found = [w in restorer.words(f"say {DISGUISES[kind](w)} now") for w in words]
    assert np.mean(found) >= 0.9, [w for w, ok in zip(words, found, strict=True) if not ok]


def test_plain_text_stays():
    restorer = T.Restorer(COST)
    assert restorer.words("The people say 1984 of 50%, and 455 ... nothing") >= {"the", "people", "1984", "50", "455", "nothing"}
    assert restorer.words(None) == restorer.words("") == set()
    plain = _WORDS.split()
    assert restorer.words(" ".join(plain)) >= set(plain)


def test_every_telling_feature_counts(spark):
    """Hundreds of telling words are all learnt."""
    rnd = random.Random(1)
    bad = ["".join(rnd.choices("bcdfglmnrstv", k=9)) for _ in range(300)]
    rows = [(i, " ".join(rnd.sample(bad, 40)) if i % 2 else "quite harmless words here") for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = T.fit(docs, spark.createDataFrame([(i, i % 2) for i in range(120)], "doc_id long, toxic int"))
    assert sum(w in model.weights for w in bad) > 0.9 * len(bad)


def test_same_model_each_time(spark, sf):
    from marlstone.llm.common import table

    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    a, b = T.fit(docs, labels), T.fit(docs.repartition(3), labels.repartition(2))
    assert a.base == b.base and a.weights == b.weights and np.array_equal(a.cost, b.cost)


def test_held_out_figures(spark):
    """Not below what the README states."""
    from marlstone.llm import queries

    sf = "/root/testdata/sf0.01"
    truth = dict(duck(sf).execute("SELECT doc_id, toxic FROM labels").fetchall())
    held = [(truth[r.doc_id], r.score) for r in queries.op9_deobfuscated_toxicity(spark, sf).collect() if r.held_out and r.doc_id in truth]
    good, bad = [s for y, s in held if y], [s for y, s in held if not y]
    assert np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad]) >= 0.898
    assert np.mean([(s >= 0.5) == y for y, s in held]) >= 0.9425
