import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from marlstone.functions import labels
from marlstone.operators import detection, embeddings, metrics

# Published confusion counts and the metrics they give.
GOLDEN = [
    (23643, 6136, 557, 19664, 0.866140, 0.876007, 0.854566),
    (22685, 380, 615, 520, 0.958884, 0.978540, 0.511057),
    (23453, 95, 647, 5, 0.969339, 0.984427, 0.013298),
    (23813, 13163, 387, 12637, 0.729000, 0.778508, 0.650989),
    (23267, 2872, 933, 22928, 0.923900, 0.924412, 0.923381),
    (23700, 5087, 500, 20713, 0.888260, 0.894559, 0.881161),
]


def test_golden_confusions(spark):
    rows = spark.createDataFrame([(*r, i) for i, r in enumerate(GOLDEN)], "tp long, fp long, fn long, tn long, acc double, f1x double, f1n double, i int")
    got = rows.select("acc", "f1x", "f1n", *metrics.confusion_metrics(*(F.col(c) for c in ("tp", "fp", "fn", "tn")))).collect()
    for r in got:
        assert math.isclose(r.accuracy, r.acc, abs_tol=1e-6) and math.isclose(r.f1, r.f1x, abs_tol=1e-6) and math.isclose(r.f1_neg, r.f1n, abs_tol=1e-6)


def test_empty_and_null_rules(spark):
    empty = spark.createDataFrame([], "t boolean, p boolean")
    assert set(metrics.binary_metrics(empty, "t", "p").first()) == {0.0, 0}
    rows = spark.createDataFrame([(True, None), (False, None), (None, True), (True, True)], "t boolean, p boolean")
    got = metrics.binary_metrics(rows, "t", "p").first()
    assert got.support == 3 and math.isclose(got.accuracy, 1 / 3)
    assert metrics.macro_metrics(spark.createDataFrame([], "t int, p int"), "t", "p").first().f1_macro == 0.0
    assert metrics.mean_average_precision(spark.createDataFrame([], "k int, y int, s double"), "y", "s", "k").first().mean_ap == 0.0


def _ap(y, s):
    total, out = sum(y), 0.0
    for t in sorted(set(s), reverse=True):
        on = [a for a, b in zip(y, s, strict=True) if b >= t]
        out += sum(a for a, b in zip(y, s, strict=True) if b == t) / total * sum(on) / len(on)
    return out


def test_average_precision(spark):
    cases = {0: ([1, 0, 1, 1, 0], [0.9, 0.8, 0.8, 0.4, 0.1])}
    rnd = random.Random(5)
    for k in range(1, 8):
        cases[k] = ([rnd.randint(0, 1) for _ in range(30)] + [1], [rnd.randint(0, 9) / 10 for _ in range(31)])
    rows = spark.createDataFrame([(k, a, b) for k, (y, s) in cases.items() for a, b in zip(y, s, strict=True)], "k int, y int, s double")
    got = {r.k: r.average_precision for r in metrics.average_precision(rows, "y", "s", ["k"]).collect()}
    assert math.isclose(got[0], 0.805556, abs_tol=1e-6)
    for k, (y, s) in cases.items():
        assert math.isclose(got[k], _ap(y, s), abs_tol=1e-12)


def test_macro_against_plain(spark):
    rnd = random.Random(1)
    pairs = [(rnd.choice("abcd"), rnd.choice(["a", "b", "c", "e", None])) for _ in range(200)]
    got = metrics.macro_metrics(spark.createDataFrame(pairs, "t string, p string"), "t", "p").first()
    f = []
    for k in "abcde":
        tp = sum(t == p == k for t, p in pairs)
        n, m = sum(t == k for t, _ in pairs), sum(p == k for _, p in pairs)
        pr, re = tp / m if m else 0, tp / n if n else 0
        f.append(2 * pr * re / (pr + re) if pr + re else 0)
    assert math.isclose(got.f1_macro, sum(f) / 5) and math.isclose(got.accuracy, sum(t == p for t, p in pairs) / 200)


def test_hybrid_label_table(spark):
    """All mapping states by all model answers against the rule in plain Python."""
    maps = [(False, None, None), (True, False, None), (True, True, True), (True, True, False), (True, True, None)]
    answers = list(itertools.product([True, False, None], repeat=3))
    rows = spark.createDataFrame([(*m, *a) for m in maps for a in answers], "mapped boolean, mn boolean, mb boolean, n boolean, b boolean, m boolean")
    out = rows.select("*", labels.hybrid_label(*(F.col(c) for c in ("mapped", "mn", "mb", "n", "b", "m"))).alias("f")).collect()
    assert len(out) == 135
    for r in out:
        nature, life = (r.mn, r.mb) if r.mapped else (r.n, r.b)
        assert (r.f.final_nature, r.f.final_biotic, r.f.final_material) == ((True, life, r.m) if nature else (nature, None, None))
        assert r.f.nature_source == r.f.biotic_source == ("wordnet" if r.mapped else "vlm") and r.f.material_source == "vlm"


@pytest.mark.parametrize(("word", "axis", "value"), [(" Yes ", "nature", True), ("NO", "nature", False), ("none", "biotic", None), ("abiotic", "biotic", False), ("n/a", "material", None), ("yes", "colour", None)])
def test_label_words(spark, word, axis, value):
    assert spark.createDataFrame([(word,)], "w string").select(labels.label_to_bool(F.col("w"), axis)).first()[0] is value


def test_one_class_truth_gives_zeros(spark):
    rows = spark.createDataFrame([(1, True, True, True), (2, True, True, False)], "i int, a boolean, t boolean, p boolean")
    assert metrics.any_positive(rows, "i", "a", "t", "p").first().support == 0


def test_detections_and_wide(spark):
    rows = spark.createDataFrame([(1, 0, "a", 0.9, True, True, None), (1, 1, "b", 0.7, True, None, True), (2, 0, "a", 0.1, True, True, None)], "i int, category_id int, name string, score double, is_nature boolean, is_biotic boolean, is_material boolean")
    got = {r.i: r for r in detection.project_detections(detection.detected(rows, "score", 0.7), "i").collect()}
    assert got[1].raw_prediction == "a, b" and got[1].pred_biotic and got[1].pred_material
    assert got[2].no_match and got[2].pred_nature is False and got[2].pred_biotic is None
    wide = detection.multi_hot(rows.withColumn("y_true", F.col("score") > 0.5), "i", "category_id", [1, 0]).orderBy("i").collect()
    assert [tuple(r) for r in wide] == [(1, 1.0, 1.0), (2, 0.0, 0.0)]


def test_reports(spark):
    nodes = spark.createDataFrame([(True, "biotic", None), (None, "abiotic", "material")], "is_nature boolean, life_category string, tangibility string")
    lines = [r.line for r in metrics.coverage_report(metrics.class_coverage(nodes), "toy").collect()]
    assert lines[:2] == ["toy", "  total: 2"] and "  unmapped: 1" in lines
    maps = spark.createDataFrame([({"a": 1, "b": 2},), ({"b": 3},), (None,)], "p map<string,int>")
    assert metrics.models_tracked(maps, "p").first().models == 2


def test_average_precision_by_ranges(spark, monkeypatch):
    """Continuous scores in several ranges, nulls last, against a plain sum."""
    rnd = random.Random(1)
    rows = [(rnd.choice("ab"), rnd.random() < 0.3, rnd.choice([None, round(rnd.random(), 2), rnd.random()])) for _ in range(600)]
    monkeypatch.setattr(metrics, "RANGES", 7)
    got = {r.c: (r.positives, r.average_precision) for r in metrics.average_precision(spark.createDataFrame(rows, "c string, y boolean, s double"), "y", "s", ["c"]).collect()}
    for c in "ab":
        own = [(y, s if s is not None else -1.0) for k, y, s in rows if k == c]
        positives, total = sum(y for y, _ in own), 0.0
        for s in {s for _, s in own}:
            seen = [y for y, x in own if x >= s]
            total += sum(y for y, x in own if x == s) * sum(seen) / len(seen)
        assert got[c][0] == positives and abs(got[c][1] - total / positives) < 1e-9


def test_direct_predictions(spark):
    """One prediction an image, whatever the order of its rows."""
    rows = [(1, True, True, None), (1, True, False, True), (2, True, False, None), (2, False, True, None), (3, True, True, False), (4, True, False, False)]
    df = spark.createDataFrame(rows, "image int, axis boolean, truth boolean, prediction boolean")
    for one in (df, df.orderBy("prediction"), df.repartition(3)):
        r = metrics.any_positive_direct(one, "image", "axis", "truth", "prediction").first()
        assert (r.support, r.accuracy, r.precision, r.recall) == (4, 0.5, 0.5, 0.5)
    assert metrics.any_positive_direct(df.filter("image = 1"), "image", "axis", "truth", "prediction").first().support == 0


def test_candidates_with_missing_vectors(spark, monkeypatch):
    """Missing vectors are zeros, broadcast or met block by block."""
    captions = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, -1.0]), (4, [0.6, 0.8])], "image_id int, embedding array<double>")
    cands = spark.createDataFrame([(5, [0.0, 1.0]), (2, None), (7, [1.0, 0.0]), (9, [1.0, 0.0])], "cand_idx int, embedding array<double>")
    expected = {1: (7, 1.0), 2: (2, 0.0), 3: (2, 0.0), 4: (5, 0.8)}
    for size in (64 << 20, 100):
        monkeypatch.setattr(embeddings, "BLOCK_BYTES", size)
        monkeypatch.setattr(embeddings, "BLOCK_ROWS", 3)
        assert {r.image_id: (r.cand_idx, r.similarity) for r in embeddings.best_candidate(captions, cands).collect()} == expected
    assert {r.cand_idx for r in embeddings.best_candidate(captions, cands.limit(0)).collect()} == {-1}
