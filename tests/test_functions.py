import math

import pytest
from pyspark.sql import functions as F

from marlstone.functions import labels, prompts, vectors
from marlstone.functions import text as T


def one(spark, value, build, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(build(F.col("x"))).first()[0]


@pytest.mark.parametrize(("raw", "norm"), [(" A Golden Retriever ", "golden retriever"), ("the a dog", "a dog"), (" An owl\t", "owl"), ("the", "the"), (None, None), ("", "")])
def test_normalize(spark, raw, norm):
    assert one(spark, raw, T.normalize_object) == norm


def test_normalize_many(spark):
    assert one(spark, ["Dog", " dog", "", "Cat", None, " CAT "], T.normalize_objects, "array<string>") == ["Dog", "Cat"]
    assert one(spark, None, T.normalize_objects, "array<string>") is None
    assert one(spark, [], T.normalize_objects, "array<string>") == []


@pytest.mark.parametrize(("raw", "tail"), [("golden retriever", "retriever"), ("dog", None), ("", None), (None, None)])
def test_head_noun(spark, raw, tail):
    assert one(spark, raw, T.head_noun) == tail


@pytest.mark.parametrize(("raw", "node"), [("dog (dog.n.01) x", "dog.n.01"), ("st._bernard.n.01", "_bernard.n.01"), ("été.n.02", "été.n.02"), ("plain", None), (None, None)])
def test_synset(spark, raw, node):
    assert one(spark, raw, T.synset_in) == node


@pytest.mark.parametrize(("raw", "want"), [("/a/apartment_building/outdoor 8", (8, "apartment_building/outdoor")), ("bad", (None, None)), ("/b/x y 12", (12, "x y"))])
def test_scene_line(spark, raw, want):
    assert tuple(one(spark, raw, T.scene_line)) == want


@pytest.mark.parametrize(("raw", "want"), [("['a', 'b']", ["a", "b"]), ("[]", []), ("['a'", None), ("oops", None), (None, None)])
def test_list_literal(spark, raw, want):
    assert one(spark, raw, T.list_literal) == want


@pytest.mark.parametrize(("raw", "status"), [('{"a": 1}', "object"), ("[1]", "not_object"), ("3", "not_object"), ("{bad", "malformed"), (None, "malformed")])
def test_response(spark, raw, status):
    assert one(spark, raw, T.response_status) == status
    got = one(spark, raw, lambda c: T.parse_response(c, "a int, b int"))
    assert (got is not None) == (status == "object")


@pytest.mark.parametrize(("raw", "want"), [(3725.4, "0-01:02:05"), (None, None), (0.5, "0-00:00:00"), (1.5, "0-00:00:02"), (90061.0, "1-01:01:01")])
def test_duration(spark, raw, want):
    assert one(spark, raw, T.duration, "double") == want


def test_names(spark):
    assert one(spark, "a_b/c", T.scene_display) == "a b c"
    assert one(spark, "hot_dog.x.n.01", T.node_display) == "hot dog"
    assert one(spark, "hot_dog.x.n.01", lambda c: T.node_display(c, True)) == "hot dog.x"
    assert one(spark, "org/model", T.model_slug) == "org_model"
    assert one(spark, None, T.config_key, "int") == "full"
    assert one(spark, "", lambda c: T.join_reasons(c, F.lit(None), F.lit("b"))) == "b"
    assert one(spark, "", lambda c: T.join_reasons(c, F.lit(None))) is None
    assert one(spark, "x.JPG", lambda c: T.data_url(c, F.lit(b"ab"))) == "data:image/jpeg;base64,YWI="
    assert one(spark, "data:image/png;base64,x", lambda c: T.data_url(c, F.lit(b"ab"))) == "data:image/png;base64,x"
    assert one(spark, 10.0, lambda c: T.time_left(c, F.lit(5), F.lit(15)), "double") == 20.0


def test_vectors(spark):
    v = [3.0, 4.0]
    assert one(spark, v, lambda c: vectors.dot(c, c), "array<float>") == 25.0
    assert one(spark, v, vectors.l2_normalise, "array<float>") == [0.6, 0.8]
    assert one(spark, [0.0], vectors.l2_normalise, "array<float>") == [0.0]
    assert one(spark, None, lambda c: vectors.or_zero(c, 2), "array<float>") == [0.0, 0.0]
    assert one(spark, [1.0, 5.0, 5.0], vectors.arg_max, "array<float>") == 1
    assert one(spark, -0.1, vectors.clip_score, "double") == 0.0
    assert math.isclose(one(spark, 0.3, vectors.clip_score, "double"), 0.75)
    assert one(spark, 0.0, lambda c: vectors.sigmoid_at_least(c, 0.5), "double") is True


def test_truth_and_classes(spark):
    rows = spark.createDataFrame([(True, "biotic", None), (True, "", "immaterial"), (False, "biotic", "material"), (None, None, None)], "n boolean, l string, t string")
    got = [tuple(r[0]) for r in rows.select(labels.ground_truth(F.col("n"), F.col("l"), F.col("t"))).collect()]
    assert got == [(True, True, True), (True, None, False), (False, None, None), (None, None, None)]
    assert [one(spark, k, labels.class_to_bool, "int") for k in (0, 1, 2, None)] == [True, False, None, None]
    assert one(spark, "x", lambda c: labels.empty_label(True, False))["parse_failed"] is True


def test_prompts(spark):
    assert prompts.system("full").startswith("1. ") and "\n\n3. " in prompts.system("full")
    assert prompts.system("caption", {"nature": "N"}) == "N"
    with pytest.raises(ValueError):
        prompts.system("colour")
    with pytest.raises(ValueError):
        prompts.axis_question("colour", F.lit("x"))
    words = {one(spark, v, lambda c: prompts.material_label(F.lit("owl"), c), "boolean").split(" Judge")[0] for v in (True, False, None)}
    assert len(words) == 3
