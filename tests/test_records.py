import json
import random

import pytest
from pyspark.sql import functions as F

from marlstone.operators import annotate, embeddings, matching, sampling
from marlstone.sources import readers, stores
from marlstone.streaming import annotation


def test_samples(spark):
    rows = spark.createDataFrame([(i, "abc"[i % 3]) for i in range(30)], "k int, g string")
    drawn = random.Random(42).sample(range(30), 5)
    got = sampling.python_sample(rows.withColumn("i", F.col("k").cast("long")), "i", 30, 5).orderBy("sample_pos").collect()
    assert [r.k for r in got] == drawn
    assert sampling.seeded_sample(rows, "k", 0).count() == 0 and sampling.seeded_sample(rows, "k", 99).count() == 30
    got = [r.k for r in sampling.round_robin(rows, "g", "k", 5).orderBy("turn", "g").collect()]
    assert got == [0, 1, 2, 3, 4]
    assert sampling.scaled_targets({"a": 1, "b": 100}, 10) == {"a": 1, "b": 10}
    assert sampling.members(rows, rows.filter("k < 3"), "k").count() == 3
    some = sampling.stratified_sample(rows, "g", "k", {"a": 1, "b": 1, "c": 8}, 20)
    assert some.count() == 20 and some.filter("g = 'c' AND NOT topped_up").count() == 10


def test_matching(spark):
    objects = spark.createDataFrame([(1, 0, "A red dog"), (1, 1, "cat"), (1, 2, "dog"), (2, 0, None)], "image_id int, obj_idx int, object string")
    targets = spark.createDataFrame([(1, "t", "The Dog", "n1"), (1, "u", "bird", "n2"), (2, "t", "dog", "n1")], "image_id int, target_id string, class_name string, node string")
    lemmas = spark.createDataFrame([("n2", "Cat")], "node string, lemma string")
    got = {(r.image_id, r.target_id): r.obj_idx for r in matching.match_objects(objects, matching.target_terms(targets, lemmas)).collect()}
    assert got == {(1, "t"): 0, (1, "u"): 1}
    gt = spark.createDataFrame([(1, "a", "x")], "id int, a string, s string")
    both = matching.truth_with_media(gt, gt, "id")
    assert sorted(both.columns) == ["a_x", "a_y", "id", "s_x", "s_y"]
    names = spark.createDataFrame([("abc",), ("a/b_c",)], "n string")
    assert [r[0] for r in names.select(matching.scene_candidates(F.col("n"))).collect()] == [["abc"], ["a_b_c", "a", "b_c"]]
    labels = spark.createDataFrame([("c1", True)], "k string, v boolean")
    rows = spark.createDataFrame([("c1", "c2"), ("c9", "c1")], "t string, p string")
    assert [tuple(r) for r in matching.truth_and_prediction(rows, labels, "t", "p", "k", "v").select("t", "gt", "pred").collect()] == [("c1", True, None)]
    with pytest.raises(ValueError, match="ids"):
        matching.require_none(matching.unknown_ids(rows, "t", rows.limit(0)), "ids")


def test_embeddings(spark):
    images = spark.createDataFrame([(1, [1.0, 0.0], [0.12, 0.0]), (2, [1.0, 0.0], [0.3, 0.0])], "image_id int, image_vector array<float>, caption_vector array<float>")
    objects = spark.createDataFrame([(2, [0.2, 0.0]), (2, [-0.1, 0.0])], "image_id int, object_vector array<float>")
    got = {r.image_id: r for r in embeddings.clip_scores(images, objects).collect()}
    assert abs(got[2].f_score - 0.416667) < 1e-6 and abs(got[2].object_score - 0.25) < 1e-6
    assert got[1].object_score == 0.0 and got[1].f_score == got[1].caption_score
    captions = images.select("image_id", F.col("image_vector").alias("embedding"))
    cand = spark.createDataFrame([(0, [0.5, 0.0]), (1, [0.5, 9.0])], "cand_idx int, embedding array<float>")
    assert {r.cand_idx for r in embeddings.best_candidate(captions, cand).collect()} == {0}
    assert {r.cand_idx for r in embeddings.best_candidate(captions, cand.limit(0)).collect()} == {-1}
    encoded = embeddings.encode_distinct(spark.createDataFrame([("ab",), ("ab",), (None,), ("c",)], "t string"), "t", lambda x: [[len(w)] for w in x], batch=1)
    assert {(r.t, r.vector[0]) for r in encoded.collect()} == {("ab", 2.0), ("c", 1.0)}


def test_bisect():
    seen = []

    class Model:
        def annotate(self, prompts, images, system, schema):
            seen.append(len(prompts))
            if sum(map(len, prompts)) > 10:
                raise annotate.TooLong
            return prompts

    got = annotate.annotate_safely(Model(), ["aaaa", "bbbb", "x" * 20, "cc", "d"], list("12345"), None, None)
    assert got == ["aaaa", "bbbb", None, "cc", "d"]

    class Short(Model):
        def annotate(self, *_):
            return []

    with pytest.raises(ValueError):
        annotate.annotate_safely(Short(), ["a"], ["1"], None, None)
    with pytest.raises(ValueError, match="unknown"):
        annotate.create("no such")


def test_stages(spark):
    images = spark.createDataFrame([("a dog by a river",), ("one chair",)], "image_path string")
    out = annotate.extracted_objects(annotate.captions(images)).collect()
    assert {tuple(r.objects) for r in out} == {("picture", "dog", "river"), ("picture", "one", "chair")}


def test_artifacts_and_stores(spark, tmp_path):
    path = str(tmp_path / "a")
    rows = spark.createDataFrame([("x.jpg", "c", ["o"])], "image_path string, caption string, objects array<string>")
    stores.write_artifact(rows, path, {"dataset": "d", "model": "m", "max_hops": 2})
    spark.createDataFrame([(json.dumps({"image_path": "y.jpg"}),)], "value string").write.mode("append").text(path)
    header, images = stores.read_artifact(spark, path)
    assert header == {"dataset": "d", "model": "m", "max_hops": 2} and {r.image_path for r in images.collect()} == {"x.jpg", "y.jpg"}
    rows.select(F.to_json(F.struct("*")).alias("value")).write.text(str(tmp_path / "b"))
    with pytest.raises(ValueError, match="no header"):
        stores.read_artifact(spark, str(tmp_path / "b"))
    store = str(tmp_path / "store")
    for model, f1 in (("m1", 0.1), ("m2", 0.2), ("m1", 0.3)):
        stores.save_results(spark.createDataFrame([("d", model, f1)], "dataset string, model string, f1 double"), store)
    assert {(r.model, r.f1) for r in spark.read.parquet(store).collect()} == {("m1", 0.3), ("m2", 0.2)}
    old = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "k int, v string")
    new = spark.createDataFrame([(2, "B"), (None, "N")], "k int, v string")
    assert {tuple(r) for r in stores.upsert(old, new, ["k"]).collect()} == {(1, "a"), (2, "B"), (None, "N")}
    assert stores.upsert(None, new, ["k"]).count() == 2
    stores.write_predictions(rows, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True, escape='"').first().objects == '["o"]'
    assert stores.prediction_path("f", "d", "org/m") == "f/d_org_m"
    made = []
    for _ in range(2):
        got = stores.load_or_create(spark, str(tmp_path / "s"), lambda: made.append(1) or rows)
        assert got.count() == 1
    assert len(made) == 1
    reports = [spark.createDataFrame([(x,)], "line string") for x in ("r1", "r2")]
    stores.write_report(reports, str(tmp_path / "rep"))
    assert {r.value for r in spark.read.text(str(tmp_path / "rep")).collect()} == {"r1", "r2"}
    mapped = spark.createDataFrame([({"a": 1},), (None,)], "m map<string,int>").select(stores.upsert_predictions(F.col("m"), F.lit("a"), F.lit(2)))
    assert [r[0] for r in mapped.collect()] == [{"a": 2}, {"a": 2}]


def test_readers(spark, tmp_path):
    def put(name, text):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
        return str(p)

    sheet = put("tax.csv", 'l1,l2,Bio,Mat\n"a (a.n.01)",,biotic,\n"a (a.n.01)","dog (dog.n.01)",Biotic,material\n')
    got = readers.read_annotations(spark, sheet, "Bio", "Mat").orderBy("row").collect()
    assert [(r.node, r.tangibility) for r in got] == [("a.n.01", None), ("dog.n.01", "material")]
    excluded, allowed = readers.read_scene_keys(spark, put("m.csv", "bar\nfoo\n"), put("k.csv", "synset,source\nx.n.01 1/2,MIT Places\ny.n.01,other\n"))
    assert {r.name for r in excluded.collect()} == {"bar", "foo"} and [r.node for r in allowed.collect()] == ["x.n.01"]
    scenes = put("s.txt", "/a/airfield 0\n/b/bar/in 1\n")
    assert {(r.scene_id, r.name) for r in readers.read_scenes(spark, scenes, 2).collect()} == {(0, "airfield"), (1, "bar/in")}
    with pytest.raises(ValueError, match="scene ids"):
        readers.read_scenes(spark, scenes, 3)
    with pytest.raises(ValueError, match="malformed"):
        readers.read_scenes(spark, put("bad.txt", "airfield\n"), 1)
    mapping = readers.read_mapping(spark, put("map.csv", "Places_Name,places_id,WordNet Synset\nx,1,a.n.1\ny,,b.n.1\nx,nan,c.n.1\n"))
    assert {(r.key, r.node) for r in mapping.collect()} == {("x", "c.n.1"), ("1", "a.n.1"), ("y", "b.n.1")}
    coco = put("c.json", json.dumps({"images": [{"id": 1, "file_name": "f"}, {"id": 2, "file_name": "g"}], "annotations": [{"image_id": 1, "category_id": 3}] * 2, "categories": [{"id": 3, "name": "cat"}]}))
    images, annotations, categories = readers.read_instances(spark, coco)
    assert [tuple(r) for r in matching.image_targets(images, annotations, categories).select("image_id", "name").collect()] == [(1, "cat")]
    with pytest.raises(ValueError, match="no categories"):
        readers.read_categories(spark, put("n.json", "{}"))
    truth = "platform_id," + ",".join(c for s in readers.SLOTS for c in s) + "\np1," + ",".join(["yes", "material", "biotic", "no", "material", ""] + [""] * 6) + "\n"
    posts = readers.read_posts(spark, put("gt.csv", truth), put("media.csv", "platform_id,media_files\np1,\"['a.jpg', 'b.jpg']\"\np2,\"[oops\"\n")).orderBy("slot").collect()
    assert [(r.file, r.gt_nature, r.gt_material, r.gt_biotic, r.repaired) for r in posts] == [("a.jpg", True, True, True, False), ("b.jpg", False, None, None, True)]
    put("img/n01/x.png", "p"), put("img/n02/y.png", "q")
    files = readers.load_dataset(spark, "folder", root=str(tmp_path / "img"))
    assert [r.class_dir for r in readers.folder_targets(files, spark.createDataFrame([("n01",)], "class_dir string")).collect()] == ["n01"]
    assert {r.data_url for r in readers.read_images(spark, str(tmp_path / "img")).collect()} == {"data:image/png;base64,cA==", "data:image/png;base64,cQ=="}
    assert readers.read_text(spark, put("d.txt", "one\ntwo")) == "one\ntwo"
    with pytest.raises(ValueError, match="unknown dataset"):
        readers.load_dataset(spark, "none")


def test_stream(spark, tmp_path):
    for i in range(3):
        p = tmp_path / "in" / f"{i}.json"
        p.parent.mkdir(exist_ok=True)
        p.write_text(json.dumps({"image_path": f"dog {i}"}) + "\n")
    rows = annotation.read_stream(spark, str(tmp_path / "in"), "image_path string", files_per_batch=2)
    query = annotation.annotate_stream(rows, annotate.captions, str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert {r.caption for r in got} == {f"a picture of dog {i}" for i in range(3)} and {r.batch for r in got} == {0, 1}


def test_inference_records(spark, tmp_path):
    """Images without objects or matches, and an artifact that is read back."""
    from marlstone.operators import inference
    from marlstone.sources import categories

    kind = "image_path string, targets array<struct<class_name:string,synset_id:string,gt_nature:boolean,gt_biotic:boolean,gt_material:boolean>>"
    images = spark.createDataFrame([("a ring", [("Ring", "r.n.1", True, True, None), ("tree", None, None, None, None)]), ("no", None)], kind)
    vocabulary = spark.createDataFrame([("ring", "r.n.1")], "lemma string, node string")
    resolved = spark.createDataFrame([("r.n.1", True, "biotic")], "node string, is_nature boolean, life_category string")
    records = inference.infer(images, vocabulary, resolved)
    stores.write_artifact(records, str(tmp_path / "a"), {"dataset": "toy", "model": "rule"})
    _, back = stores.read_artifact(spark, str(tmp_path / "a"))
    for r in (records, back):
        rows = {(x.image_path, x.object): x for x in inference.exploded_objects(r).collect()}
        assert rows["a ring", "ring"].final.final_biotic is True and rows["a ring", "picture"].final.nature_source == "vlm"
    lemmas = spark.createDataFrame([("r.n.1", "band")], "node string, lemma string")
    scores = {r.axis: r for r in inference.holistic_scores(back, lemmas).collect()}
    assert scores["nature"].support == 1 and scores["biotic"].accuracy == 1.0 and scores["material"].support == 0
    assert categories.categories(spark).count() == 80 and categories.synonyms(spark).filter("word = 'boy'").first().node == "person.n.01"


def test_more_metrics(spark):
    from marlstone.operators import metrics

    rows = spark.createDataFrame([(1, True, True, None), (1, False, True, None), (2, True, False, True)], "i int, a boolean, t boolean, p boolean")
    got = metrics.any_positive_direct(rows, "i", "a", "t", "p").first()
    assert got.support == 2 and got.accuracy == 0.0
    truth = spark.createDataFrame([(True, True, None), (False, None, None)], "gt_nature boolean, gt_biotic boolean, gt_material boolean")
    assert tuple(metrics.truth_composition(truth).first()) == (1, 1, 1, 0, 0, 0)
    seen = spark.createDataFrame([("k1", "a", 1), ("k1", "b", 2), ("k2", "a", 3)], "k string, g string, s int")
    assert [(r.k, r.g) for r in sampling.round_robin_of_last(seen, "g", "k", "s", 5).orderBy("g").collect()] == [("k2", "a"), ("k1", "b")]
    assert [r[0] for r in spark.range(5).select(sampling.batch_number(F.col("id"), 2)).collect()] == [0, 0, 1, 1, 2]
