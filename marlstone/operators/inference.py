"""The two-part run: annotate images, then score what was annotated.

A record is a row per image with positionally aligned arrays of objects, their
raw labels and their final ones; scoring explodes it again. What a model said is
written before it branches, so each question is asked once.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import prompts
from marlstone.functions.labels import hybrid_label, label_to_bool
from marlstone.functions.text import parse_response
from marlstone.operators import annotate, embeddings, matching, metrics
from marlstone.schemas import FINALS, FULL_LABEL, LABELS
from marlstone.session import cut
from marlstone.sources import stores

AXES = ("nature", "biotic", "material")


def _field(name: str):
    return lambda x: x[name]


def infer(images: DataFrame, vocabulary: DataFrame, resolved: DataFrame, name: str = "rule", **more) -> DataFrame:
    """image_path, targets, caption, objects, object_labels, object_finals of
    each image (image_path, targets)."""
    # Written before it branches: no branch may ask the model again.
    seen = cut(annotate.extracted_objects(annotate.captions(images, name, **more), name, **more), "extracted")
    each = seen.select("image_path", "targets", "caption", F.posexplode_outer("objects").alias("obj_idx", "object"))
    mapped = matching.objects_to_nodes(each.filter("object IS NOT NULL").select("image_path", "obj_idx", "object"), vocabulary, resolved)
    labelled = annotate.labelled_objects(cut(mapped, "mapped"), name, **more)
    lab = F.col("label")
    final = hybrid_label(F.col("mapped"), F.col("map_nature"), F.col("map_biotic"), label_to_bool(lab["nature"], "nature"), label_to_bool(lab["biotic"], "biotic"), label_to_bool(lab["material"], "material"))
    rows = labelled.select("image_path", "obj_idx", "object", "label", "mapped", F.col("mapped_node").alias("mapped_synset"), final.alias("f"))
    rows = rows.select("image_path", F.struct("obj_idx", "object", "label", F.struct("object", "mapped", "mapped_synset", "f.*").alias("final")).alias("o"))
    # An image has as many objects as its caption names.
    nested = rows.groupBy("image_path").agg(F.sort_array(F.collect_list("o")).alias("o"))
    out = seen.select("image_path", "targets", "caption").join(nested, "image_path", "left")
    fields = (("object", "objects", "array<string>"), ("label", "object_labels", LABELS), ("final", "object_finals", FINALS))
    return cut(out.select("image_path", "targets", "caption", *[F.coalesce(F.transform("o", _field(k)), F.from_json(F.lit("[]"), t)).alias(n) for k, n, t in fields]), "records")


def exploded_objects(records: DataFrame) -> DataFrame:
    """image_path, obj_idx, object, label and final: a row per object; an image
    without objects has one row of nulls."""
    rows = records.select("image_path", F.posexplode_outer(F.arrays_zip("objects", "object_labels", "object_finals")).alias("obj_idx", "z"))
    return rows.select("image_path", "obj_idx", F.col("z.objects").alias("object"), F.col("z.object_labels").alias("label"), F.col("z.object_finals").alias("final"))


def exploded_targets(records: DataFrame) -> DataFrame:
    """image_path, target_id and the target's fields, where gt_nature is known."""
    rows = records.select("image_path", F.posexplode("targets").alias("target_id", "t")).select("image_path", "target_id", "t.*")
    return rows.filter("gt_nature IS NOT NULL")


def matched_targets(records: DataFrame, lemmas: DataFrame) -> DataFrame:
    """Targets with the first object that matches one of their terms, or null."""
    targets = exploded_targets(records).withColumn("node", F.col("synset_id"))
    objects = exploded_objects(records).filter("object IS NOT NULL")
    hits = matching.match_objects(objects.select("image_path", "obj_idx", "object"), matching.target_terms(targets, lemmas, "image_path"), "image_path")
    return targets.join(hits, ["image_path", "target_id"], "left")


def axis_metrics(rows: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """A row of binary metrics for each axis; (truth, prediction) columns."""
    cells = F.array(*[F.struct(F.lit(a).alias("axis"), F.col(t).alias("t"), F.col(p).alias("p")) for a, (t, p) in pairs.items()])
    return metrics.binary_metrics(rows.select(F.explode(cells).alias("c")).select("c.*"), "t", "p", ["axis"])


def holistic_scores(records: DataFrame, lemmas: DataFrame) -> DataFrame:
    """Multi-label scoring: nature by image (any target against any object),
    sub-axes by matched object; targets without a match are left out."""
    finals = exploded_objects(records)
    images = finals.groupBy("image_path").agg(F.coalesce(F.bool_or(F.coalesce("final.final_nature", F.lit(False))), F.lit(False)).alias("p"))
    truth = exploded_targets(records).groupBy("image_path").agg(F.bool_or("gt_nature").alias("t"))
    nature = truth.join(images, "image_path").select(F.lit("nature").alias("axis"), "t", "p")
    met = matched_targets(records, lemmas).join(finals.select("image_path", "obj_idx", "final"), ["image_path", "obj_idx"])
    subs = [met.select(F.lit(a).alias("axis"), F.col(f"gt_{a}").alias("t"), F.col(f"final.final_{a}").alias("p")) for a in AXES[1:]]
    return metrics.binary_metrics(nature.unionByName(subs[0]).unionByName(subs[1]), "t", "p", ["axis"])


def single_label_predictions(images: DataFrame, objects: DataFrame, candidates: DataFrame) -> DataFrame:
    """Per image the candidate that its caption is nearest to (pred_node), the
    object nearest to that candidate, and that object's final label.

    images(image_id, gt_node, gt_nature, gt_biotic, gt_material, embedding of
    the caption); objects(image_id, obj_idx, object, object_vector, final_nature,
    final_biotic, final_material); candidates(cand_idx, node, embedding)."""
    best = embeddings.best_candidate(images, candidates)
    classes = candidates.select("cand_idx", F.col("node").alias("pred_node"), F.col("embedding").alias("class_vector"))
    predicted = best.join(classes, "cand_idx", "left").select("image_id", "pred_node", "class_vector", F.col("similarity").alias("pred_similarity"))
    near = embeddings.representative_object(objects.select("image_id", "obj_idx", "object_vector"), predicted.select("image_id", "class_vector"))
    own = objects.select("image_id", "obj_idx", "object", *[f"final_{a}" for a in AXES])
    picked = near.join(own, ["image_id", "obj_idx"], "left")
    return images.drop("embedding").join(predicted.drop("class_vector"), "image_id").join(picked, "image_id")


def single_label_scores(rows: DataFrame) -> DataFrame:
    """Axes of ``single_label_predictions``; a missing answer counts as wrong."""
    return axis_metrics(rows, {a: (f"gt_{a}", f"final_{a}") for a in AXES})


def calibrate(pairs: DataFrame, name: str = "rule", **more) -> DataFrame:
    """Pairs (image_path, class_name, gt_*) with pred_* of the model asked about
    the true class, and parse_failed; sub-axes count for nature alone."""
    asked = pairs.filter("gt_nature IS NOT NULL").withColumn("_prompt", prompts.full_label(F.col("class_name")))
    raw = annotate.respond(asked, name, "_prompt", "image_path", "_raw", prompts.system("full"), "label", **more)
    r = raw.withColumn("_r", parse_response(F.col("_raw"), FULL_LABEL))
    nature = label_to_bool(F.col("_r.nature"), "nature")
    r = r.withColumn("pred_nature", nature).withColumn("parse_failed", F.col("_r").isNull())
    for axis, field in (("biotic", "life_category"), ("material", "tangibility")):
        r = r.withColumn(f"pred_{axis}", F.when(F.col("pred_nature"), label_to_bool(F.col(f"_r.{field}"), axis)))
    return r.drop("_prompt", "_raw", "_r")


def calibration_scores(rows: DataFrame) -> DataFrame:
    return axis_metrics(rows, {a: (f"gt_{a}", f"pred_{a}") for a in AXES})


def annotate_to(path: str, images: DataFrame, vocabulary: DataFrame, resolved: DataFrame, header: dict, name: str = "rule", **more) -> None:
    """The first part of a run: annotate images and write the artifact."""
    began = time.monotonic()
    records = infer(images, vocabulary, resolved, name, **more)
    stores.write_artifact(records, path, {**header, "model": name}, time.monotonic() - began)


def score_from(spark: SparkSession, path: str, lemmas: DataFrame, out: str | None = None) -> tuple[dict, DataFrame]:
    """The second part: the artifact's header and scores by axis; with ``out`` the
    predictions are written there as CSV, an object a row."""
    header, records = stores.read_artifact(spark, path)
    if out is not None:
        rows = exploded_objects(records).filter("object IS NOT NULL")
        stores.write_predictions(rows.select("image_path", "obj_idx", "object", "label", "final"), stores.prediction_path(out, header["dataset"], header["model"]))
    return header, holistic_scores(records, lemmas)
