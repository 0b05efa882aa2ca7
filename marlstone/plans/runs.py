"""Queries of whole runs: annotate, then score; by the rule annotator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators import inference, metrics
from marlstone.plans.registry import query
from marlstone.plans.scoring import _candidates, _confusion_sql, _image, rounded
from marlstone.schemas import TARGETS
from marlstone.session import table


def _noun():
    return F.split_part("p_name", F.lit(" "), F.lit(2))


def part_records(spark: SparkSession, d: str) -> DataFrame:
    """A picture of each part with one target, its noun; all nouns but bolts are
    in the taxonomy, rings and widgets as nature."""
    k = F.col("p_partkey")
    nature = F.when(k % 7 != 0, k % 3 != 0)
    target = F.struct(_noun().alias("class_name"), F.lit("").alias("synset_id"), nature.alias("gt_nature"), F.when(nature, k % 2 == 0).alias("gt_biotic"), F.when(nature, F.lit(True)).alias("gt_material"))
    part = table(spark, d, "part")
    images = part.select(F.concat("p_name", F.lit(" x"), k.cast("string")).alias("image_path"), F.array(target).cast(TARGETS).alias("targets"))
    nouns = part.select(_noun().alias("lemma")).distinct().filter("lemma <> 'bolt'").withColumn("node", F.concat(F.lit("w_"), "lemma"))
    resolved = nouns.select("node", F.col("lemma").isin("ring", "widget").alias("is_nature"), F.when(F.col("lemma") == "ring", "biotic").alias("life_category"))
    return inference.infer(images, nouns, resolved)


_OBJECTS = """WITH img AS (SELECT p_partkey AS k, p_name || ' x' || p_partkey AS image_path, split_part(p_name, ' ', 1) AS adj, split_part(p_name, ' ', 2) AS noun FROM part),
obj AS (SELECT image_path, i - 1 AS obj_idx, o[i] AS object, noun FROM (SELECT *, list_filter(list_distinct_ordered, lambda x: len(x) > 2) AS o FROM (SELECT *, ['picture', adj, noun, 'x' || k] AS list_distinct_ordered FROM img)), range(1, 5) t(i) WHERE i <= len(o)),
lab AS (SELECT image_path, CAST(obj_idx AS INTEGER) AS obj_idx, object, object = noun AND noun <> 'bolt' AS mapped, object = noun AND noun IN ('ring', 'widget') AS mn, noun FROM obj) """


@query(
    _OBJECTS + """SELECT image_path, obj_idx, object, mapped, CASE WHEN mapped THEN 'w_' || noun END AS mapped_synset, mn AS final_nature, CASE WHEN mn AND noun = 'ring' THEN true END AS final_biotic,
  CASE WHEN mn THEN true END AS final_material, CASE WHEN mapped THEN 'wordnet' ELSE 'vlm' END AS nature_source, NOT mapped OR mn AS vlm_called, 'a picture of ' || image_path AS caption FROM lab"""
)
def inference_records(spark: SparkSession, d: str) -> DataFrame:
    records = part_records(spark, d)
    rows = inference.exploded_objects(records).join(records.select("image_path", "caption"), "image_path")
    return rows.select("image_path", "obj_idx", "object", "final.mapped", "final.mapped_synset", "final.final_nature", "final.final_biotic", "final.final_material", "final.nature_source", "label.vlm_called", "caption")


_HOLISTIC = """WITH r AS (SELECT split_part(p_name, ' ', 2) AS noun, CASE WHEN p_partkey % 7 <> 0 THEN p_partkey % 3 <> 0 END AS n, p_partkey % 2 = 0 AS b FROM part),
pairs AS (
  SELECT 'nature' AS axis, n AS t, noun IN ('ring', 'widget') AS p FROM r WHERE n IS NOT NULL
  UNION ALL SELECT 'biotic', b, coalesce(CASE WHEN noun = 'ring' THEN true END, NOT b) FROM r WHERE n
  UNION ALL SELECT 'material', true, coalesce(CASE WHEN noun IN ('ring', 'widget') THEN true END, false) FROM r WHERE n
) """


@query(_HOLISTIC + _confusion_sql("pairs", "axis"))
def holistic_scores(spark: SparkSession, d: str) -> DataFrame:
    lemmas = spark.createDataFrame([], "node string, lemma string")
    return rounded(inference.holistic_scores(part_records(spark, d), lemmas))


@query("SELECT CAST(count(*) AS BIGINT) AS targets, CAST(count(*) AS BIGINT) AS hits, 1.0::DOUBLE AS extraction_hit_rate FROM part WHERE p_partkey % 7 <> 0")
def extraction_hits(spark: SparkSession, d: str) -> DataFrame:
    lemmas = spark.createDataFrame([], "node string, lemma string")
    return rounded(metrics.extraction_hits(inference.matched_targets(part_records(spark, d), lemmas)))


@query(
    """WITH r AS (SELECT split_part(p_name, ' ', 2) AS noun, p_partkey % 3 <> 0 AS n, p_partkey % 2 = 0 AS b, p_partkey % 50 = 9 AS long FROM part), f AS (SELECT *, CASE WHEN NOT long THEN noun = 'ring' END AS pn FROM r),
pairs AS (
  SELECT 'nature' AS axis, n AS t, coalesce(pn, NOT n) AS p FROM f UNION ALL SELECT 'biotic', b, coalesce(CASE WHEN pn THEN true END, NOT b) FROM f WHERE n
  UNION ALL SELECT 'material', true, coalesce(CASE WHEN pn THEN true END, false) FROM f WHERE n
) """ + _confusion_sql("pairs", "axis")
)
def calibration_scores(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    nature = k % 3 != 0
    name = F.when(k % 50 == 9, F.repeat(_noun(), 3000)).otherwise(_noun())
    pairs = table(spark, d, "part").select(F.col("p_name").alias("image_path"), name.alias("class_name"), nature.alias("gt_nature"), F.when(nature, k % 2 == 0).alias("gt_biotic"), F.when(nature, F.lit(True)).alias("gt_material"))
    return rounded(inference.calibration_scores(inference.calibrate(pairs)))


@query(
    """WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), cand AS (SELECT label AS c, arg_min(e, vec_id) AS ce FROM v GROUP BY 1),
best AS (SELECT vec_id, label, c, ce, row_number() OVER (PARTITION BY vec_id ORDER BY list_dot_product(e, ce) DESC, c) AS k FROM v, cand),
obj AS (SELECT b.vec_id, o.vec_id AS oi, row_number() OVER (PARTITION BY b.vec_id ORDER BY list_dot_product(o.e, ce) DESC, o.vec_id) AS k FROM best b JOIN v o ON o.vec_id // 3 = b.vec_id WHERE b.k = 1),
r AS (SELECT b.vec_id, b.label < 5 AS n, b.label = 0 AS bi, CASE oi % 3 WHEN 0 THEN true WHEN 1 THEN false END AS pn, CASE oi % 4 WHEN 0 THEN true END AS pb, oi % 2 = 0 AS pm FROM best b LEFT JOIN obj o ON o.vec_id = b.vec_id AND o.k = 1 WHERE b.k = 1),
pairs AS (
  SELECT 'nature' AS axis, n AS t, coalesce(pn, NOT n) AS p FROM r UNION ALL SELECT 'biotic', bi, coalesce(pb, NOT bi) FROM r WHERE n UNION ALL SELECT 'material', true, coalesce(pm, false) FROM r WHERE n
) """ + _confusion_sql("pairs", "axis")
)
def single_label_scores(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings")
    i, label = F.col("vec_id"), F.col("label")
    images = v.select(i.alias("image_id"), label.alias("gt_node"), (label < 5).alias("gt_nature"), F.when(label < 5, label == 0).alias("gt_biotic"), F.when(label < 5, F.lit(True)).alias("gt_material"), "embedding")
    objects = v.select(
        _image(), i.alias("obj_idx"), F.lit("x").alias("object"), F.col("embedding").alias("object_vector"),
        F.when(i % 3 == 0, True).when(i % 3 == 1, False).alias("final_nature"), F.when(i % 4 == 0, True).alias("final_biotic"), (i % 2 == 0).alias("final_material"),
    )
    candidates = _candidates(v).withColumn("node", F.col("cand_idx"))
    return rounded(inference.single_label_scores(inference.single_label_predictions(images, objects, candidates)))
