"""Queries of the evaluation, detection and vector operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions.labels import hybrid_label, label_to_bool
from marlstone.operators import detection, embeddings, matching, metrics
from marlstone.plans.registry import query
from marlstone.session import table

DIGITS = 9


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _confusion_sql(source: str, by: str = "", where: str = "") -> str:
    """Metrics from t and p columns of ``source``."""
    lead, group = (f"{by}, ", f" GROUP BY {by}") if by else ("", "")
    return f"""SELECT {lead}round(coalesce((tp + tn) / nullif(s, 0), 0), 9) AS accuracy, round(pp, 9) AS precision, round(rr, 9) AS recall,
  round(coalesce(2 * pp * rr / nullif(pp + rr, 0), 0), 9) AS f1, round(pn, 9) AS precision_neg, round(rn, 9) AS recall_neg, round(coalesce(2 * pn * rn / nullif(pn + rn, 0), 0), 9) AS f1_neg, CAST(s AS BIGINT) AS support
FROM (SELECT *, tp + fp + fn + tn AS s, coalesce(tp / nullif(tp + fp, 0), 0) AS pp, coalesce(tp / nullif(tp + fn, 0), 0) AS rr, coalesce(tn / nullif(tn + fn, 0), 0) AS pn, coalesce(tn / nullif(tn + fp, 0), 0) AS rn
  FROM (SELECT {lead}CAST(count(*) FILTER (WHERE t AND p) AS DOUBLE) AS tp, CAST(count(*) FILTER (WHERE NOT t AND p) AS DOUBLE) AS fp, CAST(count(*) FILTER (WHERE t AND NOT p) AS DOUBLE) AS fn, CAST(count(*) FILTER (WHERE NOT t AND NOT p) AS DOUBLE) AS tn
    FROM {source}{where}{group}))"""


_JUDGED = """WITH raw AS (
  SELECT d.doc_id, lang, n_chars, l.toxic = 0 AS t, CASE WHEN n_chars NOT BETWEEN 1000 AND 1200 THEN n_chars > 700 END AS guess FROM documents d JOIN labels l USING (doc_id)
), rows_ AS (SELECT *, coalesce(guess, NOT t) AS p FROM raw WHERE t IS NOT NULL) """


def judged(spark: SparkSession, d: str) -> DataFrame:
    """Documents with a truth and a prediction that is sometimes missing."""
    n = F.col("n_chars")
    guess = F.when(~n.between(1000, 1200), n > 700)
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars", guess.alias("pred"))
    return docs.join(table(spark, d, "labels").select("doc_id", "quality", (F.col("toxic") == 0).alias("gt")), "doc_id")


@query(_JUDGED + _confusion_sql("rows_"))
def binary_metrics_posneg(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.binary_metrics(judged(spark, d), "gt", "pred"))


@query(_JUDGED + ", both_ AS (SELECT lang, t, p FROM rows_ UNION ALL SELECT 'all', t, p FROM rows_) " + _confusion_sql("both_", "lang"))
def binary_metrics_by_lang(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.binary_metrics_with_total(judged(spark, d), "gt", "pred", "lang"))


@query(
    """WITH r AS (SELECT label AS t, CASE WHEN vec_id % 4 = 0 THEN (label + 1) % 10 WHEN vec_id % 9 <> 0 THEN label END AS p FROM embeddings),
g AS (SELECT t AS k, count(*) AS n, count(*) FILTER (WHERE t = p) AS tp FROM r GROUP BY 1), q AS (SELECT p AS k, count(*) AS n FROM r WHERE p IS NOT NULL GROUP BY 1),
e AS (SELECT coalesce(tp, 0) AS tp, coalesce(g.n, 0) AS gt, coalesce(CAST(tp AS DOUBLE) / q.n, 0) AS pr, coalesce(CAST(tp AS DOUBLE) / g.n, 0) AS re FROM g FULL JOIN q USING (k))
SELECT round(sum(tp) / CAST(sum(gt) AS DOUBLE), 9) AS accuracy, round(avg(pr), 9) AS precision_macro, round(avg(re), 9) AS recall_macro,
  round(avg(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END), 9) AS f1_macro, CAST(sum(gt) AS BIGINT) AS support FROM e"""
)
def macro_prf(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("vec_id")
    guess = F.when(v % 4 == 0, (F.col("label") + 1) % 10).when(v % 9 != 0, F.col("label"))
    return rounded(metrics.macro_metrics(table(spark, d, "embeddings").select("label", guess.alias("pred")), "label", "pred"))


_AP = """WITH s AS (
  SELECT l_linenumber AS k, l_quantity AS q, sum(CAST(l_returnflag = 'R' AS INT)) AS y, count(*) AS n FROM lineitem GROUP BY 1, 2
), c AS (
  SELECT k, y, sum(y) OVER w AS hits, sum(n) OVER w AS seen FROM s WINDOW w AS (PARTITION BY k ORDER BY q DESC RANGE UNBOUNDED PRECEDING)
), ap AS (SELECT k, CAST(sum(y) AS BIGINT) AS positives, sum(y * (CAST(hits AS DOUBLE) / seen)) / sum(y) AS a FROM c GROUP BY k) """


def _scores(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_linenumber", (F.col("l_returnflag") == "R").alias("y"), "l_quantity")


@query(_AP + "SELECT k AS l_linenumber, positives, round(a, 9) AS average_precision FROM ap")
def average_precision(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.average_precision(_scores(spark, d), "y", "l_quantity", ["l_linenumber"]))


@query(_AP + "SELECT round(avg(a), 9) AS mean_ap, CAST(count(*) AS BIGINT) AS n_classes FROM ap WHERE positives > 0")
def mean_ap(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.mean_average_precision(_scores(spark, d), "y", "l_quantity", "l_linenumber"))


# Part types as detector classes: their axes are nature (3 yes, 2 no, 1 not mapped), biotic and material.
_TYPES = [
    (0, "ECONOMY", True, True, True), (1, "LARGE", True, False, True), (2, "MEDIUM", False, None, None),
    (3, "PROMO", True, None, False), (4, "SMALL", False, None, None), (5, "STANDARD", None, None, None),
]


def _sql(v) -> str:
    return "NULL" if v is None else str(v).lower() if isinstance(v, bool) else repr(v)


_DETECTED = (
    "WITH types AS (SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(_sql, r)) + ")" for r in _TYPES) + """) v(category_id, name, is_nature, is_biotic, is_material)), det AS (
  SELECT l_orderkey AS image_id, category_id, name, CAST(is_nature AS BOOLEAN) AS is_nature, CAST(is_biotic AS BOOLEAN) AS is_biotic, CAST(is_material AS BOOLEAN) AS is_material,
    bool_or(l_linestatus = 'O') AS y_true, max(l_quantity) / 50 >= 0.5 AS present
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN types ON p_type = name GROUP BY ALL) """
)


def detections(spark: SparkSession, d: str) -> DataFrame:
    types = F.broadcast(spark.createDataFrame(_TYPES, "category_id int, name string, is_nature boolean, is_biotic boolean, is_material boolean"))
    part = table(spark, d, "part").select("p_partkey", F.col("p_type").alias("name")).join(types.select("name", "category_id"), "name").select("p_partkey", "category_id")
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linestatus", "l_quantity").join(part, F.col("l_partkey") == F.col("p_partkey"))
    # Grouped by ids alone; what a class is comes after.
    long = rows.groupBy(F.col("l_orderkey").alias("image_id"), "category_id").agg(F.bool_or(F.col("l_linestatus") == "O").alias("y_true"), (F.max("l_quantity") / 50).alias("score"))
    return detection.detected(long.join(types, "category_id"), "score", 0.5)


def _any_sql(axis: str, pool: str = "") -> str:
    return (
        _DETECTED + f", img AS (SELECT image_id, bool_or(coalesce({axis}, false) AND y_true) AS t, bool_or(coalesce({axis}, false) AND present) AS p{', bool_or(coalesce(is_nature, false) AND y_true) AS pool_' if pool else ''} FROM det GROUP BY 1) "
        + _confusion_sql("img", where=" WHERE pool_" if pool else "")
    )


@query(_any_sql("is_nature"))
def multilabel_any_positive(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.any_positive(detections(spark, d), "image_id", "is_nature", "y_true", "present"))


@query(_any_sql("is_biotic", "is_nature"))
def multilabel_any_positive_nature_pool(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.any_positive(detections(spark, d), "image_id", "is_biotic", "y_true", "present", pool="is_nature"))


@query(_DETECTED + ", flat AS (SELECT y_true AS t, present AS p FROM det WHERE is_nature IS NOT NULL) " + _confusion_sql("flat"))
def multilabel_flat_metrics(spark: SparkSession, d: str) -> DataFrame:
    return rounded(detection.flat_metrics(detections(spark, d), "is_nature"))


@query(
    _DETECTED + """, f AS (SELECT image_id, bool_or(present AND coalesce(is_nature, false)) AS n, bool_or(present AND coalesce(is_biotic, false)) AS b, bool_or(present AND coalesce(is_material, false)) AS m,
  coalesce(string_agg(name, ', ' ORDER BY category_id) FILTER (WHERE present), '') AS names, NOT bool_or(present) AS none_ FROM det GROUP BY 1)
SELECT image_id, n AS pred_nature, CASE WHEN b THEN true WHEN n THEN false END AS pred_biotic, CASE WHEN m THEN true WHEN n THEN false END AS pred_material, none_ AS no_match, names AS raw_prediction FROM f"""
)
def detector_projection(spark: SparkSession, d: str) -> DataFrame:
    return detection.project_detections(detections(spark, d), "image_id")


@query(
    """SELECT o_orderkey, bool_or(CASE l_returnflag WHEN 'A' THEN true WHEN 'N' THEN false END) AS gt_nature, coalesce(bool_or(l_linestatus = 'O' AND l_returnflag <> 'R'), false) AS pred_nature
FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1"""
)
def image_level_or(spark: SparkSession, d: str) -> DataFrame:
    gt = F.when(F.col("l_returnflag") == "A", True).when(F.col("l_returnflag") == "N", False)
    final = F.when(F.col("l_returnflag") != "R", F.col("l_linestatus") == "O")
    items = table(spark, d, "lineitem").select("l_orderkey", gt.alias("gt"), final.alias("final"))
    rows = table(spark, d, "orders").select("o_orderkey").join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return metrics.image_any(rows, "o_orderkey", "gt", "final")


@query(
    """SELECT image_id, target_id, CAST(min(obj_idx) AS BIGINT) AS obj_idx FROM (
  SELECT p_size AS image_id, p_partkey AS obj_idx, unnest([p_name, split_part(p_name, ' ', 2)]) AS term FROM part
) JOIN (SELECT p_size AS image_id, p_brand AS target_id, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE split_part(p_name, ' ', 2) END AS term FROM part WHERE p_partkey % 7 = 0) USING (image_id, term) GROUP BY 1, 2"""
)
def object_gt_match(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    objects = part.select(F.col("p_size").alias("image_id"), F.col("p_partkey").alias("obj_idx"), F.concat(F.lit("A "), "p_name").alias("object"))
    name = F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.split_part("p_name", F.lit(" "), F.lit(2)))
    targets = part.filter(F.col("p_partkey") % 7 == 0).select(F.col("p_size").alias("image_id"), F.col("p_brand").alias("target_id"), name.alias("class_name"), F.lit("none").alias("node"))
    lemmas = spark.createDataFrame([], "node string, lemma string")
    return matching.match_objects(objects, matching.target_terms(targets, lemmas))


_OBJECTS = """WITH obj AS (SELECT o_orderkey, p_name AS object, p_size % 2 = 0 AS mapped, l_linenumber = 3 AS failed
  FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey AND l_returnflag <> 'N' LEFT JOIN part ON l_partkey = p_partkey),
img AS (SELECT o_orderkey, count(object) AS n, count(object) FILTER (WHERE mapped) AS m, count(object) FILTER (WHERE failed) AS f FROM obj GROUP BY 1) """


def order_objects(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("l_linenumber")
    part = table(spark, d, "part").select("p_partkey", F.col("p_name").alias("object"), (F.col("p_size") % 2 == 0).alias("mapped"))
    items = table(spark, d, "lineitem").filter("l_returnflag <> 'N'").select("l_orderkey", "l_partkey", (n == 3).alias("parse_failed"))
    items = items.join(part, F.col("l_partkey") == F.col("p_partkey"), "left")
    return table(spark, d, "orders").select("o_orderkey").join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left")


@query(
    _OBJECTS + """SELECT CAST(count(*) AS BIGINT) AS images, CAST(sum(n) AS BIGINT) AS objects, round(avg(n), 9) AS objects_per_image, round(sum(f) / CAST(sum(n) AS DOUBLE), 9) AS parse_failure_rate,
  round(sum(m) / CAST(sum(n) AS DOUBLE), 9) AS mapping_rate, round((sum(n) - sum(m)) / CAST(sum(n) AS DOUBLE), 9) AS fallback_rate FROM img"""
)
def extraction_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.extraction_diagnostics(order_objects(spark, d), "o_orderkey"))


@query(_OBJECTS + "SELECT o_orderkey, CAST(n AS BIGINT) AS objects, round(CAST(m AS DOUBLE) / nullif(n, 0), 9) AS mapped_rate FROM img")
def image_object_rates(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.image_rates(order_objects(spark, d), "o_orderkey"))


@query(
    """WITH r AS (SELECT c_custkey, CASE WHEN c_nationkey % 5 = 0 THEN c_mktsegment ELSE 'n' || c_nationkey END AS id, CASE c_custkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS n,
  c_custkey % 2 = 0 AS b, CASE WHEN c_custkey % 4 > 0 THEN c_custkey % 4 = 1 END AS m FROM customer),
f AS (SELECT id, arg_min(n, c_custkey) AS n, arg_min(b, c_custkey) AS b, min(c_custkey) AS k FROM r WHERE n IS NOT NULL GROUP BY id), g AS (SELECT f.*, r.m FROM f JOIN r ON r.c_custkey = f.k)
SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (WHERE n) AS BIGINT) AS nature, CAST(count(*) FILTER (WHERE NOT n) AS BIGINT) AS no_nature, CAST(count(*) FILTER (WHERE n AND b) AS BIGINT) AS biotic,
  CAST(count(*) FILTER (WHERE n AND NOT b) AS BIGINT) AS abiotic, CAST(count(*) FILTER (WHERE n AND m) AS BIGINT) AS material, CAST(count(*) FILTER (WHERE n AND NOT m) AS BIGINT) AS immaterial FROM g"""
)
def class_stats(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    rows = table(spark, d, "customer").select(
        "c_custkey", "c_mktsegment", F.when(F.col("c_nationkey") % 5 == 0, "").otherwise(F.concat(F.lit("n"), F.col("c_nationkey").cast("string"))).alias("node"),
        F.when(k % 3 == 0, True).when(k % 3 == 1, False).alias("gt_nature"), (k % 2 == 0).alias("gt_biotic"), F.when(k % 4 > 0, k % 4 == 1).alias("gt_material"),
    )
    return metrics.class_stats(rows, "node", "c_mktsegment", "c_custkey")


@query(
    """WITH n AS (SELECT CASE n_nationkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS is_nature, CASE n_nationkey % 4 WHEN 0 THEN 'biotic' WHEN 1 THEN 'abiotic' END AS l, CASE n_nationkey % 5 WHEN 0 THEN 'material' WHEN 1 THEN 'immaterial' END AS t FROM nation)
SELECT CAST(count(*) AS BIGINT) AS total, """ + ", ".join(f"CAST(count(*) FILTER (WHERE {c}) AS BIGINT) AS {a}" for a, c in [("nature", "is_nature"), ("no_nature", "NOT is_nature"), ("unmapped", "is_nature IS NULL"), ("biotic", "l = 'biotic'"), ("abiotic", "l = 'abiotic'"), ("material", "t = 'material'"), ("immaterial", "t = 'immaterial'")]) + " FROM n"  # fmt: skip
)
def class_coverage(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n_nationkey")
    return metrics.class_coverage(
        table(spark, d, "nation").select(
            F.when(n % 3 == 0, True).when(n % 3 == 1, False).alias("is_nature"), F.when(n % 4 == 0, "biotic").when(n % 4 == 1, "abiotic").alias("life_category"),
            F.when(n % 5 == 0, "material").when(n % 5 == 1, "immaterial").alias("tangibility"),
        )
    )


_CAND = """WITH cand AS (SELECT label AS cand_idx, arg_min(CAST(embedding AS DOUBLE[]), vec_id) AS c FROM embeddings GROUP BY 1), best AS (
  SELECT vec_id, label, cand_idx, list_dot_product(CAST(embedding AS DOUBLE[]), c) AS s, row_number() OVER (PARTITION BY vec_id ORDER BY list_dot_product(CAST(embedding AS DOUBLE[]), c) DESC, cand_idx) AS k FROM embeddings, cand) """


def _image():
    """Every vector is an object of the image with a third of its id."""
    return F.floor(F.col("vec_id") / 3).alias("image_id")


def _candidates(vectors: DataFrame) -> DataFrame:
    return vectors.groupBy(F.col("label").alias("cand_idx")).agg(F.min_by("embedding", "vec_id").alias("embedding"))


def _matched(spark: SparkSession, d: str) -> DataFrame:
    vectors = table(spark, d, "embeddings")
    return embeddings.best_candidate(vectors, _candidates(vectors), key="vec_id")


@query(_CAND + "SELECT vec_id, CAST(cand_idx AS INTEGER) AS cand_idx, round(s, 6) AS similarity FROM best WHERE k = 1")
def clipmatch_top1(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_matched(spark, d), 6)


@query(_CAND + "SELECT round(avg(CAST(cand_idx = label AS INT)), 9) AS accuracy, CAST(count(*) AS BIGINT) AS support FROM best WHERE k = 1")
def clipmatch_accuracy(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").select("vec_id", "label").join(_matched(spark, d), "vec_id")
    return rounded(metrics.top1_accuracy(rows, "label", "cand_idx"))


@query(
    """WITH cls AS (SELECT label, arg_min(CAST(embedding AS DOUBLE[]), vec_id) AS c FROM embeddings GROUP BY 1), img AS (SELECT vec_id AS image_id, c FROM embeddings JOIN cls USING (label)),
sim AS (SELECT image_id, vec_id, list_dot_product(CAST(embedding AS DOUBLE[]), c) AS s FROM embeddings JOIN img ON image_id = vec_id // 3),
best AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY s DESC, vec_id) AS k FROM sim)
SELECT i.image_id, vec_id AS obj_idx, round(s, 6) AS similarity FROM img i LEFT JOIN best b ON b.image_id = i.image_id AND k = 1"""
)
def best_object_for_prediction(spark: SparkSession, d: str) -> DataFrame:
    vectors = table(spark, d, "embeddings")
    objects = vectors.select(_image(), F.col("vec_id").alias("obj_idx"), F.col("embedding").alias("object_vector"))
    images = vectors.select(F.col("vec_id").alias("image_id"), F.col("label").alias("cand_idx"))
    predicted = images.join(_candidates(vectors), "cand_idx").select("image_id", F.col("embedding").alias("class_vector"))
    return rounded(embeddings.representative_object(objects, predicted), 6)


_CLIP = """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), img AS (
  SELECT a.vec_id AS image_id, a.e AS i, list_dot_product(a.e, b.e) AS cs FROM v a JOIN v b ON b.vec_id = a.vec_id + 1
), obj AS (SELECT vec_id // 3 AS image_id, e FROM v), agg AS (
  SELECT image_id, count(*) AS n, sum(2.5 * greatest(list_dot_product(i, e), 0)) AS s FROM obj JOIN img USING (image_id) GROUP BY 1
), r AS (SELECT image_id, coalesce(n, 0) AS n, coalesce(s, 0) AS s, 2.5 * greatest(cs, 0) AS c FROM img LEFT JOIN agg USING (image_id)) """


def _clip(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings")
    caption = v.select((F.col("vec_id") - 1).alias("image_id"), F.col("embedding").alias("caption_vector"))
    images = v.select(F.col("vec_id").alias("image_id"), F.col("embedding").alias("image_vector")).join(caption, "image_id")
    objects = v.select(_image(), F.col("embedding").alias("object_vector"))
    return embeddings.clip_scores(images, objects)


@query(_CLIP + "SELECT image_id, CAST(n AS BIGINT) AS n_objects, round(CASE WHEN n > 0 THEN s / n ELSE 0 END, 6) AS object_score FROM r")
def object_clipscore(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_clip(spark, d).select("image_id", "n_objects", "object_score"), 6)


@query(_CLIP + "SELECT image_id, round(c, 6) AS caption_score, round((c + s) / (n + 1), 6) AS f_score FROM r")
def f_clipscore(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_clip(spark, d).select("image_id", "caption_score", "f_score"), 6)


@query(
    """WITH r AS (SELECT p_partkey, p_partkey % 4 < 2 AS mapped, p_partkey % 4 = 0 AS mn, CASE p_size % 3 WHEN 0 THEN true WHEN 1 THEN false END AS mb,
  CASE p_partkey % 5 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true END AS vn, CASE p_size % 4 WHEN 0 THEN true WHEN 1 THEN false END AS vb, CASE p_size % 5 WHEN 0 THEN true WHEN 1 THEN false END AS vm FROM part),
f AS (SELECT p_partkey, CASE WHEN mapped THEN mn ELSE vn END AS n, CASE WHEN mapped THEN mb ELSE vb END AS b, vm, CASE WHEN mapped THEN 'wordnet' ELSE 'vlm' END AS s FROM r)
SELECT p_partkey, n AS final_nature, CASE WHEN n THEN b END AS final_biotic, CASE WHEN n THEN vm END AS final_material, s AS nature_source, s AS biotic_source, 'vlm' AS material_source FROM f"""
)
def hybrid_labels(spark: SparkSession, d: str) -> DataFrame:
    k, z = F.col("p_partkey"), F.col("p_size")
    words = table(spark, d, "part").select(
        "p_partkey", (k % 4 < 2).alias("mapped"), (k % 4 == 0).alias("mn"), F.when(z % 3 == 0, True).when(z % 3 == 1, False).alias("mb"),
        F.when(k % 5 == 0, " Yes ").when(k % 5 == 1, "no").when(k % 5 == 2, "YES").when(k % 5 == 3, "maybe").alias("n"),
        F.when(z % 4 == 0, "biotic").when(z % 4 == 1, "Abiotic").when(z % 4 == 2, "none").alias("b"), F.when(z % 5 == 0, "material").when(z % 5 == 1, "immaterial").otherwise("n/a").alias("m"),
    )
    final = hybrid_label(F.col("mapped"), F.col("mn"), F.col("mb"), label_to_bool(F.col("n"), "nature"), label_to_bool(F.col("b"), "biotic"), label_to_bool(F.col("m"), "material"))
    return words.select("p_partkey", final.alias("f")).select("p_partkey", "f.*")


@query(
    """SELECT lang, CAST(count(*) FILTER (WHERE n_chars < 200) AS BIGINT) AS n_true, round(avg(CAST(n_chars < 200 AS INT)), 9) AS rate, CAST(count(*) AS BIGINT) AS total FROM documents GROUP BY 1"""
)
def no_match_rate(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("lang", (F.col("n_chars") < 200).alias("no_match"))
    return rounded(metrics.flag_rate(rows, "no_match", ["lang"]))
