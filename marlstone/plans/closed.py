"""Queries of closed-set classifiers, direct answers, forced roots and names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import labels as L
from marlstone.functions import text as T
from marlstone.functions import vectors as V
from marlstone.operators import annotate, classify, detection, embeddings, graph, matching, metrics, sampling
from marlstone.plans.registry import query
from marlstone.plans.scoring import _DETECTED, _confusion_sql, detections, rounded
from marlstone.plans.taxonomy import _CLOSURE, _COUNTS, _counts, _edge, _n
from marlstone.session import table
from marlstone.sources import categories, readers


def _classified(spark: SparkSession, d: str) -> DataFrame:
    names = spark.range(10).select(F.col("id").cast("int").alias("class_index"), F.concat(F.lit("w"), F.col("id").cast("string")).alias("node"))
    names = classify.index_table(names, {0: "w0", 7: "w7"}, 10)
    i = F.substring("node", 2, 9).cast("int")
    known = names.filter(i % 4 != 3).select("node", (i < 5).alias("is_nature"))
    rows = table(spark, d, "embeddings").select("vec_id", F.concat(F.lit("w"), F.col("label").cast("string")).alias("true_node"), F.slice("embedding", 1, 10).alias("logits"))
    return classify.closed_set_labels(rows, names, known, "true_node", "is_nature")


_CLASSIFIED = """WITH r AS (SELECT vec_id, label, CAST(list_position(embedding[1:10], list_max(embedding[1:10])) - 1 AS INTEGER) AS c FROM embeddings),
m AS (SELECT vec_id, label < 5 AS gt, CASE WHEN c % 4 <> 3 THEN c < 5 END AS pred, c FROM r WHERE label % 4 <> 3) """


@query(_CLASSIFIED + "SELECT vec_id, c AS class_index, 'w' || c AS pred_node, gt, pred FROM m")
def closed_set_classes(spark: SparkSession, d: str) -> DataFrame:
    return _classified(spark, d).select("vec_id", "class_index", "pred_node", "gt", "pred")


@query(_CLASSIFIED + ", pairs AS (SELECT gt AS t, coalesce(pred, NOT gt) AS p FROM m) " + _confusion_sql("pairs"))
def closed_set_scores(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.binary_metrics(_classified(spark, d), "gt", "pred"))


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN true WHEN 1 THEN false END AS flag FROM customer")
def class_remap(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", L.class_to_bool((F.col("c_custkey") % 4).cast("int")).alias("flag"))


@query(
    """WITH x AS (SELECT vec_id, unnest(embedding[1:8]) AS x, unnest(range(8)) AS k FROM embeddings)
SELECT CAST(k AS INTEGER) AS class_index, CAST(count(*) FILTER (WHERE 1 / (1 + exp(-10 * CAST(x AS DOUBLE))) >= 0.6) AS BIGINT) AS present, CAST(count(*) AS BIGINT) AS total FROM x GROUP BY 1"""
)
def sigmoid_present(spark: SparkSession, d: str) -> DataFrame:
    each = table(spark, d, "embeddings").select("vec_id", F.posexplode(F.slice("embedding", 1, 8)).alias("class_index", "x"))
    on = V.sigmoid_at_least(10 * F.col("x").cast("double"), 0.6)
    return each.groupBy("class_index").agg(F.count_if(on).alias("present"), F.count("*").alias("total"))


_DIRECT = _DETECTED + """, img AS (SELECT image_id, bool_or(coalesce(is_nature, false) AND y_true) AS t, CASE WHEN image_id % 7 <> 0 THEN image_id % 3 = 0 END AS guess FROM det GROUP BY 1),
pairs AS (SELECT t, coalesce(guess, NOT t) AS p FROM img) """


@query(_DIRECT + _confusion_sql("pairs"))
def direct_image_scores(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("image_id")
    rows = detections(spark, d).withColumn("guess", F.when(i % 7 != 0, i % 3 == 0))
    return rounded(metrics.any_positive_direct(rows, "image_id", "is_nature", "y_true", "guess"))


_ZERO = "SELECT " + ", ".join(f"0.0::DOUBLE AS {c}" for c in ("accuracy", "precision", "recall", "f1", "precision_neg", "recall_neg", "f1_neg")) + ", 0::BIGINT AS support"


@query(_ZERO)
def one_class_guard(spark: SparkSession, d: str) -> DataFrame:
    """Every image has a present class: a truth of one kind scores nothing."""
    rows = detections(spark, d).withColumn("axis", F.lit(True)).withColumn("truth", F.lit(True))
    return metrics.any_positive(rows, "image_id", "axis", "truth", "present")


@query(
    _DETECTED + """SELECT image_id, """ + ", ".join(f"CAST(coalesce(max(CASE WHEN category_id = {k} AND y_true THEN 1 WHEN category_id = {k} THEN 0 END), 0) AS FLOAT) AS \"{k}\"" for k in range(6)) + " FROM det GROUP BY 1"
)
def multi_hot_truth(spark: SparkSession, d: str) -> DataFrame:
    return detection.multi_hot(detections(spark, d), "image_id", "category_id", list(range(6)))


@query(
    "WITH RECURSIVE edges AS (SELECT 'r' || n_regionkey AS parent, 'n' || n_nationkey AS child FROM nation UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier UNION ALL SELECT 'loose', 'bit' "
    "UNION ALL SELECT 'root', 'r' || r_regionkey FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation) UNION ALL SELECT 'root', 'loose' "
    "UNION ALL SELECT 'root', 'n' || k FROM (SELECT DISTINCT s_nationkey AS k FROM supplier) WHERE k NOT IN (SELECT n_nationkey FROM nation)), " + f"{_CLOSURE} {_COUNTS}"
)
def forced_root_closure(spark: SparkSession, d: str) -> DataFrame:
    edges = table(spark, d, "nation").select(*_edge(_n("r", "n_regionkey"), _n("n", "n_nationkey"), F.col("n_nationkey")))
    edges = edges.unionByName(table(spark, d, "supplier").select(*_edge(_n("n", "s_nationkey"), _n("s", "s_suppkey"), F.col("s_suppkey"))))
    edges = edges.unionByName(spark.createDataFrame([("loose", "bit", 1)], "parent string, child string, edge_seq long"))
    return _counts(graph.ancestor_closure(graph.with_root(edges, "root")))


@query(
    """WITH RECURSIVE edges AS (SELECT 'root' AS parent, 'r' || r_regionkey AS child FROM region UNION ALL SELECT 'r' || n_regionkey, 'n' || n_nationkey FROM nation), """ + _CLOSURE + """, senses AS (
  SELECT DISTINCT split_part(p_name, ' ', 2) AS word, p_size AS rank, 'n' || (p_size % 25) AS node FROM part WHERE p_size <= 12),
cand AS (SELECT p_partkey AS id, idx, CASE idx WHEN 0 THEN split_part(p_name, ' ', 1) WHEN 1 THEN split_part(p_name, ' ', 2) ELSE 'bolt' END AS word, (p_partkey * (idx + 3)) % 11 / 10.0 - 0.2 AS score, 'n' || (p_partkey % 25) AS pred FROM part, range(3) t(idx)),
sim AS (SELECT a.n_nationkey AS x, b.n_nationkey AS y, CASE WHEN a.n_nationkey = b.n_nationkey THEN 1.0 WHEN a.n_regionkey = b.n_regionkey THEN 2.0 / 3 ELSE 1.0 / 3 END AS wup FROM nation a, nation b),
hits AS (SELECT id, idx, score, pred AS node, 0 AS k FROM cand WHERE word = 'ring' AND score > 0 UNION ALL
  SELECT id, idx, score, node, row_number() OVER (PARTITION BY id, idx ORDER BY wup DESC, rank) - 1 AS k FROM (
    SELECT id, idx, score, s.node, wup, rank FROM cand JOIN senses s USING (word) JOIN sim ON s.node = 'n' || x AND pred = 'n' || y WHERE score > 0 AND word <> 'ring'))
SELECT id AS p_partkey, arg_min(node, (score * -1000 + idx)) AS node FROM hits WHERE k = 0 GROUP BY id"""
)
def text_to_node_synonyms(spark: SparkSession, d: str) -> DataFrame:
    """Several candidates a picture, by falling score; one word is a known synonym."""
    part = table(spark, d, "part")
    word = F.split_part("p_name", F.lit(" "), F.lit(2))
    senses = part.filter("p_size <= 12").select(word.alias("word"), F.col("p_size").alias("rank"), F.concat(F.lit("n"), (F.col("p_size") % 25).cast("string")).alias("node")).distinct()
    each = part.select(F.col("p_partkey").alias("id"), F.posexplode(F.array(F.split_part("p_name", F.lit(" "), F.lit(1)), word, F.lit("bolt"))).alias("idx", "text"), F.concat(F.lit("n"), (F.col("p_partkey") % 25).cast("string")).alias("pred_node"))
    cand = each.withColumn("score", (F.col("id") * (F.col("idx") + 3)) % 11 / 10.0 - 0.2)
    edges = table(spark, d, "region").select(*_edge(F.lit("root"), _n("r", "r_regionkey"), F.col("r_regionkey")))
    edges = edges.unionByName(table(spark, d, "nation").select(*_edge(_n("r", "n_regionkey"), _n("n", "n_nationkey"), F.col("n_nationkey"))))
    asked = cand.select(F.col("text").alias("word"), "pred_node").join(senses, "word").select("node", "pred_node").distinct()
    similarity = graph.wu_palmer(asked, graph.ancestor_closure(edges), "root", "node", "pred_node").select("node", "pred_node", "wup")
    same = spark.createDataFrame([("ring",)], "word string")
    return graph.resolve_text(cand, senses, similarity, same).withColumnRenamed("id", "p_partkey")


@query(
    """WITH terms AS (SELECT p_size AS image_id, p_brand AS target_id, unnest([lower(p_type), split_part(p_name, ' ', 2)]) AS term FROM part WHERE p_size % 2 = 0 UNION ALL SELECT p_size, p_brand, lower(p_type) FROM part WHERE p_size % 2 = 1)
SELECT image_id, target_id, CAST(min(obj_idx) AS BIGINT) AS obj_idx FROM (SELECT p_size AS image_id, p_partkey AS obj_idx, unnest([p_name, split_part(p_name, ' ', 2)]) AS term FROM part) JOIN terms USING (image_id, term) GROUP BY 1, 2"""
)
def object_gt_match_lemmas(spark: SparkSession, d: str) -> DataFrame:
    """Targets match by their node's lemmas too."""
    part = table(spark, d, "part")
    word = F.split_part("p_name", F.lit(" "), F.lit(2))
    objects = part.select(F.col("p_size").alias("image_id"), F.col("p_partkey").alias("obj_idx"), F.concat(F.lit("The "), "p_name").alias("object"))
    node = F.when(F.col("p_size") % 2 == 0, F.concat(word, F.lit(".n.01"))).otherwise("none")
    targets = part.select(F.col("p_size").alias("image_id"), F.col("p_brand").alias("target_id"), F.col("p_type").alias("class_name"), node.alias("node"))
    lemmas = part.select(F.concat(word, F.lit(".n.01")).alias("node"), F.initcap(word).alias("lemma")).distinct()
    return matching.match_objects(objects, matching.target_terms(targets, lemmas))


@query("SELECT doc_id, quality = 1 AS kept, CAST(NULL AS VARCHAR) AS nature, CAST(NULL AS VARCHAR) AS reasoning, quality = 0 AS parse_failed, quality = 1 AS vlm_called FROM labels")
def empty_labels(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "labels").select("doc_id", (F.col("quality") == 1).alias("kept"))
    label = F.when(F.col("kept"), L.empty_label()).otherwise(L.empty_label(parse_failed=True, vlm_called=False))
    return rows.select("doc_id", "kept", label.alias("l")).select("doc_id", "kept", "l.nature", "l.reasoning", "l.parse_failed", "l.vlm_called")


@query(
    """SELECT p_partkey, replace(p_name, ' ', '_') || '.n.' || p_size AS node, p_name AS short, 'st. ' || p_name AS whole, p_brand || '_' || p_type AS slug, CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS VARCHAR) ELSE 'full' END AS config,
  'a photo of a ' || p_name AS prompt FROM part"""
)
def display_names(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size").cast("string")
    node = F.concat(F.translate("p_name", " ", "_"), F.lit(".n."), size)
    model = F.concat("p_brand", F.lit("/"), "p_type")
    return table(spark, d, "part").select(
        "p_partkey", node.alias("node"), T.node_display(node).alias("short"), T.node_display(F.concat(F.lit("st._"), node), whole=True).alias("whole"),
        T.model_slug(model).alias("slug"), T.config_key(F.when(F.col("p_size") % 2 == 0, F.col("p_size"))).alias("config"), T.photo_of(F.col("p_name")).alias("prompt"),
    )


@query("SELECT event_id, CASE WHEN event_id % 3 > 0 THEN round((event_id * 1.0 / (event_id % 3)) * greatest(5 - event_id % 3, 0), 6) END AS seconds, CAST(event_id // 64 AS BIGINT) AS batch FROM events")
def time_left_by_batch(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    left = T.time_left(e.cast("double"), e % 3, F.lit(5))
    return table(spark, d, "events").select("event_id", F.round(left, 6).alias("seconds"), sampling.batch_number(e, 64).alias("batch"))


@query("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def sample_members(spark: SparkSession, d: str) -> DataFrame:
    return sampling.members(table(spark, d, "documents").select("doc_id", "source"), table(spark, d, "labels").filter("quality = 1"), "doc_id")


@query("SELECT CAST(l_partkey AS BIGINT) AS id, 'missing' AS problem FROM (SELECT p_partkey AS l_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_linenumber = 7) UNION ALL SELECT -1, 'unknown'")
def id_check(spark: SparkSession, d: str) -> DataFrame:
    have = table(spark, d, "lineitem").filter("l_linenumber = 7").select(F.col("l_partkey").alias("id")).unionByName(spark.createDataFrame([(-1,)], "id long"))
    return matching.unknown_ids(have, "id", table(spark, d, "part").select(F.col("p_partkey").alias("id")))


@query("SELECT CAST(count(DISTINCT event_type) AS BIGINT) AS models FROM events")
def models_tracked(spark: SparkSession, d: str) -> DataFrame:
    each = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.max("value").alias("v"))
    # A user has at most one entry for each of a few event types.
    maps = each.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "v"))).alias("p"))
    return metrics.models_tracked(maps, "p")


@query(
    """WITH r AS (SELECT quality = 1 AS n, CASE WHEN toxic = 1 THEN doc_id % 2 = 0 END AS b, CASE WHEN doc_id % 3 > 0 THEN doc_id % 3 = 1 END AS m FROM labels)
SELECT CAST(count(*) FILTER (WHERE n) AS BIGINT) AS nature, CAST(count(*) FILTER (WHERE NOT n) AS BIGINT) AS no_nature, CAST(count(*) FILTER (WHERE b) AS BIGINT) AS biotic, CAST(count(*) FILTER (WHERE NOT b) AS BIGINT) AS abiotic,
  CAST(count(*) FILTER (WHERE m) AS BIGINT) AS material, CAST(count(*) FILTER (WHERE NOT m) AS BIGINT) AS immaterial FROM r"""
)
def truth_composition(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    rows = table(spark, d, "labels").select((F.col("quality") == 1).alias("gt_nature"), F.when(F.col("toxic") == 1, k % 2 == 0).alias("gt_biotic"), F.when(k % 3 > 0, k % 3 == 1).alias("gt_material"))
    return metrics.truth_composition(rows)


def _lengths(words: list[str]) -> list[list[float]]:
    return [[float(len(w)), float(w.count("r"))] for w in words]


@query("SELECT DISTINCT p_name AS text, CAST(length(p_name) AS DOUBLE) AS size, round(length(p_name) / sqrt(length(p_name) ** 2 + (length(p_name) - length(replace(p_name, 'r', ''))) ** 2), 6) AS first FROM part")
def encoded_names(spark: SparkSession, d: str) -> DataFrame:
    """Each distinct name is encoded once; vectors of length one."""
    found = embeddings.encode_distinct(table(spark, d, "part"), "p_name", _lengths)
    return found.select(F.col("p_name").alias("text"), F.get("vector", F.lit(0)).cast("double").alias("size"), F.round(F.get(V.l2_normalise(F.col("vector")), F.lit(0)), 6).alias("first"))


@query("SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN 0.0 ELSE round(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 5) END AS own FROM embeddings")
def zero_for_missing(spark: SparkSession, d: str) -> DataFrame:
    held = V.or_zero(F.when(F.col("vec_id") % 3 != 0, F.col("embedding")), 64)
    return table(spark, d, "embeddings").select("vec_id", F.round(V.dot(held, F.col("embedding")), 5).alias("own"))


def _values(rows) -> str:
    return "VALUES " + ", ".join("(" + ", ".join(repr(x) for x in r) + ")" for r in rows)


@query(
    f"WITH c AS (SELECT * FROM ({_values(categories.CATEGORIES)}) v(category_id, node, name)), s AS (SELECT * FROM ({_values([(w, n) for n, ws in categories.SYNONYMS.items() for w in ws])}) v(word, node))"
    " SELECT category_id, name, CAST(count(word) AS BIGINT) AS synonyms, split_part(node, '.', 1) <> replace(name, ' ', '_') AS renamed FROM c LEFT JOIN s USING (node) GROUP BY ALL"
)
def category_tables(spark: SparkSession, d: str) -> DataFrame:
    met = categories.categories(spark).join(categories.synonyms(spark), "node", "left")
    renamed = F.split_part("node", F.lit("."), F.lit(1)) != F.translate("name", " ", "_")
    return met.groupBy("category_id", "name", renamed.alias("renamed")).agg(F.count("word").alias("synonyms"))


@query(
    """SELECT CAST(p_partkey AS VARCHAR) AS image_path, CASE WHEN p_partkey % 5 = 0 THEN 'kept' ELSE 'a picture of ' || p_partkey END AS what, CASE WHEN p_partkey % 10 = 0 THEN 'kept too' ELSE '[too long]' END AS why FROM part"""
)
def question_grid_resumed(spark: SparkSession, d: str) -> DataFrame:
    """Answers that are there aren't asked again; failures keep their text."""
    k = F.col("p_partkey")
    images = table(spark, d, "part").select(k.cast("string").alias("image_path"), k)
    done = images.filter(k % 5 == 0).select("image_path", F.lit("what").alias("question"), F.lit("kept").alias("answer"))
    done = done.unionByName(images.filter(k % 10 == 0).select("image_path", F.lit("why").alias("question"), F.lit("kept too").alias("answer")))
    asked = annotate.questions(images.select("image_path"), {"what": "What is it?", "why": "Why? " * 1000}, done=done, failed="[too long]")
    return asked.select("image_path", F.col("answers")["what"].alias("what"), F.col("answers")["why"].alias("why"))


@query("SELECT event_id, CAST(user_id AS VARCHAR) AS file FROM events WHERE user_id IN (SELECT user_id FROM events WHERE event_type = 'click')")
def readable_rows(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select("event_id", F.col("user_id").cast("string").alias("file"), "event_type")
    return readers.readable(events.drop("event_type"), events.filter("event_type = 'click'"), "file").select("event_id", "file")


@query("SELECT doc_id, CAST(turn AS INTEGER) AS turn, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS turn FROM documents) ORDER BY turn, source, doc_id LIMIT 60")
def round_robin_last_class(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source", F.lit(1).alias("seq"))
    both = docs.unionByName(docs.withColumn("source", F.lit("src0")).withColumn("seq", F.lit(0)))
    return sampling.round_robin_of_last(both, "source", "doc_id", "seq", 60).select("doc_id", "turn", "source")


@query("SELECT 'nature' AS axis, CAST(5 AS BIGINT) AS n UNION ALL SELECT 'unknown', 0")
def axis_words(spark: SparkSession, d: str) -> DataFrame:
    """Words that an axis knows, over all cases and blanks; an unknown axis has none."""
    words = table(spark, d, "region").select(F.when(F.col("r_regionkey") % 2 == 0, " YES ").otherwise("No").alias("w"))
    counts = [words.select(L.label_to_bool(F.col("w"), a).alias("b")).agg(F.count("b").alias("n")).select(F.lit(a).alias("axis"), "n") for a in ("nature", "unknown")]
    return counts[0].unionByName(counts[1])
