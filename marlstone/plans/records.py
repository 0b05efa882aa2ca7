"""Queries of the text, sampling, source, store and annotation operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.operators import annotate, matching, metrics, sampling
from marlstone.plans.registry import query
from marlstone.plans.scoring import judged, rounded
from marlstone.session import scratch, table
from marlstone.sources import readers, stores


@query(
    """WITH r AS (SELECT event_id, event_type, CASE event_id % 4 WHEN 0 THEN props WHEN 1 THEN '[1, 2]' WHEN 2 THEN '{bad' ELSE NULL END AS raw FROM events),
s AS (SELECT event_type, CASE WHEN raw IS NULL OR NOT json_valid(raw) THEN 'malformed' WHEN json_type(raw) = 'OBJECT' THEN 'object' ELSE 'not_object' END AS status,
  CASE WHEN event_id % 4 = 0 THEN CAST(json_extract(raw, '$.k') AS BIGINT) END AS k FROM r)
SELECT event_type, status, CAST(count(*) AS BIGINT) AS n, CAST(sum(k) AS BIGINT) AS k_sum FROM s GROUP BY 1, 2"""
)
def response_parse_status(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    raw = F.when(e % 4 == 0, F.col("props")).when(e % 4 == 1, "[1, 2]").when(e % 4 == 2, "{bad")
    rows = table(spark, d, "events").select("event_type", raw.alias("raw"))
    rows = rows.select("event_type", T.response_status(F.col("raw")).alias("status"), T.parse_response(F.col("raw"), "k long")["k"].alias("k"))
    return rows.groupBy("event_type", "status").agg(F.count("*").alias("n"), F.sum("k").alias("k_sum"))


@query(
    """SELECT p_partkey, array_to_string(CASE WHEN p_partkey % 2 = 0 THEN [trim(p_name), p_type, p_brand] ELSE [p_type, p_name] END, '|') AS objects,
  CASE WHEN p_partkey % 2 = 0 THEN split_part(p_name, ' ', 2) END AS head FROM part"""
)
def normalize_objects_distinct(spark: SparkSession, d: str) -> DataFrame:
    none = F.lit(None).cast("string")
    even = F.array(F.concat("p_name", F.lit(" ")), F.upper("p_name"), F.lit(" "), "p_type", none, "p_brand", F.lower("p_type"))
    odd = F.array(F.lit(""), "p_type", F.concat(F.lit("\t"), "p_name"), F.initcap("p_name"))
    part = table(spark, d, "part").select("p_partkey", "p_name", F.when(F.col("p_partkey") % 2 == 0, even).otherwise(odd).alias("o"))
    name = F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise(F.split_part("p_name", F.lit(" "), F.lit(1)))
    return part.select("p_partkey", F.array_join(T.normalize_objects(F.col("o")), "|").alias("objects"), T.head_noun(name).alias("head"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN NULL WHEN p_partkey % 3 = 1 THEN replace(p_name, ' ', '_') || '.n.' || p_size ELSE '_' || split_part(p_name, ' ', 2) || '.a.' || p_size END AS node FROM part")
def synset_regex_extract(spark: SparkSession, d: str) -> DataFrame:
    size, k = F.col("p_size").cast("string"), F.col("p_partkey")
    cell = F.when(k % 3 == 0, F.concat("p_name", F.lit(".x."), size)).when(k % 3 == 1, F.concat("p_name", F.lit(" ("), F.translate("p_name", " ", "_"), F.lit(".n."), size, F.lit(") b.n.1")))
    cell = cell.otherwise(F.concat(F.lit("st._"), F.split_part("p_name", F.lit(" "), F.lit(2)), F.lit(".a."), size))
    return table(spark, d, "part").select("p_partkey", T.synset_in(cell).alias("node"))


@query(
    """SELECT page_id, CASE WHEN page_id % 5 <> 4 THEN CAST(page_id AS INTEGER) END AS scene_id, CASE WHEN page_id % 5 <> 4 THEN url END AS name,
  CASE WHEN page_id % 5 <> 4 THEN translate(url, '/_', '  ') END AS shown FROM pages"""
)
def places_path_parse(spark: SparkSession, d: str) -> DataFrame:
    lead = F.when(F.col("page_id") % 2 == 0, "/a/").otherwise("")
    line = F.concat(lead, "url", F.when(F.col("page_id") % 5 == 4, "").otherwise(F.concat(F.lit(" "), F.col("page_id").cast("string"))))
    rows = table(spark, d, "pages").select("page_id", T.scene_line(line).alias("s"))
    return rows.select("page_id", "s.scene_id", "s.name", T.scene_display(F.col("s.name")).alias("shown"))


@query(
    """WITH s AS (SELECT event_id, CASE WHEN event_id % 10 <> 0 THEN event_id * 12.5 END AS x FROM events), r AS (SELECT event_id, CAST(CASE WHEN x - floor(x) = 0.5 AND CAST(floor(x) AS BIGINT) % 2 = 0 THEN floor(x) ELSE floor(x + 0.5) END AS BIGINT) AS s FROM s)
SELECT event_id, (s // 86400) || '-' || lpad(CAST(s % 86400 // 3600 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s % 3600 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') AS duration FROM r"""
)
def format_duration(spark: SparkSession, d: str) -> DataFrame:
    seconds = F.when(F.col("event_id") % 10 != 0, F.col("event_id") * 12.5)
    return table(spark, d, "events").select("event_id", T.duration(seconds).alias("duration"))


@query("SELECT doc_id, source, CAST(row_number() OVER (ORDER BY md5(doc_id || '|42'), doc_id) AS INTEGER) AS sample_pos FROM documents QUALIFY sample_pos <= 50")
def seeded_sample(spark: SparkSession, d: str) -> DataFrame:
    return sampling.seeded_sample(table(spark, d, "documents").select("doc_id", "source"), "doc_id", 50)


@query("SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 25")
def head_n(spark: SparkSession, d: str) -> DataFrame:
    return sampling.head(table(spark, d, "documents").select("doc_id", "lang"), "doc_id", 25)


@query(
    """SELECT doc_id, source, CAST(turn AS INTEGER) AS turn FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS turn FROM documents) ORDER BY turn, source, doc_id LIMIT 47"""
)
def round_robin_by_class(spark: SparkSession, d: str) -> DataFrame:
    return sampling.round_robin(table(spark, d, "documents").select("doc_id", "source"), "source", "doc_id", 47)


_TARGETS = {"good_clean": 6, "good_toxic": 4, "poor_clean": 4, "poor_toxic": 6}
_BUCKET = "CASE quality WHEN 1 THEN 'good' ELSE 'poor' END || CASE toxic WHEN 1 THEN '_toxic' ELSE '_clean' END"


@query(
    f"""WITH want AS (SELECT * FROM (VALUES ('good_clean', 18), ('good_toxic', 12), ('poor_clean', 12), ('poor_toxic', 18)) t(bucket, want)), ranked AS (
  SELECT doc_id, {_BUCKET} AS bucket, md5(doc_id || '|42') AS h, row_number() OVER (PARTITION BY {_BUCKET} ORDER BY md5(doc_id || '|42'), doc_id) AS r FROM labels
) SELECT doc_id, bucket, r > want AS topped_up FROM ranked JOIN want USING (bucket) ORDER BY r > want, h, doc_id LIMIT 60"""
)
def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "labels").select("doc_id", F.expr(_BUCKET).alias("bucket"))
    return sampling.stratified_sample(rows, "bucket", "doc_id", _TARGETS, 60).select("doc_id", "bucket", "topped_up")


@query(
    """WITH r AS (SELECT doc_id, l.toxic = 0 AS t, CASE WHEN n_chars NOT BETWEEN 1000 AND 1200 THEN n_chars > 700 END AS p, quality FROM documents JOIN labels l USING (doc_id)), b AS (
  SELECT doc_id, unnest(list_filter([CASE WHEN t AND p THEN 'TP' END, CASE WHEN t AND NOT p THEN 'FN' END, CASE WHEN NOT t AND p THEN 'FP' END, CASE WHEN NOT t AND NOT p THEN 'TN' END, CASE WHEN p IS NULL THEN 'no_match' END, CASE WHEN quality = 0 AND p THEN 'poor_but_on' END], lambda x: x IS NOT NULL)) AS bucket FROM r
) SELECT doc_id, bucket, CAST(row_number() OVER (PARTITION BY bucket ORDER BY md5(doc_id || '|42'), doc_id) AS INTEGER) AS place FROM b QUALIFY place <= 10"""
)
def example_buckets(spark: SparkSession, d: str) -> DataFrame:
    t, p = F.col("gt"), F.col("pred")
    buckets = {"TP": t & p, "FN": t & ~p, "FP": ~t & p, "TN": ~t & ~p, "no_match": p.isNull(), "poor_but_on": (F.col("quality") == 0) & p}
    return sampling.example_buckets(judged(spark, d), buckets, "doc_id", 10).select("doc_id", "bucket", "place")


@query(
    """WITH s AS (SELECT doc_id, unnest(range(4)) AS slot FROM documents JOIN labels USING (doc_id) WHERE doc_id % 10 <> 9), r AS (
  SELECT doc_id, slot, doc_id || '_' || slot || '.jpg' AS file, (doc_id + slot) % 3 AS n, CASE (doc_id + slot) % 4 WHEN 0 THEN true WHEN 1 THEN false END AS m, CASE (doc_id + slot) % 5 WHEN 0 THEN true WHEN 1 THEN false END AS b FROM s WHERE slot <= doc_id % 5
) SELECT doc_id, CAST(slot AS INTEGER) AS slot, file, n = 0 AS gt_nature, CASE WHEN n = 0 THEN m END AS gt_material, CASE WHEN n = 0 THEN b END AS gt_biotic, n = 1 AND (m IS NOT NULL OR b IS NOT NULL) AS repaired FROM r WHERE n < 2"""
)
def media_slot_explode(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    names = F.transform(F.sequence(F.lit(0), (k % 5).cast("int")), lambda i: F.concat(F.lit("'"), k.cast("string"), F.lit("_"), i.cast("string"), F.lit(".jpg'")))
    literal = F.when(k % 10 == 9, "[oops").otherwise(F.concat(F.lit("["), F.array_join(names, ", "), F.lit("]")))
    media = table(spark, d, "documents").select("doc_id", literal.alias("media_files"), F.col("source").alias("kind"))
    cells, slots = [], []
    for i in range(4):
        v = k + i
        cells.append(F.when(v % 3 == 0, " Yes").when(v % 3 == 1, "no").otherwise("unsure").alias(f"n{i}"))
        cells.append(F.when(v % 4 == 0, "material").when(v % 4 == 1, "Immaterial").alias(f"m{i}"))
        cells.append(F.when(v % 5 == 0, "biotic").when(v % 5 == 1, "abiotic").alias(f"b{i}"))
        slots.append((f"n{i}", f"m{i}", f"b{i}"))
    truth = table(spark, d, "labels").select("doc_id", *cells)
    rows = matching.truth_with_media(truth, media, "doc_id").withColumn("_list", T.list_literal(F.col("media_files"))).filter("_list IS NOT NULL")
    return matching.explode_slots(rows, "_list", slots, ["doc_id"])


@query("SELECT DISTINCT o_orderkey, p_type, o_orderstatus FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey WHERE p_type <> 'PROMO'")
def cocolike_distinct_targets(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").select("p_partkey", "p_type")
    items = table(spark, d, "lineitem").select("l_orderkey", "l_partkey").join(part, F.col("l_partkey") == F.col("p_partkey"))
    annotations = items.select(F.col("l_orderkey").alias("o_orderkey"), "p_type")
    categories = part.select("p_type").distinct().filter("p_type <> 'PROMO'")
    pairs = matching.image_targets(table(spark, d, "orders").select("o_orderkey"), annotations, categories, "o_orderkey", "p_type")
    return pairs.join(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey").select("o_orderkey", "p_type", "o_orderstatus")


@query("SELECT doc_id, lang AS language, n_chars FROM documents WHERE lang IN ('en', 'es')")
def language_union(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    parts = {x: docs.filter(F.col("lang") == x).drop("lang") for x in ("en", "es")}
    return matching.tagged_union(parts).select("doc_id", "language", "n_chars")


@query(
    """WITH s AS (SELECT doc_id, source FROM documents ORDER BY md5(doc_id || '|42'), doc_id LIMIT 40), w AS (SELECT doc_id, source FROM documents ORDER BY doc_id LIMIT 30)
SELECT doc_id, source FROM s UNION ALL SELECT doc_id, source FROM w WHERE doc_id NOT IN (SELECT doc_id FROM s)"""
)
def sample_topup(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source")
    return matching.top_up(sampling.seeded_sample(docs, "doc_id", 40).drop("sample_pos"), sampling.head(docs, "doc_id", 30), "doc_id")


@query("SELECT event_type, user_id, arg_max(value, event_id) AS value, max(event_id) AS event_id FROM events GROUP BY 1, 2")
def results_store_upsert(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("event_type", "user_id", "value", "event_id")
    old, new = rows.filter("event_id % 2 = 0"), rows.filter("event_id % 2 = 1")
    keys = ["event_type", "user_id"]
    # The log's halves, each folded into a store; the later entry of a key wins.
    both = stores.latest(old, keys, "event_id").unionByName(stores.latest(new, keys, "event_id"))
    return stores.latest(both, keys, "event_id").select("event_type", "user_id", "value", "event_id")


@query("SELECT user_id, count(DISTINCT event_type) AS models, max(CASE event_type WHEN 'click' THEN v END) AS click, max(CASE event_type WHEN 'view' THEN CAST(-1.0 AS DOUBLE) END) AS replaced FROM (SELECT user_id, event_type, max(value) AS v FROM events GROUP BY 1, 2) GROUP BY 1")
def comparison_upsert(spark: SparkSession, d: str) -> DataFrame:
    each = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.max("value").alias("v"))
    # A user has at most one entry for each of a few event types.
    maps = each.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "v"))).alias("p"))
    maps = maps.withColumn("p", F.when(F.map_contains_key("p", "view"), stores.upsert_predictions(F.col("p"), F.lit("view"), F.lit(-1.0))).otherwise(F.col("p")))
    return maps.select("user_id", F.size("p").cast("long").alias("models"), F.try_element_at("p", F.lit("click")).alias("click"), F.try_element_at("p", F.lit("view")).alias("replaced"))


@query("SELECT d.doc_id, quality, quality IS NULL AS missing FROM (SELECT doc_id FROM documents ORDER BY md5(doc_id || '|42'), doc_id LIMIT 80) d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def sample_join_results(spark: SparkSession, d: str) -> DataFrame:
    sample = sampling.seeded_sample(table(spark, d, "documents").select("doc_id"), "doc_id", 80).select("doc_id")
    results = table(spark, d, "labels").select("doc_id", "quality", F.lit(1).alias("seq"))
    results = results.unionByName(results.withColumn("quality", F.lit(-1).cast("int")).withColumn("seq", F.lit(0)))
    return matching.sample_with_results(sample, results, "doc_id", "seq").select("doc_id", "result.quality", "missing")


@query("SELECT doc_id || '.jpg' AS image_path, text AS caption, [lang, source] AS objects, 3 AS max_hops, true AS timed FROM documents")
def jsonl_artifact_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    path = scratch(spark, "artifact")
    records = docs.select(F.concat(F.col("doc_id").cast("string"), F.lit(".jpg")).alias("image_path"), F.col("text").alias("caption"), F.array("lang", "source").alias("objects"))
    stores.write_artifact(records, path, {"dataset": "documents", "model": "none", "max_hops": 3}, 1.5)
    header, images = stores.read_artifact(spark, path)
    return images.select("image_path", "caption", "objects", F.lit(header["max_hops"]).alias("max_hops"), F.lit(header["inference_time_seconds"] == 1.5).alias("timed"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 50 <> 7 THEN 'a picture of ' || p_name END AS response FROM part")
def annotator_bisect(spark: SparkSession, d: str) -> DataFrame:
    long = F.when(F.col("p_partkey") % 50 == 7, F.repeat(F.lit("x"), 5000)).otherwise(F.lit("what is this"))
    rows = table(spark, d, "part").select("p_partkey", F.col("p_name").alias("image_path"), long.alias("prompt"))
    return annotate.respond(rows, "rule", "prompt", "image_path", "response").select("p_partkey", "response")


@query(
    """WITH r AS (SELECT p_partkey, split_part(p_name, ' ', 2) AS w, p_partkey % 3 > 0 AS mapped, p_partkey % 3 = 1 AS mn FROM part)
SELECT p_partkey, CASE WHEN NOT mapped THEN CASE WHEN w = 'ring' THEN 'yes' ELSE 'no' END END AS nature, CASE WHEN NOT mapped THEN CASE WHEN w = 'ring' THEN 'material' ELSE 'none' END WHEN mn THEN 'material' END AS material,
  CASE WHEN NOT mapped OR mn THEN 'by rule' END AS reasoning, NOT mapped OR mn AS vlm_called, false AS parse_failed FROM r"""
)
def label_routing(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    objects = table(spark, d, "part").select("p_partkey", F.col("p_name").alias("image_path"), F.split_part("p_name", F.lit(" "), F.lit(2)).alias("object"), (k % 3 > 0).alias("mapped"), F.when(k % 3 > 0, k % 3 == 1).alias("map_nature"), F.lit(None).cast("boolean").alias("map_biotic"))
    return annotate.labelled_objects(objects).select("p_partkey", "label.nature", "label.material", "label.reasoning", "label.vlm_called", "label.parse_failed")


@query("SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns, 'a picture of ' || conv_id AS what, 'a picture of ' || conv_id AS why FROM conversations GROUP BY conv_id")
def question_grid(spark: SparkSession, d: str) -> DataFrame:
    images = table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("n_turns")).withColumn("image_path", F.col("conv_id").cast("string"))
    asked = annotate.questions(images, {"what": "What is it?", "why": "Why is it?"})
    return asked.select("conv_id", "n_turns", F.col("answers")["what"].alias("what"), F.col("answers")["why"].alias("why"))


@query(
    """SELECT CAST(row_number() OVER (ORDER BY min(p_partkey), p_type) - 1 AS INTEGER) AS cand_idx, arg_min(p_name, p_partkey) AS class_name, p_type AS node, p_type < 'M' AS gt_nature,
  CASE WHEN p_type < 'M' THEN p_type = 'LARGE' END AS gt_biotic FROM part WHERE p_type <> 'PROMO' GROUP BY p_type"""
)
def candidate_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    classes = part.select(F.col("p_type").alias("node"), F.col("p_name").alias("class_name"), "p_partkey")
    resolved = part.select(F.col("p_type").alias("node")).distinct().filter("node <> 'PROMO'")
    resolved = resolved.select("node", (F.col("node") < "M").alias("is_nature"), F.when(F.col("node") == "LARGE", "biotic").otherwise("abiotic").alias("life_category"))
    return readers.candidate_vocabulary(classes, resolved, "p_partkey")


@query("SELECT CAST(count(*) FILTER (WHERE quality = 0) AS BIGINT) AS n_true, round(avg(CAST(quality = 0 AS INT)), 9) AS rate, CAST(count(*) AS BIGINT) AS total FROM labels")
def parse_failure_rate(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.flag_rate(table(spark, d, "labels").select((F.col("quality") == 0).alias("f")), "f"))
