"""Queries of readers and stores: tables are written as files, then read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.functions.labels import ground_truth
from marlstone.operators import graph, inference, matching, metrics
from marlstone.plans.registry import query
from marlstone.plans.runs import _HOLISTIC, _noun
from marlstone.plans.scoring import _confusion_sql, rounded
from marlstone.plans.taxonomy import _labels, _n
from marlstone.schemas import TARGETS
from marlstone.session import scratch, table
from marlstone.sources import readers, stores


def _csv(rows: DataFrame, label: str, header: bool = True) -> str:
    path = scratch(rows.sparkSession, label)
    rows.write.csv(path, header=header, escape='"')
    return path


@query(
    """WITH a AS (SELECT n_nationkey AS k, CASE WHEN n_nationkey % 3 = 2 THEN 'r' || n_regionkey || '.n.01' ELSE lower(n_name) || '.n.' || n_nationkey END AS node,
  CASE n_nationkey % 4 WHEN 0 THEN 'biotic' WHEN 1 THEN 'abiotic' END AS life, CASE n_nationkey % 5 WHEN 0 THEN 'material' WHEN 1 THEN 'immaterial' END AS tang FROM nation)
SELECT node, arg_max(tang IS NOT NULL, k) AS is_nature, arg_max(life, k) FILTER (WHERE life IS NOT NULL) AS life_category, arg_max(tang, k) FILTER (WHERE tang IS NOT NULL) AS tangibility FROM a GROUP BY node"""
)
def annotation_sheet(spark: SparkSession, d: str) -> DataFrame:
    """A sheet of hierarchy columns; the deepest filled cell names the node."""
    k = F.col("n_nationkey")
    deep = F.when(k % 3 != 2, F.concat(F.lit("in "), F.translate(F.lower("n_name"), " ", "_"), F.lit("."), F.lit("n."), k.cast("string")))
    sheet = table(spark, d, "nation").select(
        k.alias("row"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string"), F.lit(".n.01")).alias("level 1"), deep.alias("level 2"),
        F.when(k % 4 == 0, "Biotic").when(k % 4 == 1, " abiotic").alias("Biotic/abiotic"), F.when(k % 5 == 0, "material").when(k % 5 == 1, "Immaterial").alias("Material/immaterial"),
    )
    rows = readers.read_annotations(spark, _csv(sheet, "sheet"), "Biotic/abiotic", "Material/immaterial")
    return graph.annotations(rows, "node", "life", "tangibility", "row")


@query(
    """WITH s AS (SELECT n_nationkey AS k, lower(n_name) || '/' || n_regionkey AS name FROM nation WHERE n_nationkey % 6 <> 5)
SELECT CAST(k AS INTEGER) AS scene_id, name, CASE WHEN k % 2 = 0 THEN split_part(name, '/', 1) || '.n.01' END AS node FROM s"""
)
def scene_files(spark: SparkSession, d: str) -> DataFrame:
    """A list of scenes with its ids checked, names to leave out, and allowed nodes."""
    k = F.col("n_nationkey")
    name = F.concat(F.lower("n_name"), F.lit("/"), F.col("n_regionkey").cast("string"))
    nation = table(spark, d, "nation")
    lines = scratch(spark, "scenes")
    nation.select(F.concat(F.lit("/x/"), name, F.lit(" "), k.cast("string"))).write.text(lines)
    missing = _csv(nation.filter(k % 6 == 5).select(name), "missing", header=False)
    word = F.lower("n_name")
    keys = _csv(nation.select(F.concat(word, F.lit(".n.01 1/2")).alias("synset"), F.when(k % 2 == 0, "MIT, other").otherwise("other").alias("source")), "keys")
    excluded, allowed = readers.read_scene_keys(spark, missing, keys)
    senses = nation.select(word.alias("word"), F.lit(1).alias("rank"), F.concat(word, F.lit(".n.01")).alias("node"))
    scenes = readers.load_dataset(spark, "scenes", path=lines, expected=25)
    return matching.scenes_to_nodes(scenes, senses, allowed, excluded).select("scene_id", "name", "node")


@query("SELECT p_type AS class_dir, CAST(count(*) AS BIGINT) AS rows_, p_type < 'M' AS is_nature FROM part WHERE p_type <> 'PROMO' GROUP BY p_type")
def image_folder(spark: SparkSession, d: str) -> DataFrame:
    """Files below a folder a class; a class without a mapping is left out."""
    root = scratch(spark, "folder")
    part = table(spark, d, "part")
    part.select(F.col("p_type").alias("class"), F.col("p_partkey").cast("string")).repartition("class").write.partitionBy("class").text(root)
    classes = part.select("p_type").distinct().filter("p_type <> 'PROMO'").select(F.concat(F.lit("class="), "p_type").alias("class_dir"), F.col("p_type").alias("name"))
    files = readers.folder_targets(readers.load_dataset(spark, "folder", root=root), classes).select("class_dir", "name").distinct()
    rows = part.groupBy("p_type").agg(F.count("*").alias("rows_"))
    return files.join(rows, F.col("name") == F.col("p_type")).select(F.col("name").alias("class_dir"), "rows_", (F.col("name") < "M").alias("is_nature"))


@query(
    """SELECT CAST(n_nationkey AS BIGINT) AS image_id, n_name || '.jpg' AS file_name, r_name AS name, 'r' || r_regionkey AS node, true AS gt_nature, false AS gt_biotic, true AS gt_material
FROM nation JOIN region ON r_regionkey = n_regionkey OR r_regionkey = n_nationkey % 5 WHERE r_regionkey % 3 = 1"""
)
def instance_file(spark: SparkSession, d: str) -> DataFrame:
    """Images, annotations and categories of one file, as targets with their truth."""
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    # An instances file is one object: of 25 nations.
    images = nation.agg(F.collect_list(F.struct(F.col("n_nationkey").alias("id"), F.concat("n_name", F.lit(".jpg")).alias("file_name"))).alias("images"))
    both = F.explode(F.array("n_regionkey", F.col("n_nationkey") % 5, "n_regionkey"))
    annotations = nation.select(F.col("n_nationkey").alias("image_id"), both.alias("category_id")).agg(F.collect_list(F.struct("image_id", "category_id")).alias("annotations"))
    found = region.agg(F.collect_list(F.struct(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"))).alias("categories"))
    path = scratch(spark, "instances")
    parts = images.unionByName(annotations, allowMissingColumns=True).unionByName(found, allowMissingColumns=True)
    parts.agg(*[F.max(c).alias(c) for c in parts.columns]).write.json(path)
    nodes = region.select(F.col("r_regionkey").alias("category_id"), _n("r", "r_regionkey").alias("node"))
    labels = _labels(spark, d).withColumn("life_category", F.coalesce("life_category", F.lit("abiotic")))
    return readers.load_dataset(spark, "instances", path=path, nodes=nodes, resolved=labels)


@query(
    """WITH k AS (SELECT lower(n_name) AS key, 'n' || n_nationkey AS node, n_nationkey AS seq FROM nation WHERE n_nationkey % 4 > 0 UNION ALL SELECT CAST(n_nationkey AS VARCHAR), 'n' || n_nationkey, n_nationkey FROM nation WHERE n_nationkey % 4 > 0)
SELECT s_suppkey, node FROM supplier LEFT JOIN k ON key = CAST(s_nationkey AS VARCHAR)"""
)
def mapping_file(spark: SparkSession, d: str) -> DataFrame:
    """Names and ids to nodes by a CSV; blank nodes map nothing."""
    k = F.col("n_nationkey")
    sheet = table(spark, d, "nation").select(F.lower("n_name").alias("Places_Name"), k.cast("string").alias("places_id"), F.when(k % 4 > 0, F.concat(F.lit(" n"), k.cast("string"))).alias("WordNet synset"))
    mapping = readers.read_mapping(spark, _csv(sheet, "mapping"))
    rows = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").cast("string").alias("ident"))
    return matching.explicit_mapping(rows, mapping, F.lit("no such name"), F.col("ident")).select("s_suppkey", "node")


@query(
    """WITH s AS (SELECT doc_id, unnest(range(4)) AS slot FROM labels), r AS (
  SELECT doc_id, slot, doc_id || '_' || slot || '.jpg' AS file, (doc_id + slot) % 3 AS n, CASE WHEN (doc_id + slot) % 4 < 2 THEN (doc_id + slot) % 4 = 0 END AS m, CASE WHEN (doc_id + slot) % 5 < 2 THEN (doc_id + slot) % 5 = 0 END AS b FROM s WHERE slot <= doc_id % 5
) SELECT CAST(doc_id AS VARCHAR) AS platform_id, CAST(slot AS INTEGER) AS slot, file, n = 0 AS gt_nature, CASE WHEN n = 0 THEN m END AS gt_material, CASE WHEN n = 0 THEN b END AS gt_biotic, n = 1 AND (m IS NOT NULL OR b IS NOT NULL) AS repaired FROM r WHERE n < 2"""
)
def post_files(spark: SparkSession, d: str) -> DataFrame:
    """Posts and their media from two CSVs, a row a slot."""
    k = F.col("doc_id")
    cells = []
    for i, (nature, material, biotic) in enumerate(readers.SLOTS):
        v = k + i
        cells += [F.when(v % 3 == 0, "Yes").when(v % 3 == 1, "No").alias(nature), F.when(v % 4 == 0, "material").when(v % 4 == 1, "immaterial").alias(material), F.when(v % 5 == 0, "biotic").when(v % 5 == 1, "abiotic").alias(biotic)]
    labels = table(spark, d, "labels")
    names = F.transform(F.sequence(F.lit(0), (k % 5).cast("int")), lambda i: F.concat(F.lit("'"), k.cast("string"), F.lit("_"), i.cast("string"), F.lit(".jpg'")))
    truth = _csv(labels.select(k.alias("platform_id"), *cells), "truth")
    media = _csv(labels.select(k.alias("platform_id"), F.concat(F.lit("["), F.array_join(names, ", "), F.lit("]")).alias("media_files")), "media")
    return readers.load_dataset(spark, "posts", truth=truth, media=media)


@query("SELECT r_regionkey, 'data:image/png;base64,' || to_base64(encode(r_name || chr(10))) AS data_url, r_name || chr(10) AS whole FROM region")
def image_bytes(spark: SparkSession, d: str) -> DataFrame:
    """Bytes of files as data URLs, and a file's text as a whole."""
    root = scratch(spark, "bytes")
    region = table(spark, d, "region")
    region.select("r_regionkey", "r_name").repartition("r_regionkey").write.partitionBy("r_regionkey").text(root)
    files = readers.read_images(spark, root)
    key = F.regexp_extract("image_path", r"r_regionkey=(\d+)", 1).cast("int")
    text = spark.read.text(root, wholetext=True).select("r_regionkey", F.col("value").alias("whole"))
    # Files of text have no image's suffix; what is after it is compared.
    urls = files.select(key.alias("r_regionkey"), F.concat(F.lit("data:image/png;base64,"), F.split_part("data_url", F.lit(";base64,"), F.lit(2))).alias("data_url"))
    return urls.join(text, "r_regionkey")


@query("SELECT r_regionkey, r_name || chr(10) AS definition FROM region WHERE r_regionkey = 2")
def definition_file(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "definition")
    one = table(spark, d, "region").filter("r_regionkey = 2")
    one.select("r_name").coalesce(1).write.text(path)
    return one.select("r_regionkey", F.lit(readers.read_text(spark, path)).alias("definition"))


@query("SELECT event_type AS dataset, 'm' || (user_id % 10) AS model, CAST(count(*) AS BIGINT) AS support, CAST(max(event_id) AS BIGINT) AS last, user_id % 10 < 4 AS replaced FROM events WHERE event_id % 2 = CASE WHEN user_id % 10 < 4 THEN 1 ELSE 0 END GROUP BY 1, 2, 5")
def results_store_overwrite(spark: SparkSession, d: str) -> DataFrame:
    """A store whose keys a later run replaces; all others stay."""
    path = scratch(spark, "results")
    rows = table(spark, d, "events").select(F.col("event_type").alias("dataset"), F.concat(F.lit("m"), (F.col("user_id") % 10).cast("string")).alias("model"), "event_id", (F.col("user_id") % 10 < 4).alias("replaced"))
    old = rows.filter("event_id % 2 = 0").withColumn("replaced", F.lit(False))
    new = rows.filter("event_id % 2 = 1 AND replaced")
    for run in (old, new):
        stores.save_results(run.groupBy("dataset", "model", "replaced").agg(F.count("*").alias("support"), F.max("event_id").alias("last")), path)
    return spark.read.parquet(path).filter("evaluated_at IS NOT NULL").select("dataset", "model", "support", "last", "replaced")


@query("SELECT event_type, user_id, CAST(max(event_id) AS BIGINT) AS event_id, CAST(CASE WHEN user_id % 10 < 4 THEN 1 END AS INTEGER) AS run FROM events WHERE event_id % 2 = CASE WHEN user_id % 10 < 4 THEN 1 ELSE 0 END GROUP BY 1, 2")
def results_upsert_by_key(spark: SparkSession, d: str) -> DataFrame:
    """New rows in place of the store's with the same keys; new columns are null before."""
    rows = table(spark, d, "events").groupBy("event_type", "user_id", (F.col("event_id") % 2).alias("half")).agg(F.max("event_id").alias("event_id"))
    later = F.col("user_id") % 10 < 4
    # A key that the later run has nothing of is gone from both.
    store = rows.filter((F.col("half") == 0) & ~later).drop("half").unionByName(rows.filter((F.col("half") == 1) & later).drop("half").withColumn("event_id", F.lit(-1).cast("long")))
    return stores.upsert(store, rows.filter((F.col("half") == 1) & later).drop("half").withColumn("run", F.lit(1)), ["event_type", "user_id"])


@query(
    """WITH s AS (SELECT quality, CASE WHEN doc_id % 2 = 0 THEN '50' ELSE 'full' END AS config FROM labels)
SELECT 'labels' AS dataset, config AS config_key, CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (WHERE quality = 1) AS BIGINT) AS nature FROM s GROUP BY config"""
)
def class_stats_store(spark: SparkSession, d: str) -> DataFrame:
    """Class statistics of a data set, replaced by configuration."""
    path = scratch(spark, "stats")
    labels = table(spark, d, "labels").withColumn("config_key", T.config_key(F.when(F.col("doc_id") % 2 == 0, 50)))
    stats = labels.groupBy("config_key").agg(F.count("*").alias("total"), F.count_if(F.col("quality") == 1).alias("nature")).withColumn("dataset", F.lit("labels"))
    stores.save_results(stats.withColumn("total", F.lit(-1).cast("long")), path, ["dataset", "config_key"])
    for key in ("50", "full"):
        stores.save_results(stats.filter(F.col("config_key") == key), path, ["dataset", "config_key"])
    return spark.read.schema("total long, nature long, dataset string, config_key string").parquet(path).select("dataset", "config_key", "total", "nature")


@query("SELECT CAST(doc_id AS VARCHAR) AS doc_id, text, '[\"' || lang || '\",\"' || source || '\"]' AS tags, '{\"n\":' || n_chars || ',\"none\":null}' AS final FROM documents")
def prediction_file(spark: SparkSession, d: str) -> DataFrame:
    """Predictions as CSV, nested columns as JSON, quotes and line ends kept."""
    path = stores.prediction_path(scratch(spark, "predictions"), "documents", "a/b")
    docs = table(spark, d, "documents")
    stores.write_predictions(docs.select("doc_id", "text", F.array("lang", "source").alias("tags"), F.struct(F.col("n_chars").alias("n"), F.lit(None).cast("string").alias("none")).alias("final")), path)
    return spark.read.csv(path, header=True, escape='"', multiLine=True, inferSchema=False)


@query(
    """WITH r AS (SELECT count(*) AS total, count(*) FILTER (WHERE n_nationkey % 3 = 0) AS nature FROM nation)
SELECT unnest(['nations', '  total: ' || total, '  nature: ' || nature, 'again', '  total: ' || total, '  nature: ' || nature]) AS line FROM r"""
)
def report_file(spark: SparkSession, d: str) -> DataFrame:
    """Reports one after the other in one text; an older one is gone."""
    path = scratch(spark, "report")
    n = F.col("n_nationkey")
    stats = metrics.class_coverage(table(spark, d, "nation").select((n % 3 == 0).alias("is_nature"), F.lit(None).cast("string").alias("life_category"), F.lit(None).cast("string").alias("tangibility"))).select("total", "nature")
    for titles in (["old"], ["nations", "again"]):
        stores.write_report([metrics.coverage_report(stats, title) for title in titles], path)
    return spark.read.text(path).withColumnRenamed("value", "line")


@query("SELECT doc_id, CAST(1 AS INTEGER) AS made FROM documents WHERE lang = 'en'")
def saved_sample(spark: SparkSession, d: str) -> DataFrame:
    """What was saved first is read again; nothing is made anew."""
    path = scratch(spark, "saved")
    docs = table(spark, d, "documents").filter("lang = 'en'").select("doc_id")
    out = None
    for made in (1, 2):
        out = stores.load_or_create(spark, path, lambda made=made: docs.withColumn("made", F.lit(made)))
    return out


@query(_HOLISTIC + _confusion_sql("pairs", "axis"))
def artifact_run_scores(spark: SparkSession, d: str) -> DataFrame:
    """Both parts of a run through its artifact: annotate and write; read and score."""
    k = F.col("p_partkey")
    nature = F.when(k % 7 != 0, k % 3 != 0)
    target = F.struct(_noun().alias("class_name"), F.lit("").alias("synset_id"), nature.alias("gt_nature"), F.when(nature, k % 2 == 0).alias("gt_biotic"), F.when(nature, F.lit(True)).alias("gt_material"))
    part = table(spark, d, "part")
    images = part.select(F.concat("p_name", F.lit(" x"), k.cast("string")).alias("image_path"), F.array(target).cast(TARGETS).alias("targets"))
    nouns = part.select(_noun().alias("lemma")).distinct().filter("lemma <> 'bolt'").withColumn("node", F.concat(F.lit("w_"), "lemma"))
    resolved = nouns.select("node", F.col("lemma").isin("ring", "widget").alias("is_nature"), F.when(F.col("lemma") == "ring", "biotic").alias("life_category"))
    path, out = scratch(spark, "artifact"), scratch(spark, "predictions")
    inference.annotate_to(path, images, nouns, resolved, {"dataset": "part", "max_hops": 3})
    header, scores = inference.score_from(spark, path, spark.createDataFrame([], "node string, lemma string"), out)
    matching.require_none(spark.read.csv(f"{out}/part_{header['model']}", header=True, escape='"').filter("image_path IS NULL OR final IS NULL"), "predictions")
    return rounded(scores)


@query("SELECT s_suppkey, true AS gt_nature, false AS gt_biotic, s_suppkey % 2 = 0 AS gt_material FROM supplier")
def truth_of_nodes(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 2 == 0, "material").otherwise("immaterial").alias("t"))
    return rows.select("s_suppkey", ground_truth(F.lit(True), F.lit("abiotic"), F.col("t")).alias("g")).select("s_suppkey", "g.*")
