"""Readers: files of every kind the engine takes, as typed tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.functions.labels import AXES, ground_truth
from marlstone.operators import graph, matching


def read_sheet(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """A sheet exported as CSV; all cells are text, blank ones null."""
    return spark.read.csv(path, header=header, inferSchema=False, multiLine=True, escape='"', nullValue="")


def read_annotations(spark: SparkSession, path: str, life: str, tangibility: str, seq: str = "row") -> DataFrame:
    """row, node, life, tangibility of a taxonomy sheet; all other columns are
    levels of the hierarchy, in order. CSV keeps the rows' order in one file."""
    sheet = read_sheet(spark, path)
    levels = [F.col(f"`{c}`") for c in sheet.columns if c not in (life, tangibility, seq)]
    number = F.col(seq).cast("long") if seq in sheet.columns else F.monotonically_increasing_id()
    return sheet.select(number.alias("row"), graph.node_in_row(levels).alias("node"), F.col(f"`{life}`").alias("life"), F.col(f"`{tangibility}`").alias("tangibility"))


def read_scene_keys(spark: SparkSession, missing: str, keys: str, source: str = "MIT") -> tuple[DataFrame, DataFrame]:
    """Names to leave out, and the nodes whose source has the given tag."""
    out = read_sheet(spark, missing, header=False)
    excluded = out.select(T.strip(F.col(out.columns[0])).alias("name")).filter("name IS NOT NULL").distinct()
    sheet = read_sheet(spark, keys)
    node, tag = sheet.columns[:2]
    allowed = sheet.filter(F.col(f"`{tag}`").contains(source)).select(F.split(T.strip(F.col(f"`{node}`")), " ")[0].alias("node"))
    return excluded, allowed.filter("node IS NOT NULL AND node <> ''").distinct()


def read_image_folder(spark: SparkSession, root: str) -> DataFrame:
    """image_path and class_dir of every file below ``root``; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select(F.col("path").alias("image_path"), F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("class_dir"))


def folder_targets(files: DataFrame, classes: DataFrame) -> DataFrame:
    """Files with their folder's class; unmapped classes are left out."""
    return files.join(classes, "class_dir")


def read_instances(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """images, annotations and categories of an instances file."""
    schema = "images array<struct<id:long,file_name:string>>, annotations array<struct<image_id:long,category_id:int>>, categories array<struct<id:int,name:string>>"
    whole = spark.read.schema(schema).json(path, multiLine=True)
    images = whole.select(F.explode("images").alias("i")).select(F.col("i.id").alias("image_id"), "i.file_name")
    return images, whole.select(F.explode("annotations").alias("a")).select("a.*"), read_categories(spark, path)


def instance_targets(spark: SparkSession, path: str, nodes: DataFrame, resolved: DataFrame) -> DataFrame:
    """image_id, file_name, name, node and the truth of each labelled category on
    an image of an instances file; ``nodes`` has category_id and node."""
    images, annotations, found = read_instances(spark, path)
    pairs = matching.image_targets(images, annotations, found.join(nodes.select("category_id", "node"), "category_id"))
    met = graph.mapped_classes(pairs.join(images, "image_id"), resolved, "node")
    truth = ground_truth(F.col("is_nature"), F.col("life_category"), F.col("tangibility"))
    return met.select("image_id", "file_name", "name", "node", truth.alias("g")).select("image_id", "file_name", "name", "node", "g.*")


def read_categories(spark: SparkSession, path: str) -> DataFrame:
    whole = spark.read.schema("categories array<struct<id:int,name:string>>").json(path, multiLine=True)
    matching.require_none(whole.filter("categories IS NULL"), f"no categories in {path}")
    return whole.select(F.explode("categories").alias("c")).select(F.col("c.id").alias("category_id"), "c.name")


def read_scenes(spark: SparkSession, path: str, expected: int | None = None) -> DataFrame:
    """scene_id and name; with ``expected`` the ids must be 0 to expected - 1 and
    every line well formed, else malformed lines are left out."""
    lines = spark.read.text(path).filter("trim(value) <> ''").select(T.scene_line(F.col("value")).alias("s"), "value")
    if expected is not None:
        matching.require_none(lines.filter("s.name IS NULL OR s.scene_id IS NULL").select("value"), "malformed lines")
        ids = spark.range(expected).select(F.col("id").cast("int").alias("scene_id"))
        matching.require_none(matching.unknown_ids(lines.select("s.scene_id"), "scene_id", ids), "scene ids")
    return lines.filter("s.name IS NOT NULL AND s.scene_id IS NOT NULL").select("s.*")


#: Slots of a post and the columns of each.
SLOTS = [(f"nature_visual_{i}", f"nep_materiality_visual_{i}", f"nep_biological_visual_{i}") for i in range(4)]


def read_posts(spark: SparkSession, truth: str, media: str, key: str = "platform_id", files: str = "media_files") -> DataFrame:
    """A row per media slot of two CSVs joined on their key."""
    posts = matching.truth_with_media(read_sheet(spark, truth), read_sheet(spark, media), key)
    rows = posts.withColumn("_list", T.list_literal(F.col(files))).filter("_list IS NOT NULL")
    return matching.explode_slots(rows, "_list", SLOTS, [key])


def read_mapping(spark: SparkSession, path: str) -> DataFrame:
    """key -> node of a CSV: the node column is the first whose name has synset,
    wordnet or wnid, else the last; every other column gives keys; of repeated
    keys the last row's wins."""
    sheet = read_sheet(spark, path)
    names = [c.strip().lower() for c in sheet.columns]
    sheet = sheet.toDF(*names)
    node = next((c for c in names if any(w in c for w in ("synset", "wordnet", "wnid"))), names[-1])
    keys = F.explode(F.array(*[T.strip(F.col(f"`{c}`")) for c in names if c != node]))
    rows = sheet.withColumn("_row", F.monotonically_increasing_id()).select("_row", keys.alias("key"), T.strip(F.col(f"`{node}`")).alias("node"))
    real = rows.filter(F.col("key").isNotNull() & F.col("node").isNotNull() & ~F.lower("key").isin("", "nan") & ~F.lower("node").isin("", "nan"))
    return real.groupBy("key").agg(F.max_by("node", "_row").alias("node"))


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first().value


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """image_path and data_url."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path").alias("image_path"), T.data_url(F.col("path"), F.col("content")).alias("data_url"))


def readable(rows: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """Rows whose file is there; the others are left out."""
    return rows.join(files.select(key).distinct(), key, "left_semi")


_DATASETS: dict[str, Callable[..., DataFrame]] = {"folder": read_image_folder, "instances": instance_targets, "posts": read_posts, "scenes": read_scenes}


def register_dataset(name: str, reader: Callable[..., DataFrame]) -> None:
    _DATASETS[name] = reader


def load_dataset(spark: SparkSession, name: str, **options) -> DataFrame:
    if name not in _DATASETS:
        raise ValueError(f"unknown dataset {name!r}; known: {sorted(_DATASETS)}")
    return _DATASETS[name](spark, **options)


def candidate_vocabulary(classes: DataFrame, resolved: DataFrame, order: str) -> DataFrame:
    """cand_idx, class_name, node, gt_nature, gt_biotic: distinct mapped nodes in
    the order of their first class. A closed vocabulary, small by nature."""
    from pyspark.sql import Window

    first = classes.groupBy("node").agg(F.min_by("class_name", order).alias("class_name"), F.min(order).alias("_o"))
    labels = resolved.select("node", F.col("is_nature").alias("gt_nature"), F.when(F.col("is_nature"), F.nullif("life_category", F.lit("")) == AXES["biotic"][0]).alias("gt_biotic"))
    met = first.join(labels, "node")
    return met.withColumn("cand_idx", F.row_number().over(Window.orderBy("_o", "node")) - 1).select("cand_idx", "class_name", "node", "gt_nature", "gt_biotic")


def index_to_node(logits: DataFrame, names: DataFrame, index: str = "class_index") -> DataFrame:
    """Rows with the node of their class index, by a table (class_index, node)."""
    return logits.join(names.select(F.col("class_index").alias(index), "node"), index, "left")
