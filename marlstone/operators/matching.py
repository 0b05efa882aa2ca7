"""Joins between phrases, names, slots and label tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.labels import AXES, binary_map
from marlstone.functions.text import head_noun, normalize_object


def objects_to_nodes(objects: DataFrame, vocabulary: DataFrame, resolved: DataFrame, phrase: str = "object") -> DataFrame:
    """Objects with node, mapped, map_nature and map_biotic: the phrase's node
    in the vocabulary and that node's resolved label; biotic is null unless the
    node is nature and says so."""
    words = vocabulary.select(F.col("lemma").alias("_lemma"), F.col("node").alias("mapped_node"))
    labels = resolved.select(F.col("node").alias("mapped_node"), F.col("is_nature").alias("map_nature"), F.nullif("life_category", F.lit("")).alias("_life"))
    met = objects.join(words, normalize_object(F.col(phrase)) == F.col("_lemma"), "left").join(labels, "mapped_node", "left")
    biotic = F.when(F.col("map_nature"), F.col("_life") == "biotic")
    mapped = F.col("map_nature").isNotNull()
    return met.select(*objects.columns, F.when(mapped, F.col("mapped_node")).alias("mapped_node"), mapped.alias("mapped"), "map_nature", biotic.alias("map_biotic"))


def match_objects(objects: DataFrame, terms: DataFrame, image: str = "image_id", target: str = "target_id") -> DataFrame:
    """image, target, obj_idx: the first object whose whole phrase, or whose
    last word, is one of the target's terms. objects(image, obj_idx, object);
    terms(image, target, term)."""
    norm = normalize_object(F.col("object"))
    keys = F.array_distinct(F.array_compact(F.array(norm, head_noun(norm))))
    return objects.select(image, "obj_idx", F.explode(keys).alias("term")).join(terms.select(image, target, "term").distinct(), [image, "term"]).groupBy(image, target).agg(F.min("obj_idx").alias("obj_idx"))


def target_terms(targets: DataFrame, lemmas: DataFrame, image: str = "image_id", target: str = "target_id") -> DataFrame:
    """A target's terms: its class name and its node's lemmas, normalised."""
    own = targets.select(image, target, normalize_object(F.col("class_name")).alias("term"))
    of = targets.join(lemmas, "node").select(image, target, normalize_object(F.col("lemma")).alias("term"))
    return own.unionByName(of).filter("term <> ''").distinct()


def scene_candidates(name: Column) -> Column:
    """Words to look a scene name up by, best first: all parts joined, the part
    before the slash, the part after it."""
    head, tail = F.substring_index(name, "/", 1), F.substring_index(name, "/", -1)
    return F.array_distinct(F.array_compact(F.array(F.translate(name, "/", "_"), head, F.when(name.contains("/"), tail))))


def scenes_to_nodes(scenes: DataFrame, senses: DataFrame, allowed: DataFrame, excluded: DataFrame | None = None, name: str = "name") -> DataFrame:
    """Scenes with the node of the first sense of the first candidate word that
    is allowed; excluded names are left out, unresolved ones have null."""
    own = scenes if excluded is None else scenes.join(excluded.select(name).distinct(), name, "left_anti")
    words = own.select(F.col(name).alias("_n")).distinct().select("_n", F.posexplode(scene_candidates(F.col("_n"))).alias("prio", "word"))
    found = words.join(senses, "word").join(allowed.select("node").distinct(), "node", "left_semi")
    best = found.groupBy("_n").agg(F.min_by("node", F.struct("prio", "rank")).alias("node"))
    return own.join(best, F.col(name) == F.col("_n"), "left").drop("_n")


def explicit_mapping(rows: DataFrame, mapping: DataFrame, name: Column, ident: Column) -> DataFrame:
    """Rows with the node that a mapping (key, node) gives their name, else their id."""
    by_name = mapping.select(F.col("key").alias("_k1"), F.col("node").alias("_n1"))
    by_id = mapping.select(F.col("key").alias("_k2"), F.col("node").alias("_n2"))
    met = rows.join(by_name, name == F.col("_k1"), "left").join(by_id, ident.cast("string") == F.col("_k2"), "left")
    return met.select(*rows.columns, F.coalesce("_n1", "_n2").alias("node"))


def truth_and_prediction(rows: DataFrame, labels: DataFrame, truth: str, prediction: str, key: str, value: str) -> DataFrame:
    """Both classes' labels: rows without a labelled truth are left out, an
    unlabelled prediction is null."""
    gt = labels.select(F.col(key).alias(truth), F.col(value).alias("gt"))
    pred = labels.select(F.col(key).alias(prediction), F.col(value).alias("pred"))
    return rows.join(gt, truth).join(pred, prediction, "left")


def truth_with_media(truth: DataFrame, media: DataFrame, key: str) -> DataFrame:
    """Inner join on a key; columns that both have get the suffixes _x and _y."""
    both = (set(truth.columns) & set(media.columns)) - {key}
    left = truth.select([F.col(c).alias(f"{c}_x") if c in both else F.col(c) for c in truth.columns])
    right = media.select([F.col(c).alias(f"{c}_y") if c in both else F.col(c) for c in media.columns])
    return left.join(right, key)


def explode_slots(rows: DataFrame, files: str, slots: list[tuple[str, str, str]], keep: list[str]) -> DataFrame:
    """A row per slot that has a file and a yes or no for nature: keep columns,
    slot, file, gt_nature, gt_material, gt_biotic and repaired.

    ``slots`` names each slot's nature, material and biotic columns. What isn't
    nature has neither sub-label; ``repaired`` says that it had one."""
    cells = F.array(*[F.struct(binary_map(F.col(n), *AXES["nature"]).alias("n"), binary_map(F.col(m), *AXES["material"]).alias("m"), binary_map(F.col(b), *AXES["biotic"]).alias("b")) for n, m, b in slots])
    out = rows.select(*keep, F.col(files).alias("_files"), F.posexplode(cells).alias("slot", "_c"))
    out = out.withColumn("file", F.get("_files", F.col("slot"))).filter(F.col("file").isNotNull() & F.col("_c.n").isNotNull())
    n, m, b = F.col("_c.n"), F.col("_c.m"), F.col("_c.b")
    return out.select(*keep, "slot", "file", n.alias("gt_nature"), F.when(n, m).alias("gt_material"), F.when(n, b).alias("gt_biotic"), (~n & (m.isNotNull() | b.isNotNull())).alias("repaired"))


def image_targets(images: DataFrame, annotations: DataFrame, categories: DataFrame, image: str = "image_id", category: str = "category_id") -> DataFrame:
    """Distinct categories of each image; images without any are left out."""
    pairs = annotations.select(image, category).distinct().join(images.select(image), image)
    return pairs.join(categories, category)


def top_up(sample: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The sample and the wanted rows that it lacks."""
    return sample.unionByName(wanted.join(sample.select(key), key, "left_anti"))


def sample_with_results(sample: DataFrame, results: DataFrame, key: str, seq: str) -> DataFrame:
    """Each sample row with its last result; none gives nulls and ``missing``."""
    last = results.groupBy(F.col(key).alias("_k")).agg(F.max_by(F.struct(*[c for c in results.columns if c != key]), seq).alias("result"))
    met = sample.join(last, F.col(key) == F.col("_k"), "left").drop("_k")
    return met.withColumn("missing", F.col("result").isNull())


def tagged_union(parts: dict[str, DataFrame], tag: str = "language") -> DataFrame:
    """All rows of all parts, tagged with their part's name."""
    out = None
    for name, part in parts.items():
        one = part.withColumn(tag, F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def unknown_ids(rows: DataFrame, key: str, expected: DataFrame) -> DataFrame:
    """Ids of the rows that aren't expected and expected ones that no row has."""
    have, want = rows.select(key).distinct(), expected.select(key).distinct()
    extra = have.join(want, key, "left_anti").withColumn("problem", F.lit("unknown"))
    return extra.unionByName(want.join(have, key, "left_anti").withColumn("problem", F.lit("missing")))


def require_none(rows: DataFrame, what: str) -> None:
    """Fail if there is any row; names a few."""
    if some := rows.take(5):
        raise ValueError(f"{what}: {[r.asDict() for r in some]}")
