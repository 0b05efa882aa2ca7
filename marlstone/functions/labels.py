"""Three-valued label logic: a null is 'not applicable', never false."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The words of each axis, true then false.
AXES = {"nature": ("yes", "no"), "biotic": ("biotic", "abiotic"), "material": ("material", "immaterial")}


def binary_map(c: Column, positive: str, negative: str) -> Column:
    """True, false or null for a closed pair of words, whatever case and blanks."""
    word = F.lower(F.trim(c.cast("string")))
    return F.when(word == positive, F.lit(True)).when(word == negative, F.lit(False))


def label_to_bool(c: Column, axis: str) -> Column:
    """A model's word on an axis; null for any other word or an unknown axis."""
    return binary_map(c, *AXES[axis]) if axis in AXES else F.lit(None).cast("boolean")


def class_to_bool(c: Column) -> Column:
    """A classifier's class 0, 1 or 2: true, false, not applicable."""
    return F.when(c == 0, F.lit(True)).when(c == 1, F.lit(False))


def ground_truth(is_nature: Column, life: Column, tangibility: Column, blank_material: bool = True) -> Column:
    """struct(gt_nature, gt_biotic, gt_material) of a resolved node; the last
    two apply to nature alone, and blank tangibility counts as material."""
    material = F.coalesce(F.nullif(tangibility, F.lit("")) == "material", F.lit(blank_material))
    return F.struct(
        is_nature.alias("gt_nature"),
        F.when(is_nature, F.nullif(life, F.lit("")) == "biotic").alias("gt_biotic"),
        F.when(is_nature, material).alias("gt_material"),
    )


def hybrid_label(mapped: Column, map_nature: Column, map_biotic: Column, nature: Column, biotic: Column, material: Column) -> Column:
    """Final label and provenance of an object: nature and biotic from the
    taxonomy where it is mapped, else from the model; material always from the
    model; what isn't nature has neither."""
    final = F.when(mapped, map_nature).otherwise(nature)
    life = F.when(mapped, F.when(map_nature, map_biotic)).otherwise(biotic)
    source = F.when(mapped, F.lit("wordnet")).otherwise(F.lit("vlm"))
    return F.struct(
        final.alias("final_nature"),
        F.when(final, life).alias("final_biotic"),
        F.when(final, material).alias("final_material"),
        source.alias("nature_source"),
        source.alias("biotic_source"),
        F.lit("vlm").alias("material_source"),
    )


def empty_label(parse_failed: bool = False, vlm_called: bool = True) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(
        none.alias("reasoning"), none.alias("nature"), none.alias("biotic"), none.alias("material"),
        F.lit(parse_failed).alias("parse_failed"), F.lit(vlm_called).alias("vlm_called"),
    )


def penalised(truth: Column, prediction: Column) -> Column:
    """A missing prediction counts as the wrong one, where there is a truth."""
    return F.when(truth.isNotNull(), F.coalesce(prediction, ~truth))
