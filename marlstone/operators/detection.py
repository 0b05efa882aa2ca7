"""Multi-label detections: a long table (image, category, truth, score)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.operators.metrics import confusion_metrics


def detected(rows: DataFrame, score: str, threshold: float) -> DataFrame:
    return rows.withColumn("present", F.col(score) >= threshold)


def project_detections(rows: DataFrame, image: str, name: str = "name") -> DataFrame:
    """Per image from its detections (present, is_nature, is_biotic,
    is_material): nature if any nature class is on; a sub-label is true if a
    class of it is on, else false for nature and null otherwise; no_match if
    nothing is on; names of what is on, in order of category."""
    on = F.coalesce(F.col("present"), F.lit(False))
    flags = rows.groupBy(image).agg(
        F.coalesce(F.bool_or(on & F.col("is_nature")), F.lit(False)).alias("n"),
        F.coalesce(F.bool_or(on & F.col("is_biotic")), F.lit(False)).alias("b"),
        F.coalesce(F.bool_or(on & F.col("is_material")), F.lit(False)).alias("m"),
        F.sort_array(F.collect_set(F.when(on, F.struct("category_id", name)))).alias("on"),
    )

    def sub(c: str):
        return F.when(F.col(c), F.lit(True)).when(F.col("n"), F.lit(False))

    names = F.transform("on", lambda x: x[name])
    return flags.select(image, F.col("n").alias("pred_nature"), sub("b").alias("pred_biotic"), sub("m").alias("pred_material"), (F.size("on") == 0).alias("no_match"), F.array_join(names, ", ").alias("raw_prediction"))


def flat_metrics(rows: DataFrame, axis: str, truth: str = "y_true", prediction: str = "present") -> DataFrame:
    """Presence against presence over all pairs whose class is labelled."""
    t, p = F.coalesce(F.col(truth), F.lit(False)), F.coalesce(F.col(prediction), F.lit(False))
    counts = rows.filter(F.col(axis).isNotNull()).agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn"))
    return counts.select(*confusion_metrics(*(F.col(c) for c in ("tp", "fp", "fn", "tn"))))


def multi_hot(rows: DataFrame, image: str, category: str, classes: list[int]) -> DataFrame:
    """One column per class in order of id, for output."""
    wide = rows.groupBy(image).pivot(category, sorted(classes)).agg(F.max(F.col("y_true").cast("float")))
    return wide.fillna(0.0)
