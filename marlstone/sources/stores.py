"""Artifacts and result stores: written once, or replaced key by key."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions.text import model_slug
from marlstone.schemas import HEADER, RECORD
from marlstone.session import delete, exists, scratch


def _lines(rows: DataFrame, kind: str) -> DataFrame:
    # A shadowing record_type column would be written twice.
    rows = rows.drop("record_type")
    return rows.select(F.to_json(F.struct(F.lit(kind).alias("record_type"), *rows.columns), {"ignoreNullFields": "false"}).alias("value"))


def write_artifact(images: DataFrame, path: str, header: dict, seconds: float | None = None) -> None:
    """JSON lines: a header, an image a line, and a footer if the time is known.
    Lines are told apart by their record_type, never by their place."""
    spark = images.sparkSession
    ends = [json.dumps({"record_type": "header", **header})]
    if seconds is not None:
        ends.append(json.dumps({"record_type": "footer", "inference_time_seconds": seconds}))
    spark.createDataFrame([(x,) for x in ends], "value string").coalesce(1).write.text(path)
    _lines(images, "image").write.mode("append").text(path)


def read_artifact(spark: SparkSession, path: str) -> tuple[dict, DataFrame]:
    """The header with the footer's fields, and the image records; lines without
    a tag are images. Raises if there is no header."""
    lines = spark.read.text(path).filter("trim(value) <> ''").withColumn("kind", F.coalesce(F.get_json_object("value", "$.record_type"), F.lit("image")))
    heads = lines.filter("kind IN ('header', 'footer')").select("kind", F.from_json("value", HEADER).alias("h")).select("kind", "h.*").limit(16).collect()
    found = {r.kind: {k: v for k, v in r.asDict().items() if k not in ("kind", "record_type") and v is not None} for r in heads}
    if "header" not in found:
        raise ValueError(f"no header in {path}")
    images = lines.filter("kind = 'image'").select(F.from_json("value", RECORD).alias("r")).select("r.*").drop("record_type")
    return found["header"] | found.get("footer", {}), images


def upsert(store: DataFrame | None, new: DataFrame, keys: list[str]) -> DataFrame:
    """``new`` in place of the store's rows with the same keys."""
    if store is None:
        return new
    same = [store[k].eqNullSafe(new[k]) for k in keys]
    condition = same[0]
    for c in same[1:]:
        condition = condition & c
    return store.join(new, condition, "left_anti").unionByName(new, allowMissingColumns=True)


def save_results(new: DataFrame, path: str, keys: list[str] | None = None) -> None:
    """Replace the partitions of the keys that ``new`` has; all others stay.
    Each run's rows are stamped with the time."""
    keys = keys or ["dataset", "model"]
    stamped = new.withColumn("evaluated_at", F.current_timestamp())
    stamped.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def latest(rows: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """A log of upserts folded into a store: the last row of each key."""
    rest = [c for c in rows.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), seq).alias("_v"))
    return last.select(*keys, *[F.col(f"_v.{c}").alias(c) for c in rest])


def upsert_predictions(old: Column, model: Column, payload: Column) -> Column:
    """A map of model to payload with one model's entry replaced."""
    kept = F.map_filter(F.coalesce(old, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))), lambda k, _: k != model)
    return F.map_concat(kept, F.create_map(model, payload))


def write_predictions(rows: DataFrame, path: str) -> None:
    """CSV with nested columns as JSON."""
    flat = [F.to_json(c, {"ignoreNullFields": "false"}).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in rows.dtypes]
    rows.select(*flat).write.mode("overwrite").csv(path, header=True, escape='"')


def prediction_path(folder: str, dataset: str, model: str) -> str:
    return f"{folder}/{dataset}_{model.replace('/', '_')}"


def slugged(rows: DataFrame, model: str = "model") -> DataFrame:
    return rows.withColumn(model, model_slug(F.col(model)))


def write_report(reports: list[DataFrame], path: str) -> None:
    """Reports one after the other; an older one is replaced."""
    for i, report in enumerate(reports):
        report.coalesce(1).write.mode("append" if i else "overwrite").text(path)


def load_or_create(spark: SparkSession, path: str, make) -> DataFrame:
    """What was saved, as it is, else what ``make`` gives, saved first. A copy is
    complete before it takes its name, so a lost run leaves none."""
    if not exists(spark, path):
        part = scratch(spark, "sample")
        make().write.parquet(part)
        spark.read.parquet(part).write.mode("errorifexists").parquet(path)
        delete(spark, part)
    return spark.read.parquet(path)
