"""Similarity operators over vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.functions.vectors import clip_score, dot
from marlstone.session import ship

#: Candidate bytes up to which they are sent to every task; more meet the
#: captions in blocks of these bytes and of so many captions.
BLOCK_BYTES, BLOCK_ROWS = 64 << 20, 8192


def _matrix(vectors, size: int) -> np.ndarray:
    """Rows of ``size``; a missing vector is one of zeros, so that rows stay aligned."""
    out = np.zeros((len(vectors), size))
    for i, v in enumerate(vectors):
        if v is not None:
            out[i, : len(v)] = v
    return out


def best_candidate(captions: DataFrame, candidates: DataFrame, key: str = "image_id", vector: str = "embedding") -> DataFrame:
    """key, cand_idx, similarity: the candidate most similar to each caption, the
    first on ties; -1 without candidates. A missing vector, on either side, counts
    as one of zeros; repeated keys give a row each.

    Candidates of a measured size are a matrix in every task. More of them meet
    the captions block by block, and the blocks' winners are merged by caption:
    neither side is ever whole in one place.
    """
    spark = captions.sparkSession
    ship(spark)
    size = candidates.select(F.count("*").alias("n"), F.max(F.size(vector)).alias("width")).first()
    width = max(0, size.width or 0)
    if not size.n:
        return captions.select(key, F.lit(-1).alias("cand_idx"), F.lit(None).cast("double").alias("similarity"))
    schema = f"{key} {captions.schema[key].dataType.simpleString()}, cand_idx int, similarity double"
    known = candidates.select("cand_idx", F.col(vector).alias("_c"))

    def winners(keys, vectors, idx, matrix) -> pd.DataFrame:
        sims = _matrix(vectors, width) @ matrix.T
        best = sims.argmax(1)
        return pd.DataFrame({key: keys, "cand_idx": idx[best], "similarity": sims[np.arange(len(best)), best]})

    if size.n * (width * 8 + 64) <= BLOCK_BYTES:
        rows = known.orderBy("cand_idx").toPandas()
        held = spark.sparkContext.broadcast((rows.cand_idx.to_numpy(), _matrix(rows._c, width)))

        def match(batches):
            for batch in batches:
                if len(batch):
                    yield winners(batch[key], batch[vector], *held.value)

        return captions.select(key, vector).mapInPandas(match, schema)

    blocks = -(-size.n * (width * 8 + 64) // BLOCK_BYTES)
    parts = max(1, -(-captions.count() // BLOCK_ROWS))
    left = captions.select(key, vector, F.xxhash64(F.monotonically_increasing_id()).alias("_row"))
    left = left.withColumn("_part", F.pmod("_row", F.lit(parts))).withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = known.withColumn("_block", F.pmod(F.hash("cand_idx"), F.lit(blocks)).cast("int")).withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))

    def meet(asked: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("cand_idx", kind="stable")
        if not len(asked) or not len(own):
            return pd.DataFrame({key: asked[key][:0], "cand_idx": [], "similarity": [], "_row": []})
        return winners(asked[key], asked[vector], own.cand_idx.to_numpy(), _matrix(own._c, width)).assign(_row=asked._row.to_numpy())

    met = left.groupBy("_part", "_block").cogroup(right.groupBy("_part", "_block")).applyInPandas(meet, f"{schema}, _row long")
    best = F.max_by(F.struct("cand_idx", "similarity"), F.struct("similarity", -F.col("cand_idx")))
    return met.groupBy("_row", key).agg(best.alias("b")).select(key, "b.cand_idx", "b.similarity")


def representative_object(objects: DataFrame, predicted: DataFrame, image: str = "image_id") -> DataFrame:
    """Each image's object most similar to its predicted candidate (the first on
    ties); null for an image without objects. objects(image, obj_idx,
    object_vector); predicted(image, class_vector)."""
    sim = objects.join(predicted, image).select(image, "obj_idx", dot(F.col("object_vector"), F.col("class_vector")).alias("similarity"))
    best = sim.groupBy(image).agg(F.max_by(F.struct("obj_idx", "similarity"), F.struct("similarity", -F.col("obj_idx"))).alias("b"))
    return predicted.select(image).join(best, image, "left").select(image, "b.obj_idx", "b.similarity")


def clip_scores(images: DataFrame, objects: DataFrame, image: str = "image_id", weight: float = 2.5) -> DataFrame:
    """Per image: caption_score, object_score (mean; 0 without objects) and
    f_score: (caption + sum of objects) / (objects + 1). images(image,
    image_vector, caption_vector); objects(image, object_vector)."""
    pairs = objects.join(images.select(image, "image_vector"), image)
    sums = pairs.groupBy(image).agg(F.sum(clip_score(dot(F.col("image_vector"), F.col("object_vector")), weight)).alias("_s"), F.count("*").alias("n_objects"))
    out = images.join(sums, image, "left").withColumn("n_objects", F.coalesce("n_objects", F.lit(0)).cast("long"))
    caption = clip_score(dot(F.col("image_vector"), F.col("caption_vector")), weight)
    total = F.coalesce("_s", F.lit(0.0))
    return out.select(
        image, "n_objects", caption.alias("caption_score"),
        F.coalesce(F.try_divide(total, F.col("n_objects")), F.lit(0.0)).alias("object_score"), ((caption + total) / (F.col("n_objects") + 1)).alias("f_score"),
    )


def encode_distinct(texts: DataFrame, text: str, encode, batch: int = 64) -> DataFrame:
    """text, vector: each distinct text encoded once, ``batch`` at a time.
    ``encode`` takes a list of texts and returns as many vectors."""
    ship(texts.sparkSession)

    def run(batches):
        for frame in batches:
            words = frame[text].tolist()
            found = [v for i in range(0, len(words), batch) for v in encode(words[i : i + batch])]
            yield pd.DataFrame({text: words, "vector": [np.asarray(v, np.float32) for v in found]})

    return texts.select(text).filter(F.col(text).isNotNull()).distinct().mapInPandas(run, f"{text} string, vector array<float>")
