"""Reproducible samples: order is a hash of the key, never a file's order."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_order(key: Column, seed: int = 42) -> Column:
    return F.md5(F.concat(key.cast("string"), F.lit(f"|{seed}")).cast("binary"))


def seeded_sample(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows by hash order, with their place in it."""
    picked = rows.withColumn("_h", hash_order(F.col(key), seed)).orderBy("_h", key).limit(n)
    return picked.withColumn("sample_pos", F.row_number().over(Window.orderBy("_h", key))).drop("_h")


def python_sample(rows: DataFrame, index: str, total: int, n: int, seed: int = 42) -> DataFrame:
    """The rows whose dense index Python's ``random.sample`` draws, in its order."""
    drawn = random.Random(seed).sample(range(total), min(n, total))
    places = rows.sparkSession.createDataFrame([(i, p) for p, i in enumerate(drawn)], f"{index} long, sample_pos long")
    return rows.join(places, index)


def head(rows: DataFrame, seq: str, n: int) -> DataFrame:
    return rows.orderBy(seq).limit(n)


def round_robin(rows: DataFrame, group: str, key: str, n: int) -> DataFrame:
    """The first key of every group in order of group, then the second, up to n.

    Only the first ceil-of-n keys of a group can be drawn, so each group's rank
    is cut there before groups are merged."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(key))
    own = rows.withColumn("_g", F.coalesce(F.col(group), F.lit(""))).withColumn("turn", rank).filter(F.col("turn") <= n)
    return own.orderBy("turn", "_g", key).limit(n).drop("_g")


def round_robin_of_last(rows: DataFrame, group: str, key: str, seq: str, n: int) -> DataFrame:
    """``round_robin`` where a key counts for the group that it was last seen in."""
    last = rows.groupBy(key).agg(F.max_by(group, seq).alias(group))
    return round_robin(last, group, key, n)


def batch_number(index: Column, size: int) -> Column:
    """Fixed-size batches in order of a dense index."""
    return F.floor(index / size).cast("long")


def scaled_targets(targets: dict[str, int], n: int) -> dict[str, int]:
    """Targets scaled to n rows, each at least 1, halves to even."""
    total = sum(targets.values())
    return {k: max(1, round(v * n / total)) for k, v in targets.items()}


def stratified_sample(rows: DataFrame, bucket: str, key: str, targets: dict[str, int], n: int, seed: int = 42) -> DataFrame:
    """Up to each bucket's scaled target by hash order, topped up from what is
    left, cut to n; with the bucket and ``topped_up``."""
    spark = rows.sparkSession
    want = spark.createDataFrame(list(scaled_targets(targets, n).items()), f"{bucket} string, _want int")
    ranked = rows.join(F.broadcast(want), bucket).withColumn("_h", hash_order(F.col(key), seed))
    # No bucket gives more than n rows.
    ranked = ranked.withColumn("_r", F.row_number().over(Window.partitionBy(bucket).orderBy("_h", key))).filter(F.col("_r") <= n)
    ranked = ranked.withColumn("topped_up", F.col("_r") > F.col("_want"))
    return ranked.orderBy("topped_up", "_h", key).limit(n).drop("_want", "_r", "_h")


def example_buckets(rows: DataFrame, buckets: dict[str, Column], key: str, k: int, seed: int = 42) -> DataFrame:
    """Up to k rows of each bucket; a row may be in several."""
    inside = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in buckets.items()]))
    own = rows.withColumn("bucket", F.explode(inside)).withColumn("_h", hash_order(F.col(key), seed))
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy("_h", key))
    return own.withColumn("place", rank).filter(F.col("place") <= k).drop("_h")


def members(rows: DataFrame, sample: DataFrame, key: str) -> DataFrame:
    return rows.join(sample.select(key), key, "left_semi")
