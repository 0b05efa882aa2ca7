"""Vector expressions over array<float>; arithmetic is in doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    pair = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pair, F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def l2_normalise(v: Column) -> Column:
    """Of length one; a zero vector stays as it is."""
    norm = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(x.cast("double")))


def or_zero(v: Column, size: int) -> Column:
    """A zero vector in place of a missing one, so that rows stay aligned."""
    return F.coalesce(v, F.array_repeat(F.lit(0.0).cast("float"), size))


def clip_score(similarity: Column, weight: float = 2.5) -> Column:
    return F.lit(weight) * F.greatest(similarity, F.lit(0.0))


def sigmoid_at_least(logit: Column, threshold: float) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-logit)) >= threshold


def arg_max(v: Column) -> Column:
    """Index of the first largest element."""
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")
