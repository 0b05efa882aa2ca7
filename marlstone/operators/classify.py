"""Closed-set classifiers: scores over classes, made into nodes and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.functions.vectors import arg_max
from marlstone.operators import matching
from marlstone.sources.readers import index_to_node


def index_table(names: DataFrame, expected: dict[int, str], size: int) -> DataFrame:
    """class_index and node, checked: indices are 0 to size - 1, each once, and a
    few known ones have the expected nodes. Fails otherwise."""
    spark = names.sparkSession
    ids = spark.range(size).select(F.col("id").cast("int").alias("class_index"))
    matching.require_none(matching.unknown_ids(names, "class_index", ids), "class indices")
    matching.require_none(names.groupBy("class_index").count().filter("count > 1"), "repeated class indices")
    known = spark.createDataFrame(list(expected.items()), "class_index int, expected string")
    matching.require_none(names.join(F.broadcast(known), "class_index").filter(~F.col("node").eqNullSafe(F.col("expected"))), "nodes of known classes")
    return names


def top_classes(rows: DataFrame, names: DataFrame, logits: str = "logits") -> DataFrame:
    """Rows with class_index, the first largest of their logits, and its node as
    pred_node; null without logits."""
    out = rows.withColumn("class_index", F.when(F.size(logits) > 0, arg_max(F.col(logits))))
    return index_to_node(out, names, "class_index").withColumnRenamed("node", "pred_node")


def closed_set_labels(rows: DataFrame, names: DataFrame, labels: DataFrame, truth: str, value: str, logits: str = "logits") -> DataFrame:
    """Rows whose true node is labelled, with gt and pred: the labels of the true
    node and of the node that the classifier puts first."""
    return matching.truth_and_prediction(top_classes(rows, names, logits), labels, truth, "pred_node", "node", value)
