"""The annotation stages over a stream of files.

A stream has no state here: each micro-batch runs the same plan as a table, and
is written under its own batch id, so a batch that is tried again replaces its
first try.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def read_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(path)


def annotate_stream(rows: DataFrame, plan: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Write ``plan`` of every micro-batch to ``out/batch=<id>``."""

    def one(batch: DataFrame, batch_id: int) -> None:
        plan(batch).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return rows.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
