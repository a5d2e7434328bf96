"""Structured Streaming over detections that arrive as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tessera.operators.detections import suppress

SCHEMA = "image string, ordinal long, class_id int, confidence double, ring array<struct<x:double,y:double>>"


def read_detections(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Detections as JSON lines, one image's rows within one file."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).json(path)


def suppress_stream(detections: DataFrame, out: str, checkpoint: str, threshold: float) -> StreamingQuery:
    """Suppress each micro-batch and append the kept rows to Parquet.

    A batch is written to a folder of its own number, so a batch that is run
    again after a failure replaces its rows.
    """

    def batch(rows: DataFrame, number: int) -> None:
        suppress(rows, threshold).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return detections.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
