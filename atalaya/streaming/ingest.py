"""An extension: the event stream as micro-batches, counted by cell and shift of eight hours, late rows bounded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 1) -> DataFrame:
    """Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def shift_counts(events: DataFrame, cells: int, late: str = "1 hour") -> DataFrame:
    """window_start, hex_id, n: events by tumbling windows of eight hours and cell, with a watermark on ts."""
    keyed = events.withWatermark("ts", late).groupBy(F.window("ts", "8 hours").alias("w"), (F.col("user_id") % cells + 1).alias("hex_id"))
    return keyed.agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "hex_id", "n")
