"""Change counts over a stream of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT_SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, schema: str = EVENT_SCHEMA, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def windowed_changes(events: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """start, path, n: changes of each path by window; events later than the watermark are left out."""
    rows = events.filter(F.col("event_type").isin("click", "purchase")).withWatermark("ts", late)
    return rows.groupBy(F.window("ts", width), F.col("user_id").alias("path")).agg(F.count("*").alias("n")).select("window.start", "path", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """start, end, path, n: bursts of changes of a path without a pause longer than gap."""
    rows = events.withWatermark("ts", late)
    return rows.groupBy(F.session_window("ts", gap).alias("w"), F.col("user_id").alias("path")).agg(F.count("*").alias("n")).select("w.start", "w.end", "path", "n")
