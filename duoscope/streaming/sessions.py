"""Event-time forms of sessions and responses: an extension, the batch forms are the ones compared."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def sessions(events: DataFrame, time: str = "ts", user: str = "user_id", gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """Sessions of a user: one ends once the watermark has passed its gap."""
    s = events.withWatermark(time, late).groupBy(F.session_window(time, gap), F.col(user)).agg(F.count(F.lit(1)).alias("n"))
    return s.select(user, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def activity(events: DataFrame, time: str = "ts", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by event type and window."""
    w = events.withWatermark(time, late).groupBy(F.window(time, width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return w.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def read_stream(spark: SparkSession, path: str, schema: StructType, files_a_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger).parquet(path)
