"""Event streams: tumbling, sliding and session windows with watermarks, the same on batches and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, folder: str, files_per_trigger: int = 16) -> DataFrame:
    """The events table as a stream of its files."""
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{folder}/event[s].parquet")


def _timed(events: DataFrame, late: str) -> DataFrame:
    """Events with a watermark, which streams keep on instants only."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def windowed(events: DataFrame, width: str = "1 day", slide: str | None = None, late: str = "2 days") -> DataFrame:
    """(start, event_type, n, total) by window; on a stream, events later than ``late`` are left out and state is dropped behind it."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    g = _timed(events, late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return g.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 days") -> DataFrame:
    """(user_id, start, end, n) of a user's events less than ``gap`` apart."""
    g = _timed(events, late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), F.col("w.end").cast("timestamp_ntz").alias("end"), "n")


def run_to_table(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """All that a stream has now, as an in-memory table: for tests and small reports."""
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def write_stream(stream: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """A stream into Parquet files, exactly once through its checkpoint; returns the running query."""
    return stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).start()
