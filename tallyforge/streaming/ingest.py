"""Structured Streaming over the same operators: files as they come, bursts of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.sources.files import document_format


def file_stream(spark: SparkSession, path: str, most_files: int = 1000) -> DataFrame:
    """New files under a path, each content once within an hour's watermark."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    df = spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", most_files).load(path)
    df = df.select("path", F.col("modificationTime").alias("modified"), "content", F.sha2("content", 256).alias("file_hash"), document_format(F.col("path")).alias("format"))
    return df.withWatermark("modified", "1 hour").dropDuplicatesWithinWatermark(["file_hash"])


def bursts(events: DataFrame, time: str = "ts", key: str = "event_type", length: str = "2 days", slide: str = "1 day", late: str = "1 day") -> DataFrame:
    """Events by key and sliding window: how many. On a stream, windows close `late` after their end; on a table the result is the same."""
    e = events.withColumn("_t", F.col(time).cast("timestamp"))
    e = e.withWatermark("_t", late) if events.isStreaming else e
    g = e.groupBy(F.window("_t", length, slide).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return g.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def sessions(events: DataFrame, time: str = "ts", key: str = "user_id", gap: str = "2 hours", late: str = "1 day") -> DataFrame:
    """Events by key and session: start, end (after its gap) and how many."""
    e = events.withColumn("_t", F.col(time).cast("timestamp"))
    e = e.withWatermark("_t", late) if events.isStreaming else e
    g = e.groupBy(F.session_window("_t", gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return g.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
