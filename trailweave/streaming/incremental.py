"""Streams of events: counts, sessions and follow-up checks with watermarks.

Beyond batch parity: the same questions asked of events as they arrive.  State is
bounded by the watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, folder: str, pattern: str = "events.parquet", per_trigger: int = 1) -> DataFrame:
    """The ``events`` table as a stream with event time ``ts``."""
    schema = spark.read.parquet(f"{folder}/{pattern}").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", per_trigger).parquet(folder)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def activity_counts(events: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(start, event_type, n, total) per tumbling window."""
    out = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(user_id, start, end, n) of runs of a user's events without a longer gap."""
    out = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def followed(events: DataFrame, first: str, second: str, seconds: int, late: str = "1 hour") -> DataFrame:
    """(event_id, follower): each event of one type with later events of another by the same user in time; null if none came."""
    a = events.filter(F.col("event_type") == first).select("event_id", "user_id", "ts").withWatermark("ts", late).alias("a")
    b = events.filter(F.col("event_type") == second).select(F.col("event_id").alias("follower"), F.col("user_id").alias("who"), F.col("ts").alias("at")).withWatermark("at", late).alias("b")
    on = F.expr(f"user_id = who AND at >= ts AND at <= ts + INTERVAL {int(seconds)} SECONDS")
    return a.join(b, on, "left_outer").select("event_id", "follower")


def drained(stream: DataFrame, spark: SparkSession, path: str) -> DataFrame:
    """What a stream's closed windows give once all present files are read, kept under ``path``."""
    query = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")
