"""Event-time windows and duplicate removal over the timestamped event feed, for batch and streaming frames alike."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from inswing.plans.workspace import Workspace


def timed(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)


def tumbling(events: DataFrame, size: str = "6 hours") -> DataFrame:
    return timed(events).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("v")) \
        .select(F.col("window.start").alias("start"), "event_type", "n", "v")


def sliding(events: DataFrame, size: str = "12 hours", slide: str = "6 hours") -> DataFrame:
    return timed(events).groupBy(F.window("ts", size, slide)).agg(F.count("*").alias("n"), F.sum("value").alias("v")) \
        .select(F.col("window.start").alias("start"), "n", "v")


def sessions(events: DataFrame, gap: str = "2 hours") -> DataFrame:
    return timed(events).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"), F.sum("value").alias("v")) \
        .select("user_id", F.col("session_window.start").alias("start"), "n", "v")


def deduplicated(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """Plain duplicates by id: the watermark bounds how long an id is remembered."""
    return timed(events, delay).dropDuplicatesWithinWatermark(["event_id"])


def stream_unique(ws: Workspace) -> DataFrame:
    """The events table sent twice through a file stream and deduplicated on the way."""
    base = f"{ws.root}/stream/unique"
    e = ws.source("events").withColumn("ts", F.col("ts").cast("timestamp"))
    e.unionByName(e).repartitionByRange(4, "ts").write.mode("overwrite").parquet(f"{base}/in")
    stream = ws.spark.readStream.schema(e.schema).parquet(f"{base}/in")
    q = (deduplicated(stream).writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/cp")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return ws.spark.read.schema(e.schema).parquet(f"{base}/out")
