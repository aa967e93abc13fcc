"""Streaming extension: windows with watermarks, and idempotent appends by key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "2 hours", time: str = "ts") -> DataFrame:
    """Counts and sums by event type in tumbling (or sliding) windows; rows later than ``late`` are left out of a stream."""
    window = F.window(time, width, slide) if slide else F.window(time, width)
    found = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return found.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours", time: str = "ts") -> DataFrame:
    """Session windows of each user."""
    found = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return found.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def append_new(stream: DataFrame, path: str, keys: list[str], checkpoint: str):
    """Append to a table at ``path`` only rows whose keys it lacks; a repeated batch adds nothing."""

    def batch(df: DataFrame, _: int) -> None:
        new = df.dropDuplicates(keys)
        store = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        if store.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).exists(store):
            new = new.join(df.sparkSession.read.parquet(path).select(*keys), keys, "left_anti")
        new.write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
