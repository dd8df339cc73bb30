"""Time chunks over streams: watermarked windows with the batch operators' statistics, and per-key counters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def event_time(df: DataFrame, time: str) -> DataFrame:
    """Zone-less timestamps as instants, as watermarks need."""
    return df.withColumn(time, F.col(time).cast("timestamp"))


def window_statistics(df: DataFrame, keys: list[str], time: str, value: str, duration: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """keys, window_start, window_end, n_events, mean, std of half-open windows; rows later than `late` are left out."""
    w = F.window(time, duration, slide) if slide else F.window(time, duration)
    d = event_time(df, time).withWatermark(time, late).groupBy(*keys, w.alias("w"))
    out = d.agg(F.count(value).alias("n_events"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    return out.select(*keys, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n_events", "mean", "std")


def sessions(df: DataFrame, keys: list[str], time: str, gap: str, late: str = "1 hour") -> DataFrame:
    d = event_time(df, time).withWatermark(time, late).groupBy(*keys, F.session_window(time, gap).alias("w"))
    return d.agg(F.count("*").alias("n_events")).select(*keys, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n_events")


def first_of_key(df: DataFrame, keys: list[str], time: str, late: str = "1 hour") -> DataFrame:
    """Each key once while it is within the watermark."""
    return event_time(df, time).withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def run_available(df: DataFrame, name: str, mode: str = "complete") -> StreamingQuery:
    """Process what is there into an in-memory table of that name, and wait."""
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def run_to_files(df: DataFrame, folder: str) -> DataFrame:
    """Process what is there, wait, and read the whole result from Parquet in the folder, which all executors share.

    Each batch writes the result anew, so windows that the watermark has not closed are there too.
    """
    spark, path = df.sparkSession, f"{folder}/result"
    spark.createDataFrame([], df.schema).write.parquet(path)  # a stream without rows has no batch
    q = df.writeStream.foreachBatch(lambda batch, i: batch.write.mode("overwrite").parquet(path)).outputMode("complete")
    q.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(path)


def write_files(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    q = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return q
