"""Streaming statistics (ours: the surveyed toolkit has no streams).

Arriving measurements or rasters are aggregated by event time; state is bounded by the watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def windowed_statistics(events: DataFrame, time: str, value: str, *keys: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Count, least, largest and mean of each key and tumbling window; works on batches and streams alike."""
    source = events.withWatermark(time, late) if events.isStreaming else events
    grouped = source.groupBy(F.window(time, window), *keys).agg(F.count("*").alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi"), F.round(F.avg(value), 6).alias("mean"))
    return grouped.select(F.col("window.start").alias("start"), *keys, "n", "lo", "hi", "mean")


def sessions(events: DataFrame, time: str, key: str, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions of each key that end after a gap."""
    source = events.withWatermark(time, late) if events.isStreaming else events
    grouped = source.groupBy(F.session_window(time, gap), key).agg(F.count("*").alias("n"))
    return grouped.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), key, "n")


def arriving_files(spark: SparkSession, path: str, glob: str = "*.{tif,tiff}") -> DataFrame:
    """(path, content) of raster files as they arrive below path."""
    return spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path).select("path", "content")
