"""The same work on readings that arrive: windows, running statistics, deduplication, hourly means.

Inputs are streaming frames `(unit, channel, ts, value)` with an event time; late rows past the watermark are dropped
(`late.counted_windows` counts them).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.repair import clean


def stream_windows(readings: DataFrame, length: str, slide: str | None = None, lateness: str = "10 minutes") -> DataFrame:
    """Five summaries of each channel of a unit in sliding (or, without `slide`, tumbling) windows of event time."""
    win = F.window("ts", length, slide) if slide else F.window("ts", length)
    found = readings.withWatermark("ts", lateness).groupBy("unit", "channel", win.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.min("value").alias("minimum"), F.max("value").alias("maximum"), F.max(F.struct("ts", "value"))["value"].alias("last"))
    return found.select("unit", "channel", F.col("w.start").alias("win_start"), F.col("w.end").alias("win_end"), "n", "mean", "minimum", "maximum", "last")


def stream_clean_normalise(readings: DataFrame, stats: DataFrame, bounds: DataFrame | None = None) -> DataFrame:
    """Readings cleaned by `bounds` (P12), then standard scores by fitted statistics, static tables of a row per channel."""
    readings = readings if bounds is None else clean(readings, bounds)
    z = (F.col("value") - F.col("mean")) / F.when(F.col("std") > 0, F.col("std")).otherwise(1.0)
    return readings.join(stats, "channel").withColumn("value", z).select(*readings.columns)


def stream_statistics(readings: DataFrame) -> DataFrame:
    """Running count, mean and population deviation of each channel; write in update or complete mode."""
    return readings.groupBy("channel").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


def stream_dedupe(readings: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """T5: one reading of each unit, channel and instant, the first to arrive."""
    return readings.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["unit", "channel", "ts"])


def stream_hourly(readings: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Mean and count of each channel-hour of a unit."""
    hours = readings.withWatermark("ts", lateness).groupBy("unit", "channel", F.window("ts", "1 hour").alias("w"))
    return hours.agg(F.avg("value").alias("mean"), F.count(F.lit(1)).alias("n")).select("unit", "channel", F.col("w.start").alias("hour"), "mean", "n")
