"""Features of windows."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .windows import WIN


def window_statistics(tokens: DataFrame) -> DataFrame:
    """per channel of a window; what too few readings can't support is null."""
    w = Window.partitionBy(*WIN, "channel").orderBy("time", "value")
    rows = tokens.withColumn("_step", F.abs(F.col("value") - F.lag("value").over(w)))
    return rows.groupBy(*WIN, "channel").agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("deviation"), F.min("value").alias("minimum"), F.max("value").alias("maximum"), F.min(F.struct("time", "value"))["value"].alias("first"),
        F.max(F.struct("time", "value"))["value"].alias("last"), F.regr_slope("value", "time").alias("slope"), F.avg("_step").alias("mean_step"), F.avg("gap").alias("mean_gap"))


def per_channel_features(stats: DataFrame, channels: list[str], columns: list[str]) -> DataFrame:
    """a wide row for each window; an absent channel has count 0 and nulls."""
    wide = stats.groupBy(*WIN).pivot("channel", channels).agg(*[F.first(c).alias(c) for c in columns])
    return wide.fillna(0, [f"{c}_n" for c in channels if "n" in columns])


def channel_aggregated_features(stats: DataFrame, columns: list[str]) -> DataFrame:
    """mean, deviation, minimum and maximum across a window's channels of every column."""
    each = [f(c).alias(f"{c}_{name}") for c in columns for f, name in ((F.avg, "mean"), (F.stddev_pop, "deviation"), (F.min, "min"), (F.max, "max"))]
    return stats.groupBy(*WIN).agg(F.count(F.lit(1)).alias("channels"), F.sum("n").alias("tokens"), *each)


def window_spectrum(tokens: DataFrame, cycles: int = 8, least: int = 4) -> DataFrame:
    """floating-mean Lomb-Scargle power of each channel of a window at 1 to `cycles` cycles, up to half its count.

    The share of variance that a sine with a free mean explains, from sums of products alone.
    """
    rows = tokens.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*WIN, "channel"))).where(F.col("_n") >= least)
    rows = rows.withColumn("cycle", F.explode(F.sequence(F.lit(1), F.least(F.floor(F.col("_n") / 2), F.lit(cycles)).cast("int"))))
    angle = 2 * math.pi * F.col("cycle") * F.col("time")
    rows = rows.withColumn("c", F.cos(angle)).withColumn("s", F.sin(angle))
    v = F.col("value")
    m = rows.groupBy(*WIN, "channel", "cycle").agg(F.avg(v).alias("y"), F.avg("c").alias("c"), F.avg("s").alias("s"), F.avg(v * v).alias("yy"), F.avg(v * F.col("c")).alias("yc"), F.avg(v * F.col("s")).alias("ys"), F.avg(F.col("c") * F.col("c")).alias("cc"), F.avg(F.col("s") * F.col("s")).alias("ss"), F.avg(F.col("c") * F.col("s")).alias("cs"))
    yy, yc, ys, cc, ss, cs = (F.expr(x) for x in ("yy - y * y", "yc - y * c", "ys - y * s", "cc - c * c", "ss - s * s", "cs - c * s"))
    det = cc * ss - cs * cs
    power = F.when((det > 1e-9) & (yy > 1e-9), (ss * yc * yc + cc * ys * ys - 2 * cs * yc * ys) / (yy * det))
    return m.select(*WIN, "channel", "cycle", power.alias("power"))


def standardise_features(rows: DataFrame, columns: list[str], fit: DataFrame | None = None) -> DataFrame:
    """features over the fitting rows' mean and deviation; nulls at the mean. One row of fits is broadcast."""
    fit = rows if fit is None else fit
    aggs = [x for c in columns for x in (F.avg(c).alias(f"_m_{c}"), F.stddev_pop(c).alias(f"_s_{c}"))]
    both = rows.crossJoin(F.broadcast(fit.agg(*aggs)))
    z = {c: F.coalesce((F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") > 0, F.col(f"_s_{c}")).otherwise(1.0), F.lit(0.0)) for c in columns}
    return both.withColumns(z).select(*rows.columns)


def spectral_features(spectrum: DataFrame, channels: list[str], cycles: int = 8) -> DataFrame:
    """the spectrum of each window as a wide row, `{channel}_p{cycle}`; null where too little was read."""
    at = lambda c, k: F.max(F.when((F.col("channel") == c) & (F.col("cycle") == k), F.col("power"))).alias(f"{c}_p{k}")
    return spectrum.groupBy(*WIN).agg(*[at(c, k) for c in channels for k in range(1, cycles + 1)])


def scheme_features(tokens: DataFrame, scheme: str, channels: list[str], columns: list[str]) -> DataFrame:
    """a window's features by scheme: `per_channel`, `aggregated` or `spectral`."""
    if scheme == "spectral":
        return spectral_features(window_spectrum(tokens), channels)
    stats = window_statistics(tokens)
    if scheme == "per_channel":
        return per_channel_features(stats, channels, columns)
    if scheme == "aggregated":
        return channel_aggregated_features(stats, columns)
    raise ValueError(f"no scheme {scheme}")
