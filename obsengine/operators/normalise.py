"""Vocabulary, channel statistics and normalisation. Fits see the training side only; they are a row per channel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.normal import normal_cdf, normal_quantile
from ..functions.ordering import median, percentiles

RANK_FLOOR = 1e-7  # normal scores stay within those of this rank and its mirror


def extend_vocabulary(vocabulary: DataFrame | None, channels: DataFrame) -> DataFrame:
    """New channels get the next ids from 1 in name order. A vocabulary has a row per channel, so it is ordered whole."""
    names = channels.select("channel").distinct()
    if vocabulary is not None:
        names = names.join(vocabulary, "channel", "left_anti")
        last = vocabulary.agg(F.coalesce(F.max("channel_id"), F.lit(0))).first()[0]
    else:
        last = 0
    new = names.withColumn("channel_id", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("channel")) + last).cast("int"))
    return new if vocabulary is None else vocabulary.select("channel", "channel_id").unionByName(new)


def fit_standard(df: DataFrame) -> DataFrame:
    """Count, mean and population deviation."""
    return df.groupBy("channel").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


def fit_robust(df: DataFrame) -> DataFrame:
    """Median, median absolute deviation and scale: 1.4826 of it, or the deviation if it is 0."""
    mid = median(df, "value", ["channel"]).join(df.groupBy("channel").agg(F.stddev_pop("value").alias("std")), "channel")
    off = median(df.join(mid, "channel").select("channel", F.abs(F.col("value") - F.col("median")).alias("off")), "off", ["channel"], "mad")
    scale = F.when(F.col("mad") > 0, 1.4826 * F.col("mad")).otherwise(F.col("std"))
    return mid.join(off, "channel").withColumn("scale", scale)


def fit_quantile(df: DataFrame, knots: int = 1001) -> DataFrame:
    """`knots` linearly interpolated quantiles."""
    return percentiles(df, "value", [i / (knots - 1) for i in range(knots)], ["channel"], "quantiles")


def normalise(df: DataFrame, stats: DataFrame) -> DataFrame:
    """Standard scores; a channel without spread is divided by 1."""
    return df.join(stats, "channel").withColumn("value", (F.col("value") - F.col("mean")) / F.when(F.col("std") > 0, F.col("std")).otherwise(1.0)).select(*df.columns)


def normalise_robust(df: DataFrame, stats: DataFrame, bound: float = 10.0) -> DataFrame:
    """Robust scores, bounded."""
    score = (F.col("value") - F.col("median")) / F.when(F.col("scale") > 0, F.col("scale")).otherwise(1.0)
    return df.join(stats, "channel").withColumn("value", F.greatest(F.least(score, F.lit(bound)), F.lit(-bound))).select(*df.columns)


def quantile_rank(df: DataFrame, stats: DataFrame) -> DataFrame:
    """A value's mid-rank among its channel's quantiles, from 0 to 1; between knots it is interpolated."""
    q = F.col("quantiles")
    below, upto = F.size(F.filter(q, lambda k: k < F.col("value"))), F.size(F.filter(q, lambda k: k <= F.col("value")))
    last = F.size(q) - 1
    low, high = F.get(q, below - 1), F.get(q, below)
    between = (below - 1 + (F.col("value") - low) / (high - low)) / last
    rank = F.when(upto > below, (below + upto - 1) / 2 / last).when(below == 0, 0.0).when(below > last, 1.0).otherwise(between)
    return df.join(stats.select("channel", "quantiles"), "channel").withColumn("rank", rank).select(*df.columns, "rank")


def normal_scores(df: DataFrame, stats: DataFrame) -> DataFrame:
    """The normal score of a value's rank among its channel's quantiles, the rank kept off 0 and 1 by the floor."""
    ranked = quantile_rank(df, stats)
    within = F.greatest(F.lit(RANK_FLOOR), F.least(F.lit(1 - RANK_FLOOR), F.col("rank")))
    return ranked.withColumn("value", normal_quantile(within)).select(*df.columns)


def from_normal_scores(df: DataFrame, stats: DataFrame) -> DataFrame:
    """Raw values of normal scores, on the line between the two quantiles about the score's rank."""
    last = F.size("quantiles") - 1
    at = normal_cdf(F.col("value")) * last
    low = F.least(F.floor(at), last - 1).cast("int")
    line = F.get("quantiles", low) + (at - low) * (F.get("quantiles", low + 1) - F.get("quantiles", low))
    return df.join(stats.select("channel", "quantiles"), "channel").withColumn("value", line).select(*df.columns)


def denormalise(df: DataFrame, stats: DataFrame) -> DataFrame:
    """Raw values of standard scores."""
    return df.join(stats, "channel").withColumn("value", F.col("value") * F.when(F.col("std") > 0, F.col("std")).otherwise(1.0) + F.col("mean")).select(*df.columns)


def unfitted_channels(df: DataFrame, stats: DataFrame) -> DataFrame:
    """Channels that are read and have no statistics."""
    return df.select("channel").distinct().join(stats, "channel", "left_anti")


def diagnose_channels(df: DataFrame, stats: DataFrame, bound: float = 3.0) -> DataFrame:
    """Extremes in fitted deviations, and the share of readings beyond the bound."""
    z = (F.col("value") - F.col("mean")) / F.when(F.col("std") > 0, F.col("std")).otherwise(1.0)
    return df.join(stats, "channel").groupBy("channel").agg(F.min(z).alias("lowest"), F.max(z).alias("highest"), F.avg((F.abs(z) > bound).cast("double")).alias("share_beyond"))
