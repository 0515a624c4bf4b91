"""Cleaning, deduplication, decimation and repair of readings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def clean(df: DataFrame, bounds: DataFrame) -> DataFrame:
    """Values outside the outer bounds go, the rest is clipped to the inner ones; a channel without bounds stays.

    `bounds`: `(channel, removed_below, clipped_below, clipped_above, removed_above)`, a row for each channel.
    """
    rows = df.join(bounds, "channel", "left")
    kept = rows.where(F.coalesce(F.col("value") >= F.col("removed_below"), F.lit(True)) & F.coalesce(F.col("value") <= F.col("removed_above"), F.lit(True)))
    return kept.withColumn("value", F.least(F.greatest("value", F.coalesce("clipped_below", "value")), F.coalesce("clipped_above", "value"))).select(*df.columns)


def cleaning_record(df: DataFrame, bounds: DataFrame) -> DataFrame:
    """How many readings `clean` removes and clips, per channel."""
    rows = df.join(bounds, "channel", "left")
    gone = F.coalesce((F.col("value") < F.col("removed_below")) | (F.col("value") > F.col("removed_above")), F.lit(False))
    clipped = ~gone & F.coalesce((F.col("value") < F.col("clipped_below")) | (F.col("value") > F.col("clipped_above")), F.lit(False))
    return rows.groupBy("channel").agg(F.count_if(gone).alias("removed"), F.count_if(clipped).alias("clipped"), F.count(F.lit(1)).alias("readings"))


def keep_preferred(df: DataFrame, key: Sequence[str], precedence: Sequence[Column]) -> DataFrame:
    """Of the rows of a key the first by precedence."""
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(*precedence))
    return df.withColumn("_nth", nth).where("_nth = 1").drop("_nth")


def drop_repeated_groups(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows whose key occurs once; all rows of a repeated key go."""
    once = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where("_n = 1").drop("_n")
    return df.join(once, list(key), "left_semi")


def most_frequent(df: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """The commonest value of each key, ties to the first by name, with its rows and the key's."""
    counts = df.groupBy(*key, value).agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy(*key).agg(F.min(F.struct((-F.col("n")).alias("m"), F.col(value).alias("v"))).alias("b"), F.sum("n").alias("total"))
    return best.select(*key, F.col("b.v").alias(value), (-F.col("b.m")).alias("n"), "total")


def widest_channels(df: DataFrame, k: int) -> DataFrame:
    """The k channels that most units hold, ties by name."""
    return df.groupBy("channel").agg(F.countDistinct("unit").alias("units")).orderBy(F.desc("units"), "channel").limit(k)


def units_with_least(df: DataFrame, n: int) -> DataFrame:
    """The rows of units with at least n readings."""
    enough = df.groupBy("unit").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= n).select("unit")
    return df.join(enough, "unit", "left_semi")


def one_row_per_instant(df: DataFrame, key: Sequence[str] = ("unit", "channel", "time")) -> DataFrame:
    """Repeated instants as one row; `disagrees` marks those whose values differ, which a caller refuses."""
    return df.groupBy(*key).agg(F.min("value").alias("value"), (F.min("value") != F.max("value")).alias("disagrees"), F.count(F.lit(1)).alias("rows"))


def wide_one_row_per_instant(wide: DataFrame, channels: Sequence[str]) -> DataFrame:
    """D7 of wide rows `(unit, time, *channels)`: `one_row_per_instant` of their finite values, grouped before a row is one for each channel."""
    held = _finite(channels)
    each = [F.when(F.count(v) > 0, F.struct(F.min(v).alias("value"), (F.min(v) != F.max(v)).alias("disagrees"), F.count(v).alias("rows"))).alias(f"_{c}") for c, v in zip(channels, held, strict=True)]
    told = _long(wide.groupBy("unit", "time").agg(*each), ["unit", "time"], channels, ["value", "disagrees", "rows"])
    return told.select("unit", "channel", "time", "value", "disagrees", "rows")


def decimate(df: DataFrame, width: float) -> DataFrame:
    """The earliest reading of each bin at its own instant; of one instant the smallest value."""
    first = F.min(F.struct("time", "value")).alias("r")
    return df.groupBy("unit", "channel", F.floor(F.col("time") / width).alias("bin")).agg(first).select("unit", "channel", "bin", "r.time", "r.value")


def scale_within_unit(df: DataFrame) -> DataFrame:
    """Values less their record's mean, over its population deviation; a constant record is centred only."""
    fit = df.groupBy("unit", "channel").agg(F.avg("value").alias("_m"), F.stddev_pop("value").alias("_s"))
    scaled = (F.col("value") - F.col("_m")) / F.when(F.col("_s") > 0, F.col("_s")).otherwise(1.0)
    return df.join(fit, ["unit", "channel"]).withColumn("value", scaled).select(*df.columns)


def hourly_means(df: DataFrame) -> DataFrame:
    """Mean and count of each channel-hour of a unit."""
    return df.groupBy("unit", "channel", F.floor("time").alias("hour")).agg(F.avg("value").alias("mean"), F.count(F.lit(1)).alias("n"))


def _long(wide: DataFrame, key: Sequence[str], channels: Sequence[str], told: Sequence[str]) -> DataFrame:
    """`(key, channel, told)`, a row for each channel whose struct of the row isn't null; rows stay where they are dealt."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), F.col(f"_{c}").alias("told")) for c in channels])).alias("_r")
    return wide.select(*key, each).where("_r.told IS NOT NULL").select(*key, "_r.channel", *[F.col(f"_r.told.{c}").alias(c) for c in told])


def _finite(channels: Sequence[str]) -> list[Column]:
    return [F.when(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf")), F.col(c).cast("double")) for c in channels]


def wide_hourly_means(wide: DataFrame, channels: Sequence[str]) -> DataFrame:
    """D13 of wide rows `(unit, time, *channels)`: `hourly_means` of their finite values, grouped before a row is one for each channel."""
    held = _finite(channels)
    each = [F.when(F.count(v) > 0, F.struct(F.avg(v).alias("mean"), F.count(v).alias("n"))).alias(f"_{c}") for c, v in zip(channels, held, strict=True)]
    told = wide.groupBy("unit", F.floor("time").alias("hour")).agg(*each)
    return _long(told, ["unit", "hour"], channels, ["mean", "n"]).select("unit", "channel", "hour", "mean", "n")


def densify(hourly: DataFrame) -> DataFrame:
    """Every hour from a series' first to its last, null where nothing was read."""
    span = hourly.groupBy("unit", "channel").agg(F.min("hour").alias("a"), F.max("hour").alias("b"))
    axis = span.select("unit", "channel", F.explode(F.sequence("a", "b")).alias("hour"))
    return axis.join(hourly, ["unit", "channel", "hour"], "left")


def fill_forward(dense: DataFrame, value: str = "mean") -> DataFrame:
    """The last value carried on; the gap before the first takes the first."""
    w = Window.partitionBy("unit", "channel").orderBy("hour")
    past = F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    back = Window.partitionBy("unit", "channel").orderBy(F.desc("hour"))  # a frame up to the end is read anew for each row
    coming = F.last(value, ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, 0))
    return dense.withColumn("filled", F.coalesce(past, coming))


def filled_hours(hourly: DataFrame, value: str = "mean") -> DataFrame:
    """D14 and D15 at once, `fill_forward(densify(hourly))` for values without gaps of their own: each hour read lays
    itself out up to the next, so hours without a reading are made where they are filled and never joined or sorted."""
    hourly = hourly.withColumn("hour", F.col("hour").cast("long"))
    till = F.lead("hour").over(Window.partitionBy("unit", "channel").orderBy("hour"))
    own = hourly.select("*", F.col(value).alias("filled"), F.coalesce(till - 1, F.col("hour")).alias("_till"))
    laid = own.select("*", F.explode(F.sequence("hour", "_till")).alias("_at"))
    read = lambda c: F.when(F.col("_at") == F.col("hour"), F.col(c)).alias(c)
    return laid.select("unit", "channel", F.col("_at").alias("hour"), *[read(c) for c in hourly.columns if c not in ("unit", "channel", "hour")], "filled")


def scorable(hourly: DataFrame, context: int = 47, least: int = 24) -> DataFrame:
    """Channel-hours that read in at least `least` of the `context` hours before."""
    w = Window.partitionBy("unit", "channel").orderBy("hour").rangeBetween(-context, -1)
    return hourly.withColumn("before", F.count(F.lit(1)).over(w)).where(F.col("before") >= least)


def time_violations(df: DataFrame) -> DataFrame:
    """Readings of a channel that repeat the instant before; empty if the table keeps the contract."""
    w = Window.partitionBy("unit", "channel").orderBy("time", "value")
    return df.withColumn("previous", F.lag("time").over(w)).where("time <= previous")
