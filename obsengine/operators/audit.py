"""Measures of how a corpus was sampled."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ordering import percentiles


def unit_regime(df: DataFrame) -> DataFrame:
    """Of each unit its span, channels, readings, instants, readings an instant, gap variation and spread of rates."""
    instants = df.groupBy("unit", "time").agg(F.count(F.lit(1)).alias("k"), F.countDistinct("channel").alias("c"))
    gap = F.col("time") - F.lag("time").over(Window.partitionBy("unit").orderBy("time"))
    per_unit = instants.withColumn("gap", gap).groupBy("unit").agg((F.max("time") - F.min("time")).alias("span"), F.sum("k").alias("readings"), F.count(F.lit(1)).alias("instants"), (F.stddev_pop("gap") / F.nullif(F.avg("gap"), F.lit(0.0))).alias("gap_variation"), F.avg("c").alias("channels_an_instant"))
    rates = df.groupBy("unit", "channel").agg(F.count(F.lit(1)).alias("n")).groupBy("unit").agg(F.count(F.lit(1)).alias("channels"), F.log10(F.max("n") / F.min("n")).alias("rate_spread"))
    return per_unit.join(rates, "unit")


def summarise(df: DataFrame, columns: list[str]) -> DataFrame:
    """The 10th, 50th and 90th percentile of each measure."""
    long = df.unpivot([], columns, "measure", "x") if columns else df
    return long.groupBy("measure").agg(*[F.percentile("x", F.lit(q / 100)).alias(f"p{q}") for q in (10, 50, 90)])


def exposure(df: DataFrame) -> DataFrame:
    """U4: readings and their share of all, per unit's part and per channel, in one pass over grouping sets."""
    sets = df.groupingSets([["part"], ["channel"]], "part", "channel").agg(F.count(F.lit(1)).alias("readings"))
    total = df.agg(F.count(F.lit(1)).alias("_all"))
    return sets.crossJoin(F.broadcast(total)).withColumn("share", F.col("readings") / F.col("_all")).drop("_all")


def channel_steps(df: DataFrame) -> DataFrame:
    """Of each channel of all units its readings, first and last, and percentiles of the step between readings."""
    step = F.col("time") - F.lag("time").over(Window.partitionBy("unit", "channel").orderBy("time"))
    rows = df.withColumn("step", step)
    steps = percentiles(rows, "step", [0.5, 0.05, 0.95], ["channel"], "p")
    counts = rows.groupBy("channel").agg(F.count(F.lit(1)).alias("readings"), F.min("time").alias("first"), F.max("time").alias("last"))
    return counts.join(steps, "channel", "left").select("channel", "readings", "first", "last", *[F.get("p", i).alias(f"step_{n}") for i, n in enumerate(("median", "p05", "p95"))])


def channel_pairs(df: DataFrame, width: float = 1.0) -> DataFrame:
    """Of each two channels the share of bins that both read, of those that either reads, over all units."""
    held = df.select("unit", "channel", F.floor(F.col("time") / width).alias("bin")).distinct()
    sizes = held.groupBy("channel").agg(F.count(F.lit(1)).alias("n"))
    other = held.select("unit", "bin", F.col("channel").alias("other"))
    both = held.join(other, ["unit", "bin"]).where("channel < other").groupBy("channel", "other").agg(F.count(F.lit(1)).alias("both"))
    rows = both.join(sizes, "channel").join(sizes.select(F.col("channel").alias("other"), F.col("n").alias("m")), "other")
    return rows.select("channel", "other", "both", (F.col("both") / (F.col("n") + F.col("m") - F.col("both"))).alias("share"))


def repeated_instants(df: DataFrame) -> DataFrame:
    """How many rows an instant of a unit and channel stands on, and how many instants that is."""
    return df.groupBy("unit", "channel", "time").agg(F.count(F.lit(1)).alias("rows")).groupBy("rows").agg(F.count(F.lit(1)).alias("instants"))


def location_summary(results: DataFrame, least: int) -> DataFrame:
    """Of each location its results and, for its most frequent organisation (ties by name), the share, finite
    readings, those with a date only, those timed without a known zone, and whether at least `least` readings are kept.

    `results`: `(location, organisation, value, dated_only, unzoned)`.
    """
    readable = F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf"))
    each = results.groupBy("location", "organisation").agg(F.count(F.lit(1)).alias("n"), F.count_if(readable).alias("readings"), F.count_if(readable & F.col("dated_only")).alias("dated_only"), F.count_if(readable & F.col("unzoned")).alias("unzoned"))
    most = F.min(F.struct((-F.col("n")).alias("n"), "organisation", "readings", "dated_only", "unzoned")).alias("o")
    rows = each.groupBy("location").agg(F.sum("n").alias("results"), most)
    return rows.select("location", "results", "o.organisation", (-F.col("o.n") / F.col("results")).alias("organisation_share"), "o.readings", "o.dated_only", "o.unzoned", (F.col("o.readings") >= least).alias("kept"))


def monthly_regime(readings: DataFrame, origin: str) -> DataFrame:
    """The sampling regime (U1) of each calendar month of all units together; times are hours from `origin`."""
    at = F.timestamp_add("HOUR", F.floor("time").cast("int"), F.lit(origin).cast("timestamp_ntz"))
    return unit_regime(readings.withColumn("unit", F.date_format(at, "yyyy-MM")).select("unit", "channel", "time", "value"))
