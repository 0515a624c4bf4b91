"""Readings in long form from wide or event tables: `(unit, channel, time, value)`, time in hours on a fixed axis."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ORIGIN = "2024-01-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hours_since(ts: str, origin: str = ORIGIN) -> Column:
    """Hours from a fixed origin to an instant, to the microsecond."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'{origin}', {ts})") / F.lit(3.6e9)


def local_to_utc(df: DataFrame, local: str, zone: str, transitions: DataFrame, origin: str = ORIGIN, to: str = "time") -> DataFrame:
    """`df` with the UTC hours since `origin` of a local clock, to the minute.

    `local` is a timestamp without zone, `zone` a name read without case and outer spaces. `transitions`: `(zone, since,
    minutes)`, from the UTC instant `since` on (null: from ever) clocks are `minutes` ahead of UTC; few rows a zone. A
    clock time that a change skips is read by the offset before it, one that comes twice is its first. A time before a
    zone's first row takes that row's offset. An unknown or null zone is UTC; a null clock gives null.
    """
    minute = lambda c: F.floor(F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'{origin}', `{c}`)") / F.lit(6e7)).cast("long")
    name = lambda c: F.upper(F.trim(F.col(c)))
    rows = transitions.select(name("zone").alias("_zone"), minute("since").alias("_since"), F.col("minutes").cast("long").alias("_minutes"))
    ahead = F.greatest("_minutes", F.lag("_minutes").over(Window.partitionBy("_zone").orderBy(F.asc_nulls_first("_since"))))
    rows = rows.withColumn("_from", F.coalesce(F.col("_since") + ahead, F.lit(-(1 << 62))))
    offsets = rows.groupBy("_zone").agg(F.sort_array(F.collect_list(F.struct("_from", "_minutes"))).alias("_offsets"))
    held = df.withColumns({"_key": name(zone), "_local": minute(local)}).join(offsets, F.col("_key") == F.col("_zone"), "left")
    begun = F.filter("_offsets", lambda o: o["_from"] <= F.col("_local"))
    offset = F.coalesce(F.try_element_at(begun, F.lit(-1))["_minutes"], F.get("_offsets", F.lit(0))["_minutes"], F.lit(0))
    return held.withColumn(to, (F.col("_local") - offset) / 60.0).drop("_key", "_local", "_zone", "_offsets")


def event_readings(events: DataFrame, unit: str = "user_id", origin: str = ORIGIN) -> DataFrame:
    """An event table as readings; rows without a finite value are absent, not null."""
    rows = events.select(F.col(unit).cast("string").alias("unit"), F.col("event_type").alias("channel"), hours_since("ts", origin).alias("time"), F.col("value").alias("value"))
    return finite(rows)


def finite(df: DataFrame, value: str = "value") -> DataFrame:
    """Rows whose value is a finite number."""
    return df.where(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(F.col(value)) < float("inf")))


def to_long(df: DataFrame, ids: Sequence[str], channels: Sequence[str]) -> DataFrame:
    """A row for each channel that a wide row holds."""
    wide = df.select(*ids, *[F.col(c).cast("double").alias(c) for c in channels])
    return finite(wide.unpivot(list(ids), list(channels), "channel", "value"))


LINE_CHANNELS = ["quantity", "price", "discount", "tax"]


def order_line_values(lineitem: DataFrame) -> DataFrame:
    """A wide row of four values per order line: its supplier and ship date, in hours from 1995."""
    return lineitem.select(F.col("l_suppkey").cast("string").alias("unit"), hours_since("l_shipdate", "1995-01-01 00:00:00").alias("time"), "l_orderkey", "l_linenumber", F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"))


def order_line_readings(lineitem: DataFrame) -> DataFrame:
    """Readings of four channels per supplier by ship date, in hours from 1995."""
    return to_long(order_line_values(lineitem), ["unit", "time", "l_orderkey", "l_linenumber"], LINE_CHANNELS)


def describe(readings: DataFrame) -> DataFrame:
    """Units, readings and channels, and an order-free fingerprint of the content: units, channels, times in
    microseconds and values in millionths. Equal readings cancel in the exclusive or, so their sum modulo 2^60 stands beside it."""
    micro = lambda c, by: F.round(F.col(c) * by).cast("long").cast("string")
    text = F.concat_ws("|", F.coalesce("unit", F.lit("")), F.coalesce("channel", F.lit("")), micro("time", 3.6e9), micro("value", 1e6))
    key = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")
    return readings.agg(F.countDistinct("unit").alias("units"), F.count(F.lit(1)).alias("readings"), F.countDistinct("channel").alias("channels"), F.bit_xor(key).alias("fingerprint"), (F.sum(key.cast("decimal(19,0)")) % F.lit(1 << 60)).cast("long").alias("total"))
