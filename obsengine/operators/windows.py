"""Windows over units, readings in windows, tokens, cells and grids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

WIN = ("unit", "position")


def units_of(readings: DataFrame) -> DataFrame:
    """Units with half-open extents in whole hours that hold all their readings."""
    return readings.groupBy("unit").agg(F.floor(F.min("time")).cast("double").alias("extent_start"), (F.floor(F.max("time")) + 1).cast("double").alias("extent_end"))


def windows_over(units: DataFrame, length: float, stride: float, keep_short: bool = False) -> DataFrame:
    """Windows from the extent's start, those that fit; with `keep_short` a short unit has one nominal window."""
    fit = F.floor((F.col("extent_end") - F.col("extent_start") - length) / stride + 1e-9).cast("int")
    last = F.greatest(fit, F.lit(0)) if keep_short else fit
    rows = units.withColumn("last", last).where("last >= 0")
    rows = rows.select("unit", "extent_start", F.explode(F.sequence(F.lit(0), "last")).alias("position"))
    start = F.col("extent_start") + F.col("position") * stride
    return rows.select("unit", "position", start.alias("win_start"), (start + length).alias("win_end"))


def assign_windows(readings: DataFrame, units: DataFrame, length: float, stride: float) -> DataFrame:
    """Each reading in every window that holds it, by its index range: no join on ranges.

    `(unit, channel, time, value, position, win_start)`; only the units' extents are joined, on the unit.
    """
    at = F.col("time") - F.col("extent_start")
    low = F.greatest(F.floor((at - length) / stride).cast("int"), F.lit(0))
    fit = F.floor((F.col("extent_end") - F.col("extent_start") - length) / stride + 1e-9).cast("int")
    high = F.least(F.floor(at / stride).cast("int") + 1, fit)
    rows = readings.join(units, "unit").withColumn("_low", low).withColumn("_high", high).where("_low <= _high")
    rows = rows.select(*readings.columns, "extent_start", F.explode(F.sequence("_low", "_high")).alias("position"))
    rows = rows.withColumn("win_start", F.col("extent_start") + F.col("position") * stride)
    return rows.where((F.col("time") >= F.col("win_start")) & (F.col("time") < F.col("win_start") + length)).drop("extent_start")


def tokenise(assigned: DataFrame, length: float, statics: DataFrame | None = None) -> DataFrame:
    """Time as a fraction of the window, and the gap since the channel's last token in it, or its start.

    `statics` are a unit's descriptors `(unit, channel, value)`: each is a token of every window of its unit that holds
    a reading, with time and gap 0, and `timeless` tells these tokens from the others.
    """
    w = Window.partitionBy(*WIN, "channel").orderBy("time", "value")
    t = (F.col("time") - F.col("win_start")) / length
    rows = assigned.withColumn("time", t)
    out = rows.withColumn("gap", F.col("time") - F.coalesce(F.lag("time").over(w), F.lit(0.0))).select("unit", "position", "channel", "value", "time", "gap")
    if statics is not None:
        told = assigned.select("unit", "position").distinct().join(statics.select("unit", "channel", F.col("value").cast("double").alias("value")), "unit")
        told = told.select("unit", "position", "channel", "value", F.lit(0.0).alias("time"), F.lit(0.0).alias("gap"), F.lit(True).alias("timeless"))
        return out.withColumn("timeless", F.lit(False)).unionByName(told)
    return out


def empty_units(units: DataFrame, assigned: DataFrame) -> DataFrame:
    """Units left without a window that holds a reading."""
    return units.select("unit").join(assigned.select("unit").distinct(), "unit", "left_anti")


def pack_windows(tokens: DataFrame, length: int | None = None) -> DataFrame:
    """A row for each window with its tokens in canonical order.

    With `length` each window's tokens are filled up to it with zeros without channel, and `mask` is true where a token
    stands; a window with more tokens is refused.
    """
    packed = tokens.groupBy(*WIN).agg(F.sort_array(F.collect_list(F.struct("time", "channel", "value", "gap"))).alias("tokens"))
    if length is None:
        return packed
    n, kinds = F.size("tokens"), dict(tokens.dtypes)
    blank = F.struct(*[(F.lit(None) if c == "channel" else F.lit(0.0)).cast(kinds[c]).alias(c) for c in ("time", "channel", "value", "gap")])
    fits = F.when(n > length, F.raise_error(F.lit(f"a window holds more than {length} tokens"))).otherwise(F.lit(length) - n)
    return packed.select(*WIN, F.concat("tokens", F.array_repeat(blank, fits)).alias("tokens"), F.concat(F.array_repeat(F.lit(True), n), F.array_repeat(F.lit(False), fits)).alias("mask"))


def window_counts(units: DataFrame, length: float, stride: float) -> DataFrame:
    """How many windows each unit has, in closed form."""
    n = F.floor((F.col("extent_end") - F.col("extent_start") - length) / stride + 1e-9) + 1
    return units.select("unit", F.greatest(n, F.lit(0)).alias("windows"))


def step_of(time: str, steps: int):
    """The bin of a time from 0 to 1, with the tolerance that stored times need."""
    return F.least(F.floor(F.col(time) * steps + 1e-3), F.lit(steps - 1)).cast("int")


def cells(tokens: DataFrame, bins: int, frame: DataFrame | None = None) -> DataFrame:
    """A row for each bin of each channel that a window holds.

    An empty bin carries the last value on (null before the first reading). `last_offset` is how far the last reading
    lies into its bin, `since` how many bins ago the channel was last read. Channels that only `frame` holds, tokens
    too, are laid out empty.
    """
    b = step_of("time", bins)
    read = tokens.withColumn("bin", b).groupBy(*WIN, "channel", "bin").agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.min("value").alias("minimum"), F.max("value").alias("maximum"),
        F.min(F.struct("time", "value"))["value"].alias("first"), F.max(F.struct("time", "value")).alias("latest"))
    if frame is None:  # a series' bins are packed in a row: readings are laid out once, and nothing is joined
        told = [c for c in read.columns if c not in (*WIN, "channel")]
        packed = read.groupBy(*WIN, "channel").agg(F.map_from_entries(F.collect_list(F.struct("bin", F.struct(*[c for c in told if c != "bin"])))).alias("_read"))
        named = reduce(lambda a, c: a & F.col(c).isNotNull(), (*WIN, "channel"), F.lit(True))
        rows = packed.select(*WIN, "channel", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.when(named, F.try_element_at("_read", i)))).alias("bin", "_cell"))
        rows = rows.select(*WIN, "channel", "bin", *[F.col(f"_cell.{c}").alias(c) for c in told if c != "bin"])
    else:
        held = frame.select(*WIN, "channel").distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
        rows = held.join(read, [*WIN, "channel", "bin"], "left")
    w = Window.partitionBy(*WIN, "channel").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    carried = F.last(F.col("latest.value"), ignorenulls=True).over(w)
    seen = F.last(F.when(F.col("n").isNotNull(), F.col("bin")), ignorenulls=True).over(w)
    value = lambda c: F.coalesce(F.col(c), carried).alias(c)
    return rows.select(
        *WIN, "channel", "bin", F.col("n").isNotNull().cast("int").alias("presence"), F.log1p(F.coalesce("n", F.lit(0))).alias("log_count"), value("mean"), value("minimum"), value("maximum"), value("first"), carried.alias("last"),
        (F.col("latest.time") * bins - F.col("bin")).alias("last_offset"), (F.col("bin") - seen).alias("since"))


def cells_without(tokens: DataFrame, hidden: DataFrame, bins: int) -> DataFrame:
    """Cells as if the readings of the cells `hidden` `(unit, position, channel, bin)` were never taken."""
    visible = tokens.withColumn("bin", step_of("time", bins)).join(hidden, [*WIN, "channel", "bin"], "left_anti").drop("bin")
    return cells(visible, bins, tokens)


def rollup_cells(cells: DataFrame, factor: int) -> DataFrame:
    """Coarser cells from finer ones, equal to laying out the readings whole: counts add, means are weighted."""
    read = cells.where("presence = 1").withColumn("n", F.round(F.expm1("log_count")))
    return read.groupBy(*WIN, "channel", F.floor(F.col("bin") / factor).alias("bin")).agg(
        F.sum("n").cast("long").alias("n"), (F.sum(F.col("mean") * F.col("n")) / F.sum("n")).alias("mean"), F.min("minimum").alias("minimum"), F.max("maximum").alias("maximum"),
        F.min(F.struct("bin", "first"))["first"].alias("first"), F.max(F.struct("bin", "last"))["last"].alias("last"))


def regular_grid(tokens: DataFrame, steps: int) -> DataFrame:
    """The latest reading of each step, carried on, 0 before the first; `observed` marks steps that read."""
    read = tokens.withColumn("step", step_of("time", steps)).groupBy(*WIN, "channel", "step").agg(F.max(F.struct("time", "value"))["value"].alias("read"))
    held = tokens.select(*WIN, "channel").distinct().withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
    w = Window.partitionBy(*WIN, "channel").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    rows = held.join(read, [*WIN, "channel", "step"], "left")
    return rows.select(*WIN, "channel", "step", F.coalesce(F.last("read", ignorenulls=True).over(w), F.lit(0.0)).alias("value"), F.col("read").isNotNull().cast("int").alias("observed"))
