"""Rules that name, admit and refuse readings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ordering import sorted_position


def qualify_by_condition(rows: DataFrame, conditions: DataFrame, settings: Sequence[str], tolerance: float) -> DataFrame:
    """`condition` of each row: the first whose settings all lie within `tolerance`; null where none does.

    `conditions`: `(condition, <settings>)`, a few rows that every task holds.
    """
    lists = conditions.agg(F.sort_array(F.collect_list(F.struct("condition", *[F.col(s).alias(f"_{s}") for s in settings]))).alias("_c"))
    fits = lambda c: F.forall(F.array(*[F.abs(F.col(s) - c[f"_{s}"]) <= tolerance for s in settings]), lambda x: F.coalesce(x, F.lit(False)))
    return rows.crossJoin(F.broadcast(lists)).withColumn("condition", F.get(F.filter("_c", fits), F.lit(0))["condition"]).drop("_c")


def map_codes(rows: DataFrame, codes: DataFrame, code: str) -> DataFrame:
    """Rows under their code's channel; `codes` `(code, channel)` is a small map, unmapped rows go."""
    return rows.join(F.broadcast(codes.select(F.col("code").alias(code), "channel")), code).drop(code)


def label_rules(column: Column | str, prefix: str, words: Sequence[str], not_words: Sequence[str] = ()) -> Column:
    """Whether a path starts with a prefix and holds any of some words and none of others, in any case."""
    low = F.lower(column)
    holds = lambda w: low.contains(w.lower())
    out = low.startswith(prefix.lower()) & F.array_contains(F.array(*map(holds, words)), True)
    return out & ~F.array_contains(F.array(*map(holds, not_words)), True) if not_words else out


def presence_tokens(rows: DataFrame, kind: str, code: str) -> DataFrame:
    """P5: a category as a timeless channel of its own with value 1; null is no category."""
    return rows.where(F.col(code).isNotNull()).select("unit", F.concat(F.lit(f"{kind}/"), F.col(code).cast("string")).alias("channel"), F.lit(1.0).alias("value"))


def fraction_to_percent(rows: DataFrame, channel: str, largest: float = 1.0) -> DataFrame:
    """A channel that is written as fraction or percent, in percent: values up to `largest` are fractions."""
    return rows.withColumn("value", F.when((F.col("channel") == channel) & (F.col("value") <= largest), F.col("value") * 100).otherwise(F.col("value")))


def within_extent(rows: DataFrame, units: DataFrame) -> DataFrame:
    """Readings from their unit's start on and before its end."""
    return rows.join(units.select("unit", "extent_start", "extent_end"), "unit").where("time >= extent_start AND time < extent_end").drop("extent_start", "extent_end")


def exclude_named(rows: DataFrame, names: Sequence[str], key: str = "unit") -> DataFrame:
    """P10: rows but those of the named keys; a name that matches nothing is refused."""
    held = {r[0] for r in rows.where(F.col(key).isin(*names)).select(key).distinct().collect()}  # at most the names
    if set(names) - held:
        raise ValueError(f"nothing is named {sorted(set(names) - held)}")
    return rows.where(~F.col(key).isin(*names))


def admit(rows: DataFrame, stats: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Readings on fitted channels, and `(unit, ignored)`: the others' names of each unit, `readable` false if none is left."""
    known = rows.join(F.broadcast(stats.select("channel", F.lit(True).alias("_known"))), "channel", "left")
    told = known.groupBy("unit").agg(F.sort_array(F.collect_set(F.when(F.col("_known").isNull(), F.col("channel")))).alias("ignored"), F.coalesce(F.bool_or("_known"), F.lit(False)).alias("readable"))
    return known.where("_known").drop("_known"), told


def adopt_statistics(vocabulary: DataFrame, source: DataFrame, key: Sequence[str] = ("channel",)) -> DataFrame:
    """A vocabulary with another corpus's statistics; a channel that has none there is refused in the task."""
    held = vocabulary.join(source.withColumn("_held", F.lit(True)), list(key), "left")
    return held.withColumn(key[0], F.when(F.col("_held"), F.col(key[0])).otherwise(F.raise_error(F.concat(F.lit("no statistics of "), F.col(key[0]))))).drop("_held")


def implausible(rows: DataFrame, ranges: DataFrame) -> DataFrame:
    """Of each channel with a physical range the readings outside, the hours they touch and the commonest, to a tenth."""
    bad = rows.join(F.broadcast(ranges.select("channel", "lowest", "highest")), "channel").where("value < lowest OR value > highest")
    common = bad.groupBy("channel", F.round("value", 1).alias("v")).agg(F.count(F.lit(1)).alias("n")).groupBy("channel").agg(F.min(F.struct((-F.col("n")).alias("n"), "v"))["v"].alias("commonest"))
    return bad.groupBy("channel").agg(F.count(F.lit(1)).alias("outside"), F.countDistinct("unit", F.floor("time")).alias("hours")).join(common, "channel")


def round_trip_residual(rows: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """The largest deviations in value and time between readings and their reconstruction, paired by order of time."""
    nth = F.row_number().over(Window.partitionBy("unit", "channel").orderBy("time", "value"))
    a = rows.select("unit", "channel", "time", "value").withColumn("nth", nth)
    b = rebuilt.select("unit", "channel", "time", "value").withColumn("nth", nth).withColumnsRenamed({"time": "time_b", "value": "value_b"})
    both = a.join(b, ["unit", "channel", "nth"], "full_outer")
    return both.groupBy("channel").agg(F.max(F.abs(F.col("value") - F.col("value_b"))).alias("value_off"), F.max(F.abs(F.col("time") - F.col("time_b"))).alias("time_off"), F.count_if(F.col("value").isNull() | F.col("value_b").isNull()).alias("unpaired"))


def split_by_names(units: DataFrame, names: Sequence[str], side: str = "held_out") -> DataFrame:
    """The named units on one side, the others training; an unknown name is refused."""
    exclude_named(units, names)
    return units.withColumn("side", F.when(F.col("unit").isin(*names), side).otherwise("training"))


def seen_unseen(scored: DataFrame, share: DataFrame) -> DataFrame:
    """`seen` of each scored unit: whether a share had read it."""
    flag = share.select("unit").distinct().withColumn("seen", F.lit(True))
    return scored.join(flag, "unit", "left").withColumn("seen", F.coalesce("seen", F.lit(False)))


def outcome_labels(windows: DataFrame, outcomes: DataFrame, outcome: str) -> DataFrame:
    """L2: the unit's 0 or 1 on each of its windows; anything else is refused, null included."""
    bit = F.when(F.col(outcome).isin(0, 1), F.col(outcome)).otherwise(F.raise_error(F.lit("an outcome is neither 0 nor 1")))
    return windows.join(outcomes.select("unit", bit.cast("long").alias("target")), "unit")


def turns_later(windows: DataFrame, hours: DataFrame, length: float) -> DataFrame:
    """L3: whether a label turns after the first window, for windows that end at first hour + length and before it turns."""
    turned = hours.groupBy("unit").agg(F.min("hour").alias("first"), F.min(F.when(F.col("label") == 1, F.col("hour"))).alias("turned"))
    rows = windows.join(turned, "unit").where((F.col("win_end") == F.col("first") + length) & (F.col("turned").isNull() | (F.col("turned") >= F.col("win_end"))))
    return rows.select("unit", "position", F.col("turned").isNotNull().cast("long").alias("target"))


def overlap_marked_rows(assigned: DataFrame, mark: Column) -> DataFrame:
    """Windows that hold a marked reading take their unit's number among the units with marks, the others 0."""
    held = assigned.groupBy("unit", "position").agg(F.coalesce(F.bool_or(mark), F.lit(False)).alias("marked"))
    numbers = sorted_position(held.where("marked").select("unit").distinct(), ["unit"], "number")
    return held.join(numbers, "unit", "left").select("unit", "position", F.when(F.col("marked"), F.col("number")).otherwise(0).cast("long").alias("event"))


def unit_events(units: DataFrame, anomaly: str = "anomaly") -> DataFrame:
    """An anomalous unit is an event of its own, numbered from 1 by name; other units are 0."""
    odd = F.coalesce(F.col(anomaly) > 0, F.lit(False))
    return sorted_position(units.where(odd), ["unit"], "event").unionByName(units.where(~odd).withColumn("event", F.lit(0).cast("long")))


def consolidate_events(rows: DataFrame, channels: Sequence[str], scored: Sequence[str]) -> DataFrame:
    """One span per event over the chosen channels; events of the scored categories are numbered in file order, others -1."""
    own = rows.where(F.col("channel").isin(*channels)).groupBy("event", "category").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("row").alias("row"))
    counts = F.coalesce(F.col("category").isin(*scored), F.lit(False))
    nth = F.row_number().over(Window.partitionBy(counts).orderBy("row", "event"))
    return own.withColumn("number", F.when(counts, nth).otherwise(-1).cast("long")).drop("row")


def label(windows: DataFrame, truths: DataFrame) -> DataFrame:
    """Windows with their target; one without a truth is refused, one with a negative target isn't scored."""
    held = windows.join(truths.select("unit", "position", "target"), ["unit", "position"], "left")
    checked = F.when(F.col("target").isNotNull(), F.col("target")).otherwise(F.raise_error(F.concat(F.lit("no truth for "), F.col("unit"))))
    return held.withColumn("target", checked).where("target >= 0")


def event_annotations(predictions: DataFrame, classes: DataFrame, taught: Sequence[str]) -> DataFrame:
    """Each event's class and the half it lies in: `taught` or `untaught`; normal windows are in both."""
    rows = predictions.join(classes.select("event", "class"), "event", "left")
    half = F.when(F.col("event") == 0, F.array(F.lit("taught"), F.lit("untaught"))).otherwise(F.array(F.when(F.col("class").isin(*taught), "taught").otherwise("untaught")))
    return rows.withColumn("half", F.explode(half))
