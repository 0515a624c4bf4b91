"""Zero-label anomaly detectors: windows that depart from their own recent history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ordering import kept, median, percentiles
from .windows import step_of

VALUES = ("mean", "minimum", "maximum", "last", "log_count")


def window_summaries(tokens: DataFrame) -> DataFrame:
    """A1: five values for each channel and window."""
    return tokens.groupBy("unit", "position", "channel").agg(F.avg("value").alias("mean"), F.min("value").alias("minimum"), F.max("value").alias("maximum"), F.max(F.struct("time", "value"))["value"].alias("last"), F.log1p(F.count(F.lit(1))).alias("log_count"))


def departure_floor(summaries: DataFrame) -> DataFrame:
    """A2: of each channel and value a tenth of the scaled median absolute deviation; without spread the median of the rest, else 1."""
    long = kept(summaries.unpivot(["channel"], list(VALUES), "kind", "x"))
    mid = median(long, "x", ["channel", "kind"], "mid")
    off = long.join(mid, ["channel", "kind"]).select("channel", "kind", F.abs(F.col("x") - F.col("mid")).alias("off"))
    mad = median(off, "off", ["channel", "kind"], "mad").select("channel", "kind", (F.col("mad") * 0.14826).alias("floor"))
    rest = mad.where("floor > 0").groupBy("kind").agg(F.median("floor").alias("rest"))
    return mad.join(rest, "kind", "left").select("channel", "kind", F.when(F.col("floor") > 0, F.col("floor")).otherwise(F.coalesce("rest", F.lit(1.0))).alias("floor"))


def histories(summaries: DataFrame, span: int = 6) -> DataFrame:
    """`summaries` with, of each value, the median and its absolute deviations' median (`mid_*`, `mad_*`) over the unit's
    `span - 1` windows before, null where under half of them read. Floors don't touch it, so several can share it.

    A window and channel stays one row: five arrays of at most `span - 1` numbers each, in one pass by unit and channel.
    """
    w = Window.partitionBy("unit", "channel").orderBy("position").rangeBetween(-(span - 1), -1)
    middle = lambda a: (F.get(a, F.floor((F.size(a) - 1) / 2).cast("int")) + F.get(a, F.floor(F.size(a) / 2).cast("int"))) / 2
    rows = summaries.select("unit", "position", "channel", *VALUES, *[F.collect_list(k).over(w).alias(f"_h_{k}") for k in VALUES])
    rows = rows.withColumns({f"_h_{k}": F.when(2 * F.size(f"_h_{k}") >= span - 1, F.sort_array(f"_h_{k}")) for k in VALUES})
    rows = rows.withColumns({f"mid_{k}": middle(F.col(f"_h_{k}")) for k in VALUES})
    off = lambda k: F.sort_array(F.transform(f"_h_{k}", lambda v: F.abs(v - F.col(f"mid_{k}"))))
    rows = rows.withColumns({f"_off_{k}": off(k) for k in VALUES})
    return rows.select("unit", "position", "channel", *VALUES, *[f"mid_{k}" for k in VALUES], *[middle(F.col(f"_off_{k}")).alias(f"mad_{k}") for k in VALUES])


def departures_of(told: DataFrame, floor: DataFrame) -> DataFrame:
    """A3 of `histories` over max(1.4826 MAD, floor); channels without a floor take no part."""
    floors = floor.groupBy("channel").agg(*[F.max(F.when(F.col("kind") == k, F.col("floor"))).alias(f"floor_{k}") for k in VALUES])
    of = lambda k: F.when(F.col(f"mid_{k}").isNotNull(), F.abs(F.col(k) - F.col(f"mid_{k}")) / F.greatest(1.4826 * F.col(f"mad_{k}"), F.col(f"floor_{k}"))).otherwise(0.0)
    largest = F.greatest(*[F.when(F.col(f"floor_{k}").isNotNull(), of(k)) for k in VALUES])
    return told.join(F.broadcast(floors), "channel").select("unit", "position", "channel", largest.alias("departure"))  # a row a channel


def channel_departures(summaries: DataFrame, floor: DataFrame, span: int = 6) -> DataFrame:
    """A3: how far each channel of a window lies from the median of its windows before, over max(1.4826 MAD, floor).

    The history is the unit's `span - 1` windows before; where under half of it reads, the departure is 0. The
    largest over the five values counts.
    """
    return departures_of(histories(summaries, span), floor)


def bin_summaries(tokens: DataFrame, bins: int) -> DataFrame:
    """A1 by bins: five values for each channel of each bin of a window; a bin without readings has no row."""
    rows = tokens.withColumn("bin", step_of("time", bins))
    return rows.groupBy("unit", "position", "channel", "bin").agg(F.avg("value").alias("mean"), F.min("value").alias("minimum"), F.max("value").alias("maximum"), F.max(F.struct("time", "value"))["value"].alias("last"), F.log1p(F.count(F.lit(1))).alias("log_count"))


def bin_departures(bins: DataFrame, floor: DataFrame, span: int = 6) -> DataFrame:
    """A3 by bins: how far each channel's bins of a window lie from the median of all bins of its windows before.

    `bins`: `bin_summaries`; `floor`: `departure_floor` of window or of bin summaries. The largest over bins and values
    counts. Where under half of the `span - 1` windows before hold a reading the departure is 0: a window counts once
    however many of its bins do, and an empty bin adds nothing to its history. A window and channel is one row, so
    the history is shuffled once for all five values and holds `span - 1` times the bins at most.
    """
    w = Window.partitionBy("unit", "channel").orderBy("position").rangeBetween(-(span - 1), -1)
    rows = bins.groupBy("unit", "channel", "position").agg(F.collect_list(F.struct(*VALUES)).alias("now"))
    rows = rows.withColumn("before", F.collect_list("now").over(w)).withColumn("held", F.flatten("before"))
    floors = floor.groupBy("channel").agg(*[F.max(F.when(F.col("kind") == k, F.col("floor"))).alias(f"floor_{k}") for k in VALUES])
    middle = lambda a: (F.get(a, F.floor((F.size(a) - 1) / 2).cast("int")) + F.get(a, F.floor(F.size(a) / 2).cast("int"))) / 2
    rows = rows.join(floors, "channel").withColumns({f"h_{k}": F.sort_array(F.col(f"held.{k}")) for k in VALUES})
    rows = rows.withColumns({f"mid_{k}": middle(F.col(f"h_{k}")) for k in VALUES})
    off = lambda k: F.transform(f"h_{k}", lambda v: F.abs(v - F.col(f"mid_{k}")))
    rows = rows.withColumns({f"off_{k}": F.sort_array(off(k)) for k in VALUES})
    rows = rows.withColumns({f"scale_{k}": F.greatest(1.4826 * middle(F.col(f"off_{k}")), F.col(f"floor_{k}")) for k in VALUES})
    largest = F.array_max(F.transform("now", lambda s: F.greatest(*[F.abs(s[k] - F.col(f"mid_{k}")) / F.col(f"scale_{k}") for k in VALUES])))
    return rows.select("unit", "position", "channel", F.when(2 * F.size("before") >= span - 1, largest).otherwise(0.0).alias("departure"))


def window_score(departures: DataFrame) -> DataFrame:
    """A4: a window's largest and mean departure."""
    return departures.groupBy("unit", "position").agg(F.max("departure").alias("score"), F.avg("departure").alias("mean_score"))


def spread_of(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """`(*by, centre, spread)`: median and scaled median absolute deviation; a deviation of rounding alone is 0."""
    mid = median(rows, value, by, "centre")
    joined = rows.join(mid, by) if by else rows.crossJoin(F.broadcast(mid))
    off = median(joined.select(*by, F.abs(F.col(value) - F.col("centre")).alias("off")), "off", by, "mad")
    both = mid.join(off, by) if by else mid.crossJoin(off)
    scaled = 1.4826 * F.col("mad")
    return both.select(*by, "centre", F.when(scaled > 1e-9 * (1 + F.abs("centre")), scaled).otherwise(0.0).alias("spread"))


def against_own_unit(scores: DataFrame, fallback: DataFrame) -> DataFrame:
    """`scores` with `read`: the score less its unit's median over the unit's spread, or `fallback`'s where it has none.

    A unit's scores meet where they lie, as its history did; a unit without a score has no row.
    """
    w = Window.partitionBy("unit")
    own = scores.where("unit IS NOT NULL").withColumn("centre", F.median("score").over(w)).where("centre IS NOT NULL")
    own = own.withColumn("_mad", 1.4826 * F.median(F.abs(F.col("score") - F.col("centre"))).over(w)).crossJoin(F.broadcast(fallback))
    spread = F.when(F.col("_mad") > 1e-9 * (1 + F.abs("centre")), F.col("_mad"))
    return own.withColumn("read", (F.col("score") - F.col("centre")) / F.coalesce(spread, F.col("fallback"))).drop("centre", "_mad", "fallback")


def score_alarm(scores: DataFrame, contamination: float, fitting: DataFrame | None = None, per_unit: bool = False) -> DataFrame:
    """A5: scores less the level that a share `contamination` of the fitting scores exceeds; one number is broadcast.

    With `per_unit` each score is first read against its own unit's scores, in `read`; a unit without a spread takes
    that of all fitting scores, else 1.
    """
    value = "score"
    scores = kept(scores)  # they end a long chain and are read several times
    if per_unit:
        of = spread_of(scores if fitting is None else fitting, "score", [])
        fallback = of.select(F.when(F.col("spread") > 0, F.col("spread")).otherwise(1.0).alias("fallback"))
        fitting = fitting if fitting is None else against_own_unit(fitting, fallback)
        scores, value = kept(against_own_unit(scores, fallback)), "read"
    level = percentiles(scores if fitting is None else fitting, value, [1 - contamination], to="_p").select(F.get("_p", 0).alias("level"))
    return scores.crossJoin(F.broadcast(level)).withColumn("alarm", F.col(value) - F.col("level"))


def mean_distance(rows: DataFrame, vector: str, dim: int, fitting: DataFrame | None = None) -> DataFrame:
    """Squared Euclidean distance from the fitting rows' mean, and the largest single square."""
    fit = (rows if fitting is None else fitting).select(F.posexplode(vector)).groupBy("pos").agg(F.avg("col").alias("m"))
    mean = fit.agg(F.sort_array(F.collect_list(F.struct("pos", "m")))["m"].alias("_mean"))
    squares = F.zip_with(F.col(vector), F.col("_mean"), lambda x, m: (x - m) * (x - m))
    out = rows.crossJoin(F.broadcast(mean)).withColumn("_sq", squares)
    return out.withColumn("distance", F.aggregate("_sq", F.lit(0.0), lambda s, x: s + x)).withColumn("farthest", F.array_max("_sq")).drop("_mean", "_sq")
