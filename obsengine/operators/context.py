"""What windows, hours and units owe to their neighbours in time: history, smoothing, correlation, nearest readings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ordering import median


def windows_before(windows: DataFrame, count: int, length: float) -> DataFrame:
    """For each k from 1 to `count` the window of the unit that ends nearest k lengths earlier.

    Within half a length, of equally near ones the earlier. Ends are met by equality of their rounded slot and its
    neighbours, so no unit's windows are compared all with all.
    """
    slot = lambda c: F.round(c / length).cast("long")
    asked = windows.select("unit", "position", "win_end", F.explode(F.sequence(F.lit(1), F.lit(count))).alias("k"))
    asked = asked.withColumn("goal", F.col("win_end") - F.col("k") * length).withColumn("slot", F.explode(F.array(*[slot(F.col("goal")) + d for d in (-1, 0, 1)])))
    held = windows.select("unit", F.col("position").alias("before"), F.col("win_end").alias("ends"), slot(F.col("win_end")).alias("slot"))
    near = asked.join(held, ["unit", "slot"]).where((F.abs(F.col("ends") - F.col("goal")) <= length / 2) & (F.col("ends") < F.col("win_end")))
    best = near.groupBy("unit", "position", "k").agg(F.min(F.struct(F.abs(F.col("ends") - F.col("goal")).alias("off"), "ends", "before")).alias("b"))
    return best.select("unit", "position", "k", "b.before", "b.ends")


def join_history(cells: DataFrame, windows: DataFrame, count: int, length: float, bins: int) -> DataFrame:
    """Each window's cells and those of the `count - 1` windows before it on one axis of `count * bins` bins.

    A place whose window doesn't end within 1 % of a length of where it should is empty. Windows that overlap are
    refused.
    """
    if interleaved_units(windows).limit(1).count():
        raise ValueError("windows of a unit overlap")
    before = windows_before(windows, count - 1, length).join(windows.select("unit", "position", "win_end"), ["unit", "position"])
    near = before.where(F.abs(F.col("win_end") - F.col("k") * length - F.col("ends")) <= 0.01 * length).select("unit", "position", "k", "before")
    places = near.unionByName(windows.select("unit", "position", F.lit(0).alias("k"), F.col("position").alias("before")))
    held = places.join(cells.withColumnRenamed("position", "before"), ["unit", "before"])
    return held.withColumn("bin", F.col("bin") + (F.lit(count - 1) - F.col("k")) * bins).drop("k", "before")


def layout_gaps(a: DataFrame, b: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """`(column, rows, only_a, only_b, largest_gap)` of two layouts of the same cells."""
    both = a.select(*key, *[F.col(c).alias(f"a_{c}") for c in columns], F.lit(True).alias("_a")).join(b.select(*key, *[F.col(c).alias(f"b_{c}") for c in columns], F.lit(True).alias("_b")), key, "full_outer")
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")).alias("gap")) for c in columns])).alias("g")
    return both.select("_a", "_b", each).groupBy("g.column").agg(F.count_if(F.col("_a") & F.col("_b")).alias("rows"), F.count_if(F.col("_b").isNull()).alias("only_a"), F.count_if(F.col("_a").isNull()).alias("only_b"), F.max("g.gap").alias("largest_gap"))


def interleaved_units(windows: DataFrame) -> DataFrame:
    """Windows that begin before an earlier one of their unit has ended."""
    w = Window.partitionBy("unit").orderBy("win_start", "position").rowsBetween(Window.unboundedPreceding, -1)
    return windows.withColumn("ended", F.max("win_end").over(w)).where("win_start < ended")


def pool_context(rows: DataFrame, value: str, span: int) -> DataFrame:
    """a window's value beside the mean of those of the `span` positions before it, or beside itself."""
    w = Window.partitionBy("unit").orderBy("position").rangeBetween(-span, -1)
    return rows.withColumn("context", F.coalesce(F.avg(value).over(w), F.col(value)))


def smooth_scores(scores: DataFrame, span: int) -> DataFrame:
    """The largest and mean score over the `span` positions that end at each window."""
    w = Window.partitionBy("unit").orderBy("position").rangeBetween(-(span - 1), 0)
    return scores.withColumn("smooth_max", F.max("score").over(w)).withColumn("smooth_mean", F.avg("score").over(w))


def unit_reference(scores: DataFrame) -> DataFrame:
    """Scores less their unit's median, over its scaled median absolute deviation; 0 spread divides by 1."""
    mid = scores.groupBy("unit").agg(F.median("score").alias("mid"))
    off = scores.join(mid, "unit").groupBy("unit").agg((1.4826 * F.median(F.abs(F.col("score") - F.col("mid")))).alias("mad"))
    scale = F.when(F.col("mad") > 0, F.col("mad")).otherwise(1.0)
    return scores.join(mid, "unit").join(off, "unit").withColumn("referred", (F.col("score") - F.col("mid")) / scale).drop("mid", "mad")


def channel_error_scales(errors: DataFrame) -> DataFrame:
    """A window's mean and largest error over its channel's median error; a channel with median 0 divides by 1."""
    mid = median(errors, "error", ["channel"], "mid")
    ratio = F.col("error") / F.when(F.col("mid") > 0, F.col("mid")).otherwise(1.0)
    return errors.join(mid, "channel").groupBy("unit", "position").agg(F.avg(ratio).alias("mean_error"), F.max(ratio).alias("max_error"))


def autocorrelation(hourly: DataFrame, lags: list[int]) -> DataFrame:
    """The correlation of a series with itself some hours before, over pairs that both read; one pair, which has none, gives NaN."""
    shifted = hourly.select("unit", "channel", F.col("hour").alias("then"), F.col("mean").alias("earlier"))
    rows = hourly.withColumn("lag", F.explode(F.array(*map(F.lit, lags)))).withColumn("then", F.col("hour") - F.col("lag"))
    return rows.join(shifted, ["unit", "channel", "then"]).groupBy("channel", "lag").agg(F.count(F.lit(1)).alias("pairs"), F.when(F.count(F.lit(1)) > 1, F.corr("mean", "earlier")).otherwise(float("nan")).alias("correlation"))


def answerability(answers: DataFrame, by: list[str], target: str, answer: str) -> DataFrame:
    """M5: the share of variance that an answer explains, from additive sums; null without variance."""
    e = F.col(target) - F.col(answer)
    spread = F.sum(F.col(target) * F.col(target)) - F.sum(target) * F.sum(target) / F.count(target)
    return answers.where(F.col(target).isNotNull() & F.col(answer).isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.when(spread > 1e-9, 1 - F.sum(e * e) / spread).alias("r2"))


def forecast_target(windows: DataFrame, readings: DataFrame, channel: str, horizon: float, tolerance: float) -> DataFrame:
    """The channel's first reading from `horizon` after a window's end, at most `tolerance` later.

    Both sides are put on one axis and the next reading is looked up by a frame: an as-of join without a range join.
    """
    own = windows.select("unit", (F.col("win_end") + horizon).alias("at"), "position", F.lit(None).cast("struct<time:double,value:double>").alias("r"), F.lit(0).alias("kind"))
    seen = readings.where(F.col("channel") == channel).select("unit", F.col("time").alias("at"), F.lit(None).cast("int").alias("position"), F.struct("time", "value").alias("r"), F.lit(1).alias("kind"))
    w = Window.partitionBy("unit").orderBy("at", "kind", "r.value").rowsBetween(0, Window.unboundedFollowing)
    rows = own.unionByName(seen).withColumn("next", F.first("r", ignorenulls=True).over(w)).where("kind = 0")
    return rows.where(F.col("next.time") <= F.col("at") + tolerance).select("unit", "position", F.col("next.value").alias("target"))


def remaining_life_metrics(predictions: DataFrame, ceiling: float) -> DataFrame:
    """K2: RMSE below the ceiling, on each unit's last window, the share within a fifth, and the asymmetric score."""
    last = F.row_number().over(Window.partitionBy("unit").orderBy(F.desc("position"))) == 1
    rows = predictions.withColumn("last", last).withColumn("e", F.col("predicted") - F.col("target"))
    e = F.col("e")
    return rows.agg(
        F.sqrt(F.avg(F.when(F.col("target") < ceiling, e * e))).alias("rmse_below_ceiling"), F.sqrt(F.avg(F.when(F.col("last"), e * e))).alias("rmse_last"),
        F.avg((F.abs(e) <= 0.2 * F.col("target")).cast("double")).alias("share_within_fifth"), F.sum(F.when(F.col("last"), F.when(e < 0, F.exp(-e / 13) - 1).otherwise(F.exp(e / 10) - 1))).alias("asymmetric_score"))


def coverage(readings: DataFrame, width: float) -> DataFrame:
    """U8: of the instants of a unit in each stretch of `width` hours the share that holds each channel."""
    rows = readings.withColumn("stretch", F.floor(F.col("time") / width))
    instants = rows.groupBy("unit", "stretch").agg(F.countDistinct("time").alias("instants"))
    return rows.groupBy("unit", "stretch", "channel").agg(F.countDistinct("time").alias("held")).join(instants, ["unit", "stretch"]).withColumn("share", F.col("held") / F.col("instants"))


def one_standard_error(errors: DataFrame, tested_to_trained: float) -> DataFrame:
    """The first variant whose mean error lies within a corrected standard error of the best; a few rows.

    `errors`: `(variant, distance, error)`, a row for each repeat. The variance of k repeats is multiplied by
    `1/k + tested_to_trained`; of those within, the variant of least distance from the default, then by name.
    """
    mean = errors.groupBy("variant", "distance").agg(F.avg("error").alias("error"), F.var_samp("error").alias("v"), F.count(F.lit(1)).alias("k"))
    best = mean.agg(F.min(F.struct("error", "variant", "v", "k")).alias("b")).select((F.col("b.error") + F.sqrt(F.coalesce("b.v", F.lit(0.0)) * (1 / F.col("b.k") + tested_to_trained))).alias("line"))
    return mean.crossJoin(F.broadcast(best)).where("error <= line").agg(F.min(F.struct("distance", "variant", "error")).alias("c")).select("c.variant", "c.distance", "c.error")


def month_units(readings: DataFrame, origin: str) -> DataFrame:
    """Calendar months of each unit, the first and last clipped to its span; hours from `origin`."""
    start = F.lit(origin).cast("timestamp_ntz")
    at = lambda c: F.timestamp_add("SECOND", F.floor(F.col(c) * 3600).cast("int"), start)
    span = readings.groupBy("unit").agg(F.floor(F.min("time")).alias("a"), (F.floor(F.max("time")) + 1).alias("b"))
    months = F.sequence(F.date_trunc("month", at("a")).cast("date"), at("b").cast("date"), F.expr("interval 1 month"))
    rows = span.select("unit", "a", "b", F.explode(months).alias("month"))
    hours = lambda d: F.datediff(d, F.lit(origin[:10]).cast("date")) * 24.0
    rows = rows.withColumn("extent_start", F.greatest(F.col("a").cast("double"), hours(F.col("month")))).withColumn("extent_end", F.least(F.col("b").cast("double"), hours(F.add_months("month", 1))))
    return rows.where("extent_start < extent_end").select(F.concat_ws("/", "unit", F.date_format("month", "yyyy-MM")).alias("unit"), "extent_start", "extent_end")
