"""Answers for hidden readings that need no model, masks and losses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ordering import seeded_rank
from .windows import WIN


def draw_masks(tokens: DataFrame, share: float, seed: int) -> DataFrame:
    """M1: single tokens hidden by digest, `share` of them; a window's first token by digest always stays visible."""
    rows = tokens.withColumn("_d", seeded_rank(seed, "unit", "position", "channel", "time", "value"))
    u = F.conv(F.substring("_d", 1, 13), 16, 10).cast("double") / float(16**13)
    first = F.min("_d").over(Window.partitionBy(*WIN))
    return rows.withColumn("hidden", (u < share) & (F.col("_d") != first)).drop("_d")


def mask_windows(tokens: DataFrame, seed: int, channel: float = 0.0, block: float = 0.0, block_span: float = 0.3, token: float = 0.0, tail: float = 0.0, tail_span: tuple[float, float] = (0.1, 0.3), interval: float = 0.0, interval_span: tuple[float, float] = (0.1, 0.3), timeless: str | None = None) -> DataFrame:
    """M1: `tokens` with `hidden` and what hid them: `by_channel`, `by_block`, `by_token`, `by_tail`, `by_interval`.

    Each argument is the rate of its draw: whole channels of a window, a stretch of `block_span` of a channel, single
    tokens, the end of a window, a stretch in all channels; spans are shares of the window. Numbers follow from digests
    of the seed, the window and the channel or the token's place, so they replay anywhere. `timeless` tokens are
    reached by no stretch of time. A window left without visible tokens shows its first one; `by_channel` holds
    where a channel shows none after that, whichever draws hid it.
    """
    number = lambda name, *key: F.conv(F.substring(seeded_rank(seed, F.lit(name), *WIN, *key), 1, 13), 16, 10).cast("double") / float(16**13)
    order = Window.partitionBy(*WIN).orderBy("time", "channel", "value")
    rows = tokens.withColumn("_nth", F.row_number().over(order))
    t, timed = F.col("time"), F.lit(True) if timeless is None else ~F.col(timeless)
    begin = number("block start", "channel") * (1 - block_span)
    last = tail_span[0] + number("tail span") * (tail_span[1] - tail_span[0])
    span = interval_span[0] + number("interval span") * (interval_span[1] - interval_span[0])
    since = number("interval start") * (1 - span)
    rows = rows.withColumns({
        "_whole": number("channel", "channel") < channel,
        "by_block": (number("block", "channel") < block) & timed & (t >= begin) & (t <= begin + block_span),
        "by_token": number("token", "_nth") < token,
        "by_tail": (number("tail") < tail) & timed & (t >= 1 - last),
        "by_interval": (number("interval") < interval) & timed & (t >= since) & (t <= since + span),
    })
    rows = rows.withColumn("hidden", F.col("_whole") | F.col("by_block") | F.col("by_token") | F.col("by_tail") | F.col("by_interval"))
    starved = F.min(F.col("hidden").cast("int")).over(Window.partitionBy(*WIN)) == 1
    rows = rows.withColumn("hidden", F.col("hidden") & ~(starved & (F.col("_nth") == 1)))
    shown = F.min(F.col("hidden").cast("int")).over(Window.partitionBy(*WIN, "channel")) == 0
    rows = rows.withColumn("by_channel", F.col("hidden") & ~shown)
    return rows.withColumns({c: F.col(c) & F.col("hidden") for c in ("by_block", "by_token", "by_tail", "by_interval")}).drop("_nth", "_whole")


def expected_ratio(channel: float = 0.0, block: float = 0.0, block_span: float = 0.3, token: float = 0.0, tail: float = 0.0, tail_span: tuple[float, float] = (0.1, 0.3), interval: float = 0.0, interval_span: tuple[float, float] = (0.1, 0.3)) -> float:
    """M1: the share of tokens that `mask_windows` hides of windows whose tokens lie evenly over time and channels."""
    stays = (1 - channel) * (1 - block * block_span) * (1 - token)
    return 1 - stays * (1 - tail * sum(tail_span) / 2) * (1 - interval * sum(interval_span) / 2)


def mask_kind(masked: DataFrame) -> DataFrame:
    """M2: `channel` where a channel of a window is left without visible tokens, else `token`."""
    visible = F.sum((~F.col("hidden")).cast("int")).over(Window.partitionBy(*WIN, "channel"))
    return masked.withColumn("kind", F.when(visible == 0, "channel").otherwise("token"))


def interpolate_hidden(masked: DataFrame) -> DataFrame:
    """For hidden tokens the line between the visible ones on either side, ends carried, and the nearest of them.

    The nearer by time, of equally near the earlier; null where the channel shows nothing in the window.
    """
    seen = F.when(~F.col("hidden"), F.struct("time", "value"))
    w = Window.partitionBy(*WIN, "channel").orderBy("time", "value")
    before = F.last(seen, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(seen, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    rows = masked.withColumn("a", before).withColumn("b", after).where("hidden")
    t = F.col("time")
    share = (t - F.col("a.time")) / F.nullif(F.col("b.time") - F.col("a.time"), F.lit(0.0))
    line = F.coalesce(F.col("a.value") + share * (F.col("b.value") - F.col("a.value")), F.col("a.value"), F.col("b.value"))
    nearest = F.when(F.col("b").isNull() | (t - F.col("a.time") <= F.col("b.time") - t), F.col("a.value")).otherwise(F.col("b.value"))
    return rows.withColumn("line", line).withColumn("nearest", F.coalesce(nearest, F.col("b.value"), F.col("a.value"))).drop("a", "b")


def squared(error: Column) -> Column:
    return error * error


def huber(error: Column, delta: float = 1.0) -> Column:
    """M4: squared near 0, linear beyond delta."""
    size = F.abs(error)
    return F.when(size < delta, error * error / 2).otherwise(delta * (size - delta / 2))


def history_answers(hourly: DataFrame, context: int = 47) -> DataFrame:
    """For each channel-hour the latest hour read before and the median of those within the context."""
    w = Window.partitionBy("unit", "channel").orderBy("hour").rangeBetween(-context, -1)
    return hourly.withColumn("last_hour", F.last("mean", ignorenulls=True).over(w)).withColumn("median_of_history", F.percentile("mean", F.lit(0.5)).over(w))


def mass_concentration(tokens: DataFrame) -> DataFrame:
    """M6: each window's sum of squares and its share of its unit's and of all."""
    mass = tokens.groupBy(*WIN).agg(F.sum(F.col("value") * F.col("value")).alias("mass"), F.count(F.lit(1)).alias("n"))
    of_unit = mass.groupBy("unit").agg(F.sum("mass").alias("unit_mass"))
    total = of_unit.agg(F.sum("unit_mass").alias("all_mass"))
    rows = mass.join(of_unit, "unit").crossJoin(F.broadcast(total))
    return rows.select(*WIN, "n", "mass", (F.col("mass") / F.nullif(F.col("unit_mass"), F.lit(0.0))).alias("share_of_unit"), (F.col("unit_mass") / F.nullif(F.col("all_mass"), F.lit(0.0))).alias("unit_share"))


def hidden_cells(cells: DataFrame, share: float, seed: int) -> DataFrame:
    """Cells that read, `value` their mean and `time` their bin, with `hidden` by digest for a share of them."""
    digest = seeded_rank(seed, *WIN, "channel", "bin")
    u = F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(16**13)
    return cells.where("presence = 1").select(*WIN, "channel", "bin", F.col("bin").cast("double").alias("time"), F.col("mean").alias("value"), (u < share).alias("hidden"))


def imputation_errors(masked: DataFrame) -> DataFrame:
    """`(unit, position, channel, error)`: how far the line between a window's visible cells misses its hidden ones on
    average; a channel without visible cells in the window is answered by its mean over all visible cells. Scored by A13.
    """
    level = masked.where("NOT hidden").groupBy("channel").agg(F.avg("value").alias("_level"))
    told = interpolate_hidden(masked).join(F.broadcast(level), "channel", "left")
    return told.groupBy(*WIN, "channel").agg(F.avg(F.abs(F.coalesce("line", "_level") - F.col("value"))).alias("error"))
