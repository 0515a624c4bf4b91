"""Intervals of ratios over drawn units: what one answer loses over another's, by digests that SQL can repeat."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import digest_position, kept


def drawn(rows: DataFrame, unit: str, resamples: int, seed: int) -> DataFrame:
    """`rows` `(unit, ...)`, one per unit, with `draw` and `k`, how often the draw takes the unit.

    Picks are dealt by place once, counted and met by their unit there; neither side is sent to the driver.
    """
    digest = lambda *c: F.sha2(F.concat_ws("|", F.lit(str(seed)), *[x.cast("string") for x in c]), 256)
    placed = digest_position(rows.withColumn("_d", digest(F.col(unit))), "_d", [unit]).drop("_d")
    n, spark = rows.count(), rows.sparkSession
    places = spark.range(n).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))))
    at = F.pmod(F.conv(F.substring(digest(F.col("draw"), F.col("id")), 1, 15), 16, 10).cast("long"), F.lit(n)) + 1
    picks = places.select("draw", at.alias("place")).repartition("place").groupBy("draw", "place").agg(F.count(F.lit(1)).alias("k"))
    return picks.join(placed.hint("merge"), "place").drop("place")


def interval(values: DataFrame, column: str, level: float = 0.95) -> DataFrame:
    tail = (1 - level) / 2
    return values.agg(F.percentile(column, F.lit(tail)).alias("low"), F.percentile(column, F.lit(1 - tail)).alias("high"))


def ratio_of_sums(tallies: DataFrame, answer: str, baseline: str, resamples: int, seed: int) -> DataFrame:
    """`1 - answer / baseline` of summed losses with an interval over drawn units; 0 in the baseline gives null."""
    skill = lambda k: 1 - F.sum(F.col(answer) * k) / F.nullif(F.sum(F.col(baseline) * k), F.lit(0.0))
    tallies = kept(tallies)
    draws = drawn(tallies, "unit", resamples, seed).groupBy("draw").agg(skill(F.col("k")).alias("skill"))
    return tallies.agg(skill(F.lit(1)).alias("skill")).crossJoin(interval(draws, "skill"))


def geometric_ratio(losses: DataFrame, answer: str, bars: list[str], resamples: int, seed: int) -> DataFrame:
    """The geometric mean over units (days, windows) of the answer's loss over the smallest bar's, with an interval.

    A unit on which either is 0 has no ratio and takes no part.
    """
    bar = F.least(*bars) if len(bars) > 1 else F.col(bars[0])
    logs = losses.select("unit", F.when((F.col(answer) > 0) & (bar > 0), F.ln(F.col(answer) / bar)).alias("l")).where("l IS NOT NULL")
    logs = kept(logs)
    draws = drawn(logs, "unit", resamples, seed).groupBy("draw").agg(F.exp(F.sum(F.col("l") * F.col("k")) / F.sum("k")).alias("ratio"))
    return logs.agg(F.exp(F.avg("l")).alias("ratio")).crossJoin(interval(draws, "ratio"))
