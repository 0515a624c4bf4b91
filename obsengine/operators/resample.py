"""Resampled comparisons over units. Draws are digests of (seed, draw, place), so SQL can repeat them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import digest_position


def pair(control: DataFrame, candidate: DataFrame) -> DataFrame:
    """B1: per-unit squared errors and counts of two runs; units that only one run has are `unpaired`."""
    both = control.select("unit", F.col("se").alias("se_a"), F.col("n").alias("n_a")).join(candidate.select("unit", F.col("se").alias("se_b"), F.col("n").alias("n_b")), "unit", "full_outer")
    return both.withColumn("unpaired", F.col("se_a").isNull() | F.col("se_b").isNull())


def paired_bootstrap(pairs: DataFrame, resamples: int, seed: int, level: float = 0.95, strata: str | None = None) -> DataFrame:
    """B2: the reduction in RMSE from a to b with a percentile interval and a two-sided p by the +1 rule.

    Place i of draw d takes the unit numbered by the digest of (seed, d, i). The draws of a place are counted before
    they meet the units' errors, and draws are spread over tasks. With `strata`, the name of a column, each draw takes
    as many units of each stratum as there are, by the digest of (seed, draw, stratum, i), and
    each pick meets its unit by itself, so no task counts a stratum's picks; null is no stratum.
    """
    digest = lambda *c: F.sha2(F.concat_ws("|", F.lit(str(seed)), *[x.cast("string") for x in c]), 256)
    by = [] if strata is None else [strata]
    units = digest_position(pairs.withColumn("_d", digest(F.col("unit"))), "_d", ["unit"], by).drop("_d")
    spark = pairs.sparkSession
    if strata is not None:
        known = units.where(F.col(strata).isNotNull())
        sizes = known.groupBy(strata).agg(F.count(F.lit(1)).alias("n"))
        cells = known.select(strata, (F.col("place") - 1).alias("i")).join(F.broadcast(sizes), strata).withColumn("draw", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(resamples - 1).cast("long"))))
        at = F.pmod(F.conv(F.substring(digest(F.col("draw"), F.col(strata), F.col("i")), 1, 15), 16, 10).cast("long"), F.col("n")) + 1
        return _interval(pairs, cells.select("draw", strata, at.alias("place"), F.lit(1).alias("k")), units, ["place", strata], level)
    n = pairs.count()
    draws = spark.range(resamples).withColumnRenamed("id", "draw").crossJoin(F.broadcast(spark.range(n).withColumnRenamed("id", "i")) if n <= 100_000 else spark.range(n).withColumnRenamed("id", "i"))
    at = F.pmod(F.conv(F.substring(digest(F.col("draw"), F.col("i")), 1, 15), 16, 10).cast("long"), F.lit(n)) + 1
    picked = draws.select("draw", at.alias("place")).groupBy("draw", "place").agg(F.count(F.lit(1)).alias("k"))
    return _interval(pairs, picked, units, ["place"], level)


def _interval(pairs: DataFrame, picked: DataFrame, units: DataFrame, on: list[str], level: float) -> DataFrame:
    """The observed reduction beside the drawn ones' interval and p."""
    error = lambda x: F.sqrt(F.sum(F.col(f"se_{x}") * F.col("k")) / F.sum(F.col(f"n_{x}") * F.col("k")))
    drawn = picked.join(units, on).groupBy("draw").agg((error("a") - error("b")).alias("reduction"))
    whole = pairs.withColumn("k", F.lit(1)).agg((error("a") - error("b")).alias("observed"))
    side = lambda c: (F.count_if(c) + 1) / (F.count(F.lit(1)) + 1)
    tail = (1 - level) / 2
    got = drawn.agg(F.percentile("reduction", F.lit(tail)).alias("low"), F.percentile("reduction", F.lit(1 - tail)).alias("high"), F.least(F.lit(1.0), 2 * F.least(side(F.col("reduction") <= 0), side(F.col("reduction") >= 0))).alias("p"))
    return whole.crossJoin(got)
