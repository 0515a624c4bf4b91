"""Queries for ridges, trees and intervals of ratios."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.ordering import kept
from ..operators import draws_of_units, features, layouts, learners, trees
from ..sources.tables import table
from .layouts import ANSWERS, answers
from .queries import CHANNELS, OBS, SEED, query, r, readings, tokens


def drawn_sql(source: str, resamples: int) -> str:
    return f"u AS (SELECT *, row_number() OVER (ORDER BY sha256('42|' || unit), unit) AS place, count(*) OVER () AS total FROM {source}), d AS (SELECT draw, CAST(('0x' || substr(sha256('42|' || draw || '|' || i), 1, 15)) AS BIGINT) % total + 1 AS place FROM range(0, {resamples}) a(draw), (SELECT place - 1 AS i, total FROM u))"


@query(f"WITH {OBS}, {ANSWERS}, t AS (SELECT unit, sum(power(last - target, 2)) AS last, sum(power(mean - target, 2)) AS mean FROM ans WHERE last IS NOT NULL GROUP BY unit), {drawn_sql('t', 100)}, x AS (SELECT draw, 1 - sum(mean) / sum(last) AS skill FROM d JOIN u USING (place) GROUP BY draw) SELECT (SELECT {r('1 - sum(mean) / sum(last)', 'o')[:-5]} FROM t) AS skill, {r('quantile_cont(skill, 0.025)', 'low')}, {r('quantile_cont(skill, 0.975)', 'high')} FROM x")
def b7_unit_bootstrap_skill(spark, sf_dir):
    tallies = layouts.gap_tallies(answers(spark, sf_dir), "last", ["mean"]).groupBy("unit").agg(F.sum("last").alias("last"), F.sum("mean").alias("mean"))
    return draws_of_units.ratio_of_sums(tallies, "mean", "last", 100, SEED)


@query(f"WITH {OBS}, {ANSWERS}, y AS (SELECT CAST(position AS VARCHAR) AS unit, avg(power(last - target, 2)) AS a, avg(power(mean - target, 2)) AS b FROM ans WHERE last IS NOT NULL GROUP BY position), t AS (SELECT unit, ln(b / a) AS l FROM y WHERE a > 0 AND b > 0), {drawn_sql('t', 100)}, x AS (SELECT draw, exp(avg(l)) AS ratio FROM d JOIN u USING (place) GROUP BY draw) SELECT (SELECT {r('exp(avg(l))', 'o')[:-5]} FROM t) AS ratio, {r('quantile_cont(ratio, 0.025)', 'low')}, {r('quantile_cont(ratio, 0.975)', 'high')} FROM x")
def b8_block_bootstrap_ratio(spark, sf_dir):
    days = answers(spark, sf_dir).dropna(subset=["last", "mean"]).groupBy(F.col("position").cast("string").alias("unit"))
    loss = lambda c: F.avg(F.pow(F.col(c) - F.col("target"), F.lit(2))).alias(c)
    return draws_of_units.geometric_ratio(days.agg(loss("last"), loss("mean")), "mean", ["last"], 100, SEED)


def halved(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumn("fold", (F.col("l_orderkey") % 2).cast("int"))
    return li.select("l_returnflag", "l_linestatus", "fold", "l_quantity", "l_discount", "l_tax", "l_extendedprice")


@query("SELECT l_returnflag, count(*) AS n, round(regr_intercept(l_extendedprice, l_quantity), 2) + 0.0 AS intercept, round(regr_slope(l_extendedprice, l_quantity), 2) + 0.0 AS slope FROM lineitem GROUP BY l_returnflag")
def i10_moments_line(spark, sf_dir):
    fits = learners.ridge(halved(spark, sf_dir), ["l_returnflag"], ["l_quantity"], "l_extendedprice", [0.0])
    return fits.select("l_returnflag", "n", F.round("intercept", 2).alias("intercept"), F.round(F.col("coefficients")[0], 2).alias("slope"))


@query()
def i7_cross_channel_ridge(spark, sf_dir):
    """Each line's price by the other values, a ridge per flag and status, penalty by cross-fit."""
    rows, keys, x = halved(spark, sf_dir), ["l_returnflag", "l_linestatus"], ["l_quantity", "l_discount", "l_tax"]
    fits = learners.ridge(rows, keys, x, "l_extendedprice", [10.0**k for k in range(-6, 5)])
    told = learners.ridge_answers(rows, fits, keys, x)
    return told.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(F.pow(F.col("predicted") - F.col("l_extendedprice"), F.lit(2)))).alias("rmse"))


def user_days(spark, sf_dir):
    """User-days with the other channels' features, whether they hold an error, and a side by the unit's number."""
    stats = features.window_statistics(tokens(spark, sf_dir))
    others = [c for c in CHANNELS if c != "error"]
    wide = features.per_channel_features(stats, CHANNELS, ["n", "mean"])
    rows = wide.withColumns({"target": (F.col("error_n") > 0).cast("int"), "side": F.when(F.col("unit").cast("long") % 2 == 0, "training").otherwise("held_out")})
    return rows, [f"{c}_{k}" for c in others for k in ("n", "mean")]


@query()
def c4_fit_and_score(spark, sf_dir):
    """Whether a user-day holds an error, by trees on the other channels' features of units of even number."""
    rows, columns = user_days(spark, sf_dir)
    return learners.fit_and_score(rows, "side", columns, "target", ["unit", "position"], 1000, True).select("unit", "position", "target", "predicted")


@query()
def a12_taught_trees(spark, sf_dir):
    """Every user-day's log-odds of a taught event: the errors of a tenth of the units of even number, each unit's one event."""
    rows, columns = user_days(spark, sf_dir)
    rows = kept(rows)  # read for the weights, the cuts, the bins and the scores
    taught = (F.col("unit").cast("long") % 20 == 0) & (F.col("target") == 1)
    model = trees.taught_trees(rows.where("side = 'training'").withColumn("event", F.when(taught, F.col("unit"))), columns)
    return trees.score_trees(model, rows, "score", raw=True).select("unit", "position", "target", "score")
