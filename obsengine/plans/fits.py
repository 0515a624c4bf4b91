"""Queries for correlations of unit pairs and for ridges with several targets, over real units."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.ordering import kept
from ..operators import forecasts, impute, layouts, repair, ridges, windows
from ..sources.tables import LINE_CHANNELS, order_line_values, table
from .queries import BINS, CHANNELS, LINES, SEED, query, r, tokens

DAILY = f"{LINES}, daily AS (SELECT unit, channel, CAST(floor(time / 24) AS BIGINT) AS hour, avg(value) AS mean FROM obs WHERE value IS NOT NULL AND isfinite(value) GROUP BY ALL), ch AS (SELECT *, CASE WHEN lag(hour) OVER w = hour - 1 THEN mean - lag(mean) OVER w END AS change FROM daily WINDOW w AS (PARTITION BY unit, channel ORDER BY hour))"


def varying(x: str, y: str) -> str:
    """SQL of a correlation, null where one side varies by rounding alone."""
    return f"CASE WHEN var_pop({x}) > 1e-9 * avg({x} * {x}) AND var_pop({y}) > 1e-9 * avg({y} * {y}) THEN corr({x}, {y}) END"


def daily(spark, sf_dir):
    """Suppliers' means a day: their hours are days here. Lines are dealt by supplier once, before a line is four readings."""
    return repair.wide_hourly_means(order_line_values(table(spark, sf_dir, "lineitem")).withColumn("time", F.col("time") / 24).repartition("unit"), LINE_CHANNELS)


@query(f"WITH {DAILY}, x AS (SELECT channel, unit, hour, change FROM ch WHERE change IS NOT NULL) SELECT a.channel, a.unit AS a, b.unit AS b, count(*) AS shared, round({varying('a.change', 'b.change')}, 4) + 0.0 AS correlation FROM x a JOIN x b ON a.channel = b.channel AND a.hour = b.hour AND a.unit < b.unit GROUP BY a.channel, a.unit, b.unit HAVING count(*) >= 8")
def u9_unit_pairs(spark, sf_dir):
    told = layouts.unit_pair_correlations(daily(spark, sf_dir), 8)
    return told.withColumn("correlation", F.round("correlation", 4) + F.lit(0.0))


@query(f"WITH {DAILY}, l AS (SELECT a.channel, a.unit, {varying('a.mean', 'b.mean')} AS level FROM ch a JOIN ch b ON a.channel = b.channel AND a.unit = b.unit AND b.hour = a.hour - 1 GROUP BY ALL HAVING count(*) >= 3), c AS (SELECT a.channel, a.unit, {varying('a.change', 'b.change')} AS change FROM ch a JOIN ch b ON a.channel = b.channel AND a.unit = b.unit AND b.hour = a.hour - 7 WHERE a.change IS NOT NULL AND b.change IS NOT NULL GROUP BY ALL HAVING count(*) >= 3) SELECT channel, unit, round(level, 4) + 0.0 AS level, round(change, 4) + 0.0 AS change FROM l JOIN c USING (channel, unit) WHERE level IS NOT NULL AND change IS NOT NULL")
def u9_autocorrelation(spark, sf_dir):
    told = layouts.unit_autocorrelations(daily(spark, sf_dir), 1, 7, least=3)
    return told.dropna().select("channel", "unit", *[(F.round(c, 4) + F.lit(0.0)).alias(c) for c in ("level", "change")])


PENALTIES = [10.0**k for k in range(-3, 4)]


@query()
def i9_cell_values(spark, sf_dir):
    """The five values of hidden cells by ridges on the line and nearest visible cell, the other channels and the bin; folds by the unit's number."""
    cells = kept(windows.cells(tokens(spark, sf_dir), BINS))  # read for the masks, the values and the other channels
    masked = kept(impute.hidden_cells(cells, 0.25, SEED))
    line = impute.interpolate_hidden(masked).select("unit", "position", "channel", "bin", "line", "nearest")
    rows, x = forecasts.own_and_cross_rows(masked, CHANNELS)
    key = ["unit", "position", "channel", "bin"]
    values = cells.where("presence = 1").select(*key, *[F.col(c).alias(f"of_{c}") for c in forecasts.FIVE])
    marks = {f"b{i}": (F.col("bin") == i).cast("double") for i in range(1, BINS)}
    rows = rows.join(line, key).join(values, key).withColumns({**marks, "fold": (F.col("unit").cast("long") % 2).cast("int")}).dropna(subset=["line"])
    rows = kept(rows)  # fitted, then answered
    x, ys = ["line", "nearest", *x, *marks], [f"of_{c}" for c in forecasts.FIVE]
    fits = ridges.target_ridges(rows, ["channel"], x, ys, PENALTIES)
    return ridges.target_answers(rows, fits, ["channel"], x, ys, rows).select(*key, *[f"predicted_{y}" for y in ys])


@query()
def i6_cell_ridge(spark, sf_dir):
    """The five values of a cell by the nine of each of the three before it and the other channels' means; folds by halves of the month."""
    rows, x = forecasts.cell_history_rows(windows.cells(tokens(spark, sf_dir), BINS), BINS, 3, CHANNELS)
    rows = kept(rows.withColumn("fold", (F.col("position") >= 15).cast("int")))  # its many columns are computed once and planned apart
    fits = ridges.target_ridges(rows, ["channel"], x, forecasts.FIVE, PENALTIES)
    return ridges.target_answers(rows, fits, ["channel"], x, forecasts.FIVE, rows).select("unit", "channel", "position", "bin", *[f"predicted_{y}" for y in forecasts.FIVE])
