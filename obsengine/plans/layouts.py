"""Queries for layouts, hidden parts, alarms by channel, tallies and verdicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features, layouts, metrics, normalise, windows
from .queries import BINS, CELLS, CHANNELS, DEPART, FEATURES, HOURLY, LABELLED, LENGTH, MASKED, OBS, STATS, TOK, WIN, departures, hourly, masked, predictions, query, r, readings, tokens


@query(f"WITH {CELLS}, c AS (SELECT DISTINCT channel FROM obs), f AS (SELECT DISTINCT unit, position FROM tokens), a AS (SELECT unit, position, channel, unnest(range(0, 6)) AS bin FROM f, c) SELECT a.unit, a.position, a.channel, a.bin, CAST(l.n IS NOT NULL AS BIGINT) AS presence, {r('ln(1 + coalesce(n, 0))', 'log_count')}, {r('carried', 'last')} FROM a LEFT JOIN laid l USING (unit, position, channel, bin)")
def w9_corpus_cells(spark, sf_dir):
    channels = readings(spark, sf_dir).select("channel").distinct()
    return layouts.corpus_cells(windows.cells(tokens(spark, sf_dir), BINS), channels, BINS).select("unit", "position", "channel", "bin", "presence", "log_count", "last")


@query(f"WITH {CELLS} SELECT channel, bool_or(n IS NOT NULL) AS ever_observed, bool_or(n IS NULL) AS ever_missed FROM laid GROUP BY channel")
def w12_readable_rows(spark, sf_dir):
    return layouts.readable_rows(windows.regular_grid(tokens(spark, sf_dir), BINS))


@query(f"WITH {CELLS} SELECT unit, position, channel, {r('coalesce(carried, 0)', 'value')}, {r('bin / 6', 'time')}, {r('(bin - coalesce(max(CASE WHEN n IS NOT NULL THEN bin END) OVER w, 0)) / 6', 'gap')} FROM laid WINDOW w AS (PARTITION BY unit, position, channel ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def w13_gridded_tokens(spark, sf_dir):
    return layouts.gridded_tokens(windows.regular_grid(tokens(spark, sf_dir), BINS), BINS)


@query(f"WITH {TOK}, c AS (SELECT unit, position // 3 AS position, channel, value, (position % 3 + time) / 3 AS time FROM tokens) SELECT unit, position, channel, {r('value', 'value')}, {r('time', 'time')}, {r('time - coalesce(lag(time) OVER (PARTITION BY unit, position, channel ORDER BY time, value), 0)', 'gap')} FROM c")
def w18_concat_windows(spark, sf_dir):
    return layouts.concat_windows(tokens(spark, sf_dir), 3)


@query(f"WITH {FEATURES}, s AS (SELECT min(mean) AS a, max(mean) AS b, avg(mean) AS m, min(mean_step) AS a2, max(mean_step) AS b2, avg(mean_step) AS m2 FROM ws WHERE CAST(unit AS BIGINT) % 2 = 0) SELECT unit, position, channel, {r('least(greatest(coalesce(mean, m), a), b)', 'mean')}, {r('least(greatest(coalesce(mean_step, m2), a2), b2)', 'mean_step')} FROM ws, s")
def f9_prepared_summaries(spark, sf_dir):
    rows = features.window_statistics(tokens(spark, sf_dir)).select("unit", "position", "channel", "mean", "mean_step")
    return layouts.prepared_summaries(rows.where(F.col("unit").cast("long") % 2 == 0), rows, ["mean", "mean_step"])


@query(f"WITH {MASKED} SELECT unit, channel, count(*) AS n, {r('avg(value)', 'mean')}, {r('min(value)', 'minimum')}, {r('max(value)', 'maximum')}, {r('max(time) - min(time)', 'span')}, {r('avg(time)', 'centre')} FROM t WHERE hidden GROUP BY unit, channel")
def f10_hidden_summaries(spark, sf_dir):
    return layouts.hidden_summaries(masked(spark, sf_dir)).drop("position", "slope")


@query(f"WITH {CELLS}, {STATS}, n AS (SELECT channel, avg(ln(1 + n)) AS log_level FROM read GROUP BY channel) SELECT unit, position, channel, bin, {r('coalesce(carried - mean_of, 0)', 'value')}, {r('CASE WHEN n IS NOT NULL THEN ln(1 + n) - log_level ELSE 0 END', 'log_count')} FROM laid JOIN (SELECT channel, mean AS mean_of FROM stats) USING (channel) JOIN n USING (channel)")
def f12_level_free(spark, sf_dir):
    cells = windows.cells(tokens(spark, sf_dir), BINS)
    counts = cells.where("presence = 1").groupBy("channel").agg(F.avg("log_count").alias("log_level"))
    levels = normalise.fit_standard(readings(spark, sf_dir)).select("channel", F.col("mean").alias("level")).join(counts, "channel")
    return layouts.level_free(cells, levels)


@query(f"WITH {OBS}, a AS (SELECT unit, CAST(round(time * 60) AS BIGINT) AS minute, channel, value FROM obs), x AS (SELECT *, row_number() OVER (PARTITION BY unit, minute, channel ORDER BY value) AS nth FROM a WHERE value > 5), y AS (SELECT unit, minute, channel, value + 0.5 AS value_b, row_number() OVER (PARTITION BY unit, minute, channel ORDER BY value) AS nth FROM a WHERE value < 60) SELECT channel, count(*) FILTER (value_b IS NULL) AS only_a, count(*) FILTER (value IS NULL) AS only_b, {r('max(abs(value - value_b))', 'largest_gap')} FROM x FULL JOIN y USING (unit, minute, channel, nth) GROUP BY channel")
def f13_diff_preparations(spark, sf_dir):
    rows = readings(spark, sf_dir).select("unit", F.round(F.col("time") * 60).cast("long").alias("minute"), "channel", "value")
    return layouts.diff_preparations(rows.where("value > 5"), rows.where("value < 60").withColumn("value", F.col("value") + 0.5))


@query(f"WITH {DEPART} SELECT channel, {r('quantile_cont(departure, 0.98)', 'alarm')} FROM dep GROUP BY channel")
def a18_channel_alarms(spark, sf_dir):
    return layouts.channel_alarms(departures(spark, sf_dir), 0.02)


@query(f"WITH {OBS}, {HOURLY}, e AS (SELECT channel, quantile_cont(mean, 0.1) AS low, median(mean) AS mid, quantile_cont(mean, 0.9) AS high FROM hourly GROUP BY channel), d AS (SELECT unit, channel, hour, abs(mean - mid) / greatest((high - low) / 2.563, 0.5) AS envelope, n / 2.0 AS own FROM hourly JOIN e USING (channel)) SELECT unit, channel, hour, {r('envelope', 'envelope')}, {r('greatest(envelope, own)', 'departure')} FROM d")
def a17_envelope_departures(spark, sf_dir):
    rows = hourly(spark, sf_dir)
    bands = rows.groupBy("channel").agg(F.percentile("mean", F.lit(0.1)).alias("low"), F.median("mean").alias("mid"), F.percentile("mean", F.lit(0.9)).alias("high"))
    now = rows.join(F.broadcast(bands), "channel").withColumn("own", F.col("n") / 2.0)
    return layouts.envelope_departures(now, 0.5).select("unit", "channel", "hour", "envelope", "departure")


ANSWERS = "ans AS (SELECT unit, CAST(floor(time / 24) AS BIGINT) AS position, channel AS kind, value AS target, lag(value) OVER w AS last, avg(value) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mean FROM obs WINDOW w AS (PARTITION BY unit, channel ORDER BY time, value))"


def answers(spark, sf_dir):
    from pyspark.sql.window import Window

    w = Window.partitionBy("unit", "channel").orderBy("time", "value")
    return readings(spark, sf_dir).select("unit", F.floor(F.col("time") / 24).alias("position"), F.col("channel").alias("kind"), F.col("value").alias("target"), F.lag("value").over(w).alias("last"), F.avg("value").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("mean"))


@query(f"WITH {OBS}, {ANSWERS} SELECT kind, unit, count(*) AS cells, {r('sum(power(last - target, 2))', 'last')}, {r('sum(power(mean - target, 2))', 'mean')} FROM ans WHERE last IS NOT NULL GROUP BY kind, unit")
def m3_gap_tallies(spark, sf_dir):
    return layouts.gap_tallies(answers(spark, sf_dir), "last", ["mean"])


@query(f"WITH {OBS}, {ANSWERS} SELECT unit, position, {r('sqrt(avg(power(last - target, 2)))', 'last')}, {r('sqrt(avg(power(mean - target, 2)))', 'mean')} FROM ans WHERE last IS NOT NULL GROUP BY unit, position")
def k12_window_losses(spark, sf_dir):
    return layouts.window_losses(answers(spark, sf_dir), ["last", "mean"]).withColumns({c: F.sqrt(c) for c in ("last", "mean")})


@query(f"WITH {LABELLED}, isl AS (SELECT unit, position - row_number() OVER (PARTITION BY unit ORDER BY position) AS island, event FROM pred WHERE score > 1), runs AS (SELECT unit, bool_or(event > 0) AS hit FROM isl GROUP BY unit, island), fr AS (SELECT unit, count(*) FILTER (NOT hit) AS false_runs FROM runs GROUP BY unit) SELECT unit, count(DISTINCT CASE WHEN event > 0 THEN event END) AS events, count(DISTINCT CASE WHEN event > 0 AND score > 1 THEN event END) AS found, count(*) FILTER (event = 0) AS normal, count(*) FILTER (event = 0 AND score <= 1) AS quiet, coalesce(any_value(false_runs), 0) AS false_runs FROM pred LEFT JOIN fr USING (unit) GROUP BY unit")
def k8_tally_by_unit(spark, sf_dir):
    p = predictions(spark, sf_dir).withColumn("flagged", F.col("score") > 1)
    return layouts.tally_by_unit(p, metrics.flagged_runs(p))


@query("WITH p AS (SELECT l_returnflag AS candidate, l_linestatus AS budget, CAST(l_linenumber AS BIGINT) AS repeat, l_discount - 0.04 AS e FROM lineitem), s AS (SELECT candidate, budget, repeat, sum(e * e) AS se, count(*) AS n FROM p GROUP BY ALL) SELECT candidate, budget, round(sqrt(sum(se) / sum(n)), 5) + 0.0 AS error, round(stddev_samp(sqrt(se / n)), 5) + 0.0 AS spread FROM s GROUP BY ALL")
def k13_curve(spark, sf_dir):
    from ..sources.tables import table

    return layouts.curve(table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("candidate"), F.col("l_linestatus").alias("budget"), F.col("l_linenumber").alias("repeat"), F.col("l_discount").alias("predicted"), F.lit(0.04).alias("target")))


@query(f"WITH {TOK}, n AS (SELECT unit, position, channel, count(*) AS n FROM tokens GROUP BY ALL) SELECT unit, position, CAST(sum(n) AS BIGINT) AS tokens, {r('count(*) / 5', 'channel_share')}, {r('avg(n)', 'readings_a_channel')}, count(*) FILTER (n = 1) AS read_once FROM n GROUP BY unit, position")
def u2_window_regime(spark, sf_dir):
    return layouts.window_regime(tokens(spark, sf_dir), len(CHANNELS))


@query(f"WITH {OBS}, {HOURLY}, d AS (SELECT *, CASE WHEN lag(hour) OVER w = hour - 1 THEN mean - lag(mean) OVER w END AS change FROM hourly WINDOW w AS (PARTITION BY unit, channel ORDER BY hour)), fl AS (SELECT channel, hour, avg(change) AS fleet FROM d WHERE change IS NOT NULL GROUP BY ALL) SELECT channel, count(*) AS changes, {r('CASE WHEN count(*) > 1 THEN corr(change, fleet) END', 'correlation')} FROM d JOIN fl USING (channel, hour) WHERE change IS NOT NULL GROUP BY channel")
def u9_fleet_correlations(spark, sf_dir):
    return layouts.fleet_correlations(hourly(spark, sf_dir))


@query("SELECT round(9 / (3 + 2 * (power(corr(l_quantity, l_extendedprice), 2) + power(corr(l_quantity, l_discount), 2) + power(corr(l_extendedprice, l_discount), 2))), 5) + 0.0 AS signals FROM lineitem")
def u10_participation_ratio(spark, sf_dir):
    from ..sources.tables import table

    return layouts.participation_ratio(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])


@query(f"WITH {WIN} SELECT count(DISTINCT unit) AS units, count(DISTINCT channel) AS channels, count(*) AS values, (SELECT count(*) FROM wins) AS windows FROM obs")
def u12_corpus_facts(spark, sf_dir):
    obs = readings(spark, sf_dir)
    return layouts.corpus_facts(obs, windows.window_counts(windows.units_of(obs), LENGTH, LENGTH))


@query(f"WITH {LABELLED}, u AS (SELECT unit, bool_or(event > 0) AS with_event FROM pred GROUP BY unit) SELECT with_event, count(*) AS units FROM u GROUP BY with_event")
def b4_strata(spark, sf_dir):
    return layouts.strata(predictions(spark, sf_dir))


@query(f"WITH {OBS}, g AS (SELECT unit, avg(value) AS m, stddev_samp(value) / sqrt(count(*)) AS s FROM obs GROUP BY unit HAVING count(*) > 1), a AS (SELECT avg(m) AS al FROM g), v AS (SELECT unit, m - al - 2 * s AS low, m - al + 2 * s AS high, al AS error, s / 4 AS spread FROM g, a), w AS (SELECT *, greatest(0.05 * error, spread) AS floor FROM v) SELECT unit, {r('floor', 'floor')}, CASE WHEN low > floor THEN 'confirmed' WHEN low > 0 THEN CASE WHEN high < floor THEN 'practically nil' ELSE 'distinguishable' END WHEN high < 0 THEN 'worse' WHEN high < floor AND low > -floor THEN 'practically nil' ELSE 'indistinguishable' END AS verdict FROM w")
def b12_verdict(spark, sf_dir):
    g = readings(spark, sf_dir).groupBy("unit").agg(F.avg("value").alias("m"), (F.stddev_samp("value") / F.sqrt(F.count(F.lit(1)))).alias("s"), F.count(F.lit(1)).alias("n")).where("n > 1")
    rows = g.crossJoin(F.broadcast(g.agg(F.avg("m").alias("error")))).withColumns({"low": F.col("m") - F.col("error") - 2 * F.col("s"), "high": F.col("m") - F.col("error") + 2 * F.col("s"), "spread": F.col("s") / 4})
    return layouts.verdict(rows, 0.05).select("unit", "floor", "verdict")
