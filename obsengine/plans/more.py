"""Queries for what windows and units owe to their neighbours in time."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit, context, detect, features, normalise, windows
from ..sources.tables import ORIGIN
from .queries import DEPART, FEATURES, HOURLY, LENGTH, OBS, SCORES, STATS, WIN, departures, hourly, query, r, readings, tokens


def placed(spark, sf_dir):
    return windows.windows_over(windows.units_of(readings(spark, sf_dir)), LENGTH, LENGTH)


@query(f"WITH {WIN}, k AS (SELECT w.unit, w.position, k, v.position AS before, v.win_end AS ends, row_number() OVER (PARTITION BY w.unit, w.position, k ORDER BY abs(v.win_end - (w.win_end - k * 30)), v.win_end) AS nth FROM wins w, range(1, 4) t(k), wins v WHERE v.unit = w.unit AND v.win_end < w.win_end AND abs(v.win_end - (w.win_end - k * 30)) <= 15) SELECT unit, position, CAST(k AS BIGINT) AS k, before, {r('ends', 'ends')} FROM k WHERE nth = 1")
def w14_windows_before(spark, sf_dir):
    return context.windows_before(placed(spark, sf_dir), 3, 30.0)


@query(f"WITH {OBS}, u AS (SELECT unit, floor(min(time)) AS s, floor(max(time)) + 1 AS e FROM obs GROUP BY unit), w AS (SELECT unit, CAST(p AS BIGINT) AS position, s + p * 100 AS win_start, s + p * 100 + 120 AS win_end FROM u, range(0, 100) t(p) WHERE s + p * 100 + 120 <= e), k AS (SELECT *, max(win_end) OVER (PARTITION BY unit ORDER BY win_start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ended FROM w) SELECT unit, position, {r('win_start', 'win_start')}, {r('win_end', 'win_end')}, {r('ended', 'ended')} FROM k WHERE win_start < ended")
def w17_interleaved_units(spark, sf_dir):
    return context.interleaved_units(windows.windows_over(windows.units_of(readings(spark, sf_dir)), 120.0, 100.0))


@query(f"WITH {SCORES} SELECT unit, position, {r('score', 'score')}, round(coalesce(avg(score) OVER (PARTITION BY unit ORDER BY position RANGE BETWEEN 5 PRECEDING AND 1 PRECEDING), score), 5) + 0.0 AS context FROM scores")
def f11_pool_context(spark, sf_dir):
    return context.pool_context(detect.window_score(departures(spark, sf_dir)).drop("mean_score"), "score", 5)


@query(f"WITH {SCORES} SELECT unit, position, {r('score', 'score')}, {r('max(score) OVER w', 'smooth_max')}, {r('avg(score) OVER w', 'smooth_mean')} FROM scores WINDOW w AS (PARTITION BY unit ORDER BY position RANGE BETWEEN 3 PRECEDING AND CURRENT ROW)")
def a16_smooth_scores(spark, sf_dir):
    return context.smooth_scores(detect.window_score(departures(spark, sf_dir)).drop("mean_score"), 4)


@query(f"WITH {SCORES}, um AS (SELECT unit, median(score) AS mid FROM scores GROUP BY unit), o AS (SELECT unit, 1.4826 * median(abs(score - mid)) AS mad FROM scores JOIN um USING (unit) GROUP BY unit) SELECT unit, position, {r('score', 'score')}, {r('(score - mid) / CASE WHEN mad > 0 THEN mad ELSE 1 END', 'referred')} FROM scores JOIN um USING (unit) JOIN o USING (unit)")
def a15_unit_reference(spark, sf_dir):
    return context.unit_reference(detect.window_score(departures(spark, sf_dir)).drop("mean_score"))


@query(f"WITH {DEPART}, m AS (SELECT channel, median(departure) AS mid FROM dep GROUP BY channel), x AS (SELECT unit, position, departure / CASE WHEN m.mid > 0 THEN m.mid ELSE 1 END AS q FROM dep JOIN m USING (channel)) SELECT unit, position, {r('avg(q)', 'mean_error')}, {r('max(q)', 'max_error')} FROM x GROUP BY unit, position".replace(", m AS (SELECT channel", ", md AS (SELECT channel").replace("WHEN m.mid > 0 THEN m.mid", "WHEN md.mid > 0 THEN md.mid").replace("FROM dep JOIN m USING", "FROM dep JOIN md USING"))
def a13_channel_error_scales(spark, sf_dir):
    return context.channel_error_scales(departures(spark, sf_dir).withColumnRenamed("departure", "error"))


@query(f"WITH {OBS}, {HOURLY}, p AS (SELECT a.channel, CAST(k AS BIGINT) AS lag, a.mean AS x, b.mean AS y FROM hourly a, (VALUES (1), (24), (168)) t(k), hourly b WHERE a.unit = b.unit AND a.channel = b.channel AND b.hour = a.hour - k) SELECT channel, lag, count(*) AS pairs, {r('corr(x, y)', 'correlation')} FROM p GROUP BY channel, lag")
def i15_autocorrelation(spark, sf_dir):
    return context.autocorrelation(hourly(spark, sf_dir), [1, 24, 168])


@query(f"WITH {OBS}, {STATS}, a AS (SELECT o.channel, o.value AS y, avg(o.value) OVER (PARTITION BY o.unit, o.channel) AS yhat FROM obs o) SELECT channel, count(*) AS n, {r('1 - sum(power(y - yhat, 2)) / (sum(y * y) - sum(y) * sum(y) / count(*))', 'r2')} FROM a GROUP BY channel")
def m5_answerability(spark, sf_dir):
    obs = readings(spark, sf_dir)
    means = obs.groupBy("unit", "channel").agg(F.avg("value").alias("answer"))
    return context.answerability(obs.join(means, ["unit", "channel"]), ["channel"], "value", "answer")


@query(f"WITH {WIN}, n AS (SELECT w.unit, w.position, o.value, row_number() OVER (PARTITION BY w.unit, w.position ORDER BY o.time, o.value) AS nth FROM wins w JOIN obs o ON o.unit = w.unit AND o.channel = 'click' AND o.time >= w.win_end + 6 AND o.time <= w.win_end + 30) SELECT unit, position, {r('value', 'target')} FROM n WHERE nth = 1")
def l8_forecast_target(spark, sf_dir):
    return context.forecast_target(placed(spark, sf_dir), readings(spark, sf_dir), "click", 6.0, 24.0)


@query(f"WITH {FEATURES}, p AS (SELECT unit, position, n AS target, least(n * 1.5, 3) + 0.5 AS predicted FROM (SELECT unit, position, CAST(sum(n) AS DOUBLE) AS n FROM ws GROUP BY unit, position)), k AS (SELECT *, predicted - target AS e, row_number() OVER (PARTITION BY unit ORDER BY position DESC) = 1 AS last FROM p) SELECT {r('sqrt(avg(e * e) FILTER (target < 5))', 'rmse_below_ceiling')}, {r('sqrt(avg(e * e) FILTER (last))', 'rmse_last')}, {r('avg(CASE WHEN abs(e) <= 0.2 * target THEN 1.0 ELSE 0 END)', 'share_within_fifth')}, {r('sum(CASE WHEN e < 0 THEN exp(-e / 13) - 1 ELSE exp(e / 10) - 1 END) FILTER (last)', 'asymmetric_score')} FROM k")
def k2_remaining_life_metrics(spark, sf_dir):
    n = features.window_statistics(tokens(spark, sf_dir)).groupBy("unit", "position").agg(F.sum("n").cast("double").alias("target"))
    return context.remaining_life_metrics(n.withColumn("predicted", F.least(F.col("target") * 1.5, F.lit(3.0)) + 0.5), 5.0)


@query(f"WITH {OBS}, s AS (SELECT *, CAST(floor(time / 168) AS BIGINT) AS stretch FROM obs), i AS (SELECT unit, stretch, count(DISTINCT time) AS instants FROM s GROUP BY ALL), h AS (SELECT unit, stretch, channel, count(DISTINCT time) AS held FROM s GROUP BY ALL) SELECT unit, stretch, channel, held, instants, {r('held / instants', 'share')} FROM h JOIN i USING (unit, stretch)")
def u8_coverage(spark, sf_dir):
    return context.coverage(readings(spark, sf_dir), 168.0)


@query(f"WITH {OBS}, {STATS}, e AS (SELECT channel AS variant, CAST(length(channel) AS DOUBLE) AS distance, avg(value) AS error FROM obs GROUP BY channel, unit), m AS (SELECT variant, distance, avg(error) AS error, var_samp(error) AS v, count(*) AS k FROM e GROUP BY ALL), b AS (SELECT error + sqrt(coalesce(v, 0) * (1.0 / k + 0.25)) AS line FROM m ORDER BY error, variant LIMIT 1) SELECT variant, {r('distance', 'distance')}, {r('error', 'error')} FROM m, b WHERE error <= line ORDER BY m.distance, variant LIMIT 1")
def b13_one_standard_error(spark, sf_dir):
    e = readings(spark, sf_dir).groupBy(F.col("channel").alias("variant"), "unit").agg(F.avg("value").alias("error"))
    return context.one_standard_error(e.withColumn("distance", F.length("variant").cast("double")), 0.25)


@query(f"WITH {OBS}, s AS (SELECT unit, floor(min(time)) AS a, floor(max(time)) + 1 AS b FROM obs GROUP BY unit), m AS (SELECT unit, a, b, CAST(unnest(generate_series(date_trunc('month', TIMESTAMP '2024-01-01' + to_hours(CAST(a AS INTEGER))), TIMESTAMP '2024-01-01' + to_hours(CAST(b AS INTEGER)), INTERVAL 1 MONTH)) AS DATE) AS month FROM s), h AS (SELECT *, greatest(a, date_diff('day', DATE '2024-01-01', month) * 24) AS x, least(b, date_diff('day', DATE '2024-01-01', CAST(month + INTERVAL 1 MONTH AS DATE)) * 24) AS y FROM m) SELECT unit || '/' || strftime(month, '%Y-%m') AS unit, {r('x', 'extent_start')}, {r('y', 'extent_end')} FROM h WHERE x < y")
def d11_month_units(spark, sf_dir):
    return context.month_units(readings(spark, sf_dir), ORIGIN)


@query(f"WITH {FEATURES}, l AS (SELECT 'mean' AS measure, mean AS x FROM ws UNION ALL SELECT 'deviation', deviation FROM ws UNION ALL SELECT 'mean_gap', mean_gap FROM ws) SELECT measure, {r('quantile_cont(x, 0.1)', 'p10')}, {r('quantile_cont(x, 0.5)', 'p50')}, {r('quantile_cont(x, 0.9)', 'p90')} FROM l GROUP BY measure")
def u3_summarise(spark, sf_dir):
    return audit.summarise(features.window_statistics(tokens(spark, sf_dir)), ["mean", "deviation", "mean_gap"])


@query(f"WITH {FEATURES}, s AS (SELECT avg(mean) AS m, stddev_pop(mean) AS sd, avg(mean_step) AS m2, stddev_pop(mean_step) AS sd2 FROM ws) SELECT unit, position, channel, {r('coalesce((mean - m) / sd, 0)', 'mean')}, {r('coalesce((mean_step - m2) / sd2, 0)', 'mean_step')} FROM ws, s")
def f7_standardise(spark, sf_dir):
    rows = features.window_statistics(tokens(spark, sf_dir)).select("unit", "position", "channel", "mean", "mean_step")
    return features.standardise_features(rows, ["mean", "mean_step"])


@query(f"WITH {OBS}, {STATS} SELECT channel FROM (SELECT DISTINCT channel FROM obs) ANTI JOIN (SELECT channel FROM stats WHERE n > 1990) USING (channel)".replace("stddev_pop(value) AS std FROM", "stddev_pop(value) AS std, count(*) AS n FROM"))
def n8_unfitted_channels(spark, sf_dir):
    obs = readings(spark, sf_dir)
    return normalise.unfitted_channels(obs, normalise.fit_standard(obs).where("n > 1990"))
