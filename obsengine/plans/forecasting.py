"""Queries for forecasts, neighbours, taught directions, convolutions and joined layouts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.ordering import kept
from ..operators import context, convolution, covariance, features, forecasts, impute, layouts, learners, nearest, repair, windows
from ..sources.tables import table
from .groups import vectors
from .more import placed
from .queries import BINS, CELLS, CHANNELS, LENGTH, OBS, QUERIES, SEED, place, query, r, readings, tokens

CONTEXT = 6
HALL = f"{OBS}, hourly AS (SELECT 'all' AS unit, channel, CAST(floor(time) AS BIGINT) AS hour, avg(value) AS mean, count(*) AS n FROM obs GROUP BY channel, CAST(floor(time) AS BIGINT))"


def hourly_all(spark, sf_dir):
    """Hourly means of each channel over all users, a series without many gaps."""
    return repair.hourly_means(readings(spark, sf_dir).withColumn("unit", F.lit("all")))


HIDE = "channel = 'click' AND (position + bin) % 3 = 0"
EIGHT = QUERIES["w8_cells"][1].replace("FROM b GROUP BY ALL", f"FROM b WHERE NOT ({HIDE}) GROUP BY ALL")


@query(EIGHT)
def w10_cells_without(spark, sf_dir):
    own = tokens(spark, sf_dir)
    hidden = own.select("unit", "position", "channel", windows.step_of("time", BINS).alias("bin")).where(HIDE).distinct()
    return windows.cells_without(own, hidden, BINS)


@query(f"WITH {CELLS} SELECT w.unit, w.position, l.channel, l.bin + (2 - j) * 6 AS bin, CAST(l.n IS NOT NULL AS BIGINT) AS presence, {r('coalesce(l.mean, l.carried)', 'mean')} FROM wins w CROSS JOIN range(0, 3) t(j) JOIN laid l ON l.unit = w.unit AND l.position = w.position - j")
def w15_join_history(spark, sf_dir):
    cells = windows.cells(tokens(spark, sf_dir), BINS)
    return context.join_history(cells, placed(spark, sf_dir), 3, LENGTH, BINS).select("unit", "position", "channel", "bin", "presence", "mean")


@query(f"WITH {CELLS}, whole AS (SELECT unit, position FROM wins WHERE position % 3 = 2), a3 AS (SELECT l.unit, l.position // 3 AS q, channel, bin + (l.position % 3) * 6 AS bin, mean, minimum, maximum FROM read l JOIN whole w ON w.unit = l.unit AND w.position // 3 = l.position // 3), b3 AS (SELECT t.unit, t.position // 3 AS q, channel, CAST(least(floor((t.position % 3 + time) / 3 * 18 + 1e-3), 17) AS BIGINT) AS bin, avg(value) AS mean, min(value) AS minimum, max(value) AS maximum FROM tokens t JOIN whole w ON w.unit = t.unit AND w.position // 3 = t.position // 3 GROUP BY ALL), f AS (SELECT a3.unit AS x, b3.unit AS y, abs(a3.mean - b3.mean) AS mean, abs(a3.minimum - b3.minimum) AS minimum, abs(a3.maximum - b3.maximum) AS maximum FROM a3 FULL JOIN b3 ON a3.unit = b3.unit AND a3.q = b3.q AND a3.channel = b3.channel AND a3.bin = b3.bin), l3 AS (SELECT x, y, unnest(['mean', 'minimum', 'maximum']) AS \"column\", unnest([mean, minimum, maximum]) AS gap FROM f) SELECT \"column\", count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) AS rows, count(*) FILTER (y IS NULL) AS only_a, count(*) FILTER (x IS NULL) AS only_b, {r('max(gap)', 'largest_gap')} FROM l3 GROUP BY \"column\"")
def w19_rollup_equals_whole(spark, sf_dir):
    """Three windows side by side against windows cut three times as long."""
    own, ends = tokens(spark, sf_dir), placed(spark, sf_dir)
    every = ends.where("position % 3 = 2").select("unit", F.floor(F.col("position") / 3).alias("position"))
    joined = context.join_history(windows.cells(own, BINS), ends, 3, LENGTH, BINS).where("position % 3 = 2 AND presence = 1").withColumn("position", F.floor(F.col("position") / 3))
    whole = windows.cells(layouts.concat_windows(own, 3), 3 * BINS).where("presence = 1").join(every, ["unit", "position"], "left_semi")
    return context.layout_gaps(joined, whole, ["unit", "position", "channel", "bin"], ["mean", "minimum", "maximum"])


@query(f"WITH sp AS ({QUERIES['f4_window_spectrum'][1]}) SELECT position, " + ", ".join(f"max(power) FILTER (channel = '{c}' AND cycle = {k}) AS {c}_p{k}" for c in CHANNELS for k in range(1, 4)) + " FROM sp GROUP BY position")
def f5_spectral_features(spark, sf_dir):
    day = F.floor(F.col("time") / 24)
    rows = readings(spark, sf_dir).select(F.lit("all").alias("unit"), day.alias("position"), "channel", (F.col("time") / 24 - day).alias("time"), "value")
    return features.spectral_features(features.window_spectrum(rows), CHANNELS, 3).drop("unit")


STEPS = 12


def series(spark, sf_dir):
    return convolution.token_series(tokens(spark, sf_dir), CHANNELS, STEPS)


@query()
def f6_convolution_features(spark, sf_dir):
    rows = kept(series(spark, sf_dir))
    told = convolution.convolution_features(rows, rows.where("position % 2 = 0"), len(CHANNELS), STEPS, 84, SEED)
    return told.select("unit", "position", F.posexplode("features").alias("feature", "share"))


@query()
def c2_convolution_ridge(spark, sf_dir):
    """The readings of the next user-day by a ridge on convolutions of this one, fitted on units of even number."""
    even = F.col("unit").cast("long") % 2 == 0
    n = tokens(spark, sf_dir).groupBy("unit", (F.col("position") - 1).alias("position")).agg(F.count(F.lit(1)).alias("target"))
    rows = series(spark, sf_dir).join(n, ["unit", "position"], "left").fillna(0, ["target"])
    rows = kept(rows.withColumn("fold", (F.col("position") % 2).cast("int")))  # twelve steps a channel; features are computed where they are read
    told = convolution.convolution_features(rows, rows.where(even), len(CHANNELS), STEPS, 84, SEED)
    out = convolution.convolution_ridge(told.where(even), told.where(~even), "target", False, [0.1, 1.0, 10.0])
    return out.select("unit", "position", "target", "predicted")


@query(f"WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS unit, lang, n_chars FROM documents), k AS (SELECT *, {place('unit', 'PARTITION BY lang')} AS nth FROM d) SELECT unit, lang AS corpus, round(n_chars / CASE lang WHEN 'en' THEN 1000.0 ELSE 500.0 END, 5) + 0.0 AS target FROM k WHERE nth <= 25 AND lang IN ('en', 'de')")
def c3_cross_corpus_rows(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("unit"), "lang", F.col("n_chars").cast("double").alias("target"))
    return learners.stacked_rows({c: (docs.where(F.col("lang") == c).drop("lang"), s) for c, s in (("en", 1000.0), ("de", 500.0))}, ["unit"], "target", 25, SEED)


@query("WITH e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), d AS (SELECT a.id, list_distance(a.v, b.v) AS d, row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.v, b.v), b.id) AS nth FROM e a JOIN e b ON b.id % 2 = 0 AND a.id <> b.id) SELECT id, round(avg(d), 5) + 0.0 AS score FROM d WHERE nth <= 3 GROUP BY id")
def a8_nearest_neighbour(spark, sf_dir):
    rows = vectors(spark, sf_dir).withColumnRenamed("vec_id", "id")
    return nearest.nearest_neighbour_detector(rows, rows.where("id % 2 = 0"), 3)


@query()
def a11_taught_direction(spark, sf_dir):
    """Vectors along the direction of label 3, of which every fourth number is a taught event."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), F.when(F.col("label") == 3, F.col("vec_id") % 4 + 1).otherwise(0).alias("event"))
    return covariance.taught_direction(rows, "v", 64, rows.where("vec_id % 2 = 0")).select("vec_id", "along", "distance", "combined")


QUARTER = 16**13 // 4


@query(f"WITH {CELLS}, hc AS (SELECT unit, position, channel, bin, CAST(bin AS DOUBLE) AS time, mean AS value, CAST('0x' || substr(sha256('2:42|' || length(unit) || ':' || unit || '|' || length(CAST(position AS VARCHAR)) || ':' || position || '|' || length(channel) || ':' || channel || '|' || length(CAST(bin AS VARCHAR)) || ':' || bin), 1, 13) AS BIGINT) < {QUARTER} AS hidden FROM read), li AS (SELECT *, last_value(CASE WHEN NOT hidden THEN time END IGNORE NULLS) OVER a AS t0, last_value(CASE WHEN NOT hidden THEN value END IGNORE NULLS) OVER a AS av, first_value(CASE WHEN NOT hidden THEN time END IGNORE NULLS) OVER z AS bt, first_value(CASE WHEN NOT hidden THEN value END IGNORE NULLS) OVER z AS bv FROM hc WINDOW a AS (PARTITION BY unit, position, channel ORDER BY time, value ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), z AS (PARTITION BY unit, position, channel ORDER BY time, value ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), lv AS (SELECT channel, avg(value) AS level FROM hc WHERE NOT hidden GROUP BY channel), er AS (SELECT unit, position, channel, avg(abs(coalesce(av + (time - t0) / nullif(bt - t0, 0) * (bv - av), av, bv, level) - value)) AS error FROM li LEFT JOIN lv USING (channel) WHERE hidden GROUP BY unit, position, channel), md AS (SELECT channel, median(error) AS mid FROM er GROUP BY channel) SELECT unit, position, {r('avg(error / CASE WHEN mid > 0 THEN mid ELSE 1 END)', 'mean_error')}, {r('max(error / CASE WHEN mid > 0 THEN mid ELSE 1 END)', 'max_error')} FROM er JOIN md USING (channel) GROUP BY unit, position")
def a14_imputation_error(spark, sf_dir):
    cells = windows.cells(tokens(spark, sf_dir), BINS)
    return context.channel_error_scales(impute.imputation_errors(impute.hidden_cells(cells, 0.25, SEED)))


@query(f"WITH {HALL}, pr AS (SELECT t.channel, t.hour, lag, avg(CASE WHEN abs(a.mean - b.mean) < 1 THEN power(a.mean - b.mean, 2) / 2 ELSE abs(a.mean - b.mean) - 0.5 END) AS error, count(*) AS pairs FROM hourly t CROSS JOIN range(1, 13) l(lag) JOIN hourly a ON a.channel = t.channel AND a.hour BETWEEN t.hour - 24 + lag AND t.hour - 1 JOIN hourly b ON b.channel = t.channel AND b.hour = a.hour - lag GROUP BY ALL), ba AS (SELECT pr.*, h.mean AS answer, row_number() OVER (PARTITION BY pr.channel, pr.hour ORDER BY round(error, 9), lag) AS nth FROM pr JOIN hourly h ON h.channel = pr.channel AND h.hour = pr.hour - lag WHERE pairs >= 6), la AS (SELECT t.channel, t.hour, any_value(t.mean) AS mean, arg_max(b.mean, b.hour) AS last FROM hourly t JOIN hourly b ON b.channel = t.channel AND b.hour BETWEEN t.hour - 24 AND t.hour - 1 GROUP BY ALL) SELECT la.channel, la.hour, {r('la.mean', 'mean')}, ba.lag, {r('coalesce(answer, last)', 'same_phase')} FROM la LEFT JOIN ba ON ba.channel = la.channel AND ba.hour = la.hour AND nth = 1")
def i4_same_phase(spark, sf_dir):
    rows = forecasts.history(hourly_all(spark, sf_dir), 24)
    return forecasts.same_phase(rows, 24).select("channel", "hour", "mean", "lag", "same_phase")


FILLED = ", ".join(r(f"coalesce(arg_max(b.mean, b.hour) FILTER (b.channel = t.channel AND b.hour <= t.hour - {CONTEXT - i}), arg_min(b.mean, b.hour) FILTER (b.channel = t.channel))", f"h{i}") for i in range(CONTEXT))
OTHERS = ", ".join(r(f"CASE WHEN t.channel = '{c}' THEN 0 ELSE coalesce(arg_max(b.mean, b.hour) FILTER (b.channel = '{c}'), 0) END", f"o_{c}") for c in CHANNELS)


@query(f"WITH {HALL} SELECT t.channel, t.hour, {r('t.mean', 'mean')}, {FILLED}, {OTHERS} FROM hourly t JOIN hourly b ON b.hour BETWEEN t.hour - {CONTEXT} AND t.hour - 1 GROUP BY t.channel, t.hour, t.mean HAVING count(*) FILTER (b.channel = t.channel) > 0")
def i6_ridge_rows(spark, sf_dir):
    return forecasts.ridge_rows(hourly_all(spark, sf_dir), CONTEXT, CHANNELS)[0].drop("unit")


def ridged(spark, sf_dir, others):
    rows, x = forecasts.ridge_rows(hourly_all(spark, sf_dir), CONTEXT, others)
    early = rows.where("hour < 480").withColumn("fold", F.when(F.col("hour") < 240, 0).otherwise(1))
    told = forecasts.clipped_ridge(early, rows.where("hour >= 480"), ["channel"], x, "mean", [10.0**k for k in range(-6, 5)])
    return told.select("channel", "hour", "mean", "predicted")


@query()
def i5_channel_ridge(spark, sf_dir):
    """Each hour from day 20 by its channel's ridge on the hours before, fitted on the days before."""
    return ridged(spark, sf_dir, [])


@query()
def i6_window_ridge(spark, sf_dir):
    return ridged(spark, sf_dir, CHANNELS)


def crossed(spark, sf_dir):
    """Hidden day cells of all users with their line, and the other channels in the same bin; the day's parity is the kind."""
    day = F.floor(F.col("time") / 24)
    one = readings(spark, sf_dir).select(F.lit("all").alias("unit"), day.alias("position"), "channel", "value", (F.col("time") / 24 - day).alias("time"), F.lit(0.0).alias("gap"))
    masked = impute.hidden_cells(windows.cells(one, 24), 0.25, SEED)
    line = impute.interpolate_hidden(masked).select("unit", "position", "channel", "bin", "line", "nearest")
    rows, x = forecasts.own_and_cross_rows(masked, CHANNELS)
    rows = rows.join(line, ["unit", "position", "channel", "bin"]).withColumns({"kind": F.col("position") % 2, "fold": (F.col("position") % 4 >= 2).cast("int")})
    return rows.dropna(subset=["line"]), x


@query()
def i8_own_and_cross_ridge(spark, sf_dir):
    rows, x = crossed(spark, sf_dir)
    told = forecasts.clipped_ridge(rows, rows, ["kind", "channel"], ["line", *x], "value", [10.0**k for k in range(-3, 4)])
    return told.select("kind", "channel", "position", "bin", "value", "predicted")


@query()
def i9_linear_cell_answer(spark, sf_dir):
    """A channel's hidden cells by a ridge on line, nearest visible, other channels and the bin."""
    rows, x = crossed(spark, sf_dir)
    rows = rows.withColumns({f"b{i}": (F.col("bin") == i).cast("double") for i in range(1, 24)})
    told = forecasts.clipped_ridge(rows, rows, ["channel"], ["line", "nearest", *x, *[f"b{i}" for i in range(1, 24)]], "value", [1.0, 10.0, 100.0, 1000.0])
    return told.select("channel", "position", "bin", "value", "predicted")


SEG = f"{HALL}, sg AS (SELECT t.channel AS kind, t.hour AS id, list(b.mean ORDER BY b.hour) AS p FROM hourly t JOIN hourly b ON b.channel = t.channel AND b.hour BETWEEN t.hour - {CONTEXT} AND t.hour - 1 GROUP BY t.channel, t.hour HAVING count(*) = {CONTEXT}), zs AS (SELECT kind, id, list_transform(p, lambda x: (x - list_avg(p)) / greatest(list_stddev_pop(p), 1e-6)) AS v FROM sg)"


def split_segments(spark, sf_dir):
    """Segments of the channels over all users: the queries from day 15, the library before."""
    rows = forecasts.segments(hourly_all(spark, sf_dir), CONTEXT).select(F.col("channel").alias("kind"), F.col("hour").alias("id"), "v")
    return rows.where("id >= 360"), rows.where("id < 360")


@query(f"WITH {SEG}, d AS (SELECT a.kind, a.id, b.id AS other, list_distance(a.v, b.v) AS distance, row_number() OVER (PARTITION BY a.kind, a.id ORDER BY list_distance(a.v, b.v), b.id) AS nth FROM zs a JOIN zs b ON a.kind = b.kind AND a.id >= 360 AND b.id < 360) SELECT kind, id, other, {r('distance', 'distance')} FROM d WHERE nth = 1")
def i11_analog_forecast(spark, sf_dir):
    return forecasts.analog_forecast(*split_segments(spark, sf_dir))


@query(f"WITH {SEG}, pl AS (SELECT kind, id AS other, {place('CAST(id AS VARCHAR)', 'PARTITION BY kind')} AS place, count(*) OVER (PARTITION BY kind) AS n FROM zs WHERE id < 360) SELECT a.id, a.kind, other FROM zs a JOIN pl ON pl.kind = a.kind AND place = CAST(('0x' || substr(sha256('42|' || a.id), 1, 15)) AS BIGINT) % n + 1 WHERE a.id >= 360")
def i12_library_draw(spark, sf_dir):
    asked, library = split_segments(spark, sf_dir)
    return forecasts.library_draw(asked, library, SEED)


@query(f"WITH {HALL}, b AS (SELECT *, CASE WHEN hour >= 24 AND hour < 72 THEN 1 WHEN hour >= 72 AND hour < 240 THEN 3 WHEN hour >= 240 AND hour < 960 THEN 10 END AS days FROM hourly), h AS (SELECT DISTINCT days, hour FROM b WHERE days IS NOT NULL), k AS (SELECT *, {place('CAST(hour AS VARCHAR)', 'PARTITION BY days')} AS nth FROM h) SELECT CAST(days AS BIGINT) AS days, hour, channel, {r('mean', 'mean')} FROM b JOIN k USING (days, hour) WHERE nth <= 20")
def i13_cold_start_cells(spark, sf_dir):
    return forecasts.cold_start_cells(hourly_all(spark, sf_dir), [1, 3, 10], 20, SEED).select("days", "hour", "channel", "mean")
