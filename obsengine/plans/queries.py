"""A query for each operator over the given tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ordering import kept
from ..operators import audit, detect, draws, features, impute, metrics, normalise, repair, resample, windows
from ..sources.tables import LINE_CHANNELS, describe, event_readings, order_line_readings, order_line_values, table

LENGTH, STRIDE, BINS, SEED = 24.0, 24.0, 6, 42
QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = rounded(f), sql
        return f

    return add


def rounded(f: Callable[[SparkSession, str], DataFrame], digits: int = 5) -> Callable[[SparkSession, str], DataFrame]:
    """Doubles to five places, integers as longs: sums differ in their last digits by the order of rows."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = f(spark, sf_dir)
        kinds = dict(df.dtypes)
        return df.select(*[(F.round(c, digits) + 0.0).alias(c) if kinds[c] == "double" else F.col(c).cast("long").alias(c) if kinds[c] in ("int", "smallint", "tinyint") else F.col(c) for c in df.columns])

    run.__name__, run.__doc__ = f.__name__, f.__doc__
    return run


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_readings(table(spark, sf_dir, "events"))


def dealt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`readings` dealt by their unit once: windows, tokens, cells, hours and histories are groups inside a unit, which Spark then finds in place."""
    return readings(spark, sf_dir).repartition("unit")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_line_readings(table(spark, sf_dir, "lineitem"))


def assigned(spark: SparkSession, sf_dir: str, length: float = LENGTH, stride: float = STRIDE) -> DataFrame:
    obs = dealt(spark, sf_dir)
    return windows.assign_windows(obs, windows.units_of(obs), length, stride)


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.tokenise(assigned(spark, sf_dir), LENGTH)


OBS = "obs AS (SELECT CAST(user_id AS VARCHAR) AS unit, event_type AS channel, date_diff('microsecond', TIMESTAMP '2024-01-01', ts) / 3.6e9 AS time, value FROM events WHERE value IS NOT NULL AND isfinite(value))"
LINES = "wide AS (SELECT CAST(l_suppkey AS VARCHAR) AS unit, date_diff('microsecond', TIMESTAMP '1995-01-01', l_shipdate) / 3.6e9 AS time, l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem), obs AS (SELECT unit, time, l_orderkey, l_linenumber, 'quantity' AS channel, l_quantity AS value FROM wide UNION ALL SELECT unit, time, l_orderkey, l_linenumber, 'price', l_extendedprice FROM wide UNION ALL SELECT unit, time, l_orderkey, l_linenumber, 'discount', l_discount FROM wide UNION ALL SELECT unit, time, l_orderkey, l_linenumber, 'tax', l_tax FROM wide)"
UNITS = "units AS (SELECT unit, floor(min(time)) AS extent_start, floor(max(time)) + 1 AS extent_end FROM obs GROUP BY unit)"
WIN = f"{OBS}, {UNITS}, wins AS (SELECT unit, CAST(p AS BIGINT) AS position, extent_start + p * 24 AS win_start, extent_start + p * 24 + 24 AS win_end FROM units, range(0, 100) r(p) WHERE extent_start + p * 24 + 24 <= extent_end), assigned AS (SELECT o.*, w.position, w.win_start FROM obs o JOIN wins w ON o.unit = w.unit AND o.time >= w.win_start AND o.time < w.win_end)"
TOK = f"{WIN}, tokens AS (SELECT unit, position, channel, value, t AS time, t - coalesce(lag(t) OVER (PARTITION BY unit, position, channel ORDER BY t, value), 0) AS gap FROM (SELECT *, (time - win_start) / 24 AS t FROM assigned))"
R = "round({0}, 5) + 0.0 AS {1}"


def r(expr: str, name: str) -> str:
    return R.format(expr, name)


def place(key: str, over: str = "") -> str:
    """SQL of the place by seeded rank of one text."""
    return f"row_number() OVER ({over} ORDER BY sha256('2:42|' || length({key}) || ':' || {key}), {key})"


@query(f"WITH {OBS} SELECT unit, channel, {r('time', 'time')}, {r('value', 'value')} FROM obs")
def s1_event_readings(spark, sf_dir):
    return readings(spark, sf_dir)


@query(f"WITH {LINES} SELECT unit, {r('time', 'time')}, l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, channel, {r('value', 'value')} FROM obs WHERE value IS NOT NULL AND isfinite(value)")
def p1_to_long(spark, sf_dir):
    return lines(spark, sf_dir)


@query(f"WITH {OBS} SELECT count(DISTINCT unit) AS units, count(*) AS readings, count(DISTINCT channel) AS channels, bit_xor(CAST('0x' || substr(md5(concat_ws('|', coalesce(unit, ''), coalesce(channel, ''), CAST(CAST(round(time * 3.6e9) AS BIGINT) AS VARCHAR), CAST(CAST(round(value * 1e6) AS BIGINT) AS VARCHAR))), 1, 15) AS BIGINT)) AS fingerprint, CAST(sum(CAST('0x' || substr(md5(concat_ws('|', coalesce(unit, ''), coalesce(channel, ''), CAST(CAST(round(time * 3.6e9) AS BIGINT) AS VARCHAR), CAST(CAST(round(value * 1e6) AS BIGINT) AS VARCHAR))), 1, 15) AS BIGINT)::HUGEINT) % 1152921504606846976 AS BIGINT) AS total FROM obs")
def s16_describe(spark, sf_dir):
    return describe(readings(spark, sf_dir))


BOUNDS = [("click", 1.0, 5.0, 60.0, 90.0), ("view", 2.0, 4.0, 50.0, 200.0), ("error", 0.0, 0.0, 10.0, 20.0)]
BOUNDS_SQL = "bounds(channel, removed_below, clipped_below, clipped_above, removed_above) AS (VALUES " + ", ".join(map(str, BOUNDS)) + ")"


def bounds(spark):
    return spark.createDataFrame(BOUNDS, "channel string, removed_below double, clipped_below double, clipped_above double, removed_above double")


@query(f"WITH {OBS}, {BOUNDS_SQL} SELECT unit, channel, {r('time', 'time')}, {r('least(greatest(value, coalesce(clipped_below, value)), coalesce(clipped_above, value))', 'value')} FROM obs LEFT JOIN bounds USING (channel) WHERE coalesce(value >= removed_below, true) AND coalesce(value <= removed_above, true)")
def p12_clean(spark, sf_dir):
    return repair.clean(readings(spark, sf_dir), bounds(spark))


@query(f"WITH {OBS}, {BOUNDS_SQL}, m AS (SELECT *, coalesce(value < removed_below OR value > removed_above, false) AS gone FROM obs LEFT JOIN bounds USING (channel)) SELECT channel, count(*) FILTER (gone) AS removed, count(*) FILTER (NOT gone AND coalesce(value < clipped_below OR value > clipped_above, false)) AS clipped, count(*) AS readings FROM m GROUP BY channel")
def p13_cleaning_record(spark, sf_dir):
    return repair.cleaning_record(readings(spark, sf_dir), bounds(spark))


@query(f"WITH {OBS}, v AS (SELECT *, lag(time) OVER (PARTITION BY unit, channel ORDER BY time, value) AS previous FROM obs) SELECT unit, channel, {r('time', 'time')}, {r('value', 'value')}, {r('previous', 'previous')} FROM v WHERE time <= previous")
def p14_time_violations(spark, sf_dir):
    return repair.time_violations(readings(spark, sf_dir))


HOURLY = "hourly AS (SELECT unit, channel, CAST(floor(time) AS BIGINT) AS hour, avg(value) AS mean, count(*) AS n FROM obs GROUP BY ALL)"


def hourly(spark, sf_dir):
    return repair.hourly_means(dealt(spark, sf_dir))


@query(f"WITH {OBS}, {HOURLY} SELECT unit, channel, hour, {r('mean', 'mean')}, n FROM hourly")
def d13_hourly_means(spark, sf_dir):
    return hourly(spark, sf_dir)


@query(f"WITH {OBS}, {HOURLY}, c AS (SELECT *, count(*) OVER (PARTITION BY unit, channel ORDER BY hour RANGE BETWEEN 167 PRECEDING AND 1 PRECEDING) AS before FROM hourly) SELECT unit, channel, hour, {r('mean', 'mean')}, n, before FROM c WHERE before >= 3")
def p15_scorable(spark, sf_dir):
    return repair.scorable(hourly(spark, sf_dir), 167, 3)


@query(f"WITH {LINES}, k AS (SELECT *, row_number() OVER (PARTITION BY unit, channel, time ORDER BY l_orderkey DESC, l_linenumber) AS nth FROM obs) SELECT unit, channel, {r('time', 'time')}, l_orderkey, {r('value', 'value')} FROM k WHERE nth = 1")
def d1_keep_preferred(spark, sf_dir):
    return repair.keep_preferred(lines(spark, sf_dir), ["unit", "channel", "time"], [F.desc("l_orderkey"), F.asc("l_linenumber")]).select("unit", "channel", "time", "l_orderkey", "value")


@query(f"WITH {LINES}, k AS (SELECT *, count(*) OVER (PARTITION BY unit, channel, time) AS n FROM obs) SELECT unit, channel, {r('time', 'time')}, {r('value', 'value')} FROM k WHERE n = 1")
def d2_drop_repeated_groups(spark, sf_dir):
    return repair.drop_repeated_groups(lines(spark, sf_dir), ["unit", "channel", "time"]).select("unit", "channel", "time", "value")


@query("WITH c AS (SELECT l_suppkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, l_returnflag) AS nth, sum(n) OVER (PARTITION BY l_suppkey) AS total FROM c) SELECT l_suppkey, l_returnflag, n, CAST(total AS BIGINT) AS total FROM k WHERE nth = 1")
def d3_most_frequent(spark, sf_dir):
    return repair.most_frequent(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_returnflag")


@query(f"WITH {OBS} SELECT channel, count(DISTINCT unit) AS units FROM obs GROUP BY channel ORDER BY units DESC, channel LIMIT 3")
def d5_widest_channels(spark, sf_dir):
    return repair.widest_channels(readings(spark, sf_dir), 3)


@query(f"WITH {OBS}, k AS (SELECT unit FROM obs GROUP BY unit HAVING count(*) >= 70) SELECT unit, channel, {r('time', 'time')}, {r('value', 'value')} FROM obs SEMI JOIN k USING (unit)")
def d6_units_with_least(spark, sf_dir):
    return repair.units_with_least(readings(spark, sf_dir), 70)


@query(f"WITH {LINES} SELECT unit, channel, {r('time', 'time')}, {r('min(value)', 'value')}, min(value) <> max(value) AS disagrees, count(*) AS rows FROM obs GROUP BY unit, channel, time")
def d7_one_row_per_instant(spark, sf_dir):
    return repair.wide_one_row_per_instant(order_line_values(table(spark, sf_dir, "lineitem")), LINE_CHANNELS)


@query(f"WITH {OBS}, k AS (SELECT *, CAST(floor(time / 6) AS BIGINT) AS bin, row_number() OVER (PARTITION BY unit, channel, floor(time / 6) ORDER BY time, value) AS nth FROM obs) SELECT unit, channel, bin, {r('time', 'time')}, {r('value', 'value')} FROM k WHERE nth = 1")
def d8_decimate(spark, sf_dir):
    return repair.decimate(readings(spark, sf_dir), 6.0)


@query(f"WITH {OBS}, k AS (SELECT *, avg(value) OVER w AS m, stddev_pop(value) OVER w AS s FROM obs WINDOW w AS (PARTITION BY unit, channel)) SELECT unit, channel, {r('time', 'time')}, {r('(value - m) / CASE WHEN s > 0 THEN s ELSE 1 END', 'value')} FROM k")
def d12_scale_within_unit(spark, sf_dir):
    return repair.scale_within_unit(readings(spark, sf_dir))


DENSE = f"{HOURLY}, span AS (SELECT unit, channel, min(hour) AS a, max(hour) AS b FROM hourly GROUP BY ALL), axis AS (SELECT unit, channel, unnest(range(a, b + 1)) AS hour FROM span), dense AS (SELECT unit, channel, hour, mean, n FROM axis LEFT JOIN hourly USING (unit, channel, hour))"


@query(f"WITH {OBS}, {DENSE} SELECT unit, channel, hour, {r('mean', 'mean')}, n, {r('last_value(mean IGNORE NULLS) OVER (PARTITION BY unit, channel ORDER BY hour)', 'filled')} FROM dense")
def d15_densify_fill_forward(spark, sf_dir):
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))  # a number that holds: what is dealt is small beside the hours laid out
    return repair.filled_hours(repair.hourly_means(readings(spark, sf_dir).repartition(parts, "unit")))


SUPPLIERS = "u AS (SELECT CAST(s_suppkey AS VARCHAR) AS unit FROM supplier)"


def suppliers(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("unit"))


@query(f"WITH {SUPPLIERS} SELECT unit, {place('unit')} AS place FROM u")
def r1_seeded_rank(spark, sf_dir):
    return draws.ranked(suppliers(spark, sf_dir), ["unit"], SEED).select("unit", "place")


@query(f"WITH {SUPPLIERS}, k AS (SELECT unit, {place('unit')} AS place, count(*) OVER () AS n FROM u) SELECT unit, CASE WHEN place <= floor(n * 0.2) THEN 'held_out' ELSE 'training' END AS side FROM k")
def r2_split_by_seed(spark, sf_dir):
    return draws.split_by_seed(suppliers(spark, sf_dir), 0.2, SEED)


@query(f"WITH {SUPPLIERS}, k AS (SELECT unit, {place('unit')} AS place, count(*) OVER () AS n FROM u) SELECT unit FROM k WHERE place <= ceil(n * 0.33)")
def r5_share(spark, sf_dir):
    return draws.share(suppliers(spark, sf_dir), 0.33, SEED)


LABELS = "l AS (SELECT CAST(doc_id AS VARCHAR) AS unit, toxic FROM labels)"


def outcomes(spark, sf_dir):
    return table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("unit"), F.col("toxic").cast("long").alias("toxic"))


@query(f"WITH {LABELS}, s AS (SELECT sum(toxic) AS ones, count(*) AS total FROM l), k AS (SELECT *, {place('unit', 'PARTITION BY toxic')} AS place FROM l), w AS (SELECT *, (2 * ones * (total // 3) + total) // (2 * total) AS want, total // 3 AS n FROM s) SELECT unit, CAST(toxic AS BIGINT) AS toxic FROM k, w WHERE CASE WHEN toxic = 1 THEN place <= want ELSE place <= n - want END")
def r9_draw_class_proportional(spark, sf_dir):
    pool = outcomes(spark, sf_dir)
    return draws.draw_class_proportional(pool, "toxic", ["unit"], pool.count() // 3, SEED)


@query(f"WITH {LABELS}, z AS (SELECT count(*) AS zeros FROM l WHERE toxic = 0), k AS (SELECT *, {place('unit', 'PARTITION BY toxic')} AS place FROM l) SELECT unit, CAST(toxic AS BIGINT) AS toxic, CAST((place - 1 + CASE WHEN toxic = 1 THEN zeros ELSE 0 END) % 5 AS BIGINT) AS fold FROM k, z")
def r13_outcome_folds(spark, sf_dir):
    return draws.outcome_folds(outcomes(spark, sf_dir), "toxic", ["unit"], 5, SEED)


@query(f"WITH d AS (SELECT source, CAST(doc_id AS VARCHAR) AS unit FROM documents), k AS (SELECT *, {place('unit', 'PARTITION BY source')} AS place FROM d) SELECT source, unit FROM k WHERE place <= 7")
def r14_sample_per_group(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("source", F.col("doc_id").cast("string").alias("unit"))
    return draws.sample_per_group(docs, ["source"], ["unit"], 7, SEED)


@query(f"WITH {OBS} SELECT channel, row_number() OVER (ORDER BY channel) AS channel_id FROM (SELECT DISTINCT channel FROM obs)")
def n1_vocabulary(spark, sf_dir):
    return normalise.extend_vocabulary(None, readings(spark, sf_dir))


@query(f"WITH {OBS} SELECT channel, count(*) AS n, {r('avg(value)', 'mean')}, {r('stddev_pop(value)', 'std')} FROM obs GROUP BY channel")
def n2_fit_standard(spark, sf_dir):
    return normalise.fit_standard(readings(spark, sf_dir))


ROBUST = "mid AS (SELECT channel, median(value) AS median, stddev_pop(value) AS std FROM obs GROUP BY channel), robust AS (SELECT channel, any_value(m.median) AS median, any_value(std) AS std, median(abs(value - m.median)) AS mad FROM obs JOIN mid m USING (channel) GROUP BY channel)"


@query(f"WITH {OBS}, {ROBUST} SELECT channel, {r('median', 'median')}, {r('std', 'std')}, {r('mad', 'mad')}, {r('CASE WHEN mad > 0 THEN 1.4826 * mad ELSE std END', 'scale')} FROM robust")
def n3_fit_robust(spark, sf_dir):
    return normalise.fit_robust(readings(spark, sf_dir))


@query(f"WITH {OBS}, q AS (SELECT channel, quantile_cont(value, [i / 20.0 FOR i IN range(21)]) AS q FROM obs GROUP BY channel) SELECT channel, CAST(k - 1 AS BIGINT) AS knot, {r('q[k]', 'quantile')} FROM q, range(1, 22) t(k)".replace("quantile_cont(value, [i / 20.0 FOR i IN range(21)])", "quantile_cont(value, [" + ", ".join(f"{i / 20}" for i in range(21)) + "])"))
def n4_fit_quantile(spark, sf_dir):
    return normalise.fit_quantile(readings(spark, sf_dir), 21).select("channel", F.posexplode("quantiles").alias("knot", "quantile"))


STATS = "stats AS (SELECT channel, avg(value) AS mean, stddev_pop(value) AS std FROM obs GROUP BY channel)"


@query(f"WITH {OBS}, {STATS} SELECT unit, channel, {r('time', 'time')}, {r('(value - mean) / CASE WHEN std > 0 THEN std ELSE 1 END', 'value')} FROM obs JOIN stats USING (channel)")
def n5_normalise(spark, sf_dir):
    obs = readings(spark, sf_dir)
    return normalise.normalise(obs, normalise.fit_standard(obs))


@query(f"WITH {OBS}, {ROBUST} SELECT unit, channel, {r('time', 'time')}, {r('greatest(least((value - median) / (CASE WHEN mad > 0 THEN 1.4826 * mad ELSE std END), 2), -2)', 'value')} FROM obs JOIN robust USING (channel)")
def n5_normalise_robust(spark, sf_dir):
    obs = readings(spark, sf_dir)
    return normalise.normalise_robust(obs, normalise.fit_robust(obs), 2.0)


@query(f"WITH {OBS} SELECT unit, channel, {r('time', 'time')}, {r('value', 'value')} FROM obs")
def n6_round_trip(spark, sf_dir):
    obs = readings(spark, sf_dir)
    stats = normalise.fit_standard(obs)
    return normalise.denormalise(normalise.normalise(obs, stats), stats)


@query(f"WITH {OBS}, {STATS}, z AS (SELECT channel, (value - mean) / CASE WHEN std > 0 THEN std ELSE 1 END AS z FROM obs JOIN stats USING (channel)) SELECT channel, {r('min(z)', 'lowest')}, {r('max(z)', 'highest')}, {r('avg(CASE WHEN abs(z) > 1.5 THEN 1.0 ELSE 0.0 END)', 'share_beyond')} FROM z GROUP BY channel")
def n9_diagnose_channels(spark, sf_dir):
    obs = readings(spark, sf_dir)
    return normalise.diagnose_channels(obs, normalise.fit_standard(obs), 1.5)


@query(f"WITH {WIN} SELECT unit, position, {r('win_start', 'win_start')}, {r('win_end', 'win_end')} FROM wins")
def w1_windows_over(spark, sf_dir):
    return windows.windows_over(windows.units_of(readings(spark, sf_dir)), LENGTH, STRIDE)


@query(f"WITH {OBS}, {UNITS}, wins AS (SELECT unit, CAST(p AS BIGINT) AS position, extent_start + p * 7 AS win_start FROM units, range(0, 200) r(p) WHERE extent_start + p * 7 + 48 <= extent_end) SELECT o.unit, channel, {r('time', 'time')}, {r('value', 'value')}, position, {r('win_start', 'win_start')} FROM obs o JOIN wins w ON o.unit = w.unit AND o.time >= win_start AND o.time < win_start + 48")
def w2_assign_windows(spark, sf_dir):
    return assigned(spark, sf_dir, 48.0, 7.0)


@query(f"WITH {TOK} SELECT unit, position, channel, {r('value', 'value')}, {r('time', 'time')}, {r('gap', 'gap')} FROM tokens")
def w3_tokenise(spark, sf_dir):
    return tokens(spark, sf_dir)


@query(f"WITH {WIN} SELECT unit FROM units ANTI JOIN assigned USING (unit)")
def w4_empty_units(spark, sf_dir):
    return windows.empty_units(windows.units_of(readings(spark, sf_dir)), assigned(spark, sf_dir))


@query(f"WITH {WIN} SELECT unit, CAST(greatest(floor((extent_end - extent_start - 24) / 24) + 1, 0) AS BIGINT) AS windows FROM units")
def w6_window_counts(spark, sf_dir):
    return windows.window_counts(windows.units_of(readings(spark, sf_dir)), LENGTH, STRIDE)


CELLS = f"""{TOK}, b AS (SELECT *, CAST(least(floor(time * 6 + 1e-3), 5) AS BIGINT) AS bin FROM tokens),
read AS (SELECT unit, position, channel, bin, count(*) AS n, avg(value) AS mean, min(value) AS minimum, max(value) AS maximum, arg_min(value, (time, value)) AS first, arg_max(value, (time, value)) AS last, max(time) AS latest FROM b GROUP BY ALL),
held AS (SELECT unit, position, channel, unnest(range(0, 6)) AS bin FROM (SELECT DISTINCT unit, position, channel FROM tokens)),
laid AS (SELECT h.*, n, mean, minimum, maximum, first, latest, last_value(last IGNORE NULLS) OVER w AS carried, last_value(CASE WHEN n IS NOT NULL THEN bin END IGNORE NULLS) OVER w AS seen FROM held h LEFT JOIN read USING (unit, position, channel, bin) WINDOW w AS (PARTITION BY unit, position, channel ORDER BY bin ROWS UNBOUNDED PRECEDING))"""


@query(f"WITH {CELLS} SELECT unit, position, channel, bin, CAST(n IS NOT NULL AS BIGINT) AS presence, {r('ln(1 + coalesce(n, 0))', 'log_count')}, {r('coalesce(mean, carried)', 'mean')}, {r('coalesce(minimum, carried)', 'minimum')}, {r('coalesce(maximum, carried)', 'maximum')}, {r('coalesce(first, carried)', 'first')}, {r('carried', 'last')}, {r('latest * 6 - bin', 'last_offset')}, bin - seen AS since FROM laid")
def w8_cells(spark, sf_dir):
    return windows.cells(tokens(spark, sf_dir), BINS)


@query(f"WITH {TOK} SELECT unit, position, channel, CAST(floor(least(floor(time * 6 + 1e-3), 5) / 2) AS BIGINT) AS bin, count(*) AS n, {r('avg(value)', 'mean')}, {r('min(value)', 'minimum')}, {r('max(value)', 'maximum')}, {r('arg_min(value, (time, value))', 'first')}, {r('arg_max(value, (time, value))', 'last')} FROM tokens GROUP BY ALL".replace("GROUP BY ALL", "GROUP BY 1, 2, 3, 4"))
def w16_rollup_cells(spark, sf_dir):
    return windows.rollup_cells(windows.cells(tokens(spark, sf_dir), BINS), 2)


@query(f"WITH {CELLS} SELECT unit, position, channel, bin AS step, {r('coalesce(carried, 0)', 'value')}, CAST(n IS NOT NULL AS BIGINT) AS observed FROM laid")
def w11_regular_grid(spark, sf_dir):
    return windows.regular_grid(tokens(spark, sf_dir), BINS)


FEATURES = f"{TOK}, stepped AS (SELECT *, abs(value - lag(value) OVER (PARTITION BY unit, position, channel ORDER BY time, value)) AS step FROM tokens), ws AS (SELECT unit, position, channel, count(*) AS n, avg(value) AS mean, stddev_pop(value) AS deviation, min(value) AS minimum, max(value) AS maximum, arg_min(value, (time, value)) AS first, arg_max(value, (time, value)) AS last, CASE WHEN count(*) > 1 THEN regr_slope(value, time) END AS slope, avg(step) AS mean_step, avg(gap) AS mean_gap FROM stepped GROUP BY unit, position, channel)"


@query(f"WITH {FEATURES} SELECT unit, position, channel, n, {', '.join(r(c, c) for c in ('mean', 'deviation', 'minimum', 'maximum', 'first', 'last', 'mean_step', 'mean_gap'))} FROM ws")
def f1_window_statistics(spark, sf_dir):
    return features.window_statistics(tokens(spark, sf_dir)).drop("slope")


@query(f"WITH {TOK} SELECT unit, position, channel, round(regr_slope(value, time), 2) + 0.0 AS slope FROM tokens GROUP BY unit, position, channel HAVING var_pop(time) > 1e-4")
def f1_window_slopes(spark, sf_dir):
    toks = tokens(spark, sf_dir)
    spread = toks.groupBy("unit", "position", "channel").agg(F.var_pop("time").alias("spread")).where("spread > 1e-4")
    return features.window_statistics(toks).join(spread, ["unit", "position", "channel"]).select("unit", "position", "channel", F.round("slope", 2).alias("slope"))


@query(f"WITH {FEATURES} SELECT unit, position, count(*) AS channels, CAST(sum(n) AS BIGINT) AS tokens, " + ", ".join(r(f"{f}({c})", f"{c}_{name}") for c in ("mean", "maximum") for f, name in (("avg", "mean"), ("stddev_pop", "deviation"), ("min", "min"), ("max", "max"))) + " FROM ws GROUP BY unit, position")
def f3_channel_aggregated(spark, sf_dir):
    return features.channel_aggregated_features(features.window_statistics(tokens(spark, sf_dir)), ["mean", "maximum"])


CHANNELS = ["click", "error", "purchase", "signup", "view"]


@query(f"WITH {FEATURES} SELECT unit, position, " + ", ".join(f"coalesce(max(n) FILTER (channel = '{c}'), 0) AS {c}_n, {r(f'''max(mean) FILTER (channel = '{c}')''', f'{c}_mean')}" for c in CHANNELS) + " FROM ws GROUP BY unit, position")
def f2_per_channel(spark, sf_dir):
    return features.per_channel_features(features.window_statistics(tokens(spark, sf_dir)), CHANNELS, ["n", "mean"])


@query(f"""WITH {OBS}, one AS (SELECT 'all' AS unit, channel, time, value FROM obs), w AS (SELECT CAST(floor(time / 24) AS BIGINT) AS position, channel, time / 24 - floor(time / 24) AS t, value FROM one), c AS (SELECT *, count(*) OVER (PARTITION BY position, channel) AS n FROM w),
x AS (SELECT c.*, k AS cycle, cos(2 * pi() * k * t) AS cc, sin(2 * pi() * k * t) AS ss FROM c, range(1, 9) r(k) WHERE n >= 4 AND k <= least(floor(n / 2), 8)),
m AS (SELECT position, channel, cycle, avg(value * value) - avg(value) * avg(value) AS yy, avg(value * cc) - avg(value) * avg(cc) AS yc, avg(value * ss) - avg(value) * avg(ss) AS ys, avg(cc * cc) - avg(cc) * avg(cc) AS cc, avg(ss * ss) - avg(ss) * avg(ss) AS ss, avg(cc * ss) - avg(cc) * avg(ss) AS cs FROM x GROUP BY position, channel, cycle)
SELECT position, channel, CAST(cycle AS BIGINT) AS cycle, round(CASE WHEN cc * ss - cs * cs > 1e-9 AND yy > 1e-9 THEN (ss * yc * yc + cc * ys * ys - 2 * cs * yc * ys) / (yy * (cc * ss - cs * cs)) END, 5) + 0.0 AS power FROM m""")
def f4_window_spectrum(spark, sf_dir):
    day = F.floor(F.col("time") / 24)
    rows = readings(spark, sf_dir).select(F.lit("all").alias("unit"), day.alias("position"), "channel", (F.col("time") / 24 - day).alias("time"), "value")
    return features.window_spectrum(rows).drop("unit")


SUMS = f"{TOK}, summ AS (SELECT unit, position, channel, avg(value) AS mean, min(value) AS minimum, max(value) AS maximum, arg_max(value, (time, value)) AS last, ln(1 + count(*)) AS log_count FROM tokens GROUP BY unit, position, channel), long AS (SELECT unit, position, channel, kind, x FROM summ UNPIVOT (x FOR kind IN (mean, minimum, maximum, last, log_count)))"
FLOOR = "mids AS (SELECT channel, kind, median(x) AS mid FROM long GROUP BY ALL), mads AS (SELECT channel, kind, median(abs(x - mid)) * 0.14826 AS floor FROM long JOIN mids USING (channel, kind) GROUP BY ALL), rest AS (SELECT kind, median(floor) AS rest FROM mads WHERE floor > 0 GROUP BY kind), floors AS (SELECT channel, kind, CASE WHEN floor > 0 THEN floor ELSE coalesce(rest, 1.0) END AS floor FROM mads LEFT JOIN rest USING (kind))"
DEPART = f"{SUMS}, {FLOOR}, h AS (SELECT a.unit, a.position, a.channel, a.kind, a.x, list(b.x) FILTER (b.x IS NOT NULL) AS h FROM long a LEFT JOIN long b ON a.unit = b.unit AND a.channel = b.channel AND a.kind = b.kind AND b.position BETWEEN a.position - 5 AND a.position - 1 GROUP BY ALL), m AS (SELECT *, list_aggregate(h, 'median') AS mid FROM h), d AS (SELECT m.*, list_aggregate(list_transform(h, lambda v: abs(v - mid)), 'median') AS mad FROM m), dep AS (SELECT unit, position, channel, max(CASE WHEN 2 * coalesce(len(h), 0) >= 5 THEN abs(x - mid) / greatest(1.4826 * mad, floor) ELSE 0 END) AS departure FROM d JOIN floors USING (channel, kind) GROUP BY unit, position, channel)"


def departures(spark, sf_dir):
    summaries = kept(detect.window_summaries(tokens(spark, sf_dir)))  # read for the floor and for the histories
    return detect.channel_departures(summaries, detect.departure_floor(summaries))


@query(f"WITH {SUMS} SELECT unit, position, channel, {', '.join(r(c, c) for c in ('mean', 'minimum', 'maximum', 'last', 'log_count'))} FROM summ")
def a1_window_summaries(spark, sf_dir):
    return detect.window_summaries(tokens(spark, sf_dir))


@query(f"WITH {SUMS}, {FLOOR} SELECT channel, kind, {r('floor', 'floor')} FROM floors")
def a2_departure_floor(spark, sf_dir):
    return detect.departure_floor(detect.window_summaries(tokens(spark, sf_dir)))


@query(f"WITH {DEPART} SELECT unit, position, channel, {r('departure', 'departure')} FROM dep")
def a3_channel_departures(spark, sf_dir):
    return departures(spark, sf_dir)


SCORES = f"{DEPART}, scores AS (SELECT unit, position, max(departure) AS score, avg(departure) AS mean_score FROM dep GROUP BY unit, position)"


@query(f"WITH {SCORES}, lv AS (SELECT quantile_cont(score, 0.99) AS level FROM scores) SELECT unit, position, {r('score', 'score')}, {r('mean_score', 'mean_score')}, {r('level', 'level')}, {r('score - level', 'alarm')} FROM scores, lv")
def a5_score_alarm(spark, sf_dir):
    return detect.score_alarm(detect.window_score(departures(spark, sf_dir)), 0.01)


@query("WITH e AS (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT i, avg(CAST(x AS DOUBLE)) AS m FROM e GROUP BY i) SELECT vec_id, round(sum((x - m) * (x - m)), 5) + 0.0 AS distance, round(max((x - m) * (x - m)), 5) + 0.0 AS farthest FROM e JOIN m USING (i) GROUP BY vec_id")
def a7_mean_distance(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return detect.mean_distance(rows, "v", 64).drop("v")


@query("WITH f AS (SELECT CAST(o_custkey AS VARCHAR) AS unit, date_diff('microsecond', TIMESTAMP '1995-01-01', max(o_orderdate)) / 3.6e9 + 1 AS failed_at FROM orders GROUP BY 1), w AS (SELECT CAST(o_custkey AS VARCHAR) AS unit, o_orderkey, date_diff('microsecond', TIMESTAMP '1995-01-01', o_orderdate) / 3.6e9 AS win_end FROM orders) SELECT unit, o_orderkey, round(least(failed_at - win_end, 5000), 5) + 0.0 AS target FROM w JOIN f USING (unit)")
def l1_remaining_life(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("unit"), "o_orderkey", (F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1995-01-01', o_orderdate)") / 3.6e9).alias("win_end"))
    failures = orders.groupBy("unit").agg((F.max("win_end") + 1).alias("failed_at"))
    return metrics.remaining_life(orders, failures, 5000.0).select("unit", "o_orderkey", "target")


EVENTS = "ev AS (SELECT unit, event_number AS number, time AS start, time + 1 AS \"end\" FROM (SELECT CAST(user_id AS VARCHAR) AS unit, event_id AS event_number, date_diff('microsecond', TIMESTAMP '2024-01-01', ts) / 3.6e9 AS time FROM events WHERE event_type = 'error'))"
LABELLED = f"{SCORES}, {EVENTS}, lab AS (SELECT w.unit, w.position, coalesce(min(number), 0) AS event FROM wins w LEFT JOIN ev e ON w.unit = e.unit AND e.start < w.win_end AND w.win_start < e.\"end\" GROUP BY 1, 2), pred AS (SELECT s.unit, s.position, round(score, 3) AS score, event FROM scores s JOIN lab USING (unit, position))"


def event_spans(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_type = 'error'")
    t = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01', ts)") / 3.6e9
    return e.select(F.col("user_id").cast("string").alias("unit"), F.col("event_id").alias("number"), t.alias("start"), (t + 1).alias("end"))


def predictions(spark, sf_dir):
    placed = windows.windows_over(windows.units_of(readings(spark, sf_dir)), LENGTH, STRIDE)
    labels = metrics.overlap_events(placed, event_spans(spark, sf_dir), LENGTH).select("unit", "position", "event")
    scores = detect.window_score(departures(spark, sf_dir)).select("unit", "position", F.round("score", 3).alias("score"))
    return scores.join(labels, ["unit", "position"])


@query(f"WITH {LABELLED} SELECT unit, position, event FROM lab")
def l4_overlap_events(spark, sf_dir):
    placed = windows.windows_over(windows.units_of(readings(spark, sf_dir)), LENGTH, STRIDE)
    return metrics.overlap_events(placed, event_spans(spark, sf_dir), LENGTH).select("unit", "position", "event")


@query(f"WITH {LABELLED}, g AS (SELECT score, sum(CASE WHEN event > 0 THEN 1.0 ELSE 0 END) AS h, sum(CASE WHEN event > 0 THEN 0 ELSE 1.0 END) AS m FROM pred GROUP BY score), c AS (SELECT *, sum(m) OVER (ORDER BY score) AS below FROM g) SELECT {r('sum(h * (below - m / 2)) / (sum(h) * sum(m))', 'auroc')} FROM c")
def k3_auroc(spark, sf_dir):
    return metrics.auroc(predictions(spark, sf_dir), "event")


SWEEP = "g AS (SELECT score, sum(CASE WHEN event > 0 THEN w ELSE 0 END) AS h, sum(CASE WHEN event > 0 THEN 0 ELSE w END) AS m FROM p GROUP BY score), c AS (SELECT *, sum(h) OVER (ORDER BY score DESC) AS hs, sum(m) OVER (ORDER BY score DESC) AS ms FROM g)"


@query(f"WITH {LABELLED}, p AS (SELECT *, 1.0 AS w FROM pred), {SWEEP} SELECT {r('sum(h * hs / (hs + ms)) / sum(h)', 'average_precision')} FROM c")
def k4_average_precision(spark, sf_dir):
    return metrics.average_precision(predictions(spark, sf_dir), "event")


@query(f"WITH {LABELLED}, p AS (SELECT *, CASE WHEN event > 0 THEN 1.0 / count(*) OVER (PARTITION BY event) ELSE CAST(1 AS DOUBLE) END AS w FROM pred), {SWEEP} SELECT {r('sum(h * hs / (hs + ms)) / sum(h)', 'average_precision')} FROM c")
def k5_event_weighted_pr_auc(spark, sf_dir):
    return metrics.average_precision(metrics.event_weights(predictions(spark, sf_dir)), "event", weight="weight")


@query(f"WITH {LABELLED}, p AS (SELECT *, 1.0 AS w FROM pred), {SWEEP}, a AS (SELECT min(score) AS alarm FROM c WHERE ms <= 0.1 * (SELECT sum(m) FROM g)) SELECT {r('count(DISTINCT CASE WHEN score >= alarm THEN event END) / count(DISTINCT event)', 'recall')}, count(DISTINCT event) AS events FROM pred, a WHERE event > 0")
def k6_event_recall_at(spark, sf_dir):
    return metrics.event_recall_at(predictions(spark, sf_dir), 0.1)


@query(f"WITH {LABELLED}, f AS (SELECT *, position - row_number() OVER (PARTITION BY unit ORDER BY position) AS island FROM pred WHERE score > 1) SELECT unit, min(position) AS first, max(position) AS last, bool_or(event > 0) AS true_alarm FROM f GROUP BY unit, island")
def k7_flagged_runs(spark, sf_dir):
    return metrics.flagged_runs(predictions(spark, sf_dir).withColumn("flagged", F.col("score") > 1))


@query("WITH o AS (SELECT o_totalprice AS a, date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) AS b FROM orders), ra AS (SELECT a, b, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS x, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS y FROM o) SELECT round(corr(x, y), 5) + 0.0 AS spearman FROM ra")
def k10_rank_agreement(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_totalprice").alias("a"), F.expr("datediff(cast(o_orderdate as date), date'1990-01-01')").alias("b"))
    return metrics.rank_agreement(rows, "a", "b")


ERRORS = "e AS (SELECT CAST(l_suppkey AS VARCHAR) AS unit, sum(power(l_discount - 0.05, 2)) AS se_a, sum(power(l_discount - 0.04, 2)) AS se_b, count(*) AS n FROM lineitem GROUP BY 1)"


def paired(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumn("unit", F.col("l_suppkey").cast("string"))
    each = lambda v: li.groupBy("unit").agg(F.sum(F.pow(F.col("l_discount") - v, F.lit(2))).alias("se"), F.count(F.lit(1)).alias("n"))
    return resample.pair(each(0.05), each(0.04))


@query(f"WITH {ERRORS} SELECT unit, {r('se_a', 'se_a')}, n AS n_a, {r('se_b', 'se_b')}, n AS n_b, false AS unpaired FROM e")
def b1_pair(spark, sf_dir):
    return paired(spark, sf_dir)


@query(f"""WITH {ERRORS}, u AS (SELECT *, row_number() OVER (ORDER BY sha256('42|' || unit), unit) AS place, count(*) OVER () AS total FROM e), d AS (SELECT draw, CAST(('0x' || substr(sha256('42|' || draw || '|' || i), 1, 15)) AS BIGINT) % total + 1 AS place FROM range(0, 200) a(draw), (SELECT place - 1 AS i, total FROM u)),
x AS (SELECT draw, sqrt(sum(se_a) / sum(n)) - sqrt(sum(se_b) / sum(n)) AS reduction FROM d JOIN u USING (place) GROUP BY draw) SELECT (SELECT {r('sqrt(sum(se_a) / sum(n)) - sqrt(sum(se_b) / sum(n))', 'o')[:-5]} FROM e) AS observed, {r('quantile_cont(reduction, 0.025)', 'low')}, {r('quantile_cont(reduction, 0.975)', 'high')}, {r('least(1.0, 2 * least((count(*) FILTER (reduction <= 0) + 1) / (count(*) + 1), (count(*) FILTER (reduction >= 0) + 1) / (count(*) + 1)))', 'p')} FROM x""")
def b2_paired_bootstrap(spark, sf_dir):
    return resample.paired_bootstrap(paired(spark, sf_dir).drop("unpaired"), 200, SEED)


@query("WITH t AS (SELECT l_shipmode_test AS test, p FROM (SELECT CAST(l_suppkey AS VARCHAR) AS l_shipmode_test, avg(l_discount) / 10 AS p FROM lineitem GROUP BY 1)), k AS (SELECT *, row_number() OVER (ORDER BY p, test) AS k, count(*) OVER () AS n FROM t) SELECT test, round(p, 5) + 0.0 AS p, round(max(least(1.0, p * (n - k + 1))) OVER (ORDER BY k), 5) + 0.0 AS holm, round(min(least(1.0, p * n / k)) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 5) + 0.0 AS benjamini_hochberg FROM k")
def b11_holm(spark, sf_dir):
    tests = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").cast("string").alias("test")).agg((F.avg("l_discount") / 10).alias("p"))
    return metrics.holm(tests)


@query(f"WITH {OBS}, i AS (SELECT unit, time, count(*) AS k, count(DISTINCT channel) AS c FROM obs GROUP BY ALL), g AS (SELECT *, time - lag(time) OVER (PARTITION BY unit ORDER BY time) AS gap FROM i), a AS (SELECT unit, max(time) - min(time) AS span, CAST(sum(k) AS BIGINT) AS readings, count(*) AS instants, stddev_pop(gap) / nullif(avg(gap), 0) AS gap_variation, avg(c) AS channels_an_instant FROM g GROUP BY unit), b AS (SELECT unit, count(*) AS channels, log10(max(n) / min(n)) AS rate_spread FROM (SELECT unit, channel, count(*) AS n FROM obs GROUP BY ALL) GROUP BY unit) SELECT unit, {r('span', 'span')}, readings, instants, {r('gap_variation', 'gap_variation')}, {r('channels_an_instant', 'channels_an_instant')}, channels, {r('rate_spread', 'rate_spread')} FROM a JOIN b USING (unit)")
def u1_unit_regime(spark, sf_dir):
    return audit.unit_regime(readings(spark, sf_dir))


@query("WITH o AS (SELECT CAST(o_custkey % 5 AS VARCHAR) AS part, o_orderpriority AS channel FROM orders) SELECT part, channel, count(*) AS readings, round(count(*) / (SELECT count(*) FROM o), 5) + 0.0 AS share FROM o GROUP BY GROUPING SETS ((part), (channel))")
def u4_exposure(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 5).cast("string").alias("part"), F.col("o_orderpriority").alias("channel"))
    return audit.exposure(rows)


@query(f"WITH {OBS}, s AS (SELECT *, time - lag(time) OVER (PARTITION BY unit, channel ORDER BY time) AS step FROM obs) SELECT channel, count(*) AS readings, {r('min(time)', 'first')}, {r('max(time)', 'last')}, {r('median(step)', 'step_median')}, {r('quantile_cont(step, 0.05)', 'step_p05')}, {r('quantile_cont(step, 0.95)', 'step_p95')} FROM s GROUP BY channel")
def u5_channel_steps(spark, sf_dir):
    return audit.channel_steps(readings(spark, sf_dir))


@query(f"WITH {OBS}, h AS (SELECT DISTINCT unit, channel, floor(time / 24) AS bin FROM obs), n AS (SELECT channel, count(*) AS n FROM h GROUP BY channel), b AS (SELECT x.channel, y.channel AS other, count(*) AS both FROM h x JOIN h y ON x.unit = y.unit AND x.bin = y.bin AND x.channel < y.channel GROUP BY 1, 2) SELECT b.channel, other, \"both\", {r('b.both / (p.n + q.n - b.both)', 'share')} FROM b JOIN n p ON p.channel = b.channel JOIN n q ON q.channel = other")
def u6_channel_pairs(spark, sf_dir):
    return audit.channel_pairs(readings(spark, sf_dir), 24.0)


@query(f"WITH {LINES} SELECT rows, count(*) AS instants FROM (SELECT count(*) AS rows FROM obs GROUP BY unit, channel, time) GROUP BY rows")
def u11_repeated_instants(spark, sf_dir):
    return audit.repeated_instants(lines(spark, sf_dir))


@query(f"WITH {OBS}, {HOURLY} SELECT unit, channel, hour, {r('mean', 'mean')}, n, {r('last_value(mean) OVER w', 'last_hour')}, {r('quantile_cont(mean, 0.5) OVER w', 'median_of_history')} FROM hourly WINDOW w AS (PARTITION BY unit, channel ORDER BY hour RANGE BETWEEN 167 PRECEDING AND 1 PRECEDING)")
def i3_history_answers(spark, sf_dir):
    return impute.history_answers(hourly(spark, sf_dir), 167)


def masked(spark, sf_dir):
    rows = readings(spark, sf_dir).select("unit", F.lit(0).alias("position"), "channel", "time", "value")
    key = F.concat_ws("|", F.lit("m"), "unit", "channel", F.round(F.col("time") * 3600).cast("long").cast("string"))
    return rows.withColumn("hidden", F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long") % 4 == 0)


MASKED = f"{OBS}, t AS (SELECT *, CAST('0x' || substr(sha256('m|' || unit || '|' || channel || '|' || CAST(round(time * 3600) AS BIGINT)), 1, 8) AS BIGINT) % 4 = 0 AS hidden FROM obs)"


@query(f"WITH {MASKED}, l AS (SELECT *, last_value(CASE WHEN NOT hidden THEN time END IGNORE NULLS) OVER a AS t0, last_value(CASE WHEN NOT hidden THEN value END IGNORE NULLS) OVER a AS av, first_value(CASE WHEN NOT hidden THEN time END IGNORE NULLS) OVER b AS bt, first_value(CASE WHEN NOT hidden THEN value END IGNORE NULLS) OVER b AS bv FROM t WINDOW a AS (PARTITION BY unit, channel ORDER BY time, value ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY unit, channel ORDER BY time, value ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) SELECT unit, channel, {r('time', 'time')}, {r('value', 'value')}, {r('coalesce(av + (time - t0) / nullif(bt - t0, 0) * (bv - av), av, bv)', 'line')}, {r('CASE WHEN bt IS NULL OR time - t0 <= bt - time THEN coalesce(av, bv) ELSE coalesce(bv, av) END', 'nearest')} FROM l WHERE hidden")
def i1_interpolate_hidden(spark, sf_dir):
    return impute.interpolate_hidden(masked(spark, sf_dir)).drop("position", "hidden")


@query(f"WITH {MASKED}, k AS (SELECT *, sum(CASE WHEN hidden THEN 0 ELSE 1 END) OVER (PARTITION BY unit, channel) AS visible FROM t) SELECT CASE WHEN visible = 0 THEN 'channel' ELSE 'token' END AS kind, count(*) AS tokens, {r('avg(value * value)', 'mean_square')} FROM k WHERE hidden GROUP BY 1")
def m2_mask_kind(spark, sf_dir):
    return impute.mask_kind(masked(spark, sf_dir)).where("hidden").groupBy("kind").agg(F.count(F.lit(1)).alias("tokens"), F.avg(impute.squared(F.col("value"))).alias("mean_square"))


@query(f"WITH {OBS}, {STATS} SELECT unit, {r('sum(CASE WHEN abs(value - mean) < 5 THEN power(value - mean, 2) / 2 ELSE 5 * (abs(value - mean) - 2.5) END)', 'huber')}, {r('sum(power(value - mean, 2))', 'squared')} FROM obs JOIN stats USING (channel) GROUP BY unit")
def m4_losses(spark, sf_dir):
    obs = readings(spark, sf_dir)
    e = F.col("value") - F.col("mean")
    return obs.join(normalise.fit_standard(obs), "channel").groupBy("unit").agg(F.sum(impute.huber(e, 5.0)).alias("huber"), F.sum(impute.squared(e)).alias("squared"))


@query(f"WITH {TOK}, m AS (SELECT unit, position, count(*) AS n, sum(value * value) AS mass FROM tokens GROUP BY ALL), u AS (SELECT *, sum(mass) OVER (PARTITION BY unit) AS um, sum(mass) OVER () AS am FROM m) SELECT unit, position, n, {r('mass', 'mass')}, {r('mass / nullif(um, 0)', 'share_of_unit')}, {r('um / am', 'unit_share')} FROM u")
def m6_mass_concentration(spark, sf_dir):
    return impute.mass_concentration(tokens(spark, sf_dir))


@query(f"WITH {OBS}, {STATS} SELECT unit, {r('sqrt(avg(power(value - mean, 2)))', 'rmse')}, count(*) AS n FROM obs JOIN stats USING (channel) GROUP BY unit")
def k1_rmse(spark, sf_dir):
    obs = readings(spark, sf_dir)
    rows = obs.join(normalise.fit_standard(obs), "channel").select("unit", F.col("value").alias("target"), F.col("mean").alias("predicted"))
    return metrics.rmse(rows, ["unit"])


from . import completed, draws as draws_, finding, fits, forecasting, groups, histories, layouts, learning, more, rules, sides  # noqa: E402, F401  add their queries to these


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, (f, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in QUERIES.items() if sql}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which user-days depart most from their own recent history: the top twenty alarms."""
    return QUERIES["a5_score_alarm"][0](spark, sf_dir).orderBy(F.desc("alarm"), "unit", "position").limit(20)
