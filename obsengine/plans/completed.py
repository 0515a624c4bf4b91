"""Queries of masks, normal scores, statics, alarms by unit, F-beta, strata, families and inner hold-outs, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.normal import normal_quantile_sql
from ..operators import detect, draws, impute, metrics, normalise, resample, windows
from ..sources.tables import table
from .queries import DEPART, ERRORS, LABELLED, LENGTH, OBS, SCORES, SEED, STATS, TOK, assigned, departures, paired, place, predictions, query, r, readings, tokens

RATES = {"channel": 0.1, "block": 0.3, "block_span": 0.3, "token": 0.1, "tail": 0.2, "tail_span": (0.1, 0.3), "interval": 0.2, "interval_span": (0.1, 0.3)}


def _number(name: str, *key: str) -> str:
    texts = [f"'{name}'", "unit", "CAST(position AS VARCHAR)", *key]
    return f"CAST('0x' || substr(sha256('2:42|' || {chr(32).join(['||', chr(39) + '|' + chr(39), '||']).join(f'length({t}) || {chr(39)}:{chr(39)} || {t}' for t in texts)}), 1, 13) AS BIGINT) / 4503599627370496.0"


_DRAWN = f"""{TOK}, n AS (SELECT *, row_number() OVER (PARTITION BY unit, position ORDER BY time, channel, value) AS nth FROM tokens),
u AS (SELECT *, {_number('channel', 'channel')} < 0.1 AS whole, {_number('block', 'channel')} < 0.3 AS blocked, {_number('block start', 'channel')} * 0.7 AS b0, {_number('token', 'CAST(nth AS VARCHAR)')} < 0.1 AS by_token, {_number('tail')} < 0.2 AS tailed, 0.1 + {_number('tail span')} * 0.2 AS tail_span, {_number('interval')} < 0.2 AS cut, 0.1 + {_number('interval span')} * 0.2 AS span, {_number('interval start')} AS i0 FROM n),
h AS (SELECT *, blocked AND time >= b0 AND time <= b0 + 0.3 AS by_block, tailed AND time >= 1 - tail_span AS by_tail, cut AND time >= i0 * (1 - span) AND time <= i0 * (1 - span) + span AS by_interval FROM u),
k AS (SELECT *, whole OR by_block OR by_token OR by_tail OR by_interval AS hit FROM h),
s AS (SELECT *, hit AND NOT (nth = 1 AND bool_and(hit) OVER (PARTITION BY unit, position)) AS hidden FROM k),
m AS (SELECT *, hidden AND bool_and(hidden) OVER (PARTITION BY unit, position, channel) AS by_channel FROM s)"""


@query(f"WITH {_DRAWN} SELECT count(*) AS tokens, {r('avg(CAST(hidden AS INT))', 'measured')}, {r(f'CAST({impute.expected_ratio(**RATES)} AS DOUBLE)', 'expected')}, " + ", ".join(f"count(*) FILTER (hidden AND {c}) AS {c}" for c in ("by_channel", "by_block", "by_token", "by_tail", "by_interval")) + " FROM m")
def m1_draw_masks(spark, sf_dir):
    hidden = impute.mask_windows(tokens(spark, sf_dir), SEED, **RATES)
    kinds = ("by_channel", "by_block", "by_token", "by_tail", "by_interval")
    return hidden.agg(F.count(F.lit(1)).alias("tokens"), F.avg(F.col("hidden").cast("double")).alias("measured"), F.lit(impute.expected_ratio(**RATES)).alias("expected"), *[F.count_if(c).alias(c) for c in kinds])


_Q = "q AS (SELECT channel, quantile_cont(value, [" + ", ".join(f"{i / 20}" for i in range(21)) + "]) AS q FROM obs GROUP BY channel)"
_RANKED = f"{OBS}, {_Q}, b AS (SELECT *, len(list_filter(q, lambda k: k < value)) AS below, len(list_filter(q, lambda k: k <= value)) AS upto FROM obs JOIN q USING (channel)), rk AS (SELECT *, CASE WHEN upto > below THEN (below + upto - 1) / 2.0 / 20 WHEN below = 0 THEN 0.0 WHEN below > 20 THEN 1.0 ELSE (below - 1 + (value - q[below]) / (q[below + 1] - q[below])) / 20 END AS rank FROM b), w AS (SELECT *, greatest(1e-7, least(1 - 1e-7, rank)) AS p FROM rk)"


@query(f"WITH {_RANKED} SELECT unit, channel, {r('time', 'time')}, {r(normal_quantile_sql('p'), 'value')} FROM w")
def n5_normal_scores(spark, sf_dir):
    obs = readings(spark, sf_dir)
    return normalise.normal_scores(obs, normalise.fit_quantile(obs, 21))


@query(f"WITH {OBS} SELECT channel, count(*) AS readings, count(*) AS restored FROM obs WHERE channel IS NOT NULL GROUP BY channel")
def n6_from_normal_scores(spark, sf_dir):
    """Values come back but for what the rank floor takes off a channel's extremes, a ten-thousandth of a knot's width."""
    obs = readings(spark, sf_dir).where("channel IS NOT NULL")
    stats = normalise.fit_quantile(obs, 1001)
    width = F.array_max(F.zip_with("quantiles", F.slice("quantiles", 2, 1000), lambda a, b: b - a))
    back = normalise.from_normal_scores(normalise.normal_scores(obs.withColumn("raw", F.col("value")), stats), stats)
    near = back.join(stats.select("channel", width.alias("width")), "channel").withColumn("near", F.abs(F.col("value") - F.col("raw")) <= 1.001e-4 * F.col("width") + 1e-9)
    return near.groupBy("channel").agg(F.count(F.lit(1)).alias("readings"), F.count_if("near").alias("restored"))


_STATIC = "st AS (SELECT CAST(c_custkey AS VARCHAR) AS unit, 'balance' AS channel, c_acctbal AS value FROM customer UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'nation', c_nationkey FROM customer)"


@query(f"WITH {TOK}, {_STATIC} SELECT unit, position, channel, {r('value', 'value')}, {r('time', 'time')}, {r('gap', 'gap')}, false AS timeless FROM tokens UNION ALL SELECT unit, position, st.channel, {r('CAST(st.value AS DOUBLE)', 'value')}, 0.0, 0.0, true FROM (SELECT DISTINCT unit, position FROM tokens) JOIN st USING (unit)")
def w3_tokenise_statics(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("unit"), F.col("c_acctbal").alias("balance"), F.col("c_nationkey").cast("double").alias("nation"))
    return windows.tokenise(assigned(spark, sf_dir), LENGTH, customers.unpivot(["unit"], ["balance", "nation"], "channel", "value"))


@query(f"WITH {TOK}, p AS (SELECT unit, position, count(*) AS n, list({{'t': time, 'c': channel, 'v': value, 'g': gap}} ORDER BY time, channel, value, gap) AS l FROM tokens GROUP BY unit, position) SELECT unit, position, CAST(1000 AS BIGINT) AS length, n AS shown, {r('l[1].t', 'first')}, {r('l[n].t', 'last')} FROM p")
def w5_pack_padded(spark, sf_dir):
    packed = windows.pack_windows(tokens(spark, sf_dir), 1000)
    shown = F.size(F.filter("mask", lambda m: m))
    return packed.select("unit", "position", F.size("tokens").alias("length"), shown.alias("shown"), F.get("tokens", 0)["time"].alias("first"), F.get("tokens", shown - 1)["time"].alias("last"))


_UNIT = f"""{SCORES}, am AS (SELECT median(score) AS c FROM scores), aw AS (SELECT 1.4826 * median(abs(score - c)) AS s, any_value(c) AS c FROM scores, am), fb AS (SELECT CASE WHEN s > 1e-9 * (1 + abs(c)) THEN s ELSE 1 END AS f FROM aw),
um AS (SELECT unit, median(score) AS c FROM scores GROUP BY unit), us AS (SELECT unit, 1.4826 * median(abs(score - c)) AS s, any_value(c) AS c FROM scores JOIN um USING (unit) GROUP BY unit),
rd AS (SELECT unit, position, score, (score - c) / CASE WHEN s > 1e-9 * (1 + abs(c)) THEN s ELSE f END AS read FROM scores JOIN us USING (unit), fb), lv AS (SELECT quantile_cont(read, 0.99) AS level FROM rd)"""


@query(f"WITH {_UNIT} SELECT unit, position, {r('score', 'score')}, {r('read', 'read')}, {r('level', 'level')}, {r('read - level', 'alarm')} FROM rd, lv")
def a5_score_alarm_per_unit(spark, sf_dir):
    return detect.score_alarm(detect.window_score(departures(spark, sf_dir)).select("unit", "position", "score"), 0.01, per_unit=True)


@query(f"""WITH {LABELLED}, f AS (SELECT *, score > 1 AS flagged FROM pred), i AS (SELECT *, position - row_number() OVER (PARTITION BY unit ORDER BY position) AS island FROM f WHERE flagged), rn AS (SELECT count(*) FILTER (NOT hit) AS false_runs FROM (SELECT bool_or(event > 0) AS hit FROM i GROUP BY unit, island)),
c AS (SELECT count(DISTINCT CASE WHEN event > 0 THEN event END) AS events, count(DISTINCT CASE WHEN event > 0 AND flagged THEN event END) AS found, count(*) FILTER (event = 0) AS normal, count(*) FILTER (event = 0 AND NOT flagged) AS quiet FROM f),
p AS (SELECT *, found / nullif(events, 0) AS recall, coalesce(found / nullif(found + false_runs, 0), 0) * quiet / normal AS precision FROM c, rn)
SELECT events, found, false_runs, {r('recall', 'recall')}, {r('precision', 'precision')}, {r('coalesce(1.25 * precision * recall / nullif(0.25 * precision + recall, 0), 0)', 'fbeta')} FROM p""")
def k7_event_fbeta(spark, sf_dir):
    return metrics.corrected_event_fbeta(predictions(spark, sf_dir).withColumn("flagged", F.col("score") > 1))


def nation_strata(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("unit"), (F.col("s_nationkey") % 5).cast("string").alias("stratum"))


@query(f"""WITH {ERRORS}, t AS (SELECT e.*, CAST(s_nationkey % 5 AS VARCHAR) AS stratum FROM e JOIN supplier ON CAST(s_suppkey AS VARCHAR) = e.unit), u AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY sha256('42|' || unit), unit) AS place, count(*) OVER (PARTITION BY stratum) AS total FROM t),
d AS (SELECT draw, stratum, CAST(('0x' || substr(sha256('42|' || draw || '|' || stratum || '|' || (place - 1)), 1, 15)) AS BIGINT) % total + 1 AS place FROM range(0, 200) a(draw), u), x AS (SELECT draw, sqrt(sum(se_a) / sum(n)) - sqrt(sum(se_b) / sum(n)) AS reduction FROM d JOIN u USING (stratum, place) GROUP BY draw)
SELECT (SELECT round(sqrt(sum(se_a) / sum(n)) - sqrt(sum(se_b) / sum(n)), 5) + 0.0 FROM t) AS observed, {r('quantile_cont(reduction, 0.025)', 'low')}, {r('quantile_cont(reduction, 0.975)', 'high')}, {r('least(1.0, 2 * least((count(*) FILTER (reduction <= 0) + 1) / (count(*) + 1), (count(*) FILTER (reduction >= 0) + 1) / (count(*) + 1)))', 'p')} FROM x""")
def b2_paired_bootstrap_strata(spark, sf_dir):
    return resample.paired_bootstrap(paired(spark, sf_dir).drop("unpaired").join(nation_strata(spark, sf_dir), "unit"), 200, SEED, strata="stratum")


@query("WITH t AS (SELECT CAST(l_suppkey AS VARCHAR) AS test, avg(l_discount) / 100000 AS p FROM lineitem GROUP BY 1), k AS (SELECT *, row_number() OVER (ORDER BY p, test) AS k FROM t) SELECT test, round(p, 5) + 0.0 AS p, round(max(least(1.0, p * (100000 - k + 1))) OVER (ORDER BY k), 5) + 0.0 AS holm, round(min(least(1.0, p * 100000 / k)) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 5) + 0.0 AS benjamini_hochberg FROM k")
def b11_holm_family(spark, sf_dir):
    tests = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").cast("string").alias("test")).agg((F.avg("l_discount") / 100000).alias("p"))
    return metrics.holm(tests, family_size=100_000)


@query("WITH u AS (SELECT CAST(c_custkey AS VARCHAR) AS unit FROM customer), k AS (SELECT unit, row_number() OVER (ORDER BY sha256('2:42|13:inner-holdout|' || length(unit) || ':' || unit), unit) AS place, count(*) OVER () AS n FROM u) SELECT unit, place <= ceil(n / 5) AS held_out FROM k")
def r6_inner_holdout(spark, sf_dir):
    return draws.inner_holdout(table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("unit")), 5, SEED)
