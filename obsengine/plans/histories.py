"""Queries for departures by bins, local clocks, window variants and a fit over several corpora."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import detect, layouts, learners, windows
from ..sources.tables import local_to_utc, table
from .queries import BINS, FLOOR, OBS, SEED, SUMS, UNITS, query, r, readings, tokens

_FIVE = "avg(value) AS mean, min(value) AS minimum, max(value) AS maximum, arg_max(value, (time, value)) AS last, ln(1 + count(*)) AS log_count"


@query(f"""WITH {SUMS}, {FLOOR}, bs AS (SELECT unit, position, channel, least(floor(time * {BINS} + 1e-3), {BINS - 1}) AS bin, {_FIVE} FROM tokens GROUP BY ALL), bl AS (SELECT unit, position, channel, bin, kind, x FROM bs UNPIVOT (x FOR kind IN (mean, minimum, maximum, last, log_count))),
k AS (SELECT DISTINCT unit, position, channel, kind FROM bl), h AS (SELECT k.*, list(b.x) FILTER (b.x IS NOT NULL) AS h, count(DISTINCT b.position) AS n FROM k LEFT JOIN bl b ON k.unit = b.unit AND k.channel = b.channel AND k.kind = b.kind AND b.position BETWEEN k.position - 5 AND k.position - 1 GROUP BY ALL),
m AS (SELECT *, list_aggregate(h, 'median') AS mid FROM h), d AS (SELECT unit, position, channel, kind, n, mid, list_aggregate(list_transform(h, lambda v: abs(v - mid)), 'median') AS mad FROM m)
SELECT unit, position, channel, {r('max(CASE WHEN 2 * n >= 5 THEN abs(x - mid) / greatest(1.4826 * mad, floor) ELSE 0 END)', 'departure')} FROM bl JOIN d USING (unit, position, channel, kind) JOIN floors USING (channel, kind) GROUP BY unit, position, channel""")
def a3_bin_departures(spark, sf_dir):
    own = tokens(spark, sf_dir)
    return detect.bin_departures(detect.bin_summaries(own, BINS), detect.departure_floor(detect.window_summaries(own)))


# When the clocks of two zones changed in 2024, in UTC, and how many minutes ahead they are from then on.
CLOCKS = (("EASTERN", None, -300), ("EASTERN", "2024-03-10 07:00:00", -240), ("EASTERN", "2024-11-03 06:00:00", -300), ("CENTRAL EUROPE", None, 60), ("CENTRAL EUROPE", "2024-03-31 01:00:00", 120), ("CENTRAL EUROPE", "2024-10-27 01:00:00", 60))
_CLOCKS = ", ".join(f"('{z}', {'NULL' if s is None else chr(39) + s + chr(39)}, {m})" for z, s, m in CLOCKS)


@query(f"""WITH t(zone, since, minutes) AS (VALUES {_CLOCKS}), o AS (SELECT zone, minutes, coalesce(date_diff('minute', TIMESTAMP '2024-01-01', CAST(since AS TIMESTAMP)) + greatest(minutes, lag(minutes) OVER (PARTITION BY zone ORDER BY since NULLS FIRST)), -1000000000) AS begins FROM t),
e AS (SELECT user_id, event_type, ts, CAST(floor(date_diff('microsecond', TIMESTAMP '2024-01-01', ts) / 6e7) AS BIGINT) AS local, CASE event_type WHEN 'click' THEN 'EASTERN' WHEN 'view' THEN 'CENTRAL EUROPE' ELSE 'NOWHERE' END AS zone FROM events)
SELECT user_id, event_type, round((local - coalesce(minutes, 0)) / 60.0, 5) + 0.0 AS time FROM e ASOF LEFT JOIN o ON e.zone = o.zone AND e.local >= o.begins""")
def p8_local_to_utc(spark, sf_dir):
    """Events read as local clock times of a zone that goes with their type, in UTC hours; one zone isn't known."""
    zone = F.when(F.col("event_type") == "click", "Eastern").when(F.col("event_type") == "view", " central europe").otherwise("nowhere")
    clocks = spark.createDataFrame(CLOCKS, "zone string, since string, minutes int").withColumn("since", F.col("since").cast("timestamp_ntz"))
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", F.col("ts").cast("timestamp_ntz").alias("ts"), zone.alias("zone"))
    return local_to_utc(rows, "ts", "zone", clocks).select("user_id", "event_type", "time")


VARIANTS = ((24.0, 24.0), (24.0, 6.0), (168.0, 24.0), (6.0, 4.0))
_FACTS = "SELECT count(DISTINCT unit) AS units, count(DISTINCT channel) AS channels, count(*) AS values FROM obs"


def _variant(n: float, s: float) -> str:
    spans = f"SELECT unit, extent_start + unnest(generate_series(0, CAST(floor((extent_end - extent_start - {n}) / {s} + 1e-9) AS BIGINT))) * {s} AS a FROM units"
    return f"SELECT CAST({n} AS DOUBLE) AS length, CAST({s} AS DOUBLE) AS stride, f.*, (SELECT count(*) FROM ({spans})) AS windows, (SELECT count(*) FROM ({spans}) w JOIN obs o ON o.unit = w.unit AND o.time >= a AND o.time < a + {n}) AS tokens FROM f"


@query(f"WITH {OBS}, {UNITS}, f AS ({_FACTS}) " + " UNION ALL ".join(_variant(n, s) for n, s in VARIANTS))
def u12_corpus_variants(spark, sf_dir):
    obs = readings(spark, sf_dir)
    return layouts.corpus_variants(obs, windows.units_of(obs), VARIANTS)


@query()
def c3_cross_corpus_fit(spark, sf_dir):
    """Lengths of documents of two languages from counts that they only partly share, by one model; odd ids are held out."""
    count = lambda sign: F.regexp_count("text", F.lit(sign)).cast("double")
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.col("n_chars").cast("double").alias("target"), count(" ").alias("spaces"), count(r"\.").alias("stops"), count(",").alias("commas"), F.when(F.col("doc_id") % 2 == 0, "training").otherwise("held_out").alias("side"))
    sources = {c: (docs.where(F.col("lang") == c), s) for c, s in (("en", 1000.0), ("de", 500.0))}
    return learners.cross_corpus_fit(sources, ["doc_id"], {"en": ["spaces", "stops"], "de": ["spaces", "commas"]}, "side", "target", 500, SEED)
