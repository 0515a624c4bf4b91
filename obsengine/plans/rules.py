"""Queries for rules on readings, labels and published files."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from ..operators import draws, normalise, predicates, windows
from ..sources import formats
from ..sources.tables import table
from .more import placed
from .queries import FEATURES, HOURLY, LABELLED, LINES, OBS, SEED, STATS, TOK, UNITS, WIN, assigned, event_spans, hourly, place, predictions, query, r, readings, suppliers, tokens


def shared(spark, name: str) -> str:
    """A new path in the folder that driver and executors share; a temporary one where the session names none."""
    at = spark.sparkContext._jsc.sc().getCheckpointDir()
    folder = at.get() if at.isDefined() else spark.conf.get("spark.checkpoint.dir", None)
    if folder is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
    folder = folder or tempfile.mkdtemp(prefix="spark-")
    return f"{folder}/{name}-{uuid.uuid4()}"


CONDITIONS = [("low", 10.0, 0.02), ("mid", 25.0, 0.05), ("high", 40.0, 0.08)]


@query("WITH c(condition, l_quantity, l_discount) AS (VALUES " + ", ".join(map(str, CONDITIONS)) + ") SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, (SELECT min(condition) FROM c WHERE abs(l.l_quantity - c.l_quantity) <= 9 AND abs(l.l_discount - c.l_discount) <= 9) AS condition FROM lineitem l")
def p2_qualify_by_condition(spark, sf_dir):
    conditions = spark.createDataFrame(CONDITIONS, "condition string, l_quantity double, l_discount double")
    return predicates.qualify_by_condition(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount"), conditions, ["l_quantity", "l_discount"], 9.0).select("l_orderkey", "l_linenumber", "condition")


@query("SELECT o_orderkey, n_name AS channel FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = 1")
def p3_map_codes(spark, sf_dir):
    codes = table(spark, sf_dir, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("code"), F.col("n_name").alias("channel"))
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    return predicates.map_codes(orders.select("o_orderkey", "c_nationkey"), codes, "c_nationkey")


@query("SELECT page_id, url FROM pages WHERE starts_with(lower(url), 'http') AND (contains(lower(url), '1') OR contains(lower(url), '7')) AND NOT contains(lower(url), '3')")
def p4_label_rules(spark, sf_dir):
    return table(spark, sf_dir, "pages").where(predicates.label_rules("url", "HTTP", ["1", "7"], ["3"])).select("page_id", "url")


@query("SELECT CAST(o_custkey AS VARCHAR) AS unit, 'status/' || o_orderstatus AS channel, 1.0::DOUBLE AS value FROM orders WHERE o_orderstatus IS NOT NULL")
def p5_presence_tokens(spark, sf_dir):
    return predicates.presence_tokens(table(spark, sf_dir, "orders").withColumn("unit", F.col("o_custkey").cast("string")), "status", "o_orderstatus")


@query(f"WITH {OBS} SELECT unit, channel, {r('time', 'time')}, {r('''CASE WHEN channel = 'click' AND value <= 20 THEN value * 100 ELSE value END''', 'value')} FROM obs")
def p7_fraction_to_percent(spark, sf_dir):
    return predicates.fraction_to_percent(readings(spark, sf_dir), "click", 20.0)


@query(f"WITH {OBS}, {UNITS} SELECT unit, channel, {r('time', 'time')}, {r('value', 'value')} FROM obs JOIN units USING (unit) WHERE time >= extent_start + 100 AND time < extent_end - 100")
def p9_within_extent(spark, sf_dir):
    units = windows.units_of(readings(spark, sf_dir)).withColumns({"extent_start": F.col("extent_start") + 100, "extent_end": F.col("extent_end") - 100})
    return predicates.within_extent(readings(spark, sf_dir), units).select("unit", "channel", "time", "value")


@query("SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderstatus NOT IN ('F') GROUP BY 1")
def p10_exclude_named(spark, sf_dir):
    return predicates.exclude_named(table(spark, sf_dir, "orders"), ["F"], "o_orderstatus").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {OBS}, k AS (SELECT channel FROM obs GROUP BY channel HAVING avg(value) < (SELECT avg(value) FROM obs)), x AS (SELECT unit, CASE WHEN channel NOT IN (SELECT channel FROM k) THEN channel END AS other FROM obs) SELECT unit, coalesce(string_agg(DISTINCT other, ',' ORDER BY other), '') AS ignored, bool_or(other IS NULL) AS readable FROM x GROUP BY unit")
def p17_admit(spark, sf_dir):
    obs = readings(spark, sf_dir)
    stats = normalise.fit_standard(obs).crossJoin(obs.agg(F.avg("value").alias("all"))).where("mean < all")
    return predicates.admit(obs, stats)[1].withColumn("ignored", F.array_join("ignored", ","))


@query(f"WITH {OBS}, {STATS} SELECT channel, row_number() OVER (ORDER BY channel) AS channel_id, {r('mean', 'mean')}, {r('std', 'std')} FROM stats")
def n7_adopt_statistics(spark, sf_dir):
    obs = readings(spark, sf_dir)
    return predicates.adopt_statistics(normalise.extend_vocabulary(None, obs).select("channel", "channel_id"), normalise.fit_standard(obs).select("channel", "mean", "std"))


@query(f"WITH {OBS}, bad AS (SELECT * FROM obs WHERE value < 5 OR value > 60), c AS (SELECT channel, round(value, 1) AS v, count(*) AS n FROM bad GROUP BY ALL) SELECT channel, count(*) AS outside, count(DISTINCT (unit, floor(time))) AS hours, (SELECT round(arg_min(v, (-n, v)), 5) + 0.0 FROM c WHERE c.channel = bad.channel) AS commonest FROM bad GROUP BY channel")
def n10_implausible(spark, sf_dir):
    obs = readings(spark, sf_dir)
    return predicates.implausible(obs, obs.select("channel").distinct().withColumns({"lowest": F.lit(5.0), "highest": F.lit(60.0)}))


@query(f"WITH {OBS} SELECT channel, 0.0::DOUBLE AS value_off, 0.0::DOUBLE AS time_off, 0::BIGINT AS unpaired FROM obs GROUP BY channel")
def n11_round_trip_residual(spark, sf_dir):
    obs = readings(spark, sf_dir)
    stats = normalise.fit_standard(obs)
    return predicates.round_trip_residual(obs, normalise.denormalise(normalise.normalise(obs, stats), stats))


@query("SELECT CAST(s_suppkey AS VARCHAR) AS unit, CASE WHEN s_suppkey IN (1, 2) THEN 'held_out' ELSE 'training' END AS side FROM supplier")
def r3_split_by_names(spark, sf_dir):
    return predicates.split_by_names(suppliers(spark, sf_dir), ["1", "2"])


@query(f"WITH u AS (SELECT CAST(s_suppkey AS VARCHAR) AS unit FROM supplier), k AS (SELECT unit, {place('unit')} AS place, count(*) OVER () AS n FROM u) SELECT unit, place <= ceil(n * 0.4) AS seen FROM k")
def r17_seen_unseen(spark, sf_dir):
    units = suppliers(spark, sf_dir)
    return predicates.seen_unseen(units, draws.share(units, 0.4, SEED))


@query(f"WITH {WIN}, f AS (SELECT CAST(doc_id AS VARCHAR) AS unit, toxic FROM labels) SELECT w.unit, position, CAST(toxic AS BIGINT) AS target FROM wins w JOIN f USING (unit)")
def l2_outcome_labels(spark, sf_dir):
    outcomes = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("unit"), "toxic")
    return predicates.outcome_labels(placed(spark, sf_dir), outcomes, "toxic").select("unit", "position", "target")


@query(f"WITH {WIN}, {HOURLY}, t AS (SELECT unit, min(hour) AS first, min(hour) FILTER (channel = 'error') AS turned FROM hourly GROUP BY unit) SELECT w.unit, position, CAST(turned IS NOT NULL AS BIGINT) AS target FROM wins w JOIN t USING (unit) WHERE win_end = first + 24 AND (turned IS NULL OR turned >= win_end)")
def l3_turns_later(spark, sf_dir):
    hours = hourly(spark, sf_dir).withColumn("label", (F.col("channel") == "error").cast("int"))
    return predicates.turns_later(placed(spark, sf_dir), hours, 24.0)


@query(f"WITH {WIN}, m AS (SELECT unit, position, bool_or(channel = 'error' AND value > 20) AS marked FROM assigned GROUP BY ALL), n AS (SELECT unit, row_number() OVER (ORDER BY unit) AS number FROM (SELECT DISTINCT unit FROM m WHERE marked)) SELECT unit, position, CASE WHEN marked THEN number ELSE 0 END AS event FROM m LEFT JOIN n USING (unit)")
def l5_overlap_marked_rows(spark, sf_dir):
    return predicates.overlap_marked_rows(assigned(spark, sf_dir), (F.col("channel") == "error") & (F.col("value") > 20))


@query("SELECT CAST(s_suppkey AS VARCHAR) AS unit, CAST(s_acctbal < 0 AS BIGINT) AS anomaly, CASE WHEN s_acctbal < 0 THEN row_number() OVER (PARTITION BY s_acctbal < 0 ORDER BY CAST(s_suppkey AS VARCHAR)) ELSE 0 END AS event FROM supplier")
def l6_unit_events(spark, sf_dir):
    units = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("unit"), (F.col("s_acctbal") < 0).cast("int").alias("anomaly"))
    return predicates.unit_events(units)


@query("WITH e AS (SELECT l_orderkey, o_orderstatus, min(l_shipdate) AS a, max(l_shipdate) AS b FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_returnflag IN ('A', 'R') GROUP BY ALL) SELECT CAST(l_orderkey AS VARCHAR) AS event, o_orderstatus AS category, CAST(a AS DATE) AS start, CAST(b AS DATE) AS \"end\", CASE WHEN o_orderstatus = 'F' THEN row_number() OVER (PARTITION BY o_orderstatus = 'F' ORDER BY l_orderkey) ELSE -1 END AS number FROM e")
def l7_consolidate_events(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    day = F.col("l_shipdate").cast("date")
    rows = li.select(F.col("l_orderkey").cast("string").alias("event"), F.col("o_orderstatus").alias("category"), F.col("l_returnflag").alias("channel"), day.alias("start"), day.alias("end"), F.col("l_orderkey").alias("row"))
    return predicates.consolidate_events(rows, ["A", "R"], ["F"])


@query(f"WITH {LABELLED} SELECT w.unit, w.position, {r('win_end', 'win_end')}, CAST(event AS DOUBLE) AS target FROM wins w JOIN lab USING (unit, position)")
def l9_label(spark, sf_dir):
    from ..operators import metrics

    w = placed(spark, sf_dir)
    truths = metrics.overlap_events(w, event_spans(spark, sf_dir), 24.0).select("unit", "position", F.col("event").cast("double").alias("target"))
    return predicates.label(w.select("unit", "position", "win_end"), truths)


@query(f"WITH {LABELLED}, kinds AS (SELECT p.event, CASE WHEN event = 0 THEN NULL WHEN event % 3 = 0 THEN 'a' ELSE 'b' END AS class FROM pred p) SELECT half, count(*) AS windows, count(DISTINCT CASE WHEN event > 0 THEN event END) AS events FROM (SELECT event, unnest(CASE WHEN event = 0 THEN ['taught', 'untaught'] WHEN class = 'a' THEN ['taught'] ELSE ['untaught'] END) AS half FROM kinds) GROUP BY half")
def l10_event_annotations(spark, sf_dir):
    p = predictions(spark, sf_dir)
    classes = event_spans(spark, sf_dir).select(F.col("number").alias("event"), F.when(F.col("number") % 3 == 0, "a").otherwise("b").alias("class"))
    halves = predicates.event_annotations(p, classes, ["a"])
    return halves.groupBy("half").agg(F.count(F.lit(1)).alias("windows"), F.countDistinct(F.when(F.col("event") > 0, F.col("event"))).alias("events"))


@query(f"WITH {TOK} SELECT unit, position, channel, {r('value', 'value')}, {r('time', 'time')}, {r('gap', 'gap')}, CAST(CAST(unit AS BIGINT) % 4 AS BIGINT) AS part FROM tokens WHERE CAST(unit AS BIGINT) % 4 IN (1, 2)")
def s17_publish_and_read(spark, sf_dir):
    path = formats.publish(tokens(spark, sf_dir).withColumn("part", F.col("unit").cast("long") % 4), shared(spark, "published"), {"length": 24, "stride": 24})
    return formats.read_published(spark, path, parts=["1", "2"]).select("unit", "position", "channel", "value", "time", "gap", "part")


@query(f"WITH {FEATURES}, p AS (SELECT unit, position, mean AS target FROM ws WHERE channel = 'click') SELECT unit, position, {r('target', 'target')}, {r('target + 1', 'control')}, {r('target - 1', 'candidate')} FROM p")
def s21_export_and_pair(spark, sf_dir):
    from ..operators import features

    clicks = features.window_statistics(tokens(spark, sf_dir)).where("channel = 'click'").select("unit", "position", F.col("mean").alias("target"))
    runs = clicks.withColumn("r", F.explode(F.array(F.struct(F.lit("one").alias("run"), F.lit(1.0).alias("off")), F.struct(F.lit("two").alias("run"), F.lit(-1.0).alias("off")))))
    path = shared(spark, "predictions")
    formats.export_predictions(runs.select("unit", F.col("position").cast("long").alias("position"), "target", (F.col("target") + F.col("r.off")).alias("predicted"), "r.run"), path)
    return formats.read_pairs(spark, path, "one", "two")


@query("WITH e AS (SELECT CAST(vec_id AS VARCHAR) AS unit, 'variate0' AS channel, CAST(i - 1 AS DOUBLE) AS time, CAST(embedding[i] AS DOUBLE) AS value FROM embeddings, range(1, 65) t(i)) SELECT unit, channel, time, round((value - avg(value) OVER w) / CASE WHEN stddev_pop(value) OVER w > 0 THEN stddev_pop(value) OVER w ELSE 1 END, 4) + 0.0 AS value FROM e WINDOW w AS (PARTITION BY unit)")
def s14_series_arrays(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("item_id"), F.col("embedding").alias("target"))
    return formats.read_series_arrays(rows).select("unit", "channel", "time", F.round("value", 4).alias("value"))


@query(f"WITH {LINES}, s AS (SELECT unit AS mission, channel, time * 3600 AS sec, value FROM obs), p AS (SELECT mission, min(sec) AS start, min(sec) + floor(floor((max(sec) - min(sec)) / 2) / 86400) * 86400 AS cutoff FROM s GROUP BY mission), b AS (SELECT mission, channel, floor((sec - start) / 86400) AS bin, arg_min(value, (sec, value)) AS value, min(sec) AS sec, any_value(start) AS start FROM s JOIN p USING (mission) WHERE sec < cutoff GROUP BY ALL) SELECT mission || '/' || strftime(TIMESTAMP '1995-01-01' + to_seconds(CAST(sec AS BIGINT)), '%Y-%m') AS unit, channel, {r('(sec - start) / 3600', 'time')}, {r('value', 'value')} FROM b")
def s9_telemetry_half(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("string").alias("mission"), F.col("l_shipdate").alias("ts"), F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"))
    return formats.telemetry_half(rows.unpivot(["mission", "ts"], ["quantity", "price", "discount", "tax"], "channel", "value"), width=86400.0)
