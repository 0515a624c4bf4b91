"""Queries for sides, strata, months and caps, and what locations and months hold."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit, draws, sides
from ..sources.tables import ORIGIN, table
from .more import placed
from .queries import LABELS, LINES, OBS, SEED, WIN, lines, place, query, r, readings, suppliers


@query(f"WITH {WIN} SELECT unit, position, {r('win_start', 'win_start')}, {r('win_end', 'win_end')} FROM wins WHERE strftime(TIMESTAMP '2024-01-01' + to_hours(CAST(floor(win_end - 48) AS INTEGER)), '%Y-%m') = '2024-01' AND strftime(TIMESTAMP '2024-01-01' + to_hours(CAST(ceil(win_end) - 1 AS INTEGER)), '%Y-%m') = '2024-01'")
def p16_untruncated(spark, sf_dir):
    return sides.untruncated(placed(spark, sf_dir), ["2024-01"], 48.0, ORIGIN)


CAP = "cnt AS (SELECT channel, count(*) AS n FROM obs GROUP BY channel), lim AS (SELECT CAST(floor(count(*) / 20) AS BIGINT) AS cap FROM obs), wid AS (SELECT channel, s, count(DISTINCT floor(floor(time / 0.25e0) / s)) AS bins FROM obs, range(1, 721) t(s) GROUP BY ALL), fit AS (SELECT channel, min(s) AS s FROM wid, lim WHERE bins <= cap GROUP BY channel), k AS (SELECT channel, time, value, row_number() OVER (PARTITION BY channel, floor(floor(time / 0.25e0) / s) ORDER BY time, value) AS nth FROM obs JOIN fit USING (channel))"


@query(f"WITH {OBS}, {CAP} SELECT 'all' AS unit, channel, {r('time', 'time')}, {r('value', 'value')} FROM k WHERE nth = 1")
def d9_thin_to_cap(spark, sf_dir):
    obs = readings(spark, sf_dir).withColumn("unit", F.lit("all"))
    return sides.thin_to_cap(obs, obs.count() // 20, 0.25)


WEIGHED = "we AS (SELECT CAST(l_suppkey AS VARCHAR) AS unit, avg(l_discount * l_discount) / 0.0035 AS mean_square FROM lineitem GROUP BY 1), he AS (SELECT *, row_number() OVER (ORDER BY mean_square DESC, unit) AS nth FROM we WHERE mean_square > 1.1), tot AS (SELECT (SELECT round_even(0.5 * count(*), 0) FROM we) - (SELECT count(*) // 2 FROM he) AS more)"


@query(f"WITH {WEIGHED}, re AS (SELECT *, {place('unit')} AS nth FROM we WHERE NOT mean_square > 1.1) SELECT unit, {r('mean_square', 'mean_square')}, CASE WHEN nth % 2 = 0 THEN 'held_out' ELSE 'training' END AS side FROM he UNION ALL SELECT unit, {r('mean_square', 'mean_square')}, CASE WHEN nth <= more THEN 'held_out' ELSE 'training' END FROM re, tot")
def r4_held_out_by_weight(spark, sf_dir):
    units = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").cast("string").alias("unit")).agg((F.avg(F.col("l_discount") * F.col("l_discount")) / 0.0035).alias("mean_square"))
    return sides.held_out_by_weight(units, 1.1, 0.5, SEED)


@query(f"WITH u AS (SELECT CAST(s_suppkey AS VARCHAR) AS unit FROM supplier), k AS (SELECT unit, {place('unit')} AS place, count(*) OVER () AS n FROM u) SELECT unit, CASE WHEN CAST(unit AS BIGINT) % 10 = 0 THEN 'test' WHEN place <= floor(n * 0.3) THEN 'validation' ELSE 'tuning' END AS side FROM k")
def r7_task_split(spark, sf_dir):
    units = draws.split_by_seed(suppliers(spark, sf_dir), 0.3, SEED)
    return sides.task_split(units, units.where(F.col("unit").cast("long") % 10 == 0), final=True)


STRATA = sides.stratum_order(7, SEED)
TURNS = "CASE bin " + " ".join(f"WHEN {b} THEN {i}" for i, b in enumerate(STRATA)) + " END"
DOCS = "docs AS (SELECT CAST(doc_id AS VARCHAR) AS unit, n_chars AS target FROM documents)"


@query(f"WITH {DOCS}, b AS (SELECT *, ntile(7) OVER (ORDER BY target, unit) - 1 AS bin FROM docs), k AS (SELECT *, {place('unit', 'PARTITION BY bin')} AS depth, {TURNS} AS turn FROM b) SELECT unit, target, bin FROM k ORDER BY depth, turn LIMIT (SELECT count(*) // 3 FROM docs)")
def r10_draw_stratified(spark, sf_dir):
    pool = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("unit"), F.col("n_chars").alias("target"))
    return sides.draw_stratified(pool, "target", ["unit"], 7, pool.count() // 3, SEED)


@query("WITH o AS (SELECT CAST(o_custkey AS VARCHAR) AS location, o_orderpriority AS organisation, o_totalprice AS value, o_orderdate FROM orders), c AS (SELECT location, organisation, count(*) AS n, row_number() OVER (PARTITION BY location ORDER BY count(*) DESC, organisation) AS nth, sum(count(*)) OVER (PARTITION BY location) AS total FROM o GROUP BY location, organisation) SELECT c.location, CAST(any_value(total) AS BIGINT) AS results, c.organisation, round(any_value(c.n / total), 5) + 0.0 AS organisation_share, count(*) FILTER (value IS NOT NULL) AS readings, count(*) FILTER (day(o_orderdate) % 2 = 0) AS dated_only, count(*) FILTER (day(o_orderdate) % 2 = 1 AND month(o_orderdate) = 2) AS unzoned, count(*) FILTER (value IS NOT NULL) >= 3 AS kept FROM c JOIN o ON o.location = c.location AND o.organisation = c.organisation WHERE nth = 1 GROUP BY c.location, c.organisation")
def u13_location_summary(spark, sf_dir):
    """Customers as locations and priorities as organisations; dates of even days stand for those without a time."""
    orders = table(spark, sf_dir, "orders")
    dated = F.dayofmonth("o_orderdate") % 2 == 0
    rows = orders.select(F.col("o_custkey").cast("string").alias("location"), F.col("o_orderpriority").alias("organisation"), F.col("o_totalprice").alias("value"), dated.alias("dated_only"), (~dated & (F.month("o_orderdate") == 2)).alias("unzoned"))
    return audit.location_summary(rows, 3)


@query(f"WITH {LINES}, m AS (SELECT strftime(TIMESTAMP '1995-01-01' + to_hours(CAST(floor(time) AS INTEGER)), '%Y-%m') AS unit, channel, time FROM obs WHERE value IS NOT NULL AND isfinite(value)), i AS (SELECT unit, time, count(*) AS k, count(DISTINCT channel) AS c FROM m GROUP BY ALL), g AS (SELECT *, time - lag(time) OVER (PARTITION BY unit ORDER BY time) AS gap FROM i), a AS (SELECT unit, max(time) - min(time) AS span, CAST(sum(k) AS BIGINT) AS readings, count(*) AS instants, stddev_pop(gap) / nullif(avg(gap), 0) AS gap_variation, avg(c) AS channels_an_instant FROM g GROUP BY unit) SELECT unit, {r('span', 'span')}, readings, instants, {r('gap_variation', 'gap_variation')}, {r('channels_an_instant', 'channels_an_instant')} FROM a")
def u14_monthly_regime(spark, sf_dir):
    found = audit.monthly_regime(lines(spark, sf_dir), "1995-01-01 00:00:00")
    return found.select("unit", "span", "readings", "instants", "gap_variation", "channels_an_instant")
