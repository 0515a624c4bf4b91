"""Queries for covariance detectors, groups and matches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit, covariance, groups
from ..sources.tables import table
from .layouts import ANSWERS, answers
from .queries import OBS, SEED, place, query, r, readings, suppliers


def vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))


@query()
def a9_whitened_distance(spark, sf_dir):
    return covariance.whitened_distance(vectors(spark, sf_dir), "v", 64).drop("v")


@query()
def a10_subspace_distance(spark, sf_dir):
    return covariance.subspace_distance(vectors(spark, sf_dir), "v", 64).drop("v")


PAIRS = "h AS (SELECT DISTINCT unit, channel, floor(time / 24) AS bin FROM obs), n AS (SELECT channel, count(*) AS n FROM h GROUP BY channel), prs AS (SELECT x.channel AS a, y.channel AS b, count(*) / (any_value(p.n) + any_value(q.n) - count(*)) AS share FROM h x JOIN h y ON x.unit = y.unit AND x.bin = y.bin AND x.channel < y.channel JOIN n p ON p.channel = x.channel JOIN n q ON q.channel = y.channel GROUP BY 1, 2), ed AS (SELECT a, b FROM prs WHERE share >= 0.06 UNION SELECT b, a FROM prs WHERE share >= 0.06)"


@query(f"WITH RECURSIVE {OBS}, {PAIRS}, reach AS (SELECT a AS node, a AS seen FROM ed UNION SELECT node, b FROM reach JOIN ed ON seen = a), roots AS (SELECT node, min(seen) AS root FROM reach GROUP BY node) SELECT root AS packet, count(*) AS channels, string_agg(node, ',' ORDER BY node) AS names FROM roots GROUP BY root")
def u7_packets(spark, sf_dir):
    return groups.packets(audit.channel_pairs(readings(spark, sf_dir), 24.0), 0.06)


POINTS = "pts AS (SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings)"


@query(f"WITH {POINTS}, nr AS (SELECT a.id AS id_a, b.id AS id_b, sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)) AS distance FROM pts a JOIN pts b ON a.id % 2 = 0 AND b.id % 2 = 1), k AS (SELECT *, row_number() OVER (PARTITION BY id_a ORDER BY distance, id_b) AS na, row_number() OVER (PARTITION BY id_b ORDER BY distance, id_a) AS nb FROM nr WHERE distance <= 0.01) SELECT id_a, id_b, {r('distance', 'distance')} FROM k WHERE na = 1 AND nb = 1")
def d16_cross_match(spark, sf_dir):
    points = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    return groups.cross_match(points.where("id % 2 = 0"), points.where("id % 2 = 1"), 0.01)


@query(f"WITH u AS (SELECT CAST(s_suppkey AS VARCHAR) AS unit FROM supplier) SELECT unit, {place('unit')} % 2 AS half FROM u")
def r16_halves(spark, sf_dir):
    return groups.halves(suppliers(spark, sf_dir), SEED)


@query(f"WITH {OBS}, {ANSWERS}, d AS (SELECT unit, kind, position, min(last) AS a, CASE WHEN position % 2 = 0 THEN max(last) END AS b FROM ans WHERE last IS NOT NULL GROUP BY unit, kind, position) SELECT unit, kind, position, 'last' AS method, {r('a', 'predicted')}, b IS NOT NULL AS complete FROM d UNION ALL SELECT unit, kind, position, 'mean', {r('b', 'predicted')}, true FROM d WHERE b IS NOT NULL")
def i14_join_answers(spark, sf_dir):
    rows = answers(spark, sf_dir).where("last IS NOT NULL").groupBy("unit", "kind", "position")
    return groups.join_answers({"last": rows.agg(F.min("last").alias("predicted")), "mean": rows.agg(F.max("last").alias("predicted")).where("position % 2 = 0")}, ["unit", "kind", "position"])
