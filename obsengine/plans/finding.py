"""Queries for what detectors find and how rankings compare."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import detect, finding, rankings
from ..sources.tables import table
from .more import placed
from .queries import FLOOR, LABELLED, SEED, SUMS, WIN, place, predictions, query, r, tokens

ENDED = f"{LABELLED}, pe AS (SELECT pred.*, win_end FROM pred JOIN wins USING (unit, position))"


@query(f"WITH {ENDED}, k AS (SELECT *, row_number() OVER (ORDER BY score DESC, unit, position) AS nth, count(*) OVER () AS n FROM pe WHERE event = 0), hk AS (SELECT win_end, (SELECT max(e.win_end) FROM pe e WHERE e.event > 0 AND e.win_end < k.win_end) AS ended FROM k WHERE nth <= floor(0.2 * n)) SELECT (SELECT CAST(floor(0.2 * any_value(n)) AS BIGINT) FROM k) AS top, count(*) FILTER (win_end - ended >= 1 AND win_end - ended <= 12) AS after FROM hk")
def k9_after_event_share(spark, sf_dir):
    p = predictions(spark, sf_dir).join(placed(spark, sf_dir), ["unit", "position"])
    return finding.after_event_share(p, 12.0, 0.2)


ARMS = f"{LABELLED}, arms AS (SELECT unit, position, event, 'plain' AS arm, score FROM pred UNION ALL SELECT unit, position, event, 'tripled', score * (1 + CASE WHEN event > 0 AND position % 2 = 0 THEN 2 ELSE 0 END) FROM pred UNION ALL SELECT unit, position, event, 'turned', CAST(position % 7 AS DOUBLE) FROM pred UNION ALL SELECT unit, position, event, 'coarse', floor(score) FROM pred)"


def arms(spark, sf_dir):
    """Four rankings of the same windows: the scores, scores told some events, the place, the scores coarsened."""
    p = predictions(spark, sf_dir)
    told = F.col("score") * (1 + F.when((F.col("event") > 0) & (F.col("position") % 2 == 0), 2).otherwise(0))
    named = {"plain": F.col("score"), "tripled": told, "turned": (F.col("position") % 7).cast("double"), "coarse": F.floor("score").cast("double")}
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("arm"), s.alias("score")) for n, s in named.items()])).alias("a")
    return p.select("unit", "position", "event", each).select("unit", "position", "event", "a.arm", "a.score")


def weighted(weight: str, rows: str = "arms", keys: str = "arm") -> str:
    """SQL of the sweep over equal scores of each group."""
    return f"gs AS (SELECT {keys}, score, sum(CASE WHEN event > 0 THEN {weight} ELSE 0 END) AS h, sum(CASE WHEN event > 0 THEN 0 ELSE {weight} END) AS m FROM {rows} GROUP BY {keys}, score), sw AS (SELECT *, sum(h) OVER w AS hs, sum(m) OVER w AS ms, sum(m) OVER (PARTITION BY {keys}) AS tm FROM gs WINDOW w AS (PARTITION BY {keys} ORDER BY score DESC))"


AREA = "sum(h * hs / (hs + ms)) / sum(h)"
AUROC = "1 - sum(h * (ms - m / 2)) / (sum(h) * sum(m))"


@query(f"WITH {ARMS}, wa AS (SELECT *, CASE WHEN event > 0 THEN 1e0 / count(*) OVER (PARTITION BY arm, event) ELSE 1e0 END AS w FROM arms), {weighted('w', 'wa')}, ar AS (SELECT arm, {AREA} AS area FROM sw GROUP BY arm), {weighted('1e0').replace('gs AS', 'g1 AS').replace('FROM gs', 'FROM g1').replace('sw AS', 's1 AS')}, al AS (SELECT arm, min(score) AS alarm FROM s1 WHERE ms <= 0.1 * tm GROUP BY arm), rc AS (SELECT arm, count(DISTINCT CASE WHEN score >= alarm THEN event END) / count(DISTINCT event) AS recall FROM arms LEFT JOIN al USING (arm) WHERE event > 0 GROUP BY arm), isl AS (SELECT arm, unit, event, position - row_number() OVER (PARTITION BY arm, unit ORDER BY position) AS island FROM arms WHERE score > 2), fr AS (SELECT arm, count(*) FILTER (NOT hit) AS false_runs FROM (SELECT arm, unit, island, bool_or(event > 0) AS hit FROM isl GROUP BY ALL) GROUP BY arm), c AS (SELECT arm, count(DISTINCT CASE WHEN event > 0 THEN event END) AS events, count(DISTINCT CASE WHEN event > 0 AND score > 2 THEN event END) AS hit, count(*) FILTER (event = 0 AND score <= 2) / count(*) FILTER (event = 0) AS quiet FROM arms GROUP BY arm), f AS (SELECT arm, hit / events AS found, coalesce(hit / nullif(hit + coalesce(false_runs, 0), 0) * quiet, 0) AS prec FROM c LEFT JOIN fr USING (arm)) SELECT arm AS run, {r('coalesce(1.25 * prec * found / nullif(0.25 * prec + found, 0), 0)', 'event_fbeta')}, {r('area', 'area')}, {r('recall', 'event_recall')} FROM f JOIN ar USING (arm) JOIN rc USING (arm)")
def k11_detection_readings(spark, sf_dir):
    runs = arms(spark, sf_dir).withColumnRenamed("arm", "run").withColumn("flagged", F.col("score") > 2)
    return finding.detection_readings(runs, 0.1, 0.5)


FOUND = "fo AS (SELECT l_orderkey AS event, 'd' || (l_suppkey % 6) AS detector, CASE l_suppkey % 3 WHEN 0 THEN 'departures' WHEN 1 THEN 'other' ELSE 'taught' END AS family, l_linenumber AS repeat, l_discount > 0.055 AS found FROM lineitem)"


@query(f"WITH {FOUND}, d AS (SELECT event, detector, family, avg(CAST(found AS INTEGER)) >= 0.5 AS found FROM fo GROUP BY ALL), f AS (SELECT event, min(CASE WHEN found THEN CASE family WHEN 'departures' THEN 0 WHEN 'other' THEN 1 ELSE 2 END END) AS first FROM d GROUP BY event) SELECT event, CASE first WHEN 0 THEN 'departures' WHEN 1 THEN 'other' WHEN 2 THEN 'taught' ELSE 'nothing' END AS finder FROM f")
def k14_first_finder(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    kind = F.col("l_suppkey") % 3
    found = li.select(F.col("l_orderkey").alias("event"), F.concat(F.lit("d"), (F.col("l_suppkey") % 6).cast("string")).alias("detector"), F.when(kind == 0, "departures").when(kind == 1, "other").otherwise("taught").alias("family"), F.col("l_linenumber").alias("repeat"), (F.col("l_discount") > 0.055).alias("found"))
    return finding.first_finder(found, ["departures", "other", "taught"])


def strata_sql(resamples: int, units: str) -> str:
    """SQL of units drawn apart in two strata; draw -1 takes each once."""
    return f"st AS (SELECT unit, stratum, {place('unit', 'PARTITION BY stratum')} AS place, count(*) OVER (PARTITION BY stratum) AS n FROM ({units})), dr AS (SELECT draw, unit, count(*) AS k FROM (SELECT draw, stratum, CAST(('0x' || substr(sha256('42|' || draw || '|' || stratum || '|' || (place - 1)), 1, 15)) AS BIGINT) % n + 1 AS place FROM st, range(0, {resamples}) t(draw)) JOIN (SELECT unit, stratum, place FROM st) USING (stratum, place) GROUP BY ALL UNION ALL SELECT -1, unit, 1 FROM st)"


UNIT_STRATA = "SELECT unit, CAST(bool_or(event > 0) AS INTEGER) AS stratum FROM pred GROUP BY unit"
RESAMPLES = 40
DRAWN_ARMS = f"{ARMS}, {strata_sql(RESAMPLES, UNIT_STRATA)}, da AS (SELECT draw, arm, event, score, k FROM arms JOIN dr USING (unit))"


def contrast(signs: dict[str, int]) -> str:
    sign = "CASE arm " + " ".join(f"WHEN '{a}' THEN {s}" for a, s in signs.items()) + " ELSE 0 END"
    return f"ct AS (SELECT draw, sum(area * {sign}) AS x FROM areas GROUP BY draw) SELECT {r('any_value(x) FILTER (draw = -1)', 'observed')}, {r('quantile_cont(x, 0.025) FILTER (draw >= 0)', 'low')}, {r('quantile_cont(x, 0.975) FILTER (draw >= 0)', 'high')}, {r('least(1.0, 2 * least((count(*) FILTER (draw >= 0 AND x <= 0) + 1) / (count(*) FILTER (draw >= 0) + 1), (count(*) FILTER (draw >= 0 AND x >= 0) + 1) / (count(*) FILTER (draw >= 0) + 1)))', 'p')} FROM ct"


AREAS = f"{DRAWN_ARMS}, {weighted('k', 'da', 'draw, arm')}, areas AS (SELECT draw, arm, {AUROC} AS area FROM sw GROUP BY draw, arm)"


@query(f"WITH {AREAS}, {contrast({'turned': -1, 'plain': 1})}")
def b3_paired_ranking_bootstrap(spark, sf_dir):
    return rankings.paired_ranking_bootstrap(arms(spark, sf_dir), "turned", "plain", "auroc", RESAMPLES, SEED)


@query(f"WITH {DRAWN_ARMS}, {weighted('k', 'da', 'draw, arm')}, al AS (SELECT draw, arm, min(score) AS alarm FROM sw WHERE ms <= 0.1 * tm GROUP BY ALL), best AS (SELECT unit, arm, event, max(score) AS best FROM arms WHERE event > 0 GROUP BY ALL), areas AS (SELECT draw, arm, sum(CASE WHEN best >= alarm THEN k ELSE 0 END) / sum(k) AS area FROM best JOIN dr USING (unit) LEFT JOIN al USING (draw, arm) GROUP BY ALL), {contrast({'turned': -1, 'plain': 1})}")
def b3_paired_event_recalls(spark, sf_dir):
    return rankings.paired_ranking_bootstrap(arms(spark, sf_dir), "turned", "plain", "recall", RESAMPLES, SEED, 0.1)


@query(f"WITH {AREAS}, {contrast({'plain': -1, 'tripled': 1, 'turned': 1, 'coarse': -1})}")
def b6_interaction(spark, sf_dir):
    return rankings.interaction(arms(spark, sf_dir), ["plain", "tripled"], ["turned", "coarse"], "auroc", RESAMPLES, SEED)


@query(f"WITH {AREAS}, v AS (SELECT arm, var_samp(area) AS v FROM areas WHERE draw >= 0 GROUP BY arm) SELECT count(*) AS seeds, {r('avg(area)', 'area')}, {r('stddev_samp(area)', 'deviation')}, {r('(SELECT sqrt(avg(v)) FROM v)', 'unit_error')} FROM areas WHERE draw = -1")
def b14_seed_spread(spark, sf_dir):
    return rankings.seed_spread(arms(spark, sf_dir), RESAMPLES, SEED)


REPEATS = "pr AS (SELECT CAST(l_linenumber AS VARCHAR) AS repeat, CAST(l_suppkey AS VARCHAR) AS unit, sum(power(l_discount - 0.05, 2)) AS se_a, count(*) AS n_a, sum(power(l_discount - 0.04, 2)) AS se_b, count(*) AS n_b FROM lineitem GROUP BY ALL)"


def draw_sql(name: str, column: str, seed: int, resamples: int) -> str:
    return f"{name}_p AS (SELECT {column}, row_number() OVER (ORDER BY sha256('{seed}|' || {column}), {column}) AS place, count(*) OVER () AS n FROM (SELECT DISTINCT {column} FROM pr)), {name} AS (SELECT draw, {column}, count(*) AS k FROM (SELECT draw, CAST(('0x' || substr(sha256('{seed}|' || draw || '|' || (place - 1)), 1, 15)) AS BIGINT) % n + 1 AS place FROM {name}_p, range(0, {resamples}) t(draw)) JOIN (SELECT {column}, place FROM {name}_p) USING (place) GROUP BY ALL)"


def repeated(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    off = lambda v: F.sum(F.pow(F.col("l_discount") - v, F.lit(2)))
    return li.groupBy(F.col("l_linenumber").alias("repeat"), F.col("l_suppkey").cast("string").alias("unit")).agg(off(0.05).alias("se_a"), F.count(F.lit(1)).alias("n_a"), off(0.04).alias("se_b"), F.count(F.lit(1)).alias("n_b"))


@query(f"WITH {REPEATS}, {draw_sql('du', 'unit', 42, 60)}, {draw_sql('dp', 'repeat', 43, 60)}, o AS (SELECT draw, sqrt(sum(se_a * k) / sum(n_a * k)) - sqrt(sum(se_b * k) / sum(n_b * k)) AS x FROM pr JOIN du USING (unit) GROUP BY draw), b AS (SELECT draw, sqrt(sum(se_a * k * j) / sum(n_a * k * j)) - sqrt(sum(se_b * k * j) / sum(n_b * k * j)) AS y FROM pr JOIN du USING (unit) JOIN (SELECT draw, repeat, k AS j FROM dp) USING (draw, repeat) GROUP BY draw) SELECT {r('quantile_cont(x, 0.025)', 'low')}, {r('quantile_cont(x, 0.975)', 'high')}, {r('quantile_cont(y, 0.025)', 'low_both')}, {r('quantile_cont(y, 0.975)', 'high_both')}, round(least(1e0, greatest(0e0, 1 - var_pop(x) / var_pop(y))), 5) + 0.0 AS share_from_repeats FROM o JOIN b USING (draw)")
def b5_two_level_bootstrap(spark, sf_dir):
    return rankings.two_level_bootstrap(repeated(spark, sf_dir), 60, SEED)


ROTATIONS = 20
ROTATED = f"{LABELLED}, ix AS (SELECT unit, event, score, row_number() OVER (PARTITION BY unit ORDER BY position) - 1 AS at, count(*) OVER (PARTITION BY unit) AS n FROM pred), tu AS (SELECT rotation, a.unit, a.event, b.score FROM ix a CROSS JOIN range(-1, {ROTATIONS}) t(rotation) JOIN ix b ON b.unit = a.unit AND b.at = (a.at + CASE WHEN rotation < 0 OR a.n < 2 THEN 0 ELSE CAST(('0x' || substr(sha256('42|' || rotation || '|' || a.unit), 1, 15)) AS BIGINT) % greatest(a.n - 1, 1) + 1 END) % a.n), nm AS (SELECT rotation, score, row_number() OVER (PARTITION BY rotation ORDER BY score DESC) AS nth, count(*) OVER (PARTITION BY rotation) AS n FROM tu WHERE event = 0), ln AS (SELECT rotation, max(score) FILTER (nth > floor(0.1 * n)) AS line FROM nm GROUP BY rotation), ht AS (SELECT DISTINCT rotation, event FROM tu JOIN ln USING (rotation) WHERE event > 0 AND score > line), bg AS (SELECT event, arg_min(unit, (unit, position)) AS unit FROM pred WHERE event > 0 GROUP BY event), ct AS (SELECT unit, count(*) FILTER (rotation < 0) AS found, count(*) FILTER (rotation >= 0) / {ROTATIONS} AS chance FROM ht JOIN bg USING (event) GROUP BY unit), rot AS (SELECT u.unit, coalesce(e.events, 0) AS events, coalesce(found, 0) AS found, coalesce(chance, 0) AS chance FROM (SELECT DISTINCT unit FROM pred) u LEFT JOIN (SELECT unit, count(*) AS events FROM bg GROUP BY unit) e ON e.unit = u.unit LEFT JOIN ct ON ct.unit = u.unit)"


def rotated(spark, sf_dir):
    return finding.chance_by_rotation(predictions(spark, sf_dir), 0.1, ROTATIONS, SEED)


@query(f"WITH {ROTATED} SELECT unit, events, found, {r('chance', 'chance')} FROM rot")
def b9_chance_by_rotation(spark, sf_dir):
    return rotated(spark, sf_dir)


EXCESS = f"{ROTATED}, fa AS (SELECT 'found' AS arm, unit, events, CAST(found AS DOUBLE) AS found, chance FROM rot UNION ALL SELECT 'half', unit, events, found * 0.5e0, chance FROM rot UNION ALL SELECT 'none', unit, events, 0e0, chance FROM rot)"


@query(f"WITH {EXCESS}, {strata_sql(81, 'SELECT unit, CAST(events > 0 AS INTEGER) AS stratum FROM rot')}, dx AS (SELECT draw, arm, sum((found - chance) * k) AS x FROM fa JOIN dr USING (unit) GROUP BY ALL), dd AS (SELECT a.draw, a.arm, a.x, max(b.x) AS rest FROM dx a JOIN dx b ON a.draw = b.draw AND a.arm <> b.arm GROUP BY ALL), sp AS (SELECT arm, quantile_cont(x, 0.0125) AS low, quantile_cont(x, 0.9875) AS high, stddev_pop(x - rest) AS sd FROM dd WHERE draw >= 0 GROUP BY arm) SELECT arm, {r('x', 'value')}, {r('rest', 'best_of_rest')}, {r('low', 'low')}, {r('high', 'high')}, {r('sd', 'sd')}, {r('(SELECT 3.083e0 * median(sd) FROM sp)', 'least_gain')} FROM dd JOIN sp USING (arm) WHERE draw = -1")
def b10_excess(spark, sf_dir):
    base = rotated(spark, sf_dir)
    named = F.explode(F.array(*[F.struct(F.lit(a).alias("arm"), F.lit(s).alias("s")) for a, s in (("found", 1.0), ("half", 0.5), ("none", 0.0))])).alias("a")
    rows = base.select("unit", "events", "found", "chance", named).select("a.arm", "unit", "events", (F.col("found") * F.col("a.s")).alias("found"), "chance")
    return finding.excess(rows, 81, SEED)  # percentiles 1.25 and 98.75 are then drawn values


def cold_sql(days: int | None) -> str:
    """SQL of departures whose floor and level come from the windows that end in the first days."""
    early = "true" if days is None else f"win_end <= (SELECT min(win_start) FROM wins) + {days} * 24"
    floor = FLOOR.replace("FROM long ", "FROM longfit ")
    return f"SELECT * FROM (WITH {SUMS}, ea AS (SELECT unit, position FROM wins WHERE {early}), longfit AS (SELECT long.* FROM long SEMI JOIN ea USING (unit, position)), {floor}, h AS (SELECT a.unit, a.position, a.channel, a.kind, a.x, list(b.x) FILTER (b.x IS NOT NULL) AS h FROM long a LEFT JOIN long b ON a.unit = b.unit AND a.channel = b.channel AND a.kind = b.kind AND b.position BETWEEN a.position - 5 AND a.position - 1 GROUP BY ALL), m AS (SELECT *, list_aggregate(h, 'median') AS mid FROM h), d AS (SELECT m.*, list_aggregate(list_transform(h, lambda v: abs(v - mid)), 'median') AS mad FROM m), sc AS (SELECT unit, position, max(CASE WHEN 2 * coalesce(len(h), 0) >= 5 THEN abs(x - mid) / greatest(1.4826 * mad, floor) ELSE 0 END) AS score FROM d JOIN floors USING (channel, kind) GROUP BY unit, position), lv AS (SELECT quantile_cont(score, 0.98) AS level FROM sc SEMI JOIN ea USING (unit, position)) SELECT CAST({'NULL' if days is None else days} AS BIGINT) AS days, unit, position, {r('score', 'score')}, {r('score - level', 'alarm')} FROM sc, lv)"


@query(f"{cold_sql(12)} UNION ALL {cold_sql(20)} UNION ALL {cold_sql(None)}")
def a19_fit_on_first_days(spark, sf_dir):
    return finding.fit_on_first_days(detect.window_summaries(tokens(spark, sf_dir)), placed(spark, sf_dir), [12, 20, None], 0.02)
