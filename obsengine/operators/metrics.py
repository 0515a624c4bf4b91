"""Labels for windows and exact, tie-aware scores of predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ordering import kept, running


def remaining_life(windows: DataFrame, failures: DataFrame, ceiling: float) -> DataFrame:
    """L1: `min(failed_at - ends_at, ceiling)` for each window; a negative one marks a refused row."""
    return windows.join(failures, "unit").withColumn("target", F.least(F.col("failed_at") - F.col("win_end"), F.lit(ceiling)))


def overlap_events(windows: DataFrame, events: DataFrame, slot: float) -> DataFrame:
    """L4: the lowest number of an event of its unit that a window overlaps, or 0.

    Both sides are dealt to the time slots that they touch and meet by equality; no nested loop.
    """
    cover = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / slot), F.floor(F.col(b) / slot)))
    w = windows.select("unit", "position", "win_start", "win_end", cover("win_start", "win_end").alias("slot"))
    e = events.select("unit", F.col("number"), F.col("start").alias("e_start"), F.col("end").alias("e_end"), cover("start", "end").alias("slot"))
    hit = w.join(e, ["unit", "slot"]).where("e_start < win_end AND win_start < e_end").groupBy("unit", "position").agg(F.min("number").alias("event"))
    return windows.join(hit, ["unit", "position"], "left").withColumn("event", F.coalesce("event", F.lit(0)))


def rmse(predictions: DataFrame, by: list[str]) -> DataFrame:
    """K1: root mean squared error and count."""
    e = F.col("predicted") - F.col("target")
    return predictions.groupBy(*by).agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.count(F.lit(1)).alias("n"))


def score_groups(predictions: DataFrame, outcome: str, score: str = "score", weight: str | None = None) -> DataFrame:
    """Rows of equal score as one: `(score, hits, misses)` by weight. What follows depends on these alone."""
    w = F.col(weight) if weight else F.lit(1.0)
    hit = F.col(outcome) > 0
    return predictions.groupBy(F.col(score).alias("score")).agg(F.sum(F.when(hit, w).otherwise(0.0)).alias("hits"), F.sum(F.when(~hit, w).otherwise(0.0)).alias("misses"))


def auroc(predictions: DataFrame, outcome: str, score: str = "score", weight: str | None = None) -> DataFrame:
    """K3: the chance that a hit scores above a miss, ties counting half; null with one outcome only."""
    g = running(score_groups(predictions, outcome, score, weight), "score", {"below": "misses"})
    won = F.sum(F.col("hits") * (F.col("below") - F.col("misses") / 2))
    return g.agg((won / F.nullif(F.sum("hits") * F.sum("misses"), F.lit(0.0))).alias("auroc"))


def average_precision(predictions: DataFrame, outcome: str, score: str = "score", weight: str | None = None) -> DataFrame:
    """K4, K5: precision averaged over hits from the highest score down, equal scores taken whole."""
    g = running(score_groups(predictions, outcome, score, weight), "score", {"h": "hits", "m": "misses"}, descending=True)
    return g.agg((F.sum(F.col("hits") * F.col("h") / F.nullif(F.col("h") + F.col("m"), F.lit(0.0))) / F.nullif(F.sum("hits"), F.lit(0.0))).alias("average_precision"))


def event_weights(predictions: DataFrame, event: str = "event") -> DataFrame:
    """K5: each event weighs one, spread over its windows; other windows one each."""
    sizes = predictions.where(F.col(event) > 0).groupBy(event).agg(F.count(F.lit(1)).alias("_n"))
    return predictions.join(sizes, event, "left").withColumn("weight", F.when(F.col(event) > 0, 1 / F.col("_n")).otherwise(1.0)).drop("_n")


def event_recall_at(predictions: DataFrame, share: float, event: str = "event", score: str = "score") -> DataFrame:
    """K6: events found when the alarm is as low as a share of normal windows allows, equal scores taken whole."""
    predictions = kept(predictions)
    g = running(score_groups(predictions, event, score), "score", {"m": "misses"}, descending=True)
    normal = g.agg(F.sum("misses")).first()[0] or 0.0
    low = g.where(F.col("m") <= share * normal).agg(F.min("score").alias("alarm"))
    rows = predictions.where(F.col(event) > 0).crossJoin(F.broadcast(low))
    return rows.agg((F.countDistinct(F.when(F.col(score) >= F.col("alarm"), F.col(event))) / F.nullif(F.countDistinct(event), F.lit(0))).alias("recall"), F.countDistinct(event).alias("events"))


def flagged_runs(predictions: DataFrame, flag: str = "flagged", event: str = "event") -> DataFrame:
    """K7: runs of neighbouring flagged windows of a unit, and whether each meets an event."""
    island = F.col("position") - F.row_number().over(Window.partitionBy("unit").orderBy("position"))
    runs = predictions.where(F.col(flag)).withColumn("_island", island)
    return runs.groupBy("unit", "_island").agg(F.min("position").alias("first"), F.max("position").alias("last"), F.bool_or(F.col(event) > 0).alias("true_alarm")).drop("_island")


def corrected_event_fbeta(predictions: DataFrame, beta: float = 0.5, flag: str = "flagged", event: str = "event") -> DataFrame:
    """K7: one row `(events, found, false_runs, recall, precision, fbeta)` at the alarm that `flag` stands for.

    Recall is the share of events with a flagged window. Precision is that of events found among these and the runs
    that meet none, times the share of normal windows left quiet: to flag everything scores nothing.
    """
    if beta <= 0:
        raise ValueError("beta must be positive")
    is_event = F.coalesce(F.col(event) > 0, F.lit(False))
    counts = predictions.agg(F.countDistinct(F.when(is_event, F.col(event))).alias("events"), F.countDistinct(F.when(is_event & F.col(flag), F.col(event))).alias("found"), F.count_if(~is_event).alias("normal"), F.count_if(~is_event & ~F.col(flag)).alias("quiet"))
    false_runs = flagged_runs(predictions, flag, event).agg(F.count_if(~F.coalesce("true_alarm", F.lit(False))).alias("false_runs"))
    rows = counts.crossJoin(F.broadcast(false_runs))  # a row each
    share = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    rows = rows.withColumn("recall", F.col("found") / F.nullif("events", F.lit(0))).withColumn("precision", share(F.col("found"), F.col("found") + F.col("false_runs")) * share(F.col("quiet"), F.col("normal")))
    weighted = share((1 + beta**2) * F.col("precision") * F.col("recall"), beta**2 * F.col("precision") + F.col("recall"))
    return rows.withColumn("fbeta", weighted).select("events", "found", "false_runs", "recall", "precision", "fbeta")


def average_rank(df: DataFrame, column: str, to: str) -> DataFrame:
    """`df` with the rank of `column`, equal values sharing their mean rank."""
    sizes = df.groupBy(column).agg(F.count(F.lit(1)).cast("double").alias("_n"))
    ranks = running(sizes, column, {"_upto": "_n"}).select(column, (F.col("_upto") - (F.col("_n") - 1) / 2).alias(to))
    return df.join(ranks, column)


def rank_agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """Spearman's correlation with mean ranks."""
    return average_rank(average_rank(df, a, "_ra"), b, "_rb").agg(F.corr("_ra", "_rb").alias("spearman"))


def holm(tests: DataFrame, p: str = "p", family_size: int | None = None) -> DataFrame:
    """Holm's adjusted p and Benjamini and Hochberg's; a family of tests is a few rows and is ordered whole.

    `family_size` counts the whole family where only some of its tests were run, and can't be less than these.
    """
    w = Window.partitionBy(F.lit(0)).orderBy(p, "test")
    back = Window.partitionBy(F.lit(0)).orderBy(F.desc(p), F.desc("test")).rowsBetween(Window.unboundedPreceding, 0)  # a frame up to the end is read anew for each row
    n = F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))
    if family_size is not None:
        n = F.when(n > family_size, F.raise_error(F.lit(f"more tests than the family's {family_size}"))).otherwise(F.lit(family_size))
    rows = tests.withColumn("_k", F.row_number().over(w)).withColumn("_n", n)
    down = F.max(F.least(F.lit(1.0), F.col(p) * (F.col("_n") - F.col("_k") + 1))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    up = F.min(F.least(F.lit(1.0), F.col(p) * F.col("_n") / F.col("_k"))).over(back)
    return rows.withColumn("holm", down).withColumn("benjamini_hochberg", up).drop("_k", "_n")
