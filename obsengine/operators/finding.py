"""What detectors find: readings of each run, events by who finds them first, chance by rotation, cold starts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ordering import kept, running, sorted_position
from . import detect
from .metrics import flagged_runs
from .rankings import areas, drawn_in_strata


def after_event_share(predictions: DataFrame, hours: float, share: float) -> DataFrame:
    """K9: of the share of normal windows scored highest, how many end from 1 to `hours` hours after an event's last
    window before them; `(top, after)`. Ends meet in slots of `hours`, not by range.
    """
    normal = kept(predictions.where("event = 0"))
    top = int(share * normal.count())
    highest = sorted_position(normal.select("unit", "position", "win_end", "score"), [F.desc("score"), F.asc("unit"), F.asc("position")]).where(F.col("place") <= top)
    slot = F.floor(F.col("win_end") / hours)
    ends = predictions.where("event > 0").select(F.col("win_end").alias("_end"), slot.alias("_slot")).distinct()
    near = highest.withColumn("_slot", F.explode(F.array(slot - 1, slot))).join(ends, "_slot").where("_end < win_end")
    since = near.groupBy("unit", "position", "win_end").agg((F.col("win_end") - F.max("_end")).alias("since")).where((F.col("since") >= 1) & (F.col("since") <= hours))
    return since.agg(F.lit(top).cast("long").alias("top"), F.count(F.lit(1)).alias("after"))


def detection_readings(predictions: DataFrame, share: float, beta: float) -> DataFrame:
    """Of each run its events' weighted area, the recall of events at a share of normal windows, and the event-wise
    F-score at its own alarm: precision over found events and runs of false alarms, times the share of quiet normals.

    `predictions`: `(run, unit, position, event, score, flagged)`.
    """
    p = kept(predictions)
    rows = p.select(F.concat_ws("|", "run", "unit").alias("unit"), "event", F.col("run").alias("arm"), "score")
    once = rows.select("unit").distinct().select(F.lit(0).alias("draw"), "unit", F.lit(1).alias("k"))
    area = areas(rows, once, "pr_auc").select(F.col("arm").alias("run"), F.col("area").alias("area"))
    recall = areas(rows.withColumn("unit", F.col("arm")), rows.select(F.lit(0).alias("draw"), F.col("arm").alias("unit"), F.lit(1).alias("k")).distinct(), "recall", share).select(F.col("arm").alias("run"), F.col("area").alias("event_recall"))
    runs = flagged_runs(p.withColumn("unit", F.struct("run", "unit"))).where("NOT true_alarm").groupBy(F.col("unit.run").alias("run")).agg(F.count(F.lit(1)).alias("false"))
    normal = F.col("event") == 0
    told = p.groupBy("run").agg(F.countDistinct(F.when(~normal, F.col("event"))).alias("events"), F.countDistinct(F.when(~normal & F.col("flagged"), F.col("event"))).alias("hit"), (F.count_if(normal & ~F.col("flagged")) / F.nullif(F.count_if(normal), F.lit(0))).alias("quiet"))
    told = told.join(runs, "run", "left").fillna(0, ["false"])
    precision = F.coalesce(F.col("hit") / F.nullif(F.col("hit") + F.col("false"), F.lit(0)) * F.col("quiet"), F.lit(0.0))
    found = F.col("hit") / F.nullif(F.col("events"), F.lit(0))
    score = (1 + beta**2) * precision * found / F.nullif(beta**2 * precision + found, F.lit(0.0))
    return told.select("run", F.coalesce(score, F.lit(0.0)).alias("event_fbeta")).join(area, "run").join(recall, "run")


def first_finder(found: DataFrame, families: Sequence[str]) -> DataFrame:
    """`(event, finder)`: the first of the families of which a detector finds the event in at least half its
    repeats, else `nothing`. `found`: `(event, detector, family, repeat, found)`.
    """
    each = found.groupBy("event", "detector", "family").agg((F.avg(F.col("found").cast("double")) >= 0.5).alias("found"))
    order = F.element_at(F.create_map(*[F.lit(x) for i, f in enumerate(families) for x in (f, i)]), F.col("family"))
    first = each.groupBy("event").agg(F.min(F.when(F.col("found"), order)).alias("_first"))
    return first.select("event", F.coalesce(F.get(F.array(*map(F.lit, families)), F.col("_first")), F.lit("nothing")).alias("finder"))


def chance_by_rotation(predictions: DataFrame, share: float, rotations: int, seed: int) -> DataFrame:
    """`(unit, events, found, chance)`: of each unit (a month) the events that begin in it, those found with a share
    of normal windows flagged, and how many are found on average when each unit's scores are turned by a drawn offset.

    Rotation -1 turns nothing. Offsets are digests of (seed, rotation, unit), from 1 to a unit's windows less one. A
    window is flagged above the score that would flag more normal windows than the share.
    """
    at = F.row_number().over(Window.partitionBy("unit").orderBy("position")) - 1
    rows = kept(predictions.select("unit", "position", "event", "score", at.alias("_at")))
    sizes = rows.groupBy("unit").agg(F.count(F.lit(1)).alias("_n"))
    digest = F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col("rotation").cast("string"), "unit"), 256)
    drawn_ = F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), F.col("_n") - 1) + 1
    offset = F.when((F.col("rotation") < 0) | (F.col("_n") < 2), F.lit(0)).otherwise(drawn_)
    asked = rows.select("unit", "event", "_at").join(sizes, "unit").withColumn("rotation", F.explode(F.sequence(F.lit(-1), F.lit(rotations - 1)))).withColumn("_from", F.pmod(F.col("_at") + offset, F.col("_n")).cast("int"))
    scores = rows.select("unit", F.col("_at").alias("_from"), "score")
    turned = kept(asked.join(scores, ["unit", "_from"]).select("rotation", "unit", "event", "score"))
    allowed = int(share * rows.where("event = 0").count())
    normal = turned.where("event = 0").groupBy("rotation", "score").agg(F.count(F.lit(1)).alias("m"))
    line = running(normal, "score", {"ms": "m"}, descending=True, by=["rotation"]).where(F.col("ms") > allowed).groupBy("rotation").agg(F.max("score").alias("_line"))
    hit = turned.where("event > 0").join(F.broadcast(line), "rotation", "left").where(F.col("_line").isNull() | (F.col("score") > F.col("_line"))).select("rotation", "event").distinct()
    begins = rows.where("event > 0").groupBy("event").agg(F.min(F.struct("unit", "position"))["unit"].alias("unit"))
    counted = hit.join(begins, "event").groupBy("unit").agg(F.count_if(F.col("rotation") < 0).alias("found"), (F.count_if(F.col("rotation") >= 0) / rotations).alias("chance"))
    return sizes.select("unit").join(begins.groupBy("unit").agg(F.count(F.lit(1)).alias("events")), "unit", "left").join(counted, "unit", "left").fillna(0)


def excess(found: DataFrame, resamples: int, seed: int, power: float = 2.241 + 0.842) -> DataFrame:
    """Of each arm the events found beyond chance with an interval over drawn units, the best of the other arms, the
    spread of their difference in the same draw, and the least gain that this spread implies.

    `found`: `(arm, unit, events, found, chance)`. Units with an event and without are drawn apart. `power` adds the
    normal quantiles of the reading's level and of power 0.8; the interval is that level's, 97.5 %.
    """
    units = found.groupBy("unit").agg((F.max("events") > 0).alias("stratum"))
    drawn_ = found.join(drawn_in_strata(units, resamples, seed), "unit").groupBy("draw", "arm").agg(F.sum((F.col("found") - F.col("chance")) * F.col("k")).alias("x"))
    others = F.collect_list(F.struct("arm", "x")).over(Window.partitionBy("draw"))  # arms are few
    rest = F.array_max(F.transform(F.filter(others, lambda o: o["arm"] != F.col("arm")), lambda o: o["x"]))
    told = kept(drawn_.withColumn("rest", rest))
    held = told.where("draw = -1").select("arm", F.col("x").alias("value"), F.col("rest").alias("best_of_rest"))
    spread = told.where("draw >= 0").groupBy("arm").agg(F.percentile("x", F.lit(0.0125)).alias("low"), F.percentile("x", F.lit(0.9875)).alias("high"), F.stddev_pop(F.col("x") - F.col("rest")).alias("sd"))
    least = spread.agg((power * F.median("sd")).alias("least_gain"))
    return held.join(spread, "arm").crossJoin(F.broadcast(least))


def fit_on_first_days(summaries: DataFrame, windows: DataFrame, days: Sequence[int | None], contamination: float, span: int = 6) -> DataFrame:
    """`(days, unit, position, score, alarm)`: the departures' floor and alarm level from the windows that end in the
    first N days alone, for each N, and from all for None; read on every window.

    `windows` `(unit, position, win_start, win_end)`. Channels that the fitting windows lack take no part.
    """
    summaries = kept(summaries)
    told_ = kept(detect.histories(summaries, span))  # the floors alone differ
    first = windows.agg(F.min("win_start").alias("_first"))
    ends = windows.select("unit", "position", "win_end").crossJoin(F.broadcast(first))
    out = None
    for n in days:
        early = ends if n is None else ends.where(F.col("win_end") <= F.col("_first") + n * 24.0)
        early = early.select("unit", "position")
        floor = detect.departure_floor(summaries.join(early, ["unit", "position"], "left_semi"))
        scores = kept(detect.window_score(detect.departures_of(told_, floor)))
        told = detect.score_alarm(scores, contamination, scores.join(early, ["unit", "position"], "left_semi"))
        rows = told.select(F.lit(n).cast("int").alias("days"), "unit", "position", "score", "alarm")
        out = rows if out is None else out.unionByName(rows)
    return out
