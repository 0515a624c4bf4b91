"""Rankings compared over drawn units: areas and recalls of many arms under the same draws, and what they differ by."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ordering import kept, ranges_for
from .draws import ranked
from .draws_of_units import drawn, interval

OFTEN = 8  # rows of one score in a batch that are summed there
DOUBLES = pa.list_(pa.float64())


def drawn_in_strata(units: DataFrame, resamples: int, seed: int) -> DataFrame:
    """`(draw, unit, k)`: how often each draw takes a unit, `units` `(unit, stratum)` drawn apart in each stratum.

    Draw -1 takes every unit once.
    """
    placed = kept(ranked(units.select("unit", F.col("stratum").cast("int").alias("stratum")), ["unit"], seed, by=["stratum"]).drop("digest"))
    sizes = placed.groupBy("stratum").agg(F.count(F.lit(1)).alias("_n"))
    digest = F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col("draw").cast("string"), F.col("stratum").cast("string"), (F.col("place") - 1).cast("string")), 256)
    at = F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), F.col("_n")) + 1
    picks = placed.join(F.broadcast(sizes), "stratum").withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))))
    picked = picks.groupBy("draw", "stratum", at.alias("place")).agg(F.count(F.lit(1)).alias("k")).join(placed, ["stratum", "place"])
    return picked.select("draw", "unit", "k").unionByName(placed.select(F.lit(-1).alias("draw"), "unit", F.lit(1).cast("long").alias("k")))


def strata_of(rows: DataFrame) -> DataFrame:
    """Units with an event's window and those without."""
    return rows.groupBy("unit").agg(F.bool_or(F.col("event") > 0).alias("stratum"))


def _wide(draws: DataFrame, names: list[int]) -> DataFrame:
    """`(unit, ks)`: how often each of the draws `names` takes a unit, one row a unit."""
    return draws.groupBy("unit").agg(F.array(*[F.sum(F.when(F.col("draw") == d, F.col("k")).otherwise(0)).cast("double") for d in names]).alias("ks"))


def _lists(column: pa.ChunkedArray | pa.Array, wide: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, wide)


def _combined(wide: int):
    """Of each batch the rows whose arm and score come often as one row of sums `hs` and `ms`, the others as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = pa.table([batch.column("arm"), batch.column("score")], ["arm", "score"]).append_column("at", pa.array(np.arange(batch.num_rows)))
            first = key.group_by(["arm", "score"]).aggregate([("at", "min"), ("at", "count")])
            which = np.full(batch.num_rows, -1)
            code = key.join(first.append_column("code", pa.array(np.arange(first.num_rows))), ["arm", "score"])
            which[code.column("at").to_numpy()] = code.column("code").to_numpy()
            often = first.column("at_count").to_numpy()[which] >= OFTEN
            rare = batch.filter(pa.array(~often))
            yield pa.RecordBatch.from_arrays([*rare.columns, pa.nulls(rare.num_rows, DOUBLES), pa.nulls(rare.num_rows, DOUBLES)], names=[*batch.schema.names, "hs", "ms"])
            if often.any():
                at = np.flatnonzero(often)
                at = at[np.argsort(which[at], kind="stable")]
                starts = np.flatnonzero(np.concatenate([[True], which[at][1:] != which[at][:-1]]))
                k = _lists(batch.column("ks"), wide)[at]
                sums = [np.add.reduceat(batch.column(c).to_numpy()[at, None] * k, starts) for c in ("h", "m")]
                one, n = batch.take(pa.array(at[starts])), len(starts)
                sums = [pa.ListArray.from_arrays(np.arange(0, n * wide + 1, wide, dtype=np.int32), pa.array(x.ravel())) for x in sums]
                kept_ = {"ks": pa.nulls(n, DOUBLES)}
                yield pa.RecordBatch.from_arrays([kept_.get(c, one.column(c)) for c in batch.schema.names] + sums, names=[*batch.schema.names, "hs", "ms"])

    return run


def _swept(rows: pa.Table, wide: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores from the highest, and of each the hits and misses that every draw takes."""
    summed = rows.filter(pa.compute.is_null(rows.column("ks")))
    rare = rows.filter(pa.compute.is_valid(rows.column("ks")))
    k = _lists(rare.column("ks"), wide)
    score = np.concatenate([summed.column("score").to_numpy(), rare.column("score").to_numpy()])
    told = [np.concatenate([_lists(summed.column(c), wide), rare.column(x).to_numpy()[:, None] * k]) for c, x in (("hs", "h"), ("ms", "m"))]
    order = np.argsort(-score, kind="stable")
    score = score[order]
    starts = np.flatnonzero(np.concatenate([[True], score[1:] != score[:-1]]))
    return score[starts], *[np.add.reduceat(x[order], starts) for x in told]


def areas(rows: DataFrame, draws: DataFrame, measure: str, share: float = 0.01) -> DataFrame:
    """`(draw, arm, area)` of rows `(unit, event, arm, score)`: `auroc`, `pr_auc` (events of equal weight) or `recall`
    of events at a share of normal windows, a unit counted as often as the draw takes it.

    Rows of equal unit, arm and score are one, and carry how often each draw takes their unit: a row stays a row however
    many draws there are. Scores that come often are summed where they lie; the rest is dealt to ranges of scores, whose
    totals are added to those below, so a task holds a range.
    """
    if measure == "pr_auc":
        sizes = rows.where("event > 0").groupBy("arm", "event").agg(F.count(F.lit(1)).alias("_n"))
        rows = rows.join(sizes, ["arm", "event"], "left").withColumn("_w", F.coalesce(1 / F.col("_n"), F.lit(1.0)))
    else:
        rows = rows.withColumn("_w", F.lit(1.0))
    hit, draws = F.col("event") > 0, kept(draws)
    names = sorted(r["draw"] for r in draws.select("draw").distinct().collect())  # a number a draw
    wide, ks = len(names), kept(_wide(draws, names))
    own = kept(rows.groupBy("unit", "arm", F.col("score").cast("double").alias("score")).agg(F.sum(F.when(hit, F.col("_w")).otherwise(0.0)).alias("h"), F.sum(F.when(~hit, F.col("_w")).otherwise(0.0)).alias("m")))
    ranges = max(8, ranges_for(own.count(), 50_000))
    splits = sorted({-float("inf"), *own.stat.approxQuantile("score", [i / ranges for i in range(1, ranges)], 0.5 / ranges), float("inf")})
    dealt = Bucketizer(splits=splits, inputCol="score", outputCol="range").transform(own.where("score IS NOT NULL"))
    carried = dealt.join(ks, "unit").select("arm", "range", "score", "h", "m", "ks")
    rows_ = kept(carried.mapInArrow(_combined(wide), "arm string, range double, score double, h double, m double, ks array<double>, hs array<double>, ms array<double>").repartition("arm", "range"))

    def total(group: pa.Table) -> pa.Table:
        _, h, m = _swept(group, wide)
        return pa.table([group.column("arm").slice(0, 1).combine_chunks().take(pa.array([0] * wide)), pa.array([group.column("range")[0].as_py()] * wide), pa.array(names, pa.int64()), pa.array(h.sum(0)), pa.array(m.sum(0))], ["arm", "range", "draw", "h", "m"])

    totals = kept(rows_.groupBy("arm", "range").applyInArrow(total, "arm string, range double, draw long, h double, m double"))
    w = Window.partitionBy("arm", "draw")
    above = w.orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)
    begin = totals.select("arm", "range", "draw", *[F.coalesce(F.sum(c).over(above), F.lit(0.0)).alias(f"{c}_above") for c in "hm"], F.sum("m").over(w).alias("m_all"))
    begin = begin.groupBy(F.col("arm").alias("of_arm"), F.col("range").alias("of_range")).agg(F.sort_array(F.collect_list(F.struct("draw", "h_above", "m_above", "m_all"))).alias("_s"))
    begin = begin.select("of_arm", "of_range", *[F.col(f"_s.{c}").alias(c) for c in ("h_above", "m_above", "m_all")])

    def sweep(group: pa.Table, start: pa.Table) -> pa.Table:
        score, h, m = _swept(group, wide)
        hs, ms, all_ = (_lists(start.column(c), wide) for c in ("h_above", "m_above", "m_all"))
        hs, ms = hs + h.cumsum(0), ms + m.cumsum(0)
        with np.errstate(invalid="ignore", divide="ignore"):
            if measure == "auroc":  # each hit beats the misses below it and half of those beside it
                told = (h * (ms - m / 2)).sum(0)
            elif measure == "pr_auc":
                told = np.nansum(h * hs / (hs + ms), 0)
            else:
                allowed = (ms <= share * all_) & (h + m > 0)
                told = np.where(allowed, score[:, None], np.inf).min(0)
        return pa.table([group.column("arm").slice(0, 1).combine_chunks().take(pa.array([0] * wide)), pa.array(names, pa.int64()), pa.array(told)], ["arm", "draw", "told"])

    told = rows_.groupBy("arm", "range").cogroup(begin.groupBy("of_arm", "of_range")).applyInArrow(sweep, "arm string, draw long, told double")
    if measure != "recall":
        both = totals.groupBy("arm", "draw").agg(F.sum("h").alias("H"), F.sum("m").alias("M")).join(told.groupBy("arm", "draw").agg(F.sum("told").alias("t")), ["arm", "draw"])
        area = 1 - F.col("t") / F.nullif(F.col("H") * F.col("M"), F.lit(0.0)) if measure == "auroc" else F.col("t") / F.nullif(F.col("H"), F.lit(0.0))
        return both.select(F.col("draw").cast(draws.schema["draw"].dataType).alias("draw"), "arm", area.alias("area"))
    alarm = {(r["arm"], r["draw"]): r["alarm"] for r in told.groupBy("arm", "draw").agg(F.min("told").alias("alarm")).collect()}  # a number a draw and arm
    best = rows.where("event > 0").groupBy("unit", "arm", "event").agg(F.max("score").cast("double").alias("best")).join(ks, "unit")

    def recalled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            arm, k, best = np.array(batch.column("arm").to_pylist()), _lists(batch.column("ks"), wide), batch.column("best").to_numpy()
            for a in dict.fromkeys(arm.tolist()):
                line = np.array([alarm.get((a, d), np.inf) for d in names])
                mine = arm == a
                sums[a] = sums.get(a, 0) + np.stack([(k[mine] * ((best[mine, None] >= line) & np.isfinite(line))).sum(0), k[mine].sum(0)])
        for a, (x, y) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([a] * wide), pa.array(names, pa.int64()), pa.array(x), pa.array(y)], names=["arm", "draw", "hit", "all"])

    got = best.select("arm", "best", "ks").mapInArrow(recalled, "arm string, draw long, hit double, all double").groupBy("draw", "arm").agg((F.sum("hit") / F.nullif(F.sum("all"), F.lit(0.0))).alias("area"))
    return got.select(F.col("draw").cast(draws.schema["draw"].dataType).alias("draw"), "arm", "area")


def _contrast(rows: DataFrame, signs: dict[str, int], measure: str, share: float, resamples: int, seed: int) -> DataFrame:
    rows = kept(rows)
    found = areas(rows, drawn_in_strata(strata_of(rows), resamples, seed), measure, share)
    sign = F.element_at(F.create_map(*[F.lit(x) for pair in signs.items() for x in pair]), F.col("arm"))
    each = kept(found.groupBy("draw").agg(F.sum(F.col("area") * sign).alias("reduction")))
    side = lambda c: (F.count_if(c) + 1) / (F.count(F.lit(1)) + 1)
    drawn_ = each.where("draw >= 0")
    p = drawn_.agg(F.least(F.lit(1.0), 2 * F.least(side(F.col("reduction") <= 0), side(F.col("reduction") >= 0))).alias("p"))
    return each.where("draw = -1").select(F.col("reduction").alias("observed")).crossJoin(interval(drawn_, "reduction")).crossJoin(p)


def paired_ranking_bootstrap(rows: DataFrame, control: str, candidate: str, measure: str, resamples: int, seed: int, share: float = 0.01) -> DataFrame:
    """What the candidate's area (or recall) has over the control's, an interval and a two-sided p over drawn units."""
    return _contrast(rows.where(F.col("arm").isin(control, candidate)), {control: -1, candidate: 1}, measure, share, resamples, seed)


def interaction(rows: DataFrame, taught: Sequence[str], untaught: Sequence[str], measure: str, resamples: int, seed: int) -> DataFrame:
    """The gain of the candidate over the control among the taught less that among the untaught, the same draws
    for all four arms; each pair is (control, candidate)."""
    signs = {taught[0]: -1, taught[1]: 1, untaught[0]: 1, untaught[1]: -1}
    return _contrast(rows.where(F.col("arm").isin(*signs)), signs, measure, 0.0, resamples, seed)


def seed_spread(rows: DataFrame, resamples: int, seed: int) -> DataFrame:
    """Of arms that differ in their seed alone the spread of their areas beside what drawing units alone spreads
    them by (root mean square over the arms); the draws are the same for all."""
    rows = kept(rows)
    found = kept(areas(rows, drawn_in_strata(strata_of(rows), resamples, seed), "auroc"))
    over = found.where("draw = -1").agg(F.count(F.lit(1)).alias("seeds"), F.avg("area").alias("area"), F.stddev_samp("area").alias("deviation"))
    units = found.where("draw >= 0").groupBy("arm").agg(F.var_samp("area").alias("v")).agg(F.sqrt(F.avg("v")).alias("unit_error"))
    return over.crossJoin(units)


def two_level_bootstrap(pairs: DataFrame, resamples: int, seed: int) -> DataFrame:
    """Intervals of the reduction in RMSE with units drawn and repeats pooled, and with repeats drawn too, and the
    share of the second's variance that units alone don't carry. `pairs`: `(repeat, unit, se_a, n_a, se_b, n_b)`.
    """
    units = drawn(pairs.select("unit").distinct(), "unit", resamples, seed)
    repeats = drawn(pairs.select(F.col("repeat").cast("string").alias("repeat")).distinct(), "repeat", resamples, seed + 1)
    sums = ["se_a", "n_a", "se_b", "n_b"]
    own = pairs.withColumn("repeat", F.col("repeat").cast("string"))
    by_repeat = kept(own.join(units, "unit").groupBy("draw", "repeat").agg(*[F.sum(F.col(c) * F.col("k")).alias(c) for c in sums]))
    gain = lambda w: F.sqrt(F.sum(F.col("se_a") * w) / F.sum(F.col("n_a") * w)) - F.sqrt(F.sum(F.col("se_b") * w) / F.sum(F.col("n_b") * w))
    one = by_repeat.groupBy("draw").agg(gain(F.lit(1)).alias("reduction"))
    two = by_repeat.join(repeats, ["draw", "repeat"]).groupBy("draw").agg(gain(F.col("k")).alias("reduction_both"))
    told = kept(one.join(two, "draw"))
    both = interval(told, "reduction_both").select(F.col("low").alias("low_both"), F.col("high").alias("high_both"))
    share = 1 - F.var_pop("reduction") / F.nullif(F.var_pop("reduction_both"), F.lit(0.0))
    part = told.agg(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(share, F.lit(0.0)))).alias("share_from_repeats"))
    return interval(told, "reduction").crossJoin(both).crossJoin(part)
