"""Which units, windows and readings take part: sides by weight, frozen sides, strata of a target, months, caps."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import kept, sorted_position
from .draws import ranked


def untruncated(windows: DataFrame, loaded: Sequence[str], hours: float, origin: str) -> DataFrame:
    """Windows of whose last `hours` hours before their end none lies in a month that isn't loaded.

    `loaded` names months as yyyy-MM, a few; times are hours from `origin`.
    """
    month = lambda h: F.date_trunc("month", F.timestamp_add("HOUR", h.cast("int"), F.lit(origin).cast("timestamp_ntz")))
    touched = F.transform(F.sequence(month(F.floor(F.col("win_end") - hours)), month(F.ceil("win_end") - 1), F.expr("interval 1 month")), lambda m: F.date_format(m, "yyyy-MM"))
    return windows.where(F.forall(touched, lambda m: m.isin(*loaded)))


def thin_to_cap(readings: DataFrame, cap: int, step: float, tried: int = 16) -> DataFrame:
    """Series of more than `cap` readings keep the earliest reading of each bin; bins are the least whole number
    of steps wide that leaves at most `cap` of them. Other series stay as they are.

    Bins of one step are found once and coarser ones follow from them, `tried` widths at a time. The count of bins
    doesn't fall steadily with the width, so widths are tried in turn; but b bins of width s take at least
    `s (b / cap - 2)` steps to fit, and widths below that are passed over.
    """
    series = ["unit", "channel"]
    over = kept(readings.groupBy(*series).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > cap).select(*series))
    fine = kept(readings.join(over, series, "left_semi").groupBy(*series, F.floor(F.col("time") / step).alias("_fine")).agg(F.min(F.struct("time", "value")).alias("r")))
    open_, chosen = over.withColumn("_from", F.lit(1).cast("long")), None
    while True:
        widths = open_.withColumn("_width", F.explode(F.sequence("_from", F.col("_from") + tried - 1))).drop("_from")
        bins = fine.select(*series, "_fine").join(widths, series).groupBy(*series, "_width", F.floor(F.col("_fine") / F.col("_width")).alias("_bin")).agg(F.lit(1).alias("_one"))
        counts = bins.groupBy(*series, "_width").agg(F.count(F.lit(1)).alias("_bins"))
        found = kept(counts.groupBy(*series).agg(F.min(F.when(F.col("_bins") <= cap, F.col("_width"))).alias("_width"), F.max("_width").alias("_last"), F.max(F.floor(F.col("_width") * (F.col("_bins") / cap - 2))).alias("_least")))
        fits = found.where("_width IS NOT NULL").select(*series, "_width")
        chosen = fits if chosen is None else chosen.unionByName(fits)
        open_ = found.where("_width IS NULL").select(*series, F.greatest(F.col("_last") + 1, "_least").alias("_from"))
        if open_.limit(1).count() == 0:
            break
    thinned = fine.join(chosen, series).groupBy(*series, F.floor(F.col("_fine") / F.col("_width"))).agg(F.min("r").alias("r"))
    return readings.join(over, series, "left_anti").select(*series, "time", "value").unionByName(thinned.select(*series, "r.time", "r.value"))


def held_out_by_weight(units: DataFrame, line: float, fraction: float, seed: int) -> DataFrame:
    """`units` `(unit, mean_square)` with `side`. Those above the line alternate from the heaviest, which trains;
    the rest of the held-out share is drawn from the others by seeded rank. Refused where alternation alone exceeds it.
    """
    n = units.count()
    heavy = units.where(F.col("mean_square") > line)
    alternated = heavy.count() // 2
    wanted = round(fraction * n)
    if alternated > wanted:
        raise ValueError("alternation holds out more than the share asked for")
    first = sorted_position(heavy, [F.desc("mean_square"), F.asc("unit")]).withColumn("_out", F.col("place") % 2 == 0)
    rest = ranked(units.where(~(F.col("mean_square") > line)), ["unit"], seed).withColumn("_out", F.col("place") <= wanted - alternated)
    both = first.select(*units.columns, "_out").unionByName(rest.select(*units.columns, "_out"))
    return both.select(*units.columns, F.when(F.col("_out"), "held_out").otherwise("training").alias("side"))


def task_split(units: DataFrame, frozen: DataFrame, final: bool = False) -> DataFrame:
    """Units `(unit, side)` as tuning (from training) and validation (from held_out); `frozen` `(unit)` are left
    out, or in a final run take the side test. A frozen share is `draws.share` of the units.
    """
    own = units.withColumn("side", F.when(F.col("side") == "training", "tuning").otherwise("validation"))
    kept_ = own.join(frozen.select("unit"), "unit", "left_anti")
    return kept_.unionByName(own.join(frozen.select("unit"), "unit", "left_semi").withColumn("side", F.lit("test"))) if final else kept_


def stratum_order(bins: int, seed: int) -> list[int]:
    """Strata in seeded order."""
    return sorted(range(bins), key=lambda b: (hashlib.sha256(f"{len(str(seed))}:{seed}|7:stratum|{len(str(b))}:{b}".encode()).hexdigest(), b))


def draw_stratified(pool: DataFrame, target: str, key: Sequence[str], bins: int, n: int, seed: int) -> DataFrame:
    """N rows taken in turn from strata of the target's ranks, whose sizes differ by one at most; nested in n.

    With strata of equal size the round and the stratum's turn give a row's place at once; only the last round has
    fewer strata.
    """
    total = pool.count()
    if total < bins:
        raise ValueError("fewer rows than bins")
    size, more = divmod(total, bins)
    turns = stratum_order(bins, seed)
    last = [b for b in turns if b < more]
    turn = F.element_at(F.create_map(*[F.lit(x) for i, b in enumerate(turns) for x in (b, i)]), F.col("bin"))
    late = F.element_at(F.create_map(*[F.lit(x) for i, b in enumerate(last) for x in (b, i)]), F.col("bin")) if last else F.lit(0)
    at = F.col("place") - 1
    binned = sorted_position(pool, [target, *key]).withColumn("bin", F.when(at < more * (size + 1), F.floor(at / (size + 1))).otherwise(more + F.floor((at - more * (size + 1)) / size)).cast("int")).drop("place")
    rows = ranked(binned, key, seed, by=["bin"])
    depth = F.col("place") - 1
    order = F.when(depth < size, depth * bins + turn).otherwise(F.lit(size * bins) + late)
    return rows.where(order < n).select(*pool.columns, "bin")
