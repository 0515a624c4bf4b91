"""Resampling at thousands of draws: each draw's units are split over blocks, and only sums of blocks travel.

A draw takes as many of n units as there are, with replacement, so the units' counts are multinomial. Places from 0 to
n - 1 stand in leaves of `LEAF`; a draw's n is split between the halves of the leaves by a seeded binomial, those
halves again, down to a leaf, in which the places are picked. A node's generator follows from the seed, the stratum
and the node alone, so every task finds its own leaves' share without seeing the others, and a lost task is repeated
exactly. A task turns its units into one weighted sum for each draw: what is shuffled is draws x tasks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import digest_position

LEAF = 256  # places: draws x LEAF counts are in memory at once
LEAVES = 32  # of a task
DRAWS = 10_000


def _generator(seed: int, stratum: str, *at: int) -> np.random.Generator:
    return np.random.default_rng([seed, zlib.crc32(stratum.encode()), *at])


def leaf_shares(seed: int, stratum: str, n: int, draws: int, low: int, high: int) -> Iterator[tuple[int, np.ndarray]]:
    """Of the leaves from `low` up to `high`, how many of its n units each draw takes from it."""
    size = lambda a, b: min(b * LEAF, n) - a * LEAF
    open_ = [(0, -(-n // LEAF), np.full(draws, n, np.int64))]
    while open_:
        a, b, taken = open_.pop()
        if b <= low or a >= high:
            continue
        if b - a == 1:
            yield a, taken
            continue
        middle = (a + b) // 2
        left = _generator(seed, stratum, a, b).binomial(taken, size(a, middle) / size(a, b))
        open_ += [(middle, b, taken - left), (a, middle, left)]


def place_counts(seed: int, stratum: str, leaf: int, taken: np.ndarray, size: int) -> np.ndarray:
    """How often each draw takes each of a leaf's places: a row for a draw, `taken` of them in all."""
    picks = _generator(seed, stratum, leaf, leaf + 1, 1).integers(0, size, int(taken.sum()))
    return np.bincount(np.repeat(np.arange(len(taken)) * size, taken) + picks, minlength=len(taken) * size).reshape(len(taken), size)


def placed(rows: DataFrame, unit: str, seed: int, stratum: str | None, leaves: int) -> DataFrame:
    """The units of `rows` with `_place` from 0, `_n` of them in their `_stratum`, and `_task`, `leaves` of them in each."""
    own = rows.select(F.col(unit).alias("_unit"), (F.lit("") if stratum is None else F.col(stratum).cast("string")).alias("_stratum")).where("_unit IS NOT NULL AND _stratum IS NOT NULL").distinct()
    digest = F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col("_unit").cast("string")), 256)
    at = digest_position(own.withColumn("_d", digest), "_d", ["_unit"], ["_stratum"], "_place").withColumn("_place", F.col("_place") - 1)
    sizes = at.groupBy(F.col("_stratum").alias("_of")).agg(F.count(F.lit(1)).alias("_n"))
    return at.join(sizes, F.col("_stratum") == F.col("_of")).select("_unit", "_stratum", "_place", "_n", F.floor(F.col("_place") / (LEAF * leaves)).cast("long").alias("_task"))


def drawn_sums(rows: DataFrame, unit: str, sums: Sequence[str], draws: int, seed: int, by: str | None = None, stratum: str | None = None, leaves: int = LEAVES) -> DataFrame:
    """`(draw[, by], *sums)`: the columns `sums` over the units that each draw takes, as often as it takes them.

    Units are drawn apart in each `stratum`; rows without a unit or a stratum take no part, and a unit has one stratum.
    Nulls add nothing; how many leaves a task has changes no draw. With `by`, a column, each of its values has sums of its own under the same draws.
    """
    kinds = dict(rows.dtypes)
    key = [] if by is None else [by]
    own = rows.groupBy(F.col(unit).alias("_own"), *key).agg(*[F.sum(F.col(c).cast("double")).alias(c) for c in sums])
    held = own.join(placed(rows, unit, seed, stratum, leaves), F.col("_own") == F.col("_unit"))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        stratum_, n, task = part["_stratum"].iloc[0], int(part["_n"].iloc[0]), int(part["_task"].iloc[0])
        place = part["_place"].to_numpy(np.int64)
        groups = [(None, np.arange(len(part)))] if by is None else [(k, np.asarray(i)) for k, i in part.groupby(by, dropna=False, sort=False).indices.items()]
        values = part[list(sums)].fillna(0.0).to_numpy(float)
        totals = [np.zeros((draws, len(sums))) for _ in groups]
        for leaf, taken in leaf_shares(seed, stratum_, n, draws, task * leaves, (task + 1) * leaves):
            size = min(LEAF, n - leaf * LEAF)
            counts = place_counts(seed, stratum_, leaf, taken, size).astype(float)
            for total, (_, rows_of) in zip(totals, groups, strict=True):
                mine = rows_of[place[rows_of] // LEAF == leaf]
                if len(mine):
                    total += counts[:, place[mine] - leaf * LEAF] @ values[mine]
        made = [pd.DataFrame({"draw": np.arange(draws, dtype=np.int32), **({} if by is None else {by: [k] * draws}), **dict(zip(sums, t.T, strict=True))}) for (k, _), t in zip(groups, totals, strict=True)]
        return pd.concat(made)

    schema = ", ".join(["draw int", *[f"`{c}` {kinds[c]}" for c in key], *[f"`{c}` double" for c in sums]])
    parts = held.groupBy("_stratum", "_task").applyInPandas(run, schema)
    return parts.groupBy("draw", *key).agg(*[F.sum(c).alias(c) for c in sums])


def drawn_counts(units: DataFrame, unit: str, draws: int, seed: int) -> DataFrame:
    """`(draw, unit, k)` of every unit and draw: for the few repeats of a run, not for a table of units."""
    kind = dict(units.dtypes)[unit]

    def run(part: pd.DataFrame) -> pd.DataFrame:
        n, task, place = int(part["_n"].iloc[0]), int(part["_task"].iloc[0]), part["_place"].to_numpy(np.int64)
        made = []
        for leaf, taken in leaf_shares(seed, "", n, draws, task * LEAVES, (task + 1) * LEAVES):
            counts = place_counts(seed, "", leaf, taken, min(LEAF, n - leaf * LEAF))
            for i in np.flatnonzero(place // LEAF == leaf):
                made.append(pd.DataFrame({"draw": np.arange(draws, dtype=np.int32), unit: part["_unit"].iloc[i], "k": counts[:, place[i] - leaf * LEAF]}))
        return pd.concat(made)

    return placed(units, unit, seed, None, LEAVES).groupBy("_task").applyInPandas(run, f"draw int, `{unit}` {kind}, k long")


def interval(values: DataFrame, column: str, level: float, low: str = "low", high: str = "high") -> DataFrame:
    tail = (1 - level) / 2
    return values.agg(F.percentile(column, F.lit(tail)).alias(low), F.percentile(column, F.lit(1 - tail)).alias(high))


def _reduction() -> Column:
    return F.sqrt(F.col("se_a") / F.nullif(F.col("n_a"), F.lit(0.0))) - F.sqrt(F.col("se_b") / F.nullif(F.col("n_b"), F.lit(0.0)))


SUMS = ("se_a", "n_a", "se_b", "n_b")


def paired_reduction(pairs: DataFrame, seed: int, draws: int = DRAWS, level: float = 0.95, strata: str | None = None) -> DataFrame:
    """B2: the reduction in RMSE from a to b, `(observed, low, high, p)`: a percentile interval and a two-sided p by the +1 rule."""
    whole = pairs.agg(*[F.sum(F.col(c).cast("double")).alias(c) for c in SUMS]).select(_reduction().alias("observed"))
    drawn = drawn_sums(pairs, "unit", SUMS, draws, seed, stratum=strata).select(_reduction().alias("reduction"))
    side = lambda c: (F.count_if(c) + 1) / (F.count(F.lit(1)) + 1)
    tail = (1 - level) / 2
    p = F.least(F.lit(1.0), 2 * F.least(side(F.col("reduction") <= 0), side(F.col("reduction") >= 0)))
    return whole.crossJoin(drawn.agg(F.percentile("reduction", F.lit(tail)).alias("low"), F.percentile("reduction", F.lit(1 - tail)).alias("high"), p.alias("p")))


def two_level(pairs: DataFrame, seed: int, draws: int = DRAWS, level: float = 0.95) -> DataFrame:
    """Intervals of the reduction with units drawn and repeats pooled, and with repeats drawn too, and the share of
    the second's variance that repeats add. `pairs`: `(repeat, unit, se_a, n_a, se_b, n_b)`."""
    own = pairs.withColumn("repeat", F.col("repeat").cast("string"))
    by_repeat = drawn_sums(own, "unit", SUMS, draws, seed, by="repeat")
    repeats = drawn_counts(own.select("repeat").distinct(), "repeat", draws, seed + 1)
    weighed = by_repeat.join(repeats, ["draw", "repeat"])
    both = weighed.groupBy("draw").agg(*[F.sum(F.col(c) * F.col("k")).alias(c) for c in SUMS]).select("draw", _reduction().alias("reduction_both"))
    told = by_repeat.groupBy("draw").agg(*[F.sum(c).alias(c) for c in SUMS]).select("draw", _reduction().alias("reduction")).join(both, "draw")
    tail = (1 - level) / 2
    cut = lambda c, p, to: F.percentile(c, F.lit(p)).alias(to)
    share = 1 - F.var_pop("reduction") / F.nullif(F.var_pop("reduction_both"), F.lit(0.0))
    return told.agg(cut("reduction", tail, "low"), cut("reduction", 1 - tail, "high"), cut("reduction_both", tail, "low_both"), cut("reduction_both", 1 - tail, "high_both"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(share, F.lit(0.0)))).alias("share_from_repeats"))


def ratio_of_sums(tallies: DataFrame, answers: Sequence[str], baseline: str, seed: int, draws: int = DRAWS, level: float = 0.95) -> DataFrame:
    """`(answer, skill, low, high)`: `1 - answer / baseline` of summed losses, all answers under the same draws."""
    sums = [*answers, baseline]
    skill = lambda a: 1 - F.col(a) / F.nullif(F.col(baseline), F.lit(0.0))
    named = F.explode(F.array(*[F.struct(F.lit(a).alias("answer"), skill(a).alias("skill")) for a in answers])).alias("s")
    whole = tallies.agg(*[F.sum(F.col(c).cast("double")).alias(c) for c in sums]).select(named).select("s.*")
    drawn = drawn_sums(tallies, "unit", sums, draws, seed).select(named).select("s.*")
    tail = (1 - level) / 2
    return whole.join(drawn.groupBy("answer").agg(F.percentile("skill", F.lit(tail)).alias("low"), F.percentile("skill", F.lit(1 - tail)).alias("high")), "answer")


def geometric_ratio(losses: DataFrame, answer: str, bars: Sequence[str], seed: int, draws: int = DRAWS, level: float = 0.95) -> DataFrame:
    """`(ratio, low, high)`: the geometric mean over units of the answer's loss over the smallest bar's.

    A unit on which either is 0 has no ratio and takes no part.
    """
    bar = F.least(*bars) if len(bars) > 1 else F.col(bars[0])
    logs = losses.select("unit", F.when((F.col(answer) > 0) & (bar > 0), F.ln(F.col(answer) / bar)).alias("l"), F.lit(1.0).alias("one")).where("l IS NOT NULL")
    drawn = drawn_sums(logs, "unit", ["l", "one"], draws, seed).select(F.exp(F.col("l") / F.col("one")).alias("ratio"))
    return logs.agg(F.exp(F.avg("l")).alias("ratio")).crossJoin(interval(drawn, "ratio", level))
