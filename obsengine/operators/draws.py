"""Splits, shares and draws by seeded rank: they nest, replay anywhere and don't depend on the order of rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import digest_position, seeded_rank


def ranked(items: DataFrame, key: Sequence[str], seed: int, by: Sequence[str] = ()) -> DataFrame:
    """Items with `digest` and `place` from 1 by it, within `by` if given."""
    rows = items.withColumn("digest", seeded_rank(seed, *key))
    return digest_position(rows, "digest", key, by)


def split_by_seed(units: DataFrame, fraction: float, seed: int, key: str = "unit") -> DataFrame:
    """R2: `side` is held_out for the lowest `floor(n * fraction)` ranks, else training; an empty side is refused."""
    n = units.count()
    held = int(n * fraction)
    if not 0 < held < n:
        raise ValueError("a side of the split would be empty")
    return ranked(units, [key], seed).withColumn("side", F.when(F.col("place") <= held, "held_out").otherwise("training")).select(*units.columns, "side")


def share(units: DataFrame, fraction: float, seed: int, key: str = "unit") -> DataFrame:
    """A nested share of whole units, rounded up."""
    n = units.count()
    return ranked(units, [key], seed).where(F.col("place") <= F.ceil(F.lit(n * fraction))).select(*units.columns)


def sample_per_group(items: DataFrame, group: Sequence[str], key: Sequence[str], n: int, seed: int) -> DataFrame:
    """N items of each group by seeded rank."""
    return ranked(items, key, seed, by=group).where(F.col("place") <= n).select(*items.columns)


def outcome_folds(sample: DataFrame, outcome: str, key: Sequence[str], k: int, seed: int) -> DataFrame:
    """Items dealt round robin to k folds, the second outcome continuing where the first ends."""
    rows = ranked(sample, key, seed, by=[outcome])
    sizes = {r[0]: r[1] for r in sample.groupBy(outcome).count().collect()}  # two outcomes
    starts, at = [], 0
    for o in sorted(sizes):
        starts += [F.lit(o), F.lit(at)]
        at += sizes[o]
    offset = F.element_at(F.create_map(*starts), F.col(outcome)) if starts else F.lit(0)
    return rows.withColumn("fold", F.pmod(F.col("place") - 1 + offset, F.lit(k))).select(*sample.columns, "fold")


def draw_class_proportional(pool: DataFrame, outcome: str, key: Sequence[str], n: int, seed: int) -> DataFrame:
    """N items such that every prefix holds each of two outcomes within one of its share.

    The j-th positive comes at the first step t with `positives * t / all + 1/2 >= j`; negatives fill the other steps.
    """
    sizes = {int(r[0]): r[1] for r in pool.groupBy(outcome).count().collect()}
    ones, total = sizes.get(1, 0), sum(sizes.values())
    if not 0 < ones < total:
        raise ValueError("one outcome only")
    rows = ranked(pool, key, seed, by=[outcome])
    want = int(positives_among(ones, total, n))
    return rows.where(F.when(F.col(outcome) == 1, F.col("place") <= want).otherwise(F.col("place") <= n - want)).select(*pool.columns)


def positives_among(ones: int, total: int, t: int) -> int:
    """How many of the first t items are positive."""
    return (2 * ones * t + total) // (2 * total)


def draw_events(windows: DataFrame, event: str, k: int, seed: int) -> DataFrame:
    """All windows of k whole events, nested in k."""
    events = windows.where(F.col(event) > 0).select(event).distinct()
    return windows.join(ranked(events, [event], seed).where(F.col("place") <= k).select(event), event, "left_semi")


def mixture(parts: Sequence[tuple[DataFrame, float, int]], seed: int, key: str = "unit") -> DataFrame:
    """Corpora read together, of each a share of units and so many passes, with the pass's number."""
    out = None
    for df, fraction, passes in parts:
        chosen = share(df.select(key).distinct(), fraction, seed, key)
        rows = df.join(chosen, key, "left_semi").withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(passes - 1))))
        out = rows if out is None else out.unionByName(rows)
    return out


def first_window(windows: DataFrame) -> DataFrame:
    """The earliest window of each unit."""
    return windows.groupBy("unit").agg(F.min(F.struct("win_end", "position")).alias("w")).select("unit", "w.position", "w.win_end")


def inner_holdout(units: DataFrame, one_in: int, seed: int) -> DataFrame:
    """`units` with `held_out`: one in `one_in` of them, rounded up, by seeded rank; two at least must be there."""
    if one_in < 2:
        raise ValueError("one_in must be at least two")
    ranked = digest_position(units.withColumn("_d", seeded_rank(seed, F.lit("inner-holdout"), "unit")), "_d", ["unit"], to="_place").drop("_d")
    n = units.count()
    if -(-n // one_in) >= n:
        raise ValueError(f"{n} units leave none to learn from when one in {one_in} is held out")
    return ranked.withColumn("held_out", F.col("_place") <= -(-n // one_in)).drop("_place")
