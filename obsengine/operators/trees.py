"""Boosted trees that send gaps their own way: features in quantile bins, a level at a time from summed histograms.

A level needs, for each open node, feature and bin, the sums of gradients and curvatures of the rows there. They add up
over tasks, so rows stay where they are and what is gathered has the size tasks x nodes x features x bins. Gaps have a bin of
their own, which each split sends to the side where it helps more. Few rows, as drawn labels are, are fitted in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import kept

MOST_TASKS, ROWS_A_BLOCK = 64, 20_000
GAP = 0  # the bin of missing values; values are in bins from 1
LEAST_GAIN = 1e-9


@dataclass(frozen=True)
class Trees:
    """Complete trees of one depth: node i has the children 2i + 1 and 2i + 2; a node without a split sends all left."""

    columns: tuple[str, ...]
    cuts: tuple[np.ndarray, ...]  # of each feature, ascending; bin b holds values in (cuts[b - 2], cuts[b - 1]]
    feature: np.ndarray  # trees x inner nodes, -1 without a split
    bin: np.ndarray  # the last bin that goes left
    gap_left: np.ndarray
    value: np.ndarray  # trees x leaves, with the learning rate
    base: float
    outcome: bool

    @property
    def depth(self) -> int:
        return int(np.log2(self.value.shape[1]))

    def binned(self, x: np.ndarray) -> np.ndarray:
        return binned(x, self.cuts)

    def raw(self, bins: np.ndarray) -> np.ndarray:
        """What the trees add up to: log-odds of an outcome, else the value."""
        out = np.full(len(bins), self.base)
        row = np.arange(len(bins))
        for t in range(len(self.value)):
            out += self.value[t][leaf_of(bins, row, self.feature[t], self.bin[t], self.gap_left[t], self.depth)]
        return out


def binned(x: np.ndarray, cuts: Sequence[np.ndarray]) -> np.ndarray:
    """Values as bins of their features; NaN is the gap."""
    out = np.empty(x.shape, np.int32)
    for j, c in enumerate(cuts):
        out[:, j] = np.where(np.isnan(x[:, j]), GAP, np.searchsorted(c, x[:, j], "left") + 1)
    return out


def leaf_of(bins: np.ndarray, row: np.ndarray, feature: np.ndarray, last: np.ndarray, gap_left: np.ndarray, depth: int) -> np.ndarray:
    """Where rows arrive after `depth` levels of one tree, counted from the level's left."""
    node = np.zeros(len(row), np.int64)
    for _ in range(depth):
        f = feature[node]
        at = bins[row, np.maximum(f, 0)]
        left = (f < 0) | np.where(at == GAP, gap_left[node], at <= last[node])
        node = 2 * node + 1 + ~left
    return node - (2**depth - 1)


def histogram(bins: np.ndarray, node: np.ndarray, g: np.ndarray, h: np.ndarray, nodes: int, wide: int) -> np.ndarray:
    """Sums `(nodes, features, wide, 2)` of gradients and curvatures."""
    n_features = bins.shape[1]
    at = (node[:, None] * n_features + np.arange(n_features)) * wide + bins
    size = nodes * n_features * wide
    sums = [np.bincount(at.ravel(), np.repeat(v, n_features), size) for v in (g, h)]
    return np.stack(sums, axis=-1).reshape(nodes, n_features, wide, 2)


def best_splits(sums: np.ndarray, l2: float, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each node the feature (-1: none), the last bin to the left and whether gaps go left, by the gain in loss.

    Ties go to the first feature, then the lowest bin, then gaps to the left. A side needs a curvature of `least`.
    """
    total = sums[:, :1].sum(axis=2, keepdims=True)  # the same for every feature
    part = np.cumsum(sums[:, :, 1:-1], axis=2)
    gap = sums[:, :, :1]
    gain = lambda s: s[..., 0] ** 2 / (s[..., 1] + l2)
    found = []
    for left in (part + gap, part):
        right = total - left
        ok = (left[..., 1] >= least) & (right[..., 1] >= least)
        found.append(np.where(ok, gain(left) + gain(right) - gain(total), -np.inf))
    both = np.stack(found, axis=-1).reshape(len(sums), -1)
    best = both.argmax(axis=1) if both.shape[1] else np.zeros(len(sums), np.int64)
    top = both[np.arange(len(sums)), best] if both.shape[1] else np.full(len(sums), -np.inf)
    cuts = part.shape[2]
    feature = np.where(top > LEAST_GAIN, best // (2 * max(cuts, 1)), -1)
    return feature, best // 2 % max(cuts, 1) + 1, best % 2 == 0


def gradients(raw: np.ndarray, y: np.ndarray, w: np.ndarray, outcome: bool) -> tuple[np.ndarray, np.ndarray]:
    if not outcome:
        return w * (raw - y), w
    p = 1 / (1 + np.exp(-raw))
    return w * (p - y), w * np.maximum(p * (1 - p), 1e-16)


def boost(sums_at: Callable[[Trees, list, int, int], np.ndarray], start: Trees, rounds: int, depth: int, rate: float, l2: float, least: float) -> Trees:
    """Grow trees from `sums_at(trees so far, splits of the open tree, level, nodes)`, the histograms of a level."""
    inner = 2**depth - 1
    feature, last, gap_left, value = (np.zeros((0, k), t) for k, t in ((inner, np.int64), (inner, np.int64), (inner, bool), (2**depth, float)))
    for _ in range(rounds):
        so_far = Trees(start.columns, start.cuts, feature, last, gap_left, value, start.base, start.outcome)
        own = [np.full(inner, -1, np.int64), np.zeros(inner, np.int64), np.ones(inner, bool)]
        for level in range(depth):
            nodes = 2**level
            found = best_splits(sums_at(so_far, own, level, nodes), l2, least)
            for to, x in zip(own, found, strict=True):
                to[nodes - 1 : 2 * nodes - 1] = x
        leaves = sums_at(so_far, own, depth, 2**depth)[:, 0].sum(axis=1)
        new = -rate * leaves[:, 0] / (leaves[:, 1] + l2)
        feature, last, gap_left = (np.vstack([a, b]) for a, b in zip((feature, last, gap_left), own, strict=True))
        value = np.vstack([value, np.where(leaves[:, 1] > 0, new, 0.0)])
    return Trees(start.columns, start.cuts, feature, last, gap_left, value, start.base, start.outcome)


def fit_here(x: np.ndarray, y: np.ndarray, w: np.ndarray, start: Trees, rounds: int, depth: int, rate: float, l2: float, least: float) -> Trees:
    """The trees of rows that are all at hand."""
    return fit_bins(start.binned(x), y, w, start, rounds, depth, rate, l2, least)


def fit_bins(bins: np.ndarray, y: np.ndarray, w: np.ndarray, start: Trees, rounds: int, depth: int, rate: float, l2: float, least: float) -> Trees:
    """The trees of binned rows that are all at hand."""
    row, wide = np.arange(len(bins)), max(map(len, start.cuts), default=0) + 2
    raw, seen = np.full(len(bins), start.base), 0

    def sums_at(so_far: Trees, own: list, level: int, nodes: int) -> np.ndarray:
        nonlocal raw, seen
        while seen < len(so_far.value):
            raw = raw + so_far.value[seen][leaf_of(bins, row, so_far.feature[seen], so_far.bin[seen], so_far.gap_left[seen], depth)]
            seen += 1
        return histogram(bins, leaf_of(bins, row, *own, level), *gradients(raw, y, w, start.outcome), nodes, wide)

    return boost(sums_at, start, rounds, depth, rate, l2, least)


def fit_trees(train: DataFrame, columns: Sequence[str], target: str, outcome: bool, weight: str | None = None, rounds: int = 100, depth: int = 3, rate: float = 0.1, l2: float = 1.0, least: float = 1.0, bins: int = 64, at_hand: int = 20_000) -> Trees:
    """Boosted trees on columns with gaps, a target of 0 and 1 (`outcome`) or a number; rows without a target take no part.

    Cuts are quantiles of the training rows. Outcomes start from even odds, numbers from their weighted mean. Up to
    `at_hand` rows are fitted in one place; beyond, rows of equal bins and target become one, and if more than `at_hand`
    differ, histograms are summed over a few tasks of packed rows, a job without a shuffle for each level.
    """
    own = train.select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)], F.col(target).cast("double").alias("y"), (F.lit(1.0) if weight is None else F.col(weight).cast("double")).alias("w")).where("y IS NOT NULL AND w > 0")
    xs = [f"x{i}" for i in range(len(columns))]
    shares = [i / bins for i in range(1, bins)]
    told = own.agg(F.count(F.lit(1)).alias("n"), (F.sum(F.col("y") * F.col("w")) / F.sum("w")).alias("mean"), F.min("y").alias("least"), F.max("y").alias("most"), *[F.percentile_approx(F.nanvl(c, F.lit(None)), F.array(*map(F.lit, shares)), F.lit(10_000)).alias(c) for c in xs]).first()
    if not told["n"]:
        raise ValueError("no labelled row")
    if outcome and told["least"] == told["most"]:
        raise ValueError("one outcome only")
    start = Trees(tuple(columns), tuple(np.unique(np.array(told[c] or [], float)) for c in xs), *[np.zeros((0, 0))] * 4, 0.0 if outcome else told["mean"], outcome)
    wide = max(map(len, start.cuts), default=0) + 2
    if told["n"] <= at_hand:
        rows = own.toPandas()  # a bounded number of labelled rows
        return fit_here(rows[xs].to_numpy(float), rows["y"].to_numpy(), rows["w"].to_numpy(), start, rounds, depth, rate, l2, least)
    held = _equal_rows(own, xs, start)
    n = held.count()
    if n <= at_hand:
        rows = held.toPandas()  # a bounded number of rows that differ
        bins, y, w = np.frombuffer(b"".join(rows["bins"]), np.uint16).reshape(n, -1).astype(np.int32), rows["y"].to_numpy(), rows["w"].to_numpy()
        return fit_bins(bins, y, w, start, rounds, depth, rate, l2, least)
    tasks = max(1, min(own.sparkSession.sparkContext.defaultParallelism, MOST_TASKS, -(-n // ROWS_A_BLOCK)))
    blocks = kept(held.repartition(tasks).mapInPandas(_packed, "bins binary, y binary, w binary"))

    def sums_at(so_far: Trees, splits: list, level: int, nodes: int) -> np.ndarray:
        def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros((nodes, len(xs), wide, 2))
            for b in batches:
                for bins, y, w in zip(b["bins"], b["y"], b["w"], strict=True):
                    y, w = np.frombuffer(y), np.frombuffer(w)
                    bins = np.frombuffer(bins, np.uint16).reshape(len(y), -1).astype(np.int32)
                    node = leaf_of(bins, np.arange(len(y)), *splits, level)
                    total += histogram(bins, node, *gradients(so_far.raw(bins), y, w, outcome), nodes, wide)
            yield pd.DataFrame({"sums": [total.tobytes()]})

        got = blocks.mapInPandas(part, "sums binary").collect()  # one row of each of few tasks
        return sum(np.frombuffer(r["sums"]) for r in got).reshape(nodes, len(xs), wide, 2)

    try:
        return boost(sums_at, start, rounds, depth, rate, l2, least)
    finally:
        blocks.unpersist()
        held.unpersist()


def _equal_rows(own: DataFrame, xs: Sequence[str], start: Trees) -> DataFrame:
    """`(bins, y, w)`: rows of equal bins and target are one with their weights added up, as sums of gradients can't tell them apart."""

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            bins = start.binned(b[xs].to_numpy(float)).astype(np.uint16)
            yield pd.DataFrame({"bins": [row.tobytes() for row in bins], "y": b["y"], "w": b["w"]})

    return own.mapInPandas(part, "bins binary, y double, w double").groupBy("bins", "y").agg(F.sum("w").alias("w")).persist()


def _packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A batch of `(bins, y, w)` as one row."""
    for b in batches:
        if len(b):
            yield pd.DataFrame({"bins": [b"".join(b["bins"])], "y": [b["y"].to_numpy(float).tobytes()], "w": [b["w"].to_numpy(float).tobytes()]})


def score_trees(model: Trees, rows: DataFrame, to: str = "predicted", raw: bool = False) -> DataFrame:
    """`rows` with the trees' answer: the probability of 1 for outcomes, with `raw` its log-odds, else the value.

    Columns that `rows` lacks count as gaps.
    """
    there = [F.col(c).cast("double") if c in rows.columns else F.lit(None).cast("double") for c in model.columns]

    @F.pandas_udf("double")
    def answer(*columns: pd.Series) -> pd.Series:
        x = np.column_stack([c.to_numpy(float) for c in columns])
        out = model.raw(model.binned(x))
        return pd.Series(1 / (1 + np.exp(-out)) if model.outcome and not raw else out)

    return rows.withColumn(to, answer(*there))


def taught_trees(fitting: DataFrame, columns: Sequence[str], event: str = "event", rounds: int = 100, depth: int = 3, rate: float = 0.1, at_hand: int = 20_000) -> Trees:
    """Trees that tell the windows of taught events (`event` not null) from the rest; `score_trees(raw=True)` scores by log-odds.

    Every event weighs as much as every other, spread over its windows, and all together as much as the rest.
    """
    sizes = fitting.where(F.col(event).isNotNull()).groupBy(F.col(event).alias("_of")).agg(F.count(F.lit(1)).alias("_windows"))
    told = fitting.agg(F.countDistinct(event).alias("events"), F.count_if(F.col(event).isNull()).alias("rest")).first()
    events, rest = told["events"], told["rest"]
    if not events or not rest:
        raise ValueError("a detector taught events needs events and windows outside them")
    rows = fitting.join(sizes, F.col(event) == F.col("_of"), "left")
    rows = rows.withColumns({"_taught": F.col(event).isNotNull().cast("int"), "_w": F.when(F.col(event).isNull(), 1.0).otherwise(rest / events / F.col("_windows"))})
    return fit_trees(rows, columns, "_taught", True, "_w", rounds, depth, rate, at_hand=at_hand)
