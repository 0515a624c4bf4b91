"""Random dilated convolutions of windows on a regular grid, and linear models on them.

The features are those of Dempster, Schmidt and Webb, "MiniRocket: A Very Fast (Almost) Deterministic Transform for Time
Series Classification" (KDD 2021), in their form for several channels.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .draws import ranked
from .ridges import loo_ridge, ridge_answer
from .windows import WIN, step_of

GOLDEN = (1 + 5**0.5) / 2


def kernel_weights() -> np.ndarray:
    """The 84 kernels of nine taps, three of them 2 and the others -1."""
    w = -np.ones((84, 9))
    for row, heavy in zip(w, combinations(range(9), 3), strict=True):
        row[list(heavy)] = 2
    return w


@dataclass(frozen=True)
class Convolutions:
    """Fitted features: for each dilation its kernels' channels (84 x channels, 0 or 1) and biases (84 x features)."""

    dilations: list[int]
    members: list[np.ndarray]
    biases: list[np.ndarray]


def convolved(series: np.ndarray, members: np.ndarray, dilation: int) -> np.ndarray:
    """`(n, 84, steps)`: every kernel over the sum of its channels, 0 beyond the ends, of series `(n, channels, steps)`."""
    steps = series.shape[2]
    mixed = np.pad(np.einsum("kc,ncs->nks", members, series), ((0, 0), (0, 0), (4 * dilation, 4 * dilation)))
    out = np.zeros((len(series), 84, steps))
    for tap, weight in enumerate(kernel_weights().T):
        out += weight[:, None] * mixed[:, :, tap * dilation : tap * dilation + steps]
    return out


def fit_convolutions(examples: np.ndarray, features: int, seed: int) -> Convolutions:
    """Dilations spread exponentially up to the series, channels drawn for each kernel, biases at quantiles of one
    example's convolution each, taken by the golden ratio."""
    n, channels, steps = examples.shape
    if steps < 9 or features < 84 or not n:
        raise ValueError("convolutions need an example of 9 steps and 84 features")
    each = features // 84
    most = min(each, 32)
    spread, counts = np.unique(np.floor(2.0 ** np.linspace(0, np.log2((steps - 1) / 8), most)).astype(int), return_counts=True)
    per = counts * each // most
    per[: each - per.sum()] += 1
    rng, done, members, biases = np.random.default_rng(seed), 0, [], []
    for dilation, k in zip(spread.tolist(), per.tolist(), strict=True):
        sizes = np.floor(2 ** rng.uniform(0, np.log2(min(channels, 9) + 1), 84)).astype(int)
        m = np.zeros((84, channels))
        for row, size in zip(m, sizes, strict=True):
            row[rng.choice(channels, size, replace=False)] = 1
        levels = ((done + np.arange(1, 84 * k + 1)) * GOLDEN % 1).reshape(84, k)
        done += 84 * k
        picked = rng.integers(n, size=84)
        b = np.empty((84, k))
        for one in np.unique(picked):
            conv = convolved(examples[one : one + 1], m, dilation)[0]
            for kernel in np.flatnonzero(picked == one):
                b[kernel] = np.quantile(conv[kernel], levels[kernel])
        members.append(m)
        biases.append(b)
    return Convolutions(spread.tolist(), members, biases)


def shares_above(series: np.ndarray, fit: Convolutions) -> np.ndarray:
    """`(n, features)`: the share of positions above each bias; every other kernel counts only where it lies inside."""
    out, steps = [], series.shape[2]
    for at, (dilation, m, b) in enumerate(zip(fit.dilations, fit.members, fit.biases, strict=True)):
        conv = convolved(series, m, dilation)
        for kernel in range(84):
            edge = 0 if (at + kernel) % 2 == 0 else 4 * dilation
            out.append((conv[:, kernel, edge : steps - edge, None] > b[kernel]).mean(axis=1))
    return np.concatenate(out, axis=1)


def window_series(grid: DataFrame, channels: Sequence[str], steps: int) -> DataFrame:
    """`(unit, position, series)`: a window's grid as one array, channel after channel, 0 for channels it lacks."""
    each = grid.where(F.col("channel").isin(*channels)).groupBy(*WIN, "channel").agg(F.transform(F.sort_array(F.collect_list(F.struct("step", "value"))), lambda s: s["value"]).alias("v"))
    held = each.groupBy(*WIN).agg(F.map_from_entries(F.collect_list(F.struct("channel", "v"))).alias("m"))
    empty = F.array_repeat(F.lit(0.0), steps)
    return held.select(*WIN, F.flatten(F.array(*[F.coalesce(F.try_element_at("m", F.lit(c)), empty) for c in channels])).alias("series"))


def token_series(tokens: DataFrame, channels: Sequence[str], steps: int) -> DataFrame:
    """`window_series(regular_grid(tokens))` from a window's tokens in one group: of each step the latest reading, carried
    on, 0 before the first and for channels that the window lacks; a window without any of the channels has no row."""
    latest = F.max(F.struct("time", "value"))["value"]
    read = tokens.where(F.col("channel").isin(*channels)).withColumn("step", step_of("time", steps)).groupBy(*WIN, "channel", "step").agg(latest.alias("v"))
    held = read.groupBy(*WIN).agg(F.map_from_entries(F.collect_list(F.struct(F.struct("channel", "step"), "v"))).alias("m"))
    at = lambda c, k: F.try_element_at("m", F.struct(F.lit(c).alias("channel"), F.lit(k).alias("step")))
    own = [F.coalesce(*[at(c, k) for k in range(step, -1, -1)], F.lit(0.0)) for c in channels for step in range(steps)]
    return held.select(*WIN, F.array(*own).alias("series"))


def convolution_features(rows: DataFrame, fitting: DataFrame, channels: int, steps: int, features: int, seed: int, examples: int = 256) -> DataFrame:
    """`(unit, position, features)` of `window_series`, beside what other columns it has. Biases come from at most `examples` fitting windows by seeded
    rank, all that the driver sees; every window is transformed in its task."""
    drawn = ranked(fitting.select(*WIN, "series"), list(WIN), seed).where(F.col("place") <= examples).orderBy("place").select("series").collect()
    fit = fit_convolutions(np.array([r["series"] for r in drawn]).reshape(-1, channels, steps), features, seed)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 64):
                part = b.iloc[at : at + 64]
                told = shares_above(np.stack(part["series"].to_numpy()).reshape(-1, channels, steps), fit)
                yield pd.DataFrame({**{c: part[c].to_numpy() for c in told_}, "features": list(told)})

    told_ = [c for c in rows.columns if c != "series"]
    schema = ", ".join(f"`{c}` {k}" for c, k in rows.dtypes if c != "series")
    return rows.select(*told_, "series").mapInPandas(run, f"{schema}, features array<double>")


def convolution_ridge(train: DataFrame, scored: DataFrame, target: str, outcome: bool, penalties: Sequence[float], fold: str = "fold") -> DataFrame:
    """`scored` with `predicted` by a ridge on `features` whose penalty has the least leave-one-out error, or by L2
    logistic regression where the target is an outcome of 0 and 1, whose penalty is the one whose fit on each fold
    answers the other best."""
    if not outcome:
        return ridge_answer(loo_ridge(train, "features", target, penalties), scored, "features")
    ready = lambda df: df.withColumn("_x", array_to_vector("features"))
    rows = ready(train).withColumn("_y", F.col(target).cast("double")).select("_x", "_y", fold).persist()
    model = lambda df, penalty: LogisticRegression(featuresCol="_x", labelCol="_y", regParam=penalty, elasticNetParam=0.0).fit(df)
    answers = lambda m, df: m.transform(df).withColumn("predicted", vector_to_array("probability")[1])

    def missed(penalty: float) -> float:
        lost = 0.0
        for held in (0, 1):
            told = answers(model(rows.where(F.col(fold) != held), penalty), rows.where(F.col(fold) == held))
            p = F.least(F.greatest(F.col("predicted"), F.lit(1e-9)), F.lit(1 - 1e-9))
            lost += told.agg(F.sum(-(F.col("_y") * F.ln(p) + (1 - F.col("_y")) * F.ln(1 - p)))).first()[0] or 0.0
        return lost

    best = min(penalties, key=missed)
    out = answers(model(rows, best), ready(scored)).select(*scored.columns, "predicted")
    rows.unpersist()
    return out
