"""Learners on features: ridges from additive sums, boosted trees, and the cell that draws, fits and scores."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .draws import ranked
from .trees import Trees, fit_trees, score_trees


HELD = 64  # squares in a task


def moment_sums(rows: DataFrame, keys: Sequence[str], x: Sequence[str], y: str | Sequence[str], fold: str = "fold") -> DataFrame:
    """`(keys, fold, sums)`: the additive sums of products of (1, x, y, or several y), a flattened square for each key and fold.

    A task's batches are summed in arrays before anything is shuffled; only squares of the features' number are. A task
    holds the squares of at most `HELD` keys and folds before it tells them.
    Rows with a gap take no part.
    """
    columns, keyed = [*x, *([y] if isinstance(y, str) else y)], [*keys, fold]
    kinds = dict(rows.dtypes)
    schema = ", ".join([*[f"{k} {kinds[k]}" for k in keyed], "pos int, s double"])

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, np.ndarray] = {}

        def told() -> Iterator[pd.DataFrame]:
            for key, s in held.items():
                yield pd.DataFrame({**dict(zip(keyed, key, strict=True)), "pos": np.arange(s.size, dtype=np.int32), "s": s.ravel()})
            held.clear()

        for b in batches:
            for key, part in b.groupby(keyed, sort=False):
                z = np.column_stack([np.ones(len(part)), part[columns].to_numpy(float)])
                held[key] = held.get(key, 0.0) + z.T @ z
                if len(held) > HELD:
                    yield from told()
        yield from told()

    own = rows.select(*keyed, *[F.col(c).cast("double").alias(c) for c in columns]).dropna()
    summed = own.mapInPandas(partial, schema).groupBy(*keyed, "pos").agg(F.sum("s").alias("s"))
    return summed.groupBy(*keyed).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "s"))), lambda v: v["s"]).alias("sums"))


def ridge(rows: DataFrame, keys: Sequence[str], x: Sequence[str], y: str, penalties: Sequence[float], fold: str = "fold") -> DataFrame:
    """A ridge for each key, `(keys, penalty, intercept, coefficients, n)`, its penalty by cross-fit between two folds.

    Features are centred and the penalty is a share of the rows times each one's variance, so units don't matter. The
    error of a fold under the other's line follows from the sums alone, so the rows are read once. A key with under two
    rows a feature answers with its mean. `fold` is 0 or 1; keys, a square each, are solved apart from each other.
    """
    d = len(x) + 1
    kinds = dict(rows.dtypes)
    schema = ", ".join([*[f"{k} {kinds[k]}" for k in keys], "penalty double, intercept double, coefficients array<double>, n long"])

    def solved(m: np.ndarray, penalty: float) -> np.ndarray:
        n = m[0, 0]
        mean = m[0, 1:d] / n
        gram = m[1:d, 1:d] - n * np.outer(mean, mean)
        cross = m[1:d, d] - mean * m[0, d]
        scale = np.where(np.diag(gram) > 1e-12, np.diag(gram), 1.0)
        w = np.linalg.solve(gram + np.diag(penalty * scale) + np.diag(np.where(np.diag(gram) > 1e-12, 0.0, 1.0)), cross) if np.isfinite(penalty) else np.zeros(d - 1)
        return np.concatenate([[m[0, d] / n - mean @ w], w])

    def error(m: np.ndarray, line: np.ndarray) -> float:
        return float(m[d, d] - 2 * line @ m[:d, d] + line @ m[:d, :d] @ line)

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        halves = [np.array(s).reshape(d + 1, d + 1) for s in part["sums"]]
        whole = sum(halves)
        best = float("inf")
        if len(halves) == 2 and min(h[0, 0] for h in halves) >= 2 * len(x):
            tried = [(error(halves[1], solved(halves[0], p)) + error(halves[0], solved(halves[1], p)), -p) for p in penalties]
            best = -min(tried)[1]
        line = solved(whole, best)
        return pd.DataFrame({**{k: [part[k].iloc[0]] for k in keys}, "penalty": [best], "intercept": [line[0]], "coefficients": [list(line[1:])], "n": [int(whole[0, 0])]})

    return moment_sums(rows, keys, x, y, fold).groupBy(*keys).applyInPandas(fit, schema)


def ridge_answers(rows: DataFrame, fits: DataFrame, keys: Sequence[str], x: Sequence[str], to: str = "predicted") -> DataFrame:
    """Each row's answer by its key's ridge; a gap in a feature or a key without a fit gives null. Fits are a row per key."""
    held = rows.join(F.broadcast(fits.select(*keys, "intercept", "coefficients")), list(keys), "left")
    out = F.col("intercept")
    for i, c in enumerate(x):
        out = out + F.get("coefficients", F.lit(i)) * F.col(c)
    return held.withColumn(to, out).drop("intercept", "coefficients")


def boosted_trees(train: DataFrame, columns: Sequence[str], target: str, outcome: bool, rounds: int = 100, depth: int = 3) -> Trees:
    """Boosted trees, with both classes of the same weight for outcomes of 0 and 1, else a regressor. Gaps need no marks."""
    if not outcome:
        return fit_trees(train, columns, target, False, rounds=rounds, depth=depth)
    ones, n = train.where(F.col(target).isNotNull()).agg(F.coalesce(F.sum(F.col(target).cast("double")), F.lit(0.0)), F.count(F.lit(1))).first()
    if not 0 < ones < n:
        raise ValueError("one outcome only")
    weight = F.when(F.col(target) == 1, n / (2.0 * ones)).otherwise(n / (2.0 * (n - ones)))
    return fit_trees(train.withColumn("_w", weight), columns, target, True, "_w", rounds, depth)


def score_windows(model: Trees, rows: DataFrame) -> DataFrame:
    """A model's answers for feature rows: the probability of 1 for outcomes, else the value. Columns it lacks count as gaps."""
    return score_trees(model, rows)


def fit_and_score(rows: DataFrame, side: str, columns: Sequence[str], target: str, key: Sequence[str], budget: int, outcome: bool, seed: int = 42) -> DataFrame:
    """Draw `budget` training rows by seeded rank, fit trees on them, and score the held-out rows."""
    pool = rows.where(F.col(side) == "training")
    drawn = ranked(pool, key, seed).where(F.col("place") <= budget).drop("digest", "place")
    return score_windows(boosted_trees(drawn, columns, target, outcome), rows.where(F.col(side) != "training"))


def stacked_rows(sources: Mapping[str, tuple[DataFrame, float]], key: Sequence[str], target: str, budget: int, seed: int) -> DataFrame:
    """Labelled rows of several corpora to fit one model on: `budget` of each by seeded rank, targets over the scale
    of their own scheme, with `corpus`."""
    out = None
    for name in sorted(sources):
        df, scale = sources[name]
        drawn = ranked(df, key, seed).where(F.col("place") <= budget).select(*df.columns)
        rows = drawn.withColumns({target: F.col(target) / scale, "corpus": F.lit(name)})
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def cross_corpus_fit(sources: Mapping[str, tuple[DataFrame, float]], key: Sequence[str], columns: Mapping[str, Sequence[str]], side: str, target: str, budget: int, seed: int = 42, rounds: int = 100) -> DataFrame:
    """One model over the labelled rows of several corpora, `(corpus, key, target, predicted)` of their held-out rows.

    `columns` names each corpus's features; the model has all of them, and those that a corpus lacks are gaps, which the
    trees send their own way. Of each corpus `budget` training rows are drawn; targets are fitted over the scale of
    their corpus and answers multiplied by it again. Corpora without training rows are answered too.
    """
    every = sorted({c for names in columns.values() for c in names})
    taken = {n: (df.where(F.col(side) == "training").select(*key, *columns[n], F.col(target).cast("double").alias(target)), scale) for n, (df, scale) in sources.items()}
    model = boosted_trees(stacked_rows(taken, key, target, budget, seed), every, target, False, rounds)
    out = None
    for name in sorted(sources):
        df, scale = sources[name]
        held = df.where(F.col(side) != "training").select(*key, *columns[name], target)
        told = score_windows(model, held).select(F.lit(name).alias("corpus"), *key, target, (F.col("predicted") * scale).alias("predicted"))
        out = told if out is None else out.unionByName(told)
    return out
