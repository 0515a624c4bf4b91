"""Ridges from additive sums: leave-one-out penalties from one factorisation, and several targets at once."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .learners import moment_sums

FLAT = 1e-12  # a feature with less than this sum of squares is constant


@dataclass(frozen=True)
class Ridge:
    """A line on features over their spread, the penalty that it was solved with, and each tried penalty's error."""

    penalty: float
    intercept: float
    coefficients: np.ndarray
    errors: dict[float, float]  # mean squared error of each row by the line without it


def _sums(rows: DataFrame, d: int) -> np.ndarray:
    """The additive products of (1, x, y), added up in each task before a row of the square is shuffled."""

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((d + 2, d + 2))
        for b in batches:
            if len(b):
                z = np.column_stack([np.ones(len(b)), np.stack(b["x"].to_numpy()), b["y"].to_numpy(float)])
                total += z.T @ z
        yield pd.DataFrame({"row": np.arange(d + 2, dtype=np.int32), "s": list(total)})

    added = rows.mapInPandas(part, "row int, s array<double>").select("row", F.posexplode("s").alias("at", "s")).groupBy("row", "at").agg(F.sum("s").alias("s"))
    out = np.zeros((d + 2, d + 2))
    got = added.toPandas()  # a square of the features' number
    out[got["row"], got["at"]] = got["s"]
    return out


def loo_ridge(train: DataFrame, features: str, target: str, penalties: Sequence[float]) -> Ridge:
    """A ridge on an array of features, its penalty that of the least leave-one-out error; rows without a target take no part.

    Features are centred and divided by their deviation; the intercept has no penalty. The first pass sums products;
    their eigenvectors give the hat diagonal of every penalty, so a second pass has all the errors of leaving a row out
    without another fit. Ties go to the larger penalty.
    """
    if not penalties or min(penalties) <= 0 or not np.isfinite(max(penalties)):
        raise ValueError("penalties are positive and finite")
    rows = train.select(F.col(features).alias("x"), F.col(target).cast("double").alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    first = rows.select(F.size("x")).first()
    if first is None:
        raise ValueError("no labelled row")
    d = first[0]
    m = _sums(rows, d)
    n = m[0, 0]
    mean, level = m[0, 1 : d + 1] / n, m[0, d + 1] / n
    gram = m[1 : d + 1, 1 : d + 1] - n * np.outer(mean, mean)
    cross = m[1 : d + 1, d + 1] - n * mean * level
    spread = np.sqrt(np.maximum(np.diag(gram), 0) / n)
    scale = np.where(spread > FLAT, 1 / np.where(spread > FLAT, spread, 1), 0.0)
    values, vectors = np.linalg.eigh(gram * np.outer(scale, scale))
    values = np.maximum(values, 0.0)
    turned = scale[:, None] * vectors
    target_ = turned.T @ cross
    strengths = np.array(sorted(set(map(float, penalties))))
    inverse = 1 / (values[:, None] + strengths)

    def missed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(len(strengths))
        for b in batches:
            if len(b):
                p = (np.stack(b["x"].to_numpy()) - mean) @ turned
                off = (b["y"].to_numpy(float) - level)[:, None] - p @ (inverse * target_[:, None])
                left = np.maximum(1 - 1 / n - (p**2) @ inverse, 1e-12)
                total += ((off / left) ** 2).sum(axis=0)
        yield pd.DataFrame({"i": np.arange(len(strengths), dtype=np.int32), "e": total})

    got = rows.mapInPandas(missed, "i int, e double").groupBy("i").agg(F.sum("e").alias("e")).toPandas().sort_values("i")
    errors = got["e"].to_numpy() / n
    best = len(errors) - 1 - int(np.argmin(errors[::-1]))
    w = turned @ (inverse[:, best] * target_)
    return Ridge(float(strengths[best]), float(level - mean @ w), w, dict(zip(strengths.tolist(), errors.tolist(), strict=True)))


def ridge_answer(model: Ridge, rows: DataFrame, features: str, to: str = "predicted") -> DataFrame:
    """`rows` with the ridge's answer; null features give null."""

    @F.pandas_udf("double")
    def answer(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if v is None else float(model.intercept + np.asarray(v) @ model.coefficients))

    return rows.withColumn(to, answer(features))


def target_ridges(rows: DataFrame, keys: Sequence[str], x: Sequence[str], ys: Sequence[str], penalties: Sequence[float], fold: str = "fold") -> DataFrame:
    """`(keys, target, penalty, intercept, coefficients, n)`: a ridge for each key and each of several targets.

    The sums of a key and fold are factorised once for every penalty and target. A target's penalty is the one whose
    line on each fold (0 and 1) answers the other best, ties to the larger; the penalty is a share of each feature's sum
    of squares. A key with under two rows a feature in a fold answers with its mean. Rows with a gap take no part.
    """
    d, t = len(x), len(ys)
    kinds = dict(rows.dtypes)
    schema = ", ".join([*[f"{k} {kinds[k]}" for k in keys], "target string, penalty double, intercept double, coefficients array<double>, n long"])
    strengths = sorted(set(map(float, penalties)))

    def lines(m: np.ndarray) -> np.ndarray:
        """`(penalties, 1 + d, targets)`."""
        n = m[0, 0]
        mean, level = m[0, 1 : d + 1] / n, m[0, d + 1 :] / n
        gram = m[1 : d + 1, 1 : d + 1] - n * np.outer(mean, mean)
        cross = m[1 : d + 1, d + 1 :] - n * np.outer(mean, level)
        size = np.diag(gram)
        scale = np.where(size > FLAT, 1 / np.sqrt(np.where(size > FLAT, size, 1)), 0.0)
        values, vectors = np.linalg.eigh(gram * np.outer(scale, scale))
        turned = scale[:, None] * vectors
        inside = turned.T @ cross
        out = np.empty((len(strengths), 1 + d, t))
        for i, p in enumerate(strengths):
            w = turned @ (np.where(values + p > FLAT, 1 / np.maximum(values + p, FLAT), 0.0)[:, None] * inside)
            out[i] = np.vstack([level - mean @ w, w])
        return out

    def missed(m: np.ndarray, line: np.ndarray) -> np.ndarray:
        """Squared errors `(penalties, targets)` of lines on the rows behind the sums."""
        square, cross, own = m[: d + 1, : d + 1], m[: d + 1, d + 1 :], np.diag(m)[d + 1 :]
        return own - 2 * np.einsum("pdt,dt->pt", line, cross) + np.einsum("pdt,de,pet->pt", line, square, line)

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        halves = [np.array(s).reshape(d + t + 1, d + t + 1) for s in part["sums"]]
        whole = sum(halves)
        n = whole[0, 0]
        own = [part[k].iloc[0] for k in keys]
        if len(halves) == 2 and min(h[0, 0] for h in halves) >= 2 * d:
            errors = missed(halves[1], lines(halves[0])) + missed(halves[0], lines(halves[1]))
            best = len(strengths) - 1 - np.argmin(errors[::-1], axis=0)
            line = lines(whole)
            told = [(strengths[b], line[b, 0, j], line[b, 1:, j]) for j, b in enumerate(best)]
        else:
            told = [(float("inf"), whole[0, d + 1 + j] / n, np.zeros(d)) for j in range(t)]
        return pd.DataFrame([(*own, y, p, i, list(c), int(n)) for y, (p, i, c) in zip(ys, told, strict=True)], columns=[*keys, "target", "penalty", "intercept", "coefficients", "n"])

    return moment_sums(rows, keys, x, list(ys), fold).groupBy(*keys).applyInPandas(fit, schema)


def target_answers(rows: DataFrame, fits: DataFrame, keys: Sequence[str], x: Sequence[str], ys: Sequence[str], bounds: DataFrame | None = None) -> DataFrame:
    """`rows` with `predicted_<target>` for each target; a gap in a feature or a key without a fit gives null.

    With `bounds`, the fitted rows, each feature is held to the range that its key was fitted on. Fits and ranges, a row
    for each key, go to every task, which answers a batch of a key's rows at once.
    """
    lines = {(*[r[k] for k in keys], r["target"]): (r["intercept"], r["coefficients"]) for r in fits.collect()}
    sides = {}
    if bounds is not None:
        found = bounds.dropna(subset=list(x)).groupBy(*keys).agg(F.array(*map(F.min, x)).cast("array<double>").alias("_lo"), F.array(*map(F.max, x)).cast("array<double>").alias("_hi"))
        sides = {tuple(r[k] for k in keys): (r["_lo"], r["_hi"]) for r in found.collect()}
    kind = pa.struct([(f"predicted_{y}", pa.float64()) for y in ys])

    @F.arrow_udf(", ".join(f"predicted_{y} double" for y in ys))
    def answer(*columns: pa.Array) -> pa.Array:
        own, value = columns[: len(keys)], [pa.compute.fill_null(c, 0.0).to_numpy(zero_copy_only=False) for c in columns[len(keys) :]]
        whole = np.all([c.is_valid().to_numpy(zero_copy_only=False) for c in columns], axis=0)
        coded = [c.dictionary_encode(null_encoding="encode") for c in own]
        codes, which = np.unique(np.column_stack([c.indices.to_numpy() for c in coded]), axis=0, return_inverse=True)
        names = [c.dictionary.to_pylist() for c in coded]
        out, known = np.zeros((len(ys), len(whole))), np.zeros((len(ys), len(whole)), bool)
        for g, code in enumerate(codes):
            key, at = tuple(n[i] for n, i in zip(names, code, strict=True)), np.flatnonzero((which.ravel() == g) & whole)
            z = [v[at] for v in value]
            if key in sides:
                z = [np.where(np.isnan(v), high, np.minimum(np.maximum(v, low), high)) for v, low, high in zip(z, *sides[key], strict=True)]
            for j, y in enumerate(ys):
                if (*key, y) in lines:
                    s, w = lines[(*key, y)]
                    for v, c in zip(z, w, strict=True):
                        s = s + v * c
                    out[j, at], known[j, at] = s, True
        return pa.StructArray.from_arrays([pa.array(o, mask=~k) for o, k in zip(out, known, strict=True)], fields=list(kind))

    held = rows.withColumn("_told", answer(*keys, *[F.col(c).cast("double") for c in x]))
    return held.select(*rows.columns, *[f"_told.predicted_{y}" for y in ys])
