"""Detectors by shrunk covariance. Only a square of the features' number comes to the driver, never rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .learners import moment_sums


def shrunk_covariance(rows: DataFrame, vector: str, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """F8: mean and Ledoit-Wolf covariance of vectors of `dim` numbers, from sums of second and fourth moments."""
    names = [f"_v{i}" for i in range(dim)]
    wide = rows.select(F.lit(0).alias("_k"), F.lit(0).alias("fold"), *[F.get(vector, F.lit(i)).alias(c) for i, c in enumerate(names)])
    got = moment_sums(wide, ["_k"], names[:-1], names[-1]).first()
    if got is None:
        raise ValueError("no row to fit on")
    m = np.array(got["sums"]).reshape(dim + 1, dim + 1)
    n, mean = m[0, 0], m[0, 1:] / m[0, 0]
    s = m[1:, 1:] / n - np.outer(mean, mean)
    level = np.trace(s) / dim
    away = float(((s - level * np.eye(dim)) ** 2).sum()) / dim
    square = F.aggregate(centred(vector, mean), F.lit(0.0), lambda a, x: a + x * x)
    fourth = rows.agg(F.sum(square * square)).first()[0]
    noise = (fourth / n - float((s**2).sum())) / (n * dim)
    share = min(max(noise, 0.0), away) / away if away > 0 else 0.0
    return mean, (1 - share) * s + share * level * np.eye(dim)


def numbers(values: np.ndarray) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def centred(vector: str, mean: np.ndarray) -> Column:
    return F.zip_with(F.col(vector), numbers(mean), lambda x, m: x - m)


def projected(rows: DataFrame, vector: str, mean: np.ndarray, directions: np.ndarray, to: str) -> DataFrame:
    """`to`: the centred vector along each column of `directions`; the matrix is sent to the tasks once."""
    table = rows.sparkSession.createDataFrame([(directions.T.tolist(),)], "_d array<array<double>>")
    held = rows.withColumn("_c", centred(vector, mean)).crossJoin(F.broadcast(table))
    along = F.transform("_d", lambda d: F.aggregate(F.zip_with(d, F.col("_c"), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x))
    return held.withColumn(to, along).drop("_c", "_d")


def whitened_distance(rows: DataFrame, vector: str, dim: int, fitting: DataFrame | None = None) -> DataFrame:
    """Squared Mahalanobis distance from the fitting rows; directions without variance take no part."""
    mean, cov = shrunk_covariance(rows if fitting is None else fitting, vector, dim)
    values, vectors = np.linalg.eigh(cov)
    held = values > 1e-12 * max(values.max(), 1e-300)
    out = projected(rows, vector, mean, vectors[:, held] / np.sqrt(values[held]), "_z")
    return out.withColumn("distance", F.aggregate("_z", F.lit(0.0), lambda s, x: s + x * x)).drop("_z")


def subspace_distance(rows: DataFrame, vector: str, dim: int, share: float = 0.9, fitting: DataFrame | None = None) -> DataFrame:
    """A10: distance inside the directions that hold `share` of the variance, and what lies outside, each over its fitting median."""
    fit = rows if fitting is None else fitting
    mean, cov = shrunk_covariance(fit, vector, dim)
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(int(np.searchsorted(np.cumsum(values) / values.sum(), share)) + 1, dim)
    sums = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x)

    def parts(df: DataFrame) -> DataFrame:
        out = projected(df, vector, mean, vectors[:, :k], "_y")
        return out.withColumns({"within": sums(F.zip_with("_y", numbers(1 / np.sqrt(np.maximum(values[:k], 1e-300))), lambda a, b: a * b)), "outside": F.greatest(sums(centred(vector, mean)) - sums(F.col("_y")), F.lit(0.0))}).drop("_y")

    mids = parts(fit).agg(F.median("within").alias("_w"), F.median("outside").alias("_o"))
    over = lambda c, m: F.col(c) / F.when(F.col(m) > 0, F.col(m)).otherwise(1.0)
    return parts(rows).crossJoin(F.broadcast(mids)).withColumn("score", over("within", "_w") + over("outside", "_o")).drop("_w", "_o")


def taught_direction(rows: DataFrame, vector: str, dim: int, fitting: DataFrame, event: str = "event") -> DataFrame:
    """Rows with `along`, their whitened coordinate towards the taught events, `distance`, their squared whitened
    distance, and `combined`, the mean of both over the fitting rows' medians and scaled deviations.

    `fitting` holds `event`: 0, or the number of a taught event, each of which weighs one over its rows. Mean, scales
    and shrunk covariance come from the rows outside the events. Events at the fitting mean give no direction.
    """
    outside = fitting.where(F.col(event) == 0)
    facts = outside.select(F.posexplode(vector)).groupBy("pos").agg(F.avg("col").alias("m"), F.stddev_pop("col").alias("s")).orderBy("pos").collect()  # a row per feature
    level, scale = np.array([f["m"] for f in facts]), np.array([f["s"] if f["s"] > 0 else 1.0 for f in facts])
    standard = lambda df: df.withColumn("_s", F.zip_with(centred(vector, level), numbers(scale), lambda x, s: x / s))
    mean, cov = shrunk_covariance(standard(outside), "_s", dim)
    values, vectors = np.linalg.eigh(cov)
    held = values > 1e-12 * max(values.max(), 1e-300)
    root = (vectors[:, held] / np.sqrt(values[held])) @ vectors[:, held].T
    taught = standard(fitting.where(F.col(event) > 0)).select(event, F.posexplode("_s")).groupBy(event, "pos").agg(F.avg("col").alias("m")).groupBy("pos").agg(F.avg("m").alias("m")).orderBy("pos").collect()
    towards = root @ (np.array([t["m"] for t in taught]) - mean) if taught else np.zeros(dim)
    if not np.linalg.norm(towards) > 1e-12:
        raise ValueError("the taught events lie at the fitting mean")
    axis = root @ (towards / np.linalg.norm(towards))

    def parts(df: DataFrame) -> DataFrame:
        out = projected(standard(df), "_s", mean, np.column_stack([root, axis]), "_z")
        return out.withColumns({"along": F.element_at("_z", -1), "distance": F.aggregate(F.slice("_z", 1, dim), F.lit(0.0), lambda s, x: s + x * x)}).drop("_z", "_s")

    own = parts(fitting).select("along", "distance")
    mids = own.agg(F.median("along").alias("_ma"), F.median("distance").alias("_md"))
    off = own.crossJoin(F.broadcast(mids)).groupBy("_ma", "_md").agg((1.4826 * F.median(F.abs(F.col("along") - F.col("_ma")))).alias("_sa"), (1.4826 * F.median(F.abs(F.col("distance") - F.col("_md")))).alias("_sd"))
    over = lambda c, m, s: (F.col(c) - F.col(m)) / F.when(F.col(s) > 0, F.col(s)).otherwise(1.0)
    return parts(rows).crossJoin(F.broadcast(off)).withColumn("combined", (over("along", "_ma", "_sa") + over("distance", "_md", "_sd")) / 2).drop("_ma", "_md", "_sa", "_sd")
