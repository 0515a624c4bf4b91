"""Groups: channels read together, sources matched in a plane, answers of many methods on the same cells."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ordering import kept
from .draws import ranked


def connected_components(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """`(node, root)`: the least node that each node of the pairs reaches, by minima passed on until none falls."""
    e = pairs.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    e = kept(e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    roots = kept(e.groupBy(F.col("u").alias("node")).agg(F.least(F.col("node"), F.min("v")).alias("root")))
    while True:
        near = e.join(roots, F.col("v") == F.col("node")).groupBy("u").agg(F.min("root").alias("low"))
        step = roots.join(near, F.col("node") == F.col("u")).select("node", F.col("root").alias("old"), F.least("root", "low").alias("root"))
        step = kept(step)
        done = step.where("root <> old").limit(1).count() == 0
        roots = step.select("node", "root")
        if done:
            return roots


def packets(pairs: DataFrame, threshold: float) -> DataFrame:
    """Groups of channels that are read together: pairs whose share reaches the threshold, joined up."""
    found = connected_components(pairs.where(F.col("share") >= threshold), "channel", "other")
    return found.groupBy(F.col("root").alias("packet")).agg(F.count(F.lit(1)).alias("channels"), F.array_join(F.array_sort(F.collect_list("node")), ",").alias("names"))


def cross_match(a: DataFrame, b: DataFrame, radius: float) -> DataFrame:
    """`(id_a, id_b, distance)`: points `(id, x, y)` that are each other's nearest within a radius, ties to the lesser id.

    Points meet in square cells of the radius and the eight around, so no side is compared with all of the other.
    """
    cell = lambda c, d=0: (F.floor(F.col(c) / radius) + d).cast("long")
    around = F.explode(F.array(*[F.struct(cell("x", i).alias("i"), cell("y", j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    left = a.select(F.col("id").alias("id_a"), F.col("x").alias("xa"), F.col("y").alias("ya"), around.alias("c")).select("id_a", "xa", "ya", "c.i", "c.j")
    right = b.select(F.col("id").alias("id_b"), F.col("x").alias("xb"), F.col("y").alias("yb"), cell("x").alias("i"), cell("y").alias("j"))
    near = left.join(right, ["i", "j"]).withColumn("distance", F.sqrt(F.pow(F.col("xa") - F.col("xb"), F.lit(2)) + F.pow(F.col("ya") - F.col("yb"), F.lit(2)))).where(F.col("distance") <= radius)
    first = lambda one, other: F.row_number().over(Window.partitionBy(one).orderBy("distance", other))
    return near.withColumns({"na": first("id_a", "id_b"), "nb": first("id_b", "id_a")}).where("na = 1 AND nb = 1").select("id_a", "id_b", "distance")


def halves(units: DataFrame, seed: int, key: str = "unit") -> DataFrame:
    """Units in two halves for cross-fitting, by parity of seeded rank."""
    return ranked(units, [key], seed).withColumn("half", (F.col("place") % 2).cast("long")).select(*units.columns, "half")


def join_answers(methods: Mapping[str, DataFrame], key: Sequence[str]) -> DataFrame:
    """`(key, method, predicted, complete)`: every method's answer per cell; `complete` if all methods answer the cell."""
    rows = None
    for name in sorted(methods):
        one = methods[name].select(*key, F.lit(name).alias("method"), "predicted")
        rows = one if rows is None else rows.unionByName(one)
    held = rows.groupBy(*key).agg((F.countDistinct("method") == len(methods)).alias("complete"))
    return rows.join(held, list(key))
