"""What the operators of this package share: table reading, durable intermediate results, seeded ranks, components."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, `spark.checkpoint.dir`.

    Where it is unset, a folder of this machine takes its place on a local master; on a cluster that is refused.
    """
    sc = spark.sparkContext
    at = sc._jsc.sc().getCheckpointDir()
    if at.isDefined():
        return at.get()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints"
    sc.setCheckpointDir(folder)
    return sc._jsc.sc().getCheckpointDir().get()


def fresh(name: str, taken: Iterable[str]) -> str:
    """`name`, with underscores before it until no column in `taken` is called so, whatever its case."""
    known = {t.lower() for t in taken}
    while name.lower() in known:
        name = f"_{name}"
    return name


def durable(df: DataFrame) -> DataFrame:
    """`df`, computed once and written to the shared folder: a lost executor loses none of it and its lineage is cut.

    A table and not a checkpoint, since that keeps the plan's guess of its size: in a loop of joins the guess squares
    with each round, until its digits take longer than the work. A table has its true size.
    """
    path = f"{shared_dir(df.sparkSession)}/{uuid.uuid4()}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def seeded(seed: int, *columns: Column | str) -> Column:
    """A non-negative 60-bit rank that depends on the seed and the values alone, so draws replay anywhere."""
    digest = F.sha2(F.concat_ws("\x1f", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string") if isinstance(c, str) else c.cast("string"), F.lit("\x1e")) for c in columns]), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """The smallest node that each node of an undirected graph reaches: `(node, root)`, a row per node in an edge.

    Every round gives each node the least label next to it and then jumps to that label's own label, so a round
    at least halves long chains. Joins are on plain keys, minima are combined before they are shuffled, and the
    labels are written to the shared folder each round. Null ends and loops join nothing. No row reaches the driver.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    e = durable(e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = durable(e.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("root")).withColumnRenamed("u", "node"))
    while True:
        near = e.join(labels, F.col("v") == F.col("node")).groupBy("u").agg(F.min("root").alias("low"))
        step = labels.join(near, F.col("node") == F.col("u"), "left").select("node", F.col("root").alias("old"), F.least("root", F.coalesce("low", "root")).alias("root"))
        jump = labels.select(F.col("node").alias("at"), F.col("root").alias("beyond"))
        after = durable(step.join(jump, F.col("root") == F.col("at"), "left").select("node", "old", F.least("root", F.coalesce("beyond", "root")).alias("root")))
        moved = after.where("root <> old").limit(1).count()
        labels = after.select("node", "root")
        if not moved:
            return labels
