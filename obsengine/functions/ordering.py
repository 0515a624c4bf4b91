"""Ranks and running sums over a whole table, without bringing the table into one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def kept(df: DataFrame) -> DataFrame:
    """`df` computed once: in the shared checkpoint folder if the session has one, else cached (and computed anew if lost)."""
    if df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        return df.checkpoint()
    return df.persist()


def seeded_rank(seed: int, *parts: Column | str) -> Column:
    """A digest of the seed and the length-prefixed parts, a total order that depends on values alone."""
    texts = [F.lit(str(seed)), *[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts]]
    return F.sha2(F.concat_ws("|", *[F.concat(F.length(t).cast("string"), F.lit(":"), t) for t in texts]), 256)


def digest_position(df: DataFrame, digest: str, ties: Sequence[str] = (), by: Sequence[str] = (), to: str = "place") -> DataFrame:
    """`df` with its place from 1 by a hexadecimal digest, within `by` if given.

    Digests spread evenly, so their first three digits deal the rows to 4,096 groups; the groups' sizes are summed
    and rows are numbered inside their group only.
    """
    rows = df.withColumn("_group", F.substring(digest, 1, 3))
    sizes = rows.groupBy(*by, "_group").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*by, "_group", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*by, "_group").orderBy(digest, *ties)
    return rows.withColumn("_row", F.row_number().over(inside)).join(starts, [*by, "_group"]).withColumn(to, (F.col("_row") + F.col("_before")).cast("long")).drop("_group", "_row", "_before")


def ranges_for(rows: int, rows_a_range: int) -> int:
    """How many ranges a table is dealt to, so that a task's share doesn't grow with the table."""
    return max(1, min(100_000, -(-rows // rows_a_range)))


def percentiles(df: DataFrame, value: str, at: Sequence[float], by: Sequence[str] = (), to: str = "percentiles", rows_a_range: int = 1_000_000) -> DataFrame:
    """`(*by, to)`: exact percentiles at the shares `at`, interpolated between ranks, as an array for each group.

    Equal values are counted before they are shuffled. Where that leaves more than a task should hold, the values of
    all groups are dealt to ranges of one order, ranks follow from the ranges' sizes, and only values at a wanted rank
    are gathered, two at most for each share. Null values don't count; a group without values has no row, nor has null.
    """
    known = df.where(F.col(value).isNotNull())
    for c in by:
        known = known.where(F.col(c).isNotNull())
    g = kept(known.groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n")))
    shares = F.array(*[F.lit(float(p)) for p in at])
    ranges = ranges_for(g.count(), rows_a_range)
    if ranges == 1:
        return g.groupBy(*by).agg(F.percentile("_v", shares, F.col("_n")).alias(to)).where(F.col(to).isNotNull())
    rows = kept(g.repartitionByRange(ranges, *by, "_v").withColumn("_range", F.spark_partition_id()))
    key = list(by) or [F.lit(0)]
    before = Window.partitionBy(*key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("_range", *by).agg(F.sum("_n").alias("_m"))
    starts = sizes.select("_range", *by, F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_before"), F.sum("_m").over(Window.partitionBy(*key)).alias("_all"))
    inside = Window.partitionBy("_range", *by).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.join(starts, ["_range", *by]).withColumn("_upto", F.col("_before") + F.sum("_n").over(inside))
    rank = lambda p: p * (F.col("_all") - 1)
    holds = lambda r: (r >= F.col("_upto") - F.col("_n")) & (r < F.col("_upto"))
    hit = placed.where(F.exists(shares, lambda p: holds(F.floor(rank(p))) | holds(F.ceil(rank(p)))))
    found = hit.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("_upto", "_v"))).alias("_hits"), F.max("_all").alias("_all"))
    value_at = lambda r: F.get(F.filter("_hits", lambda h: h["_upto"] > r), 0)["_v"]
    line = lambda p: value_at(F.floor(rank(p))) + (rank(p) - F.floor(rank(p))) * (value_at(F.ceil(rank(p))) - value_at(F.floor(rank(p))))
    return found.select(*by, F.transform(shares, line).alias(to))


def median(df: DataFrame, value: str, by: Sequence[str] = (), to: str = "median", rows_a_range: int = 1_000_000) -> DataFrame:
    """`(*by, to)`: the exact median of each group, as `percentiles` finds it."""
    return percentiles(df, value, [0.5], by, "_p", rows_a_range).select(*by, F.get("_p", 0).alias(to))


def running(df: DataFrame, order: str, sums: Mapping[str, str], descending: bool = False, by: Sequence[str] = (), ranges: int | None = None) -> DataFrame:
    """`df` with running sums along `order`, its own row included: `sums` maps new columns to summed ones.

    `order` must be a number and differ between the rows of a group `by`. Rows are dealt to ranges of about equal
    counts, each range's total is added to those after it, and only a range is summed row by row in one task.
    """
    df = kept(df)
    ranges = ranges or max(8, ranges_for(df.count(), 250_000))
    bounds = sorted(set(df.stat.approxQuantile(order, [i / ranges for i in range(1, ranges)], 0.005)))
    if not bounds:
        rows = df.withColumn("_range", F.lit(0.0))
    else:
        splits = [-float("inf"), *bounds, float("inf")]
        rows = df.withColumn("_at", F.col(order).cast("double"))
        rows = Bucketizer(splits=splits, inputCol="_at", outputCol="_range").transform(rows).drop("_at")
    way = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    totals = rows.groupBy(*by, "_range").agg(*[F.sum(c).alias(f"_t_{to}") for to, c in sums.items()])
    before = Window.partitionBy(*(by or [F.lit(0)])).orderBy(way("_range")).rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*by, "_range", *[F.coalesce(F.sum(f"_t_{to}").over(before), F.lit(0)).alias(f"_b_{to}") for to in sums])
    inside = Window.partitionBy(*by, "_range").orderBy(way(order)).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.join(starts, [*by, "_range"])
    return out.withColumns({to: F.sum(c).over(inside) + F.col(f"_b_{to}") for to, c in sums.items()}).drop("_range", *[f"_b_{to}" for to in sums])


def sorted_position(df: DataFrame, order: Sequence[Column | str], to: str = "place", ranges: int | None = None) -> DataFrame:
    """`df` with its place from 1 by a total order of columns of any kind, ties between whole rows in any order.

    Rows are dealt to ranges of the whole order, so that many rows of one value are spread too; the ranges' sizes are
    added up and rows are numbered inside their range only.
    """
    if ranges is None:
        df = kept(df)
        ranges = ranges_for(df.count(), 250_000)
    rows = kept(df.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()))
    sizes = rows.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return rows.withColumn("_row", inside).join(F.broadcast(starts), "_range").withColumn(to, (F.col("_row") + F.col("_before")).cast("long")).drop("_range", "_row", "_before")
