"""Mixing sources to target weights under one token budget.

The budget is split down a tree of domain, language and source by weights. A node can take no more than its leaves
hold times the epochs allowed; what it can't take goes to its siblings by their weights, and only what all children
of a node can't take goes to the node's own siblings. Each leaf then gives whole seeded epochs and a prefix of the
next one. Ranks are digests, so a draw replays anywhere; prefix sums are taken over buckets of ranks, and only the
bucket in which a leaf's quota ends is summed row by row. Built-in functions only.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import durable, fresh, seeded

SEP, NONE = "\x1f", "\x1e"  # between levels; for a null level
RANK_BITS = 60
MOST_SENT = 50_000  # leaves whose plan, some 100 bytes each, is sent to all tasks


def words(text: str = "text") -> Column:
    """A text's size: how many runs of other than white space it holds."""
    return F.regexp_count(F.coalesce(F.col(text).cast("string"), F.lit("")), F.lit(r"\S+")).cast("long")


ESCAPES = {"\x1b": "\x1b0", SEP: "\x1b1", NONE: "\x1b2"}  # the first sign first: it stands in the others


def path(*levels: Column) -> Column:
    """The place in the tree as one string, the same for no two places; a null level is a value of its own."""
    return F.concat_ws(SEP, *[F.coalesce(_replaced(c.cast("string"), ESCAPES), F.lit(NONE)) for c in levels])


def level(path: Column | str, nth: int) -> Column:
    """The `nth` level, from 0, of a `path` as it was."""
    said = F.get(F.split(path, SEP), F.lit(nth))
    return F.when(said != NONE, _replaced(said, {v: k for k, v in reversed(ESCAPES.items())}))


def _replaced(c: Column, signs: Mapping[str, str]) -> Column:
    for a, b in signs.items():
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _named(key: tuple[str | None, ...]) -> str:
    said = [NONE if k in (None, NONE) else k.replace("\x1b", ESCAPES["\x1b"]).replace(SEP, ESCAPES[SEP]).replace(NONE, ESCAPES[NONE]) for k in key]
    return SEP.join(said)


def fill(nodes: DataFrame, parent: Sequence[str], budget: str = "given", cap: str = "cap", weight: str = "weight", to: str = "quota") -> DataFrame:
    """`nodes` with `to`: the shares of their parent's budget, in proportion to weight and none above its cap.

    A child is full if even what everyone gets at its own cap-to-weight ratio stays within the budget; the rest share
    what is left. Children of weight 0 or less get nothing.
    """
    some = F.col(weight) > 0
    ratio = F.when(some, F.col(cap) / F.col(weight))
    kin = Window.partitionBy(*parent)
    upto = kin.orderBy(F.col("_ratio").asc_nulls_last(), "node").rowsBetween(Window.unboundedPreceding, 0)
    usable = F.when(some, F.col(weight)).otherwise(0.0)
    rows = nodes.withColumn("_ratio", ratio).withColumn("_all", F.sum(usable).over(kin)).withColumn("_c", F.sum(F.when(some, F.col(cap))).over(upto)).withColumn("_w", F.sum(usable).over(upto))
    rows = rows.withColumn("_full", F.coalesce(F.col("_c") + F.col("_ratio") * (F.col("_all") - F.col("_w")) <= F.col(budget), F.lit(False)))
    full_c, full_w = (F.coalesce(F.sum(F.when(F.col("_full"), x)).over(kin), F.lit(0.0)) for x in (F.col(cap), usable))
    rest = F.greatest(F.col(budget) - full_c, F.lit(0.0)) * usable / F.nullif(F.col("_all") - full_w, F.lit(0.0))
    return rows.withColumn(to, F.when(F.col("_full"), F.col(cap).cast("double")).otherwise(F.coalesce(rest, F.lit(0.0)))).drop("_ratio", "_all", "_c", "_w", "_full")


def quotas(leaves: DataFrame, levels: Sequence[str], budget: float, weights: Mapping[tuple[str, ...], float], epochs: int) -> DataFrame:
    """`leaves` (the levels, `available`) with `quota`. `weights` names nodes by their path, None for null; the rest weigh 1."""
    named = F.create_map(*[x for k, v in weights.items() for x in (F.lit(_named(k)), F.lit(float(v)))]) if weights else None
    rows = leaves.withColumn("cap", F.col("available").cast("double") * epochs)
    above = rows.agg(F.least(F.sum("cap"), F.lit(float(budget))).alias("given")).withColumn("_p0", F.lit(""))
    rows = rows.withColumn("_p0", F.lit(""))
    for i in range(1, len(levels) + 1):
        rows = rows.withColumn(f"_p{i}", path(*[F.col(c) for c in levels[:i]]))
    for i in range(1, len(levels) + 1):
        nodes = rows.groupBy(f"_p{i - 1}", f"_p{i}").agg(F.sum("cap").alias("cap")).withColumnRenamed(f"_p{i}", "node")
        weight = F.coalesce(F.try_element_at(named, F.col("node")), F.lit(1.0)) if named is not None else F.lit(1.0)
        shares = fill(nodes.withColumn("weight", weight).join(above, f"_p{i - 1}"), [f"_p{i - 1}"])
        above = shares.select(F.col("node").alias(f"_p{i}"), F.col("quota").alias("given"))
    return rows.join(above, f"_p{len(levels)}").withColumnRenamed("given", "quota").drop("cap", *[f"_p{i}" for i in range(len(levels) + 1)])


def mix(docs: DataFrame, levels: Mapping[str, Column], weights: Mapping[tuple[str, ...], float], budget: float | None = None, share: float = 0.8, epochs: int = 1, seed: int = 42, doc_id: str = "doc_id", tokens: Column | None = None, rows_a_bucket: int = 2000, epoch_to: str | None = None) -> DataFrame:
    """The rows of `docs` that the mixture reads, with all their columns, a row for each epoch that reads it.

    `levels` names the tree's levels and how rows give them; null is a value like any other. Without a `budget` it is
    `share` of all tokens. A leaf's rows go by seeded rank of doc_id (ties by doc_id: repeated rows have one rank and
    are interchangeable), each epoch in an order of its own; a row is read if the rows before it don't reach the quota,
    so a leaf passes its quota by less than a row. A whole epoch reads rows without tokens too, a prefix only those
    before its end. An empty table gives an empty result. Other columns pass unchanged whatever their names.
    """
    n = docs.count()
    bits = max(0, min(30, int(math.log2(max(1, n / rows_a_bucket)))))
    size = words() if tokens is None else tokens
    own = fresh("_mix_row", docs.columns)
    rows = docs.select(F.struct(*docs.columns).alias(own), path(*levels.values()).alias("_mix_leaf"), size.alias("_mix_n"), seeded(seed, doc_id).alias("_mix_rank"))
    rows = rows.withColumn("_mix_bucket", F.shiftright("_mix_rank", RANK_BITS - bits))
    names = [f"_mix_l{i}" for i in range(len(levels))]
    sums = durable(rows.groupBy("_mix_leaf", "_mix_bucket").agg(F.sum("_mix_n").alias("n")))
    leaves = sums.groupBy("_mix_leaf").agg(F.sum("n").alias("available"))
    leaves = leaves.select("*", *[level("_mix_leaf", i).alias(c) for i, c in enumerate(names)])
    if budget is None:
        budget = share * (leaves.agg(F.sum("available")).first()[0] or 0)
    given = quotas(leaves, names, budget, weights, epochs)
    whole = F.when(F.col("available") > 0, F.least(F.floor(F.col("quota") / F.col("available") + 1e-9), F.lit(epochs))).otherwise(0).cast("int")
    given = given.withColumn("whole", whole).withColumn("rest", F.when(F.col("whole") >= epochs, 0.0).otherwise(F.col("quota") - F.col("whole") * F.col("available")))
    given = given.withColumn("rest", F.when(F.col("rest") > 1e-6, F.col("rest")).otherwise(0.0)).withColumn("mask", seeded(seed, F.lit("epoch"), F.col("whole")))
    order = Window.partitionBy("_mix_leaf").orderBy("place")
    placed = sums.join(given.select("_mix_leaf", "whole", "rest", "mask"), "_mix_leaf").withColumn("place", F.col("_mix_bucket").bitwiseXOR(F.shiftright("mask", RANK_BITS - bits)))
    placed = placed.withColumn("before", F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    cut = placed.where("before < rest").groupBy("_mix_leaf").agg(F.max(F.struct("place", "before")).alias("c"))
    plan = given.join(cut.select(F.col("_mix_leaf").alias("_leaf"), F.col("c.place").alias("_mix_cut"), F.col("c.before").alias("_mix_before")), F.col("_mix_leaf") == F.col("_leaf"), "left")
    plan = durable(plan.select(F.col("_mix_leaf").alias("_mix_of"), F.col("whole").alias("_mix_whole"), F.col("rest").alias("_mix_rest"), F.col("mask").alias("_mix_mask"), "_mix_cut", "_mix_before"))
    small = plan.limit(MOST_SENT + 1).count() <= MOST_SENT  # beyond it the rows are shuffled to their leaves' plans
    drawn = rows.join(F.broadcast(plan) if small else plan, F.col("_mix_leaf") == F.col("_mix_of"))
    drawn = drawn.withColumn("_mix_order", F.col("_mix_rank").bitwiseXOR(F.col("_mix_mask"))).withColumn("_mix_place", F.shiftright("_mix_order", RANK_BITS - bits))
    part = F.when(F.col("_mix_place") < F.col("_mix_cut"), 2).when(F.col("_mix_place") == F.col("_mix_cut"), 1).otherwise(0)
    drawn = drawn.withColumn("_mix_part", part).where("_mix_whole > 0 OR _mix_part > 0")
    sure = F.when(F.col("_mix_part") == 2, F.col("_mix_whole") + 1).otherwise(F.col("_mix_whole"))
    surely = drawn.where(sure > 0).select(own, F.explode(F.sequence(F.lit(0), sure - 1)).alias("_mix_epoch"))
    inside = Window.partitionBy("_mix_leaf").orderBy("_mix_order", F.col(own)[doc_id]).rowsBetween(Window.unboundedPreceding, -1)
    edge = drawn.where("_mix_part = 1").withColumn("_mix_sum", F.coalesce(F.sum("_mix_n").over(inside), F.lit(0)) + F.col("_mix_before"))
    edge = edge.where("_mix_sum < _mix_rest").select(own, F.col("_mix_whole").alias("_mix_epoch"))
    out = surely.unionByName(edge)
    return out.select(f"{own}.*", F.col("_mix_epoch").alias(epoch_to)) if epoch_to else out.select(f"{own}.*")
