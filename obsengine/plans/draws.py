"""Queries for resampling at ten thousand draws. SQL can't repeat their seeded binomials; tests hold them against numpy."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import layouts, multinomial
from ..sources.tables import table
from .completed import nation_strata
from .finding import repeated
from .layouts import answers
from .queries import SEED, paired, query


@query()
def b2_drawn_10000(spark, sf_dir):
    return multinomial.paired_reduction(paired(spark, sf_dir).drop("unpaired"), SEED)


@query()
def b2_drawn_strata_10000(spark, sf_dir):
    return multinomial.paired_reduction(paired(spark, sf_dir).drop("unpaired").join(nation_strata(spark, sf_dir), "unit"), SEED, strata="stratum")


@query()
def b5_drawn_10000(spark, sf_dir):
    return multinomial.two_level(repeated(spark, sf_dir), SEED)


@query()
def b7_drawn_10000(spark, sf_dir):
    tallies = layouts.gap_tallies(answers(spark, sf_dir), "last", ["mean"]).groupBy("unit").agg(F.sum("last").alias("last"), F.sum("mean").alias("mean"))
    return multinomial.ratio_of_sums(tallies, ["mean"], "last", SEED)


@query()
def b8_drawn_10000(spark, sf_dir):
    days = answers(spark, sf_dir).dropna(subset=["last", "mean"]).groupBy(F.col("position").cast("string").alias("unit"))
    loss = lambda c: F.avg(F.pow(F.col(c) - F.col("target"), F.lit(2))).alias(c)
    return multinomial.geometric_ratio(days.agg(loss("last"), loss("mean")), "mean", ["last"], SEED)


@query()
def b15_monthly_skill_10000(spark, sf_dir):
    """Prices answered by the mean of their quantity and of their flag against one mean for all, whole months drawn."""
    li = table(spark, sf_dir, "lineitem").select(F.date_format("l_shipdate", "yyyy-MM").alias("unit"), F.col("l_extendedprice").alias("y"), "l_quantity", "l_returnflag")
    by_quantity, by_flag = (li.groupBy(c).agg(F.avg("y").alias(to)) for c, to in (("l_quantity", "q"), ("l_returnflag", "f")))
    told = li.join(by_quantity, "l_quantity").join(by_flag, "l_returnflag").crossJoin(li.agg(F.avg("y").alias("m")))
    off = lambda c: F.sum(F.pow(F.col(c) - F.col("y"), F.lit(2))).alias({"q": "by_quantity", "f": "by_flag", "m": "flat"}[c])
    return multinomial.ratio_of_sums(told.groupBy("unit").agg(off("q"), off("f"), off("m")), ["by_quantity", "by_flag"], "flat", SEED)
