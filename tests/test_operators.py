"""Definitions by hand and by brute force."""

import random

import pytest
from pyspark.sql import functions as F

from obsengine.functions.ordering import digest_position, running, seeded_rank
from obsengine.operators import draws, impute, metrics, normalise, repair, windows

READINGS = "unit string, channel string, time double, value double"


def sample(spark, n=300, seed=0):
    rng = random.Random(seed)
    return spark.createDataFrame([(f"u{rng.randrange(4)}", rng.choice("abc"), rng.random() * 90, rng.gauss(0, 1)) for _ in range(n)], READINGS)


def test_an_extent_of_128_holds_16_windows_of_50_every_5(spark):
    units = spark.createDataFrame([("e", 1.0, 129.0), ("fits", 0.0, 50.0), ("short", 0.0, 49.0)], "unit string, extent_start double, extent_end double")
    got = {r.unit: r.n for r in windows.windows_over(units, 50, 5).groupBy("unit").agg(F.count("*").alias("n")).collect()}
    assert got == {"e": 16, "fits": 1}
    assert {r.unit: r.windows for r in windows.window_counts(units, 50, 5).collect()} == {"e": 16, "fits": 1, "short": 0}
    assert windows.windows_over(units, 50, 5, keep_short=True).where("unit = 'short'").count() == 1


@pytest.mark.parametrize(("length", "stride"), [(10.0, 10.0), (10.0, 3.0), (5.0, 12.5), (0.3, 0.1)])
def test_readings_fall_in_the_windows_that_hold_them(spark, length, stride):
    obs = sample(spark)
    units = windows.units_of(obs)
    got = sorted((r.unit, r.time, r.position) for r in windows.assign_windows(obs, units, length, stride).collect())
    placed = windows.windows_over(units, length, stride)
    joined = obs.join(placed, "unit").where("time >= win_start AND time < win_end")
    assert got == sorted((r.unit, r.time, r.position) for r in joined.collect())


def test_rolled_up_cells_equal_cells_laid_out_whole(spark):
    obs = sample(spark, 2000).withColumn("time", F.floor(F.col("time") * 4) / 4 + 0.1)  # off the bins' edges and their tolerance
    tokens = windows.tokenise(windows.assign_windows(obs, windows.units_of(obs), 20.0, 20.0), 20.0)
    fine = windows.rollup_cells(windows.cells(tokens, 8), 4)
    whole = windows.cells(tokens, 2).where("presence = 1")
    key = ["unit", "position", "channel", "bin"]
    close = lambda c: F.abs(F.col(f"f.{c}") - F.col(f"w.{c}")) < 1e-9
    both = fine.alias("f").join(whole.alias("w"), key)
    assert both.count() == fine.count() == whole.count()
    assert both.where(~(close("mean") & close("minimum") & close("maximum") & close("first") & close("last"))).count() == 0


def test_positions_and_running_sums(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice("xy"), float(i) + rng.random() / 2, rng.randrange(5)) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, g string, x double, v long")
    placed = digest_position(df.withColumn("d", seeded_rank(7, "id")), "d", ["id"]).orderBy("place").collect()
    assert [r.place for r in placed] == list(range(1, 501)) and [r.d for r in placed] == sorted(r.d for r in placed)
    for down in (False, True):
        at = {"x": 0, "y": 0}
        got = running(df, "x", {"s": "v"}, descending=down, by=["g"], ranges=7).orderBy(F.desc("x") if down else "x").collect()
        for r in got:
            at[r.g] += r.v
            assert r.s == at[r.g]


def test_draws_nest_and_sides_are_not_empty(spark):
    units = spark.range(97).select(F.col("id").cast("string").alias("unit"))
    held = lambda f: {r.unit for r in draws.split_by_seed(units, f, 3).where("side = 'held_out'").collect()}
    assert held(0.1) < held(0.3) < held(0.8)
    assert len(held(0.3)) == 29
    with pytest.raises(ValueError, match="empty"):
        draws.split_by_seed(units, 0.001, 3)


def test_statistics_ignore_held_out_units(spark):
    obs = sample(spark)
    train = obs.where("unit <> 'u0'")
    odd = train.unionByName(obs.where("unit = 'u0'").withColumn("value", F.lit(1e9)))
    one, two = normalise.fit_standard(train).collect(), normalise.fit_standard(odd.where("unit <> 'u0'")).collect()
    assert sorted(one) == sorted(two)


def test_value_equal_to_several_knots_takes_the_middle_rank(spark):
    stats = spark.createDataFrame([("a", [0.0, 1.0, 1.0, 1.0, 2.0])], "channel string, quantiles array<double>")
    df = spark.createDataFrame([("u", "a", 0.0, v) for v in (-1.0, 0.0, 0.5, 1.0, 1.5, 2.0, 9.0)], READINGS)
    got = {r.value: r["rank"] for r in normalise.quantile_rank(df, stats).collect()}
    assert got == {-1.0: 0.0, 0.0: 0.0, 0.5: 0.125, 1.0: 0.5, 1.5: 0.875, 2.0: 1.0, 9.0: 1.0}


def test_ranking_metrics_against_pairs(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(12) / 4, int(rng.random() < 0.3)) for _ in range(200)]
    df = spark.createDataFrame(rows, "score double, event int")
    hits, misses = [s for s, e in rows if e], [s for s, e in rows if not e]
    want = sum((h > m) + (h == m) / 2 for h in hits for m in misses) / len(hits) / len(misses)
    assert abs(metrics.auroc(df, "event").first()[0] - want) < 1e-12
    precision = sum(sum(h >= s for h in hits) / sum(x >= s for x, _ in rows) for s in hits) / len(hits)
    assert abs(metrics.average_precision(df, "event").first()[0] - precision) < 1e-12


def test_masks_leave_a_token_and_cleaning_clips(spark):
    obs = sample(spark)
    tokens = windows.tokenise(windows.assign_windows(obs, windows.units_of(obs), 30.0, 30.0), 30.0)
    masked = impute.draw_masks(tokens, 1.0, 5)
    assert {r[0] for r in masked.groupBy("unit", "position").agg(F.count_if(~F.col("hidden"))).select("count_if((NOT hidden))").collect()} == {1}
    bounds = spark.createDataFrame([("a", -2.0, -1.0, 1.0, 2.0)], "channel string, removed_below double, clipped_below double, clipped_above double, removed_above double")
    got = repair.clean(obs, bounds)
    assert got.where("channel = 'a' AND abs(value) > 1").count() == 0
    assert got.where("channel <> 'a'").count() == obs.where("channel <> 'a'").count()
    assert got.where("channel = 'a'").count() == obs.where("channel = 'a' AND abs(value) <= 2").count()
