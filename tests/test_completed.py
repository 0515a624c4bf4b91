"""Percentiles by ranges, normal scores and masks against plain computations."""

import random
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from obsengine.functions.normal import normal_cdf, normal_quantile
from obsengine.functions.ordering import percentiles
from obsengine.operators import draws, impute, windows


@pytest.mark.parametrize("rows_a_range", [10**6, 50])
def test_percentiles_are_exact(spark, rows_a_range):
    rng = random.Random(1)
    rows = [(f"g{k}", rng.choice([rng.gauss(0, 1), 0.5, 7.0])) for k in range(4) for _ in range(10 ** min(k, 3) if k < 3 else 400)] + [("g1", None), (None, 1.0), ("none", None)]
    at = [0.0, 0.05, 0.5, 0.731, 1.0]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {r.g: r.percentiles for r in percentiles(df, "x", at, ["g"], rows_a_range=rows_a_range).collect()}
    assert set(got) == {"g0", "g1", "g2", "g3"}
    for g, found in got.items():
        assert np.allclose(found, np.quantile([x for h, x in rows if h == g and x is not None], at))
    whole = percentiles(df, "x", at, rows_a_range=rows_a_range).first()[0]
    assert np.allclose(whole, np.quantile([x for _, x in rows if x is not None], at))


def test_normal_scores(spark):
    ps = [1e-7, 1e-4, 0.02, 0.02425, 0.3, 0.5, 0.8, 0.99, 1 - 1e-7]
    for p, z, back in spark.createDataFrame([(p,) for p in ps], "p double").select("p", normal_quantile(F.col("p")), normal_cdf(normal_quantile(F.col("p")))).collect():
        assert abs(z - NormalDist().inv_cdf(p)) < 1e-7 and abs(back - p) < 1e-8
    for x, p in spark.createDataFrame([(x,) for x in (-9.0, -3.0, 0.0, 1.5, 8.0)], "x double").select("x", normal_cdf(F.col("x"))).collect():
        assert abs(p - NormalDist().cdf(x)) < 1e-12


def test_masks_keep_their_rates(spark):
    rows = [(f"u{u}", 0, f"c{k % 3}", float(k), (k + 0.5) / 40, 0.0, k == 0) for u in range(300) for k in range(40)]
    df = spark.createDataFrame(rows, "unit string, position long, channel string, value double, time double, gap double, timeless boolean")
    for rates in ({"channel": 0.3}, {"block": 0.5}, {"token": 0.2}, {"tail": 0.5}, {"interval": 0.7}, {"channel": 0.1, "block": 0.2, "token": 0.1, "tail": 0.2, "interval": 0.2}):
        got = impute.mask_windows(df, 7, **rates, timeless="timeless")
        measured = got.agg(F.avg(F.col("hidden").cast("int"))).first()[0]
        assert abs(measured - impute.expected_ratio(**rates)) < 0.05
        assert got.groupBy("unit").agg(F.count_if(~F.col("hidden")).alias("n")).where("n = 0").count() == 0
        if set(rates) & {"block", "tail", "interval"} and len(rates) == 1:
            assert got.where("timeless AND hidden").count() == 0
    everything = impute.mask_windows(df, 7, channel=1.0)
    assert everything.where("NOT hidden").count() == 300  # one token of each window shows


def test_padded_windows_and_inner_holdout(spark):
    df = spark.createDataFrame([("u", 0, "a", 2.0, 0.5, 0.1), ("u", 0, "b", 1.0, 0.25, 0.2)], "unit string, position long, channel string, value double, time double, gap double")
    r = windows.pack_windows(df, 4).first()
    assert [t.channel for t in r.tokens] == ["b", "a", None, None] and r.mask == [True, True, False, False]
    with pytest.raises(Exception, match="more than 1"):
        windows.pack_windows(df, 1).collect()
    units = spark.createDataFrame([(f"u{i}",) for i in range(11)], "unit string")
    assert draws.inner_holdout(units, 5, 1).where("held_out").count() == 3
    with pytest.raises(ValueError, match="none to learn"):
        draws.inner_holdout(units.limit(1), 2, 1)
