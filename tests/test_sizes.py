"""What queries shuffle: plans that grow with the readings and not with their pairs or copies."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from obsengine.operators import convolution, detect, draws_of_units, finding, layouts, metrics, rankings, repair, resample, windows
from obsengine.sources.tables import to_long


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def hourly(spark):
    r = np.random.default_rng(8)
    return spark.createDataFrame([(f"u{u}", c, int(h), float(r.normal())) for u in range(7) for c in "xy" for h in range(60) if r.random() < 0.8], "unit string, channel string, hour long, mean double")


def test_pairs_are_told_where_their_blocks_meet(spark, monkeypatch):
    whole = {(p["channel"], p["a"], p["b"]): (p["shared"], p["correlation"]) for p in layouts.unit_pair_correlations(hourly(spark), 5).collect()}
    assert len(whole) == 2 * 21
    plan = plan_of(layouts.unit_pair_correlations(hourly(spark), 5))
    assert "Exchange" not in plan[: plan.index("FlatMapGroupsInArrow")]  # no row of a pair is shuffled
    monkeypatch.setattr(layouts, "VALUES_A_BLOCK", 120)  # two units a block, as their series are long
    for p in layouts.unit_pair_correlations(hourly(spark), 5).collect():
        shared, r = whole.pop((p["channel"], p["a"], p["b"]))
        assert p["shared"] == shared and p["correlation"] == pytest.approx(r)
    assert not whole


def test_autocorrelations_deal_the_readings_once(spark):
    lines = hourly(spark).groupBy("unit", "hour").pivot("channel", ["x", "y"]).agg(F.first("mean")).withColumn("time", F.col("hour") + 0.5)
    dealt = lines.select("unit", "time", "x", "y").localCheckpoint().repartition("unit")
    own = repair.wide_hourly_means(dealt, ["x", "y"])
    assert plan_of(layouts.unit_autocorrelations(own, 1, 3)).count("Exchange") == 1
    told = {(p["channel"], p["unit"]): (p["level"], p["change"]) for p in layouts.unit_autocorrelations(own, 1, 3).collect()}
    for p in layouts.unit_autocorrelations(hourly(spark), 1, 3).collect():
        assert told.pop((p["channel"], p["unit"])) == pytest.approx((p["level"], p["change"]))
    assert not told


def readings(spark):
    r = np.random.default_rng(5)
    rows = [(f"u{u}", c, float(t), float(r.integers(4))) for u in range(5) for c in "xyz" for t in r.uniform(0, 90, 12)]
    return spark.createDataFrame([*rows, ("u1", "x", 7.5, 2.0), ("u1", "x", 7.5, 3.0)], "unit string, channel string, time double, value double")


def test_hours_are_filled_as_densified_ones_are_without_a_join(spark):
    own = repair.hourly_means(readings(spark).repartition("unit"))
    want = repair.fill_forward(repair.densify(own))
    got = repair.filled_hours(own).select(want.columns)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    assert plan_of(got).count("Exchange") == 1 and "Join" not in plan_of(got)


def test_series_of_tokens_are_those_of_their_grid_and_dealt_once(spark):
    dealt = readings(spark).repartition("unit")
    tokens = windows.tokenise(windows.assign_windows(dealt, windows.units_of(dealt), 24.0, 24.0), 24.0)
    want = convolution.window_series(windows.regular_grid(tokens, 12), ["x", "z", "w"], 12)
    got = convolution.token_series(tokens, ["x", "z", "w"], 12)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0 and got.count() > 10
    assert plan_of(got).count("Exchange") < plan_of(want).count("Exchange")
    told = convolution.convolution_features(got.withColumn("target", F.lit(1)), got, 3, 12, 84, 1)
    assert told.columns == ["unit", "position", "target", "features"]


def test_instants_of_wide_rows_are_those_of_long_ones(spark):
    wide = spark.createDataFrame([("a", 1.0, 2.0, None), ("a", 1.0, 3.0, float("nan")), ("a", 2.0, None, 5.0), ("b", 1.0, 4.0, 4.0), ("b", 1.0, 4.0, 4.0), ("c", 1.0, None, float("inf"))], "unit string, time double, x double, y double")
    got = repair.wide_one_row_per_instant(wide, ["x", "y"])
    want = repair.one_row_per_instant(to_long(wide, ["unit", "time"], ["x", "y"])).select(got.columns)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0 and got.count() == 4
    assert plan_of(got).index("Generate") < plan_of(got).index("Exchange")  # rows are shuffled before they are one for each channel


def test_holm_and_fills_read_no_frame_up_to_the_end(spark):
    tests = spark.createDataFrame([(f"t{i}", float(p)) for i, p in enumerate([0.04, 0.01, 0.04, 0.6, 0.002])], "test string, p double")
    told = metrics.holm(tests)
    assert "currentrow$(), unboundedfollowing" not in plan_of(told).lower()
    assert {r["test"]: round(r["benjamini_hochberg"], 6) for r in told.collect()} == {"t4": 0.01, "t1": 0.025, "t0": 0.05, "t2": 0.05, "t3": 0.6}
    assert "currentrow$(), unboundedfollowing" not in plan_of(repair.fill_forward(hourly(spark))).lower()


def test_strata_are_joined_by_their_sizes_where_units_lie(spark):
    pairs = spark.createDataFrame([(f"u{i}", float(i), 2, float(i % 3), 2, str(i % 2)) for i in range(40)], "unit string, se_a double, n_a long, se_b double, n_b long, stratum string")
    plan = plan_of(resample.paired_bootstrap(pairs, 20, 1, strata="stratum"))
    assert "keys=[draw#" in plan and not re.search(r"HashAggregate\(keys=\[draw#\d+L?, stratum#\d+, place#", plan)


def test_departures_shuffle_a_window_once_and_equal_their_definition(spark):
    r = np.random.default_rng(3)
    rows = [(f"u{u}", p, c, *map(float, r.normal(size=4).round(2)), float(r.integers(3))) for u in range(4) for c in "xyz" for p in range(14) if r.random() < 0.7]
    schema = "unit string, position int, channel string, " + ", ".join(f"{k} double" for k in detect.VALUES)
    summaries = spark.createDataFrame(rows, schema)
    floor = spark.createDataFrame([(c, k, 0.4) for c in "xy" for k in detect.VALUES], "channel string, kind string, floor double")
    told = detect.channel_departures(summaries, floor)
    plan = plan_of(told)
    assert "Expand" not in plan and len(re.findall(r"Exchange hashpartitioning\(unit", plan)) == 1
    got = {(d["unit"], d["position"], d["channel"]): d["departure"] for d in told.collect()}
    for u, p, c, *x in rows:
        if c == "z":
            continue
        past = np.array([y[3:] for y in rows if y[0] == u and y[2] == c and p - 5 <= y[1] < p])
        want = 0.0
        if 2 * len(past) >= 5:
            mid = np.median(past, axis=0)
            want = (np.abs(np.array(x) - mid) / np.maximum(1.4826 * np.median(np.abs(past - mid), axis=0), 0.4)).max()
        assert got.pop((u, p, c)) == pytest.approx(want)
    assert not got


def test_scores_are_read_against_their_unit_where_they_lie(spark):
    scores = spark.createDataFrame([("a", float(x)) for x in (1, 2, 4, 9)] + [("b", 3.0), ("b", 3.0), ("c", None), (None, 1.0)], "unit string, score double")
    told = detect.against_own_unit(scores, spark.createDataFrame([(2.0,)], "fallback double"))
    assert plan_of(told).count("Exchange hashpartitioning") == 1
    got = sorted((r["unit"], r["score"], round(r["read"], 6)) for r in told.collect())
    assert got == [("a", x, round((x - 3) / (1.4826 * 1.5), 6)) for x in (1.0, 2.0, 4.0, 9.0)] + [("b", 3.0, 0.0)] * 2


@pytest.mark.parametrize("measure", ["auroc", "pr_auc", "recall"])
def test_areas_of_many_draws_carry_a_row_a_score(spark, monkeypatch, measure):
    r = np.random.default_rng(6)
    rows = [(f"u{u}", int(r.integers(1, 4)) if r.random() < 0.3 else 0, a, float(round(r.normal(), 1) if a == "x" else r.integers(2))) for u in range(12) for a in "xy" for _ in range(20)]
    draws = [(d, f"u{u}", int(r.integers(1, 4))) for d in range(-1, 20) for u in range(12) if d < 0 or r.random() < 0.6]
    seen, plain = [], rankings.kept
    monkeypatch.setattr(rankings, "kept", lambda df: (lambda k: seen.append((k.columns, k.count())) or k)(plain(df)))
    got = rankings.areas(spark.createDataFrame(rows, "unit string, event int, arm string, score double"), spark.createDataFrame(draws, "draw int, unit string, k long"), measure, 0.3)
    got = {(x["draw"], x["arm"]): x["area"] for x in got.collect()}
    carried = [n for columns, n in seen if "hs" in columns]
    assert carried and max(carried) <= len(rows)  # not a row for each draw
    for d in range(-1, 20):
        k = {u: n for e, u, n in draws if e == d}
        for a in "xy":
            own = [(s, e, k[u], u) for u, e, b, s in rows if b == a and u in k]
            size = {e: sum(b == a and f == e for _, f, b, _ in rows) for e in (1, 2, 3)}
            h = [(s, n / size[e] if measure == "pr_auc" else n) for s, e, n, _ in own if e]
            m = [(s, n) for s, e, n, _ in own if not e]
            above = lambda x, s: sum(n for t, n in x if t >= s)
            if measure == "auroc":
                want = sum(n * o * ((s > t) + (s == t) / 2) for s, n in h for t, o in m) / (sum(n for _, n in h) * sum(n for _, n in m))
            elif measure == "pr_auc":
                want = sum(n * above(h, s) / (above(h, s) + above(m, s)) for s, n in h) / sum(n for _, n in h)
            else:
                line = min((s for s, *_ in own if above(m, s) <= 0.3 * sum(n for _, n in m)), default=np.inf)
                best = {}
                for s, e, n, u in own:
                    if e:
                        best[u, e] = (max(s, best.get((u, e), (s,))[0]), n)
                want = sum(n for s, n in best.values() if s >= line) / sum(n for _, n in best.values())
            assert got.pop((d, a)) == pytest.approx(want)
    assert not got


def test_picks_of_units_are_dealt_by_place_once_and_sent_to_no_driver(spark):
    rows = spark.createDataFrame([(f"u{u}", float(u)) for u in range(30)], "unit string, x double")
    told = draws_of_units.drawn(rows, "unit", 5, 1)
    assert "SortMergeJoin [place" in plan_of(told) and plan_of(told).count("Exchange hashpartitioning(draw") == 0
    got = told.groupBy("draw").agg(F.sum("k").alias("k"), F.count(F.lit(1)).alias("n")).collect()
    assert len(got) == 5 and all(r["k"] == 30 and r["n"] < 30 for r in got)


def test_first_days_share_their_histories(spark, monkeypatch):
    r = np.random.default_rng(4)
    rows = [(f"u{u}", p, "x", *map(float, r.normal(size=5))) for u in range(6) for p in range(20)]
    summaries = spark.createDataFrame(rows, "unit string, position int, channel string, " + ", ".join(f"{k} double" for k in detect.VALUES))
    ends = spark.createDataFrame([(f"u{u}", p, 24.0 * p, 24.0 * p + 24) for u in range(6) for p in range(20)], "unit string, position int, win_start double, win_end double")
    calls, plain = [], detect.histories
    monkeypatch.setattr(detect, "histories", lambda *x: calls.append(1) or plain(*x))
    told = finding.fit_on_first_days(summaries, ends, [8, None], 0.1)
    assert len(calls) == 1 and told.count() == 240
    want = detect.score_alarm(detect.window_score(detect.channel_departures(summaries, detect.departure_floor(summaries))), 0.1)
    got = told.where("days IS NULL").select("unit", "position", "score", "alarm")
    assert got.exceptAll(want.select("unit", "position", "score", "alarm")).count() == 0


def test_cells_and_rows_of_cell_values_are_computed_once(spark, monkeypatch):
    from obsengine.plans import fits

    seen, plain = [], fits.kept
    monkeypatch.setattr(fits, "kept", lambda df: seen.append(df.columns) or plain(df))
    fits.i9_cell_values(spark, "/root/testdata/sf0.001")
    assert [("presence" in c, "hidden" in c, "fold" in c) for c in seen][0] == (True, False, False) and len(seen) == 3 and "fold" in seen[-1]


def test_pairs_that_seldom_meet_are_counted_before_they_are_summed(monkeypatch):
    r = np.random.default_rng(3)
    series = []
    for _ in range(40):
        hours = np.flatnonzero(r.random(1500) < 0.08)
        series.append((hours, r.normal(size=len(hours))))
    found = {}
    for name, sparse, at_once in (("meetings", 1, 1000), ("meetings at once", 1, 1 << 20), ("products", 10**9, 1 << 20)):
        monkeypatch.setattr(layouts, "SPARSE", sparse)
        monkeypatch.setattr(layouts, "MEETINGS_AT_ONCE", at_once)
        found[name] = {(i, j): s for a, b, sums in layouts._pair_sums(series[:15], series, 8) for i, j, s in zip(a.tolist(), b.tolist(), sums.T, strict=True)}
    assert 100 < len(found["products"]) < 15 * 40
    for (i, j), s in found["products"].items():
        (g, x), (h, y) = series[i], series[j]
        x, y = x[np.isin(g, h)], y[np.isin(h, g)]
        assert s == pytest.approx([len(x), x.sum(), y.sum(), x @ y, x @ x, y @ y])
    for name in ("meetings", "meetings at once"):
        assert found[name].keys() == found["products"].keys() and all(found[name][p] == pytest.approx(s) for p, s in found["products"].items())
    monkeypatch.setattr(layouts, "SPARSE", 24)
    monkeypatch.setattr(layouts, "HOURS_A_BLOCK", 0)  # no matrix could be made
    assert sum(len(a) for a, _, _ in layouts._pair_sums(series, series, 8)) > 0
