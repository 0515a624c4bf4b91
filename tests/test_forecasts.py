"""Convolutions, neighbours, taught directions, ridges and draws against numpy and by hand."""

from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from obsengine.operators import convolution, covariance, finding, forecasts, layouts, learners, nearest, rankings, sides
from obsengine.operators import context as ctx


def test_convolution_by_hand():
    x = np.random.default_rng(0).normal(size=(2, 3, 20))
    members = np.zeros((84, 3))
    members[:, 1] = 1
    members[5, 2] = 1
    got = convolution.convolved(x, members, 2)
    heavy = list(combinations(range(9), 3))
    for kernel in (0, 5, 83):
        one = x[1, 1] + (x[1, 2] if kernel == 5 else 0)
        for at in range(20):
            want = sum((2 if t in heavy[kernel] else -1) * one[at + (t - 4) * 2] for t in range(9) if 0 <= at + (t - 4) * 2 < 20)
            assert got[1, kernel, at] == pytest.approx(want)
    assert (convolution.kernel_weights().sum(axis=1) == 0).all()


def test_convolution_features(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(12, 2, 16))
    grid = spark.createDataFrame([("u", n, c, s, float(x[n, i, s])) for n in range(12) for i, c in enumerate("ab") for s in range(16) if not (n == 11 and c == "b")], "unit string, position int, channel string, step int, value double")
    x[11, 1] = 0
    rows = convolution.window_series(grid, ["a", "b"], 16)
    got = convolution.convolution_features(rows, rows.where("position < 11"), 2, 16, 170, 3).orderBy("position").collect()
    fit = convolution.fit_convolutions(x[[0]], 170, 3)
    assert len(fit.dilations) >= 1 and len(got[0]["features"]) == 168
    assert all(0 <= v <= 1 for r in got for v in r["features"])
    again = convolution.convolution_features(rows.repartition(3), rows.where("position < 11"), 2, 16, 170, 3).orderBy("position").collect()
    assert got == again
    with pytest.raises(ValueError, match="9 steps"):
        convolution.fit_convolutions(x[:, :, :5], 84, 1)


def test_convolution_ridge_learns(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 6))
    y = x @ [1.0, -2, 0, 0, 3, 0]
    rows = spark.createDataFrame([(i, v.tolist(), float(t), int(t > 0), i % 2) for i, (v, t) in enumerate(zip(x, y, strict=True))], "id int, features array<double>, y double, hit int, fold int")
    told = convolution.convolution_ridge(rows, rows, "y", False, [1e-6, 10.0])
    assert told.agg(F.max(F.abs(F.col("predicted") - F.col("y")))).first()[0] < 0.01
    told = convolution.convolution_ridge(rows, rows, "hit", True, [1e-3, 10.0])
    assert told.where((F.col("predicted") > 0.5) != (F.col("hit") == 1)).count() < 6


def test_nearest_equals_brute_force_in_any_blocks(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 4)).round(1)
    x[50] = x[10]
    rows = spark.createDataFrame([(i, "ab"[i % 2], v.tolist()) for i, v in enumerate(x)], "id int, kind string, v array<double>")
    for block in (7, 4096):
        got = {}
        for r in nearest.nearest(rows, rows.where("id < 55"), 3, ["kind"], block).collect():
            got.setdefault(r["id"], []).append((r["rank"], r["other"], round(r["distance"], 9)))
        for i in range(60):
            near = sorted((float(np.linalg.norm(x[i] - x[j])), j) for j in range(55) if j != i and j % 2 == i % 2)[:3]
            assert [(n + 1, j, round(d, 9)) for n, (d, j) in enumerate(near)] == sorted(got[i])
    assert nearest.nearest(rows, rows.limit(0), 3).count() == 0


def test_nearest_sorts_candidates_alone_and_measures_ties_and_lengths_exactly(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(700, 3))
    x[600:650], x[650:] = x[7], 1e4 * x[650:]  # copies, and vectors beside which single precision tells nothing
    ids, sizes, plain = np.arange(700), [], np.lexsort
    monkeypatch.setattr(nearest.np, "lexsort", lambda keys: sizes.append(len(keys[0])) or plain(keys))
    nearest._closest(ids[:600], x[:600], ids[:600:2], x[:600:2], 4)
    assert sum(sizes) < 600 * 300 // 10  # not every pair is sorted
    row, other, distance = nearest._closest(ids, x, ids[::2], x[::2], 4)
    for i in range(700):
        near = sorted((float(np.sqrt(((x[i] - x[j]) ** 2).sum())), j) for j in range(0, 700, 2) if j != i)[:4]
        assert list(zip(distance[row == i].tolist(), (2 * other[row == i]).tolist(), strict=True)) == near
    odd = spark.createDataFrame([(1, [0.0, float("nan")]), (2, [1.0, 1.0]), (3, [float("inf"), 0.0]), (4, [1.0, 2.0]), (5, None)], "id int, v array<double>")
    assert [(r["id"], r["other"], r["distance"]) for r in nearest.nearest(odd, odd, 3).sort("id").collect()] == [(2, 4, 1.0), (4, 2, 1.0)]


def test_taught_direction_equals_numpy(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(150, 3)) @ rng.normal(size=(3, 3))
    event = np.array([1 if i < 6 else 2 if i < 8 else 0 for i in range(150)])
    x[event > 0] += [2.0, 0.0, 1.0]
    rows = spark.createDataFrame([(i, v.tolist(), int(e)) for i, (v, e) in enumerate(zip(x, event, strict=True))], "id int, v array<double>, event int")
    got = covariance.taught_direction(rows, "v", 3, rows).orderBy("id").collect()
    out = x[event == 0]
    z = (x - out.mean(0)) / out.std(0)
    o = z[event == 0]
    n, s = len(o), np.cov(o.T, bias=True)
    level = np.trace(s) / 3
    away = ((s - level * np.eye(3)) ** 2).sum() / 3
    noise = sum(((np.outer(v, v) - s) ** 2).sum() for v in o) / n**2 / 3
    cov = s + min(noise, away) / away * (level * np.eye(3) - s)
    values, vectors = np.linalg.eigh(cov)
    root = vectors @ np.diag(values**-0.5) @ vectors.T
    towards = root @ ((z[event == 1].mean(0) + z[event == 2].mean(0)) / 2)
    along, distance = z @ root @ towards / np.linalg.norm(towards), ((z @ root) ** 2).sum(1)
    robust = lambda v: (v - np.median(v)) / (1.4826 * np.median(np.abs(v - np.median(v))))
    assert [r["along"] for r in got] == pytest.approx(list(along))
    assert [r["distance"] for r in got] == pytest.approx(list(distance))
    assert [r["combined"] for r in got] == pytest.approx(list((robust(along) + robust(distance)) / 2))
    with pytest.raises(ValueError, match="fitting mean"):
        covariance.taught_direction(rows, "v", 3, rows.withColumn("event", F.lit(0)))


def test_same_phase_finds_a_cycle(spark):
    hourly = spark.createDataFrame([("u", "c", h, float(h % 4)) for h in range(40) if h != 17] + [("u", "d", 3, 1.0), ("u", "d", 9, 2.0)], "unit string, channel string, hour long, mean double")
    rows = {(r["channel"], r["hour"]): r for r in forecasts.same_phase(forecasts.history(hourly, 24), 24).collect()}
    assert rows["c", 39]["lag"] == 4 and rows["c", 39]["same_phase"] == 3.0
    assert rows["c", 21]["lag"] == 8  # the hour four back was not read
    assert rows["d", 9]["lag"] is None and rows["d", 9]["same_phase"] == 1.0
    assert ("d", 3) not in rows
    assert spark.range(1).select(forecasts.season_of(F.lit(13), 24), forecasts.season_of(F.lit(12), 24)).first()[:] == (1, 12)


def test_clipped_ridge_stays_in_range(spark):
    rows = spark.createDataFrame([("a", float(i), 2.0 * i, i % 2) for i in range(20)], "key string, x double, y double, fold int")
    far = spark.createDataFrame([("a", 100.0), ("b", 1.0)], "key string, x double")
    got = forecasts.clipped_ridge(rows, far, ["key"], ["x"], "y", [1e-9]).collect()
    assert len(got) == 1 and got[0]["predicted"] == pytest.approx(38.0, abs=1e-3)


def test_sides_by_hand(spark):
    units = spark.createDataFrame([(f"u{i}", m) for i, m in enumerate([5.0, 4.0, 4.0, 2.0, 0.5, 0.4, 0.3, 0.2, 0.1, 0.0])], "unit string, mean_square double")
    got = {r["unit"]: r["side"] for r in sides.held_out_by_weight(units, 1.0, 0.4, 1).collect()}
    assert [got[f"u{i}"] for i in range(4)] == ["training", "held_out", "training", "held_out"] and list(got.values()).count("held_out") == 4
    with pytest.raises(ValueError, match="more than"):
        sides.held_out_by_weight(units, 1.0, 0.1, 1)
    split = units.withColumn("side", F.lit("training"))
    assert sides.task_split(split, units.limit(3).select("unit")).count() == 7
    pool = spark.createDataFrame([(str(i), 7) for i in range(23)], "unit string, target int")
    small = {r["unit"] for r in sides.draw_stratified(pool, "target", ["unit"], 5, 9, 1).collect()}
    large = {r["unit"] for r in sides.draw_stratified(pool, "target", ["unit"], 5, 22, 1).collect()}
    assert len(small) == 9 and len(large) == 22 and small < large
    with pytest.raises(ValueError, match="fewer rows"):
        sides.draw_stratified(pool.limit(3), "target", ["unit"], 5, 2, 1)


def test_thin_to_cap_by_hand(spark):
    rows = spark.createDataFrame([("u", "c", float(t), float(t)) for t in range(100)] + [("u", "d", 1.0, 1.0), ("u", "d", 1.0, 1.0)], "unit string, channel string, time double, value double")
    got = sides.thin_to_cap(rows, 10, 1.0)
    assert sorted(r["time"] for r in got.where("channel = 'c'").collect()) == [float(t) for t in range(0, 100, 10)]
    assert got.where("channel = 'd'").count() == 2
    assert sides.thin_to_cap(rows.limit(0), 10, 1.0).count() == 0


def test_joined_history_refuses_overlap(spark):
    wins = spark.createDataFrame([("u", 0, 0.0, 10.0), ("u", 1, 5.0, 15.0)], "unit string, position int, win_start double, win_end double")
    cells = spark.createDataFrame([("u", 0, "c", 0, 1.0)], "unit string, position int, channel string, bin int, mean double")
    with pytest.raises(ValueError, match="overlap"):
        ctx.join_history(cells, wins, 2, 10.0, 2)
    apart = wins.where("position = 0").unionByName(spark.createDataFrame([("u", 1, 10.05, 20.05), ("u", 2, 25.0, 35.0)], wins.schema))
    got = ctx.join_history(cells, apart, 2, 10.0, 2).collect()
    assert sorted((r["position"], r["bin"]) for r in got) == [(0, 2), (1, 0)]


def test_first_finder_and_areas(spark):
    found = spark.createDataFrame([(1, "d", "late", 1, True), (1, "d", "late", 2, False), (1, "e", "early", 1, True), (1, "e", "early", 2, False), (1, "e", "early", 3, False), (2, "d", "late", 1, False)], "event int, detector string, family string, repeat int, found boolean")
    assert {r["event"]: r["finder"] for r in finding.first_finder(found, ["early", "late"]).collect()} == {1: "late", 2: "nothing"}
    rows = spark.createDataFrame([("a", 1, "x", 3.0), ("a", 0, "x", 3.0), ("b", 0, "x", 1.0), ("b", 0, "x", 4.0)], "unit string, event int, arm string, score double")
    once = spark.createDataFrame([(0, "a", 1), (0, "b", 1), (1, "a", 2), (1, "b", 0)], "draw int, unit string, k long")
    got = {r["draw"]: r["area"] for r in rankings.areas(rows, once, "auroc").collect()}
    assert got == {0: pytest.approx(0.5), 1: pytest.approx(0.5)}


def test_stacked_rows_and_fleet(spark):
    a = spark.createDataFrame([(str(i), float(i)) for i in range(10)], "unit string, y double")
    got = learners.stacked_rows({"p": (a, 2.0), "q": (a.withColumn("more", F.lit(1)), 1.0)}, ["unit"], "y", 4, 1)
    assert got.groupBy("corpus").count().count() == 2 and got.count() == 8 and got.where("corpus = 'p' AND y > 4.5").count() == 0
    assert layouts.window_losses(spark.createDataFrame([("u", 0, 1.0, None)], "unit string, position int, target double, a double"), ["a"]).count() == 0
