"""Leave-one-out errors against refits, several targets against one at a time, cells' history by hand, pairs against pandas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from obsengine.operators import forecasts, layouts, learners, ridges, windows


def _solved(x, y, penalty):
    mean, level = x.mean(0), y.mean()
    c = x - mean
    w = np.linalg.solve(c.T @ c + penalty * np.eye(x.shape[1]), c.T @ (y - level))
    return level - mean @ w, w


def test_left_out_errors_are_those_of_refits(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(40, 5)) * [1, 5, 0.2, 1, 1]
    x[:, 4] = 2.0  # constant
    y = x @ [1, -0.2, 3, 0, 0] + r.normal(size=40)
    rows = spark.createDataFrame([(v.tolist(), float(t)) for v, t in zip(x, y, strict=True)] + [([0.0] * 5, None)], "features array<double>, y double").repartition(3)
    model = ridges.loo_ridge(rows, "features", "y", [0.01, 1.0, 30.0])
    spread = x.std(0)
    z = x[:, :4] / spread[:4]
    for p, told in model.errors.items():
        lost = []
        for i in range(40):
            keep = np.arange(40) != i
            a, w = _solved(z[keep], y[keep], p)
            lost.append((y[i] - a - z[i] @ w) ** 2)
        assert told == pytest.approx(np.mean(lost))
    assert model.penalty == min(model.errors, key=model.errors.get)
    a, w = _solved(z, y, model.penalty)
    assert model.coefficients[:4] * spread[:4] == pytest.approx(w) and model.coefficients[4] == 0
    told = ridges.ridge_answer(model, rows, "features").where("y IS NOT NULL").toPandas()
    assert sorted(told["predicted"]) == pytest.approx(sorted(a + z @ w))
    with pytest.raises(ValueError, match="positive"):
        ridges.loo_ridge(rows, "features", "y", [0.0])


def test_several_targets_are_each_its_own(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=(200, 3))
    y = np.column_stack([x @ [1, 2, 0], r.normal(size=200), x[:, 2] ** 2])
    data = [("a" if i < 150 else "b", i % 2, *map(float, x[i]), *map(float, y[i])) for i in range(200)] + [("c", 0, 1.0, 1.0, 1.0, 5.0, 6.0, 7.0), ("a", 0, None, 1.0, 1.0, 0.0, 0.0, 0.0)]
    rows = spark.createDataFrame(data, "k string, fold int, u double, v double, w double, p double, q double, s double")
    tried = [1e-3, 0.1, 10.0]
    fits = {(f["k"], f["target"]): f for f in ridges.target_ridges(rows, ["k"], ["u", "v", "w"], ["p", "q", "s"], tried).collect()}
    for key, part in (("a", slice(0, 150)), ("b", slice(150, 200))):
        own, fold = x[part], np.arange(200)[part] % 2
        for j, name in enumerate("pqs"):
            def line(rows_, penalty, t=y[part][:, j], own=own):
                c = own[rows_] - own[rows_].mean(0)
                g = c.T @ c
                w = np.linalg.solve(g + penalty * np.diag(np.diag(g)), c.T @ (t[rows_] - t[rows_].mean()))
                return t[rows_].mean() - own[rows_].mean(0) @ w, w

            t = y[part][:, j]
            lost = {}
            for penalty in tried:
                lost[penalty] = sum(((t[fold == 1 - f] - line(fold == f, penalty)[0] - own[fold == 1 - f] @ line(fold == f, penalty)[1]) ** 2).sum() for f in (0, 1))
            fit = fits[key, name]
            assert fit["penalty"] == min(lost, key=lost.get)
            a, w = line(np.ones(len(t), bool), fit["penalty"])
            assert fit["intercept"] == pytest.approx(a, abs=1e-9) and fit["coefficients"] == pytest.approx(list(w), abs=1e-9)
    assert fits["c", "q"]["intercept"] == 6.0 and fits["c", "q"]["coefficients"] == [0.0] * 3
    told = ridges.target_answers(rows, ridges.target_ridges(rows, ["k"], ["u", "v", "w"], ["p", "q", "s"], tried), ["k"], ["u", "v", "w"], ["p", "q", "s"], rows)
    assert told.where("u IS NULL").first()["predicted_p"] is None
    assert told.where("k = 'c'").first()["predicted_s"] == 7.0


def test_cell_history_by_hand(spark):
    cell = "unit string, position long, channel string, bin int, presence int, log_count double, mean double, minimum double, maximum double, first double, last double, last_offset double, since int"
    rows = [("u", 0, "a", b, int(b != 1), 0.7, float(b), 0.0, 1.0, 2.0, 3.0, 0.5, 0) for b in range(2)] + [("u", 1, "a", 0, 1, 0.7, 9.0, 0.0, 1.0, 2.0, 3.0, 0.5, 0), ("u", 0, "b", 1, 1, 0.7, 5.0, 0.0, 1.0, 2.0, 3.0, 0.5, 0), ("u", 3, "a", 0, 1, 0.7, 8.0, 0.0, 1.0, 2.0, 3.0, 0.5, 0)]
    out, x = forecasts.cell_history_rows(spark.createDataFrame(rows, cell), 2, 2, ["a", "b"])
    got = {(r["channel"], r["hour"]): r for r in out.collect()}
    assert set(got) == {("a", 0), ("a", 2), ("a", 6), ("b", 1)} and len(x) == 2 * (9 + 2)
    two = got["a", 2]
    assert (two["f1_mean"], two["f1_presence"], two["f2_mean"], two["f2_presence"], two["o1_b"], two["o2_b"], two["o1_a"]) == (1.0, 0.0, 0.0, 1.0, 5.0, 0.0, 0.0)
    assert got["a", 6]["f1_presence"] == 0 and got["b", 1]["o1_a"] == 0.0


@pytest.mark.parametrize("sizes", [(2, 5), (64, 2048)])
def test_pairs_and_autocorrelations_are_those_of_pandas(spark, monkeypatch, sizes):
    monkeypatch.setattr(layouts, "UNITS_A_BLOCK", sizes[0])
    monkeypatch.setattr(layouts, "HOURS_A_BLOCK", sizes[1])
    r = np.random.default_rng(8)
    data = [(f"u{u}", "x", int(h), float(r.normal() + h * 0.1)) for u in range(7) for h in range(60) if r.random() < 0.8]
    data += [("flat", "x", h, 1.0) for h in range(60)]
    rows = spark.createDataFrame(data, "unit string, channel string, hour long, mean double")
    wide = pd.DataFrame(data, columns=["unit", "channel", "hour", "mean"]).pivot(index="hour", columns="unit", values="mean").reindex(range(60))
    changes = wide.diff()
    got = {(p["a"], p["b"]): p["correlation"] for p in layouts.unit_pair_correlations(rows, 5).collect()}
    for i, a in enumerate(sorted(wide)):
        for b in sorted(wide)[i + 1 :]:
            if "flat" in (a, b):
                assert got[a, b] is None
            else:
                assert got[a, b] == pytest.approx(changes[a].corr(changes[b]))
    own = {p["unit"]: p for p in layouts.unit_autocorrelations(rows, 1, 3).where(F.col("unit") != "flat").collect()}
    for u in own:
        assert own[u]["level"] == pytest.approx(wide[u].autocorr(1)) and own[u]["change"] == pytest.approx(changes[u].autocorr(3))


def test_cell_history_reads_cells_once_and_spans_batches(spark):
    cell = "unit string, position long, channel string, bin int, presence int, log_count double, mean double, minimum double, maximum double, first double, last double, last_offset double, since int"
    r = np.random.default_rng(4)
    rows = []
    for u in range(5):
        for p in range(6):
            for c in "abc":
                if r.random() < 0.7:
                    rows += [(f"u{u}", p, c, b, int(r.random() < 0.6), 0.7, None if r.random() < 0.1 else float(r.random()), *[float(v) for v in r.random(4)], None, b) for b in range(2)]
    laid = {(u, c, 2 * p + b): rest for u, p, c, b, *rest in rows}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        out, x = forecasts.cell_history_rows(spark.createDataFrame(rows, cell).coalesce(1), 2, 2, ["a", "b"])
        got = {(t["unit"], t["channel"], t["hour"]): t for t in out.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert "Window" not in out._jdf.queryExecution().toString() and set(got) == {k for k, v in laid.items() if v[0]}
    for (u, c, h), t in got.items():
        for i in (1, 2):
            own = laid.get((u, c, h - i), [0] * len(forecasts.CELL))
            assert [t[f"f{i}_{name}"] for name in forecasts.CELL] == [float(v or 0) for v in own]
            for o in "ab":
                assert t[f"o{i}_{o}"] == (0.0 if o == c else float(laid.get((u, o, h - i), [0, 0, 0])[2] or 0))


def test_sums_of_a_task_are_told_once(spark, monkeypatch):
    rows = spark.range(40).selectExpr("cast(id % 2 AS string) AS k", "cast(id % 2 AS int) AS fold", "cast(id AS double) AS x", "cast(id * id AS double) AS y").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    told = []
    try:
        seen = type(rows).mapInPandas
        monkeypatch.setattr(type(rows), "mapInPandas", lambda *a: told.append(seen(*a)) or told[-1])
        sums = learners.moment_sums(rows, ["k"], ["x"], "y")
        assert told[0].count() == 2 * 9  # a square for each key and fold, not for each batch
        assert {s["k"]: s["sums"][:2] for s in sums.collect()} == {"0": [20.0, 380.0], "1": [20.0, 400.0]}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_cells_are_laid_out_without_a_join(spark):
    rows = [("u", 0, "a", 1.0, 0.1, 0.1), ("u", 0, "a", 3.0, 0.2, 0.1), ("u", 0, "a", 5.0, 0.9, 0.7), ("u", 1, None, 2.0, 0.1, 0.1)]
    tokens = spark.createDataFrame(rows, "unit string, position int, channel string, value double, time double, gap double")
    out, framed = windows.cells(tokens, 3), windows.cells(tokens, 3, tokens)
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString() and out.dtypes == framed.dtypes
    assert sorted(out.collect(), key=str) == sorted(framed.collect(), key=str)
    got = {(c["channel"], c["bin"]): (c["presence"], c["mean"], c["since"]) for c in out.collect()}
    assert got == {("a", 0): (1, 2.0, 0), ("a", 1): (0, 3.0, 1), ("a", 2): (1, 5.0, 0), **{(None, b): (0, None, None) for b in range(3)}}
