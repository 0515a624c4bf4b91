"""Trees against a plain search over all splits, summed histograms against rows at hand, weights of events."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from obsengine.operators import trees


def _plain(x: np.ndarray, y: np.ndarray, w: np.ndarray, cuts: list, outcome: bool, rounds: int, depth: int, rate: float, l2: float, least: float) -> np.ndarray:
    """The raw answers of trees grown row by row, every split tried, gaps on both sides."""
    raw = np.full(len(y), 0.0 if outcome else np.average(y, weights=w))

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, left: int) -> dict:
        score = lambda i: g[i].sum() ** 2 / (h[i].sum() + l2)
        best = (1e-9, None)
        if left:
            for j in range(x.shape[1]):
                for c in cuts[j]:
                    for gap in (True, False):
                        go = np.where(np.isnan(x[rows, j]), gap, x[rows, j] <= c)
                        a, b = rows[go], rows[~go]
                        if h[a].sum() >= least and h[b].sum() >= least and (gain := score(a) + score(b) - score(rows)) > best[0] + 1e-12:
                            best = (gain, (a, b))
        if best[1] is None:
            return {"rows": rows}
        return {"kids": [grow(part, g, h, left - 1) for part in best[1]]}

    def put(node: dict, g: np.ndarray, h: np.ndarray) -> None:
        if "kids" in node:
            for kid in node["kids"]:
                put(kid, g, h)
        elif len(node["rows"]):
            raw[node["rows"]] -= rate * g[node["rows"]].sum() / (h[node["rows"]].sum() + l2)

    for _ in range(rounds):
        g, h = trees.gradients(raw.copy(), y, w, outcome)
        put(grow(np.arange(len(y)), g, h, depth), g, h)
    return raw


def _rows(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    r = np.random.default_rng(4)
    x = r.normal(size=(n, 3)).round(2)
    y = (x[:, 0] + np.where(x[:, 1] > 0.3, 1.5, 0) + r.normal(size=n) * 0.3 > 0.6).astype(float)
    x[r.random(n) < 0.2, 0] = np.nan
    x[(y == 1) & (r.random(n) < 0.4), 2] = np.nan
    return x, y, r.uniform(0.5, 2, n)


def _table(spark, x, y, w):
    return spark.createDataFrame([(*[None if np.isnan(v) else float(v) for v in row], float(t), float(q)) for row, t, q in zip(x, y, w, strict=True)], "a double, b double, c double, y double, w double")


@pytest.mark.parametrize("outcome", [True, False])
def test_trees_are_those_of_a_plain_search(spark, outcome):
    x, y, w = _rows(160)
    y = y if outcome else y * 3 + np.nan_to_num(x[:, 1])
    model = trees.fit_trees(_table(spark, x, y, w), ["a", "b", "c"], "y", outcome, "w", rounds=6, depth=2, bins=8)
    want = _plain(x, y, w, model.cuts, outcome, 6, 2, 0.1, 1.0, 1.0)
    assert model.raw(model.binned(x)) == pytest.approx(want)


def test_summed_histograms_are_those_of_rows_at_hand(spark):
    x, y, w = _rows(300)
    rows = _table(spark, x, y, w).repartition(4)
    here = trees.fit_trees(rows, ["a", "b", "c"], "y", True, "w", rounds=3)
    apart = trees.fit_trees(rows, ["a", "b", "c"], "y", True, "w", rounds=3, at_hand=10)
    assert (here.feature == apart.feature).all() and (here.bin == apart.bin).all() and (here.gap_left == apart.gap_left).all()
    assert apart.value == pytest.approx(here.value)


def test_gaps_go_where_they_help(spark):
    rows = spark.createDataFrame([(None if i % 4 == 0 else float(i % 7), int(i % 4 == 0)) for i in range(200)], "a double, y int")
    model = trees.fit_trees(rows, ["a"], "y", True, rounds=30)
    assert trees.score_trees(model, rows).where((F.col("predicted") > 0.5) != (F.col("y") == 1)).count() == 0
    assert trees.score_trees(model, rows.drop("a")).where("predicted < 0.5").count() == 0


def test_long_events_weigh_as_much_as_short_ones(spark):
    data = [(1.0, 1)] * 90 + [(2.0, 2)] + [(0.0, None)] * 50
    rows = spark.createDataFrame(data, "a double, event int")
    told = {r["a"]: r["score"] for r in trees.score_trees(trees.taught_trees(rows, ["a"], rounds=20), rows, "score", raw=True).distinct().collect()}
    assert told[1.0] == pytest.approx(told[2.0], abs=0.05) and told[0.0] < 0 < told[1.0]
    with pytest.raises(ValueError, match="outside"):
        trees.taught_trees(rows.where("event IS NOT NULL"), ["a"])


def test_many_rows_that_hardly_differ_are_fitted_as_few(spark, monkeypatch):
    x, y, w = _rows(60)
    many = _table(spark, np.tile(x, (5, 1)), np.tile(y, 5), np.tile(w, 5))
    here = trees.fit_trees(many, ["a", "b", "c"], "y", True, "w", rounds=3)
    tried = []
    own = trees.fit_bins
    monkeypatch.setattr(trees, "fit_bins", lambda bins, *rest: tried.append(len(bins)) or own(bins, *rest))
    few = trees.fit_trees(many, ["a", "b", "c"], "y", True, "w", rounds=3, at_hand=100)
    assert tried and tried[0] <= 60 and (here.feature == few.feature).all() and few.value == pytest.approx(here.value)
