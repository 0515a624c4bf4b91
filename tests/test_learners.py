"""Ridges against numpy, trees on a rule they can learn, rules on rows at their edges."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from obsengine.operators import layouts, learners, predicates


def test_ridge_equals_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 2))
    y = 3 + x @ [2.0, -1.0] + rng.normal(size=300) * 0.1
    data = [(i % 2 and "a" or "b", i // 2 % 2, float(u), float(v), float(t)) for i, ((u, v), t) in enumerate(zip(x, y, strict=True))] + [("c", 0, 1.0, 1.0, 5.0), ("a", 0, None, 1.0, 9.0)]
    rows = spark.createDataFrame(data, "key string, fold int, u double, v double, y double")
    fits = {r["key"]: r for r in learners.ridge(rows, ["key"], ["u", "v"], "y", [0.0, 0.01]).collect()}
    for key, odd in (("a", 1), ("b", 0)):
        own, t = x[odd::2], y[odd::2]
        c = own - own.mean(0)
        g = c.T @ c
        w = np.linalg.solve(g + fits[key]["penalty"] * np.diag(np.diag(g)), c.T @ (t - t.mean()))
        assert fits[key]["coefficients"] == pytest.approx(list(w))
        assert fits[key]["intercept"] == pytest.approx(t.mean() - own.mean(0) @ w)
    assert fits["c"]["coefficients"] == [0.0, 0.0] and fits["c"]["intercept"] == 5.0
    told = learners.ridge_answers(rows, learners.ridge(rows, ["key"], ["u", "v"], "y", [0.0]), ["key"], ["u", "v"])
    assert told.where("u IS NULL").first()["predicted"] is None


def test_trees_learn_a_rule(spark):
    rows = spark.createDataFrame([(str(i), i % 7 + 0.0, None if i % 5 == 0 else 1.0, int(i % 7 > 3), "training" if i % 3 else "held_out") for i in range(600)], "unit string, a double, b double, target int, side string")
    out = learners.fit_and_score(rows, "side", ["a", "b"], "target", ["unit"], 300, True)
    assert out.where((F.col("predicted") > 0.5) != (F.col("target") == 1)).count() == 0 and out.count() == 200
    model = learners.boosted_trees(rows, ["a", "b"], "target", False, rounds=3)
    assert learners.score_windows(model, rows.drop("b")).count() == 600
    with pytest.raises(ValueError, match="one outcome"):
        learners.boosted_trees(rows.where("target = 1"), ["a"], "target", True)


def test_refusals(spark):
    rows = spark.createDataFrame([("1", 0, 2)], "unit string, position int, outcome int")
    with pytest.raises(ValueError, match="nothing"):
        predicates.exclude_named(rows, ["2"])
    with pytest.raises(Exception, match="neither 0 nor 1"):
        predicates.outcome_labels(rows.drop("outcome"), rows, "outcome").collect()
    with pytest.raises(Exception, match="no truth"):
        predicates.label(rows, rows.limit(0).withColumn("target", F.lit(1.0))).collect()
    with pytest.raises(Exception, match="no statistics"):
        predicates.adopt_statistics(spark.createDataFrame([("x",)], "channel string"), spark.createDataFrame([], "channel string, mean double")).collect()


def test_verdicts(spark):
    rows = spark.createDataFrame([(1.0, 0.0, 0.2, 0.3), (1.0, 0.0, 0.01, 0.3), (1.0, 0.0, 0.01, 0.02), (1.0, 0.0, -0.3, -0.1), (1.0, None, -0.3, 0.3), (1.0, 0.0, -0.01, 0.01)], "error double, spread double, low double, high double")
    assert [r["verdict"] for r in layouts.verdict(rows, 0.05).collect()] == ["confirmed", "distinguishable", "practically nil", "worse", "indistinguishable", "practically nil"]


def test_whitened_and_subspace_distances(spark):
    from obsengine.operators import covariance

    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 4)) @ rng.normal(size=(4, 4))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, v array<double>")
    n, d = x.shape
    c = x - x.mean(0)
    s = c.T @ c / n
    level = np.trace(s) / d
    away = ((s - level * np.eye(d)) ** 2).sum() / d
    noise = sum(((np.outer(v, v) - s) ** 2).sum() for v in c) / n**2 / d
    cov = s + min(noise, away) / away * (level * np.eye(d) - s)
    want = np.einsum("ij,jk,ik->i", c, np.linalg.inv(cov), c)
    got = covariance.whitened_distance(rows, "v", 4).orderBy("id").collect()
    assert [r["distance"] for r in got] == pytest.approx(list(want))
    parts = covariance.subspace_distance(rows, "v", 4, share=1.0).agg(F.max("outside"), F.median("within")).first()
    assert parts[0] == pytest.approx(0, abs=1e-6) and parts[1] == pytest.approx(float(np.median(want)))
