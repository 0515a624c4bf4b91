"""Ten thousand draws against their counts laid out whole, and what multinomial counts must be."""

import hashlib

import numpy as np
import pytest

from obsengine.operators import multinomial as m


def _counts(units: list[str], seed: int, draws: int, stratum: str = "") -> dict[str, np.ndarray]:
    """Every unit's counts, from all leaves at once."""
    order = sorted(units, key=lambda u: (hashlib.sha256(f"{seed}|{u}".encode()).hexdigest(), u))
    out = {}
    for leaf, taken in m.leaf_shares(seed, stratum, len(order), draws, 0, 1 << 40):
        own = order[leaf * m.LEAF : (leaf + 1) * m.LEAF]
        counts = m.place_counts(seed, stratum, leaf, taken, len(own))
        out.update({u: counts[:, i] for i, u in enumerate(own)})
    return out


def _pairs(n: int) -> list[tuple]:
    r = np.random.default_rng(9)
    return [(f"u{i}", float(r.gamma(2)), int(r.integers(1, 9)), float(r.gamma(1.8)), int(r.integers(1, 9)), "ab"[i % 2]) for i in range(n)]


def test_leaves_of_a_task_change_no_draw(spark):
    pairs = spark.createDataFrame(_pairs(1000), "unit string, se_a double, n_a int, se_b double, n_b int, stratum string")
    one, four = ({r["draw"]: tuple(r)[1:] for r in m.drawn_sums(pairs, "unit", m.SUMS, 100, 5, leaves=n).collect()} for n in (32, 1))
    assert len(one) == 100 and all(one[d] == pytest.approx(four[d]) for d in one)


def test_reduction_is_that_of_the_counts(spark):
    rows, draws = _pairs(1000), 500
    pairs = spark.createDataFrame(rows, "unit string, se_a double, n_a int, se_b double, n_b int, stratum string")
    for strata in (None, "stratum"):
        k = {}
        for s in ("a", "b") if strata else ("",):
            k.update(_counts([r[0] for r in rows if not s or r[5] == s], 5, draws, s))
        assert all(sum(k[r[0]][d] for r in rows) == len(rows) for d in range(0, draws, 50))
        sums = np.array([[sum(k[r[0]][d] * r[i] for r in rows) for i in (1, 2, 3, 4)] for d in range(draws)])
        want = np.sqrt(sums[:, 0] / sums[:, 1]) - np.sqrt(sums[:, 2] / sums[:, 3])
        got = m.paired_reduction(pairs, 5, draws, strata=strata).first()
        assert (got["low"], got["high"]) == pytest.approx(tuple(np.quantile(want, [0.025, 0.975])))
        assert got["p"] == pytest.approx(min(1, 2 * min((want <= 0).sum() + 1, (want >= 0).sum() + 1) / (draws + 1)))


def test_counts_are_multinomial():
    n, draws = 600, 4000
    k = np.stack(list(_counts([str(i) for i in range(n)], 3, draws).values()), axis=1)
    assert (k.sum(axis=1) == n).all()
    assert k.mean(axis=0) == pytest.approx(np.ones(n), abs=0.08)
    assert k.var() == pytest.approx(1 - 1 / n, abs=0.02)
    assert np.corrcoef(k[:, 0], k[:, -1])[0, 1] == pytest.approx(-1 / n, abs=0.06)


def test_repeats_are_drawn_too(spark):
    r = np.random.default_rng(1)
    rows = [(p, f"u{i}", float(r.gamma(2) + (p == 1)), 3, float(r.gamma(2)), 3) for p in range(4) for i in range(40)]
    pairs = spark.createDataFrame(rows, "repeat int, unit string, se_a double, n_a int, se_b double, n_b int")
    draws = 300
    ku, kr = _counts([f"u{i}" for i in range(40)], 7, draws), _counts(list("0123"), 8, draws)
    one, both = [], []
    for d in range(draws):
        for out, use in ((one, False), (both, True)):
            s = [sum(row[i] * ku[row[1]][d] * (kr[str(row[0])][d] if use else 1) for row in rows) for i in (2, 3, 4, 5)]
            out.append(np.sqrt(s[0] / s[1]) - np.sqrt(s[2] / s[3]))
    got = m.two_level(pairs, 7, draws).first()
    assert (got["low"], got["high"]) == pytest.approx(tuple(np.quantile(one, [0.025, 0.975])))
    assert (got["low_both"], got["high_both"]) == pytest.approx(tuple(np.quantile(both, [0.025, 0.975])))
    assert got["share_from_repeats"] == pytest.approx(min(1, max(0, 1 - np.var(one) / np.var(both))))


def test_ratios_and_gaps(spark):
    rows = [(f"u{i}", float(i % 5), float(i % 3 + 1), None if i == 4 else 1.0) for i in range(60)] + [(None, 9.0, 9.0, 9.0)]
    t = spark.createDataFrame(rows, "unit string, a double, b double, c double")
    draws = 200
    got = {r["answer"]: r for r in m.ratio_of_sums(t.where("unit IS NOT NULL"), ["a", "c"], "b", 1, draws).collect()}
    k = _counts([r[0] for r in rows[:-1]], 1, draws)
    want = [1 - sum(k[u][d] * a for u, a, *_ in rows[:-1]) / sum(k[u][d] * b for u, _, b, _ in rows[:-1]) for d in range(draws)]
    assert (got["a"]["low"], got["a"]["high"]) == pytest.approx(tuple(np.quantile(want, [0.025, 0.975])))
    assert got["c"]["skill"] == pytest.approx(1 - 59 / 120)
    geo = m.geometric_ratio(t.where("unit IS NOT NULL"), "a", ["b", "c"], 1, draws).first()
    assert geo["low"] <= geo["ratio"] <= geo["high"]
