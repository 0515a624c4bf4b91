import numpy as np
from pyspark.sql import functions as F

from obsengine.llm import neighbours

SCHEMA = "vec_id long, embedding array<float>, label int, v string"


def brute(rows, queries, k=5):
    ids = np.array([r[0] for r in rows])
    x = np.array([r[1] for r in rows], np.float64)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for q in np.flatnonzero(np.isin(ids, queries)):
        score = np.round(u @ u[q], 12)
        near = sorted((-s, i) for s, i in zip(score.tolist(), ids.tolist(), strict=True) if i != ids[q])[:k]
        out[int(ids[q])] = [(i, -s) for s, i in near]
    return out


def test_orders_and_footrule():
    rng = np.random.default_rng(0)
    x, p = rng.standard_normal((40, 8)), rng.standard_normal((20, 8))
    o = neighbours.orders(x, p, 6)
    assert (o == np.argsort(-(x @ p.T), axis=1)[:, :6]).all()
    place = np.full((40, 20), 6)
    np.put_along_axis(place, o, np.arange(6)[None, :], 1)
    want = 6 * 7 - np.abs(place[:10, None] - place[None]).sum(2)
    assert (neighbours.footrule_gain(o[:10], neighbours.postings(o, 20), 40) == want).all()


def test_cosines_of_candidates_alone():
    rng = np.random.default_rng(3)
    x, q, p = rng.standard_normal((900, 16)), rng.standard_normal((7, 16)), rng.standard_normal((100, 16))
    p /= np.linalg.norm(p, axis=1, keepdims=True)
    own = neighbours.footrule_gain(neighbours.orders(q, p, 20), neighbours.postings(neighbours.orders(x, p, 20), 100), 900)
    a, b, score, scored = neighbours.nearest(q, x, own, 90, 6)
    edge = np.sort(own, axis=1)[:, -90]
    assert scored == (own >= edge[:, None]).sum() < 7 * 200
    assert (own[a, b] >= edge[a]).all()
    assert np.allclose(score, (x[b] * q[a]).sum(1) / np.linalg.norm(x[b], axis=1) / np.linalg.norm(q[a], axis=1))


def test_lengths_are_indexes_of_their_own(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.standard_normal(3 + i % 2).tolist(), 0, "") for i in range(200)]
    got = neighbours.search(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 50 == 0, pivots=20, prefix=9, least=200).collect()
    for parity in (0, 1):
        some = [r for r in rows if r[0] % 2 == parity]
        for q, near in brute(some, [r[0] for r in some if r[0] % 50 == 0]).items():
            assert [i for i, _ in near] == [r.vec_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == q]


def test_recall_and_exact_scores(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.standard_normal(64).astype("f4").tolist(), 0, "clash") for i in range(3000)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = neighbours.search(df, F.col("vec_id") % 50 == 0, block=700, query_block=40, pivots=500).collect()
    want = brute(rows, range(0, 3000, 50))
    found = {(r.query_id, r.vec_id): r.score for r in got}
    hits = [(q, i) in found for q, near in want.items() for i, _ in near]
    assert np.mean(hits) >= 0.9
    assert len(got) == 5 * len(want)
    for q, near in want.items():
        for i, s in near:
            assert abs(found.get((q, i), s) - s) < 1e-9
        own = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in own] == [1, 2, 3, 4, 5]
        assert [(-r.score, r.vec_id) for r in own] == sorted((-r.score, r.vec_id) for r in own)


def test_copies_ties_and_unusable_vectors(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal(4).astype("f4").tolist()
    rows = [(i, base, 0, "") for i in range(0, 400)] + [(1000 + i, rng.standard_normal(4).astype("f4").tolist(), 0, "") for i in range(60)]
    odd = [(2000, None, 0, ""), (2050, [0.0] * 4, 0, ""), (2100, [1.0, None, 2.0, 3.0], 0, ""), (2150, [float("nan")] * 4, 0, ""), (2200, [float("inf"), 0.0, 0.0, 0.0], 0, ""), (2250, [], 0, ""), (2300, [1.0, 2.0], 0, ""), (None, base, 0, ""), (7, base, 0, "")]
    df = spark.createDataFrame(rows + odd, SCHEMA)
    got = neighbours.search(df, F.col("vec_id") % 50 == 0).collect()
    want = brute(rows, [r[0] for r in rows if r[0] % 50 == 0])
    assert sorted((r.query_id, r.rank, r.vec_id) for r in got) == sorted((q, k, i) for q, near in want.items() for k, (i, _) in enumerate(near, 1))


def test_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], 0, ""), (1, [1.0, 1.0], 0, "")], SCHEMA)
    assert [(r.query_id, r.rank, r.vec_id) for r in neighbours.search(df, F.col("vec_id") % 50 == 0).collect()] == [(0, 1, 1)]
    assert neighbours.search(df.limit(0), F.col("vec_id") % 50 == 0).collect() == []
    assert neighbours.search(df.limit(1), F.lit(True)).collect() == []


def test_pivots_are_the_least_ranks_of_a_length(spark):
    """Few pivots of many rows are the same as by ranking them all; no task ranks more than some more of them."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 8))
    rows = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    found = neighbours.search(rows, F.col("vec_id") % 50 == 0, 5, pivots=64, prefix=16, share=0.2).toPandas()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    cosine = unit[::50] @ unit.T
    cosine[np.arange(60), np.arange(60) * 50] = -2
    best = np.argsort(-cosine, axis=1)[:, :5]
    hit = sum(len(set(best[q // 50]) & set(part["vec_id"])) for q, part in found.groupby("query_id"))
    assert len(found) == 300 and hit / 300 >= 0.9
