import random
import zlib

import numpy as np
import pytest

from obsengine.llm import toxicity

SCHEMA = "doc_id long, text string, score string"


def sample(n, seed=0):
    rng = random.Random(seed)
    words = ["".join(rng.choices("etaoinshr", k=rng.randint(2, 7))) for _ in range(300)]
    rows = []
    for i in range(n):
        toxic = rng.random() < 0.2
        said = rng.choices(words, k=rng.randint(5, 120))
        for _ in range(2 * toxic):
            said.insert(rng.randrange(len(said)), rng.choice(["zorgwit", "Blarfun", "krumpled"]))
        rows.append((i, " ".join(said), int(toxic)))
    return rows


def plain(text, n):
    raw = f" {text} ".lower().replace("\t", " ").encode()
    return [raw[i : i + n] for i in range(len(raw) - n + 1) if b" " not in raw[i + 1 : i + n - 1]]


def test_ngrams_by_hand():
    for text in ("", "a", "Hello  big\tworld", "é ü", "x" * 50):
        for n in (3, 5):
            got = [h for block in toxicity.ngrams(text, (n,), 20) for h in block.tolist()]
            want = plain(text, n)
            assert len(got) == len(want)
            assert len(set(got)) == len(set(want))


def test_scores_of_a_dense_refit():
    rows = sample(150, seed=3)
    y = np.array([r[2] for r in rows], float)
    held = [{g for n in toxicity.ORDERS for g in plain(r[1], n)} for r in rows]
    names = sorted(set().union(*held))
    has = np.array([[g in h for g in names] for h in held], float)
    p, q = has[y == 1].sum(0) + 1, has[y == 0].sum(0) + 1
    ratio = np.log(p / ((y == 1).sum() + 2) / (q / ((y == 0).sum() + 2)))
    told = (has.sum(0) >= 3) & (abs(ratio) > 2 * np.sqrt(1 / p + 1 / q))
    x = np.column_stack([has[:, told] * ratio[told], np.ones(len(y))])
    w, step = np.zeros(x.shape[1]), 4 / np.linalg.norm(x, 2) ** 2
    for _ in range(20000):  # proximal gradient, no penalty on the bias
        w -= step * (x.T @ (1 / (1 + np.exp(-x @ w)) - y))
        w[:-1] = np.sign(w[:-1]) * np.maximum(abs(w[:-1]) - step * 2.0, 0)
    m = toxicity.fit([r[1] for r in rows], [r[2] for r in rows], bits=24, rounds=5000)
    assert len(m.weights) > 1
    assert np.allclose([m.score(r[1]) for r in rows], 1 / (1 + np.exp(-x @ w)), atol=1e-3)


def test_a_text_that_no_longer_fits_is_passed_over(spark):
    rows = [(i, t + " x" * 100_000 if i % 7 == 0 else t, "") for i, t, _ in sample(200)]
    labels = spark.createDataFrame([(i, 0, y) for i, _, y in sample(200)], "doc_id long, quality int, toxic int")
    short = [r if r[0] % 7 else (r[0], None, "") for r in rows]
    chars = sum(len(t or "") for _, t, _ in short)
    one = toxicity.fit_table(spark.createDataFrame(rows, SCHEMA), labels, most_chars=chars)
    two = toxicity.fit_table(spark.createDataFrame([r for r in rows if r[0] % 7], SCHEMA), labels)
    assert len(one.weights) > 1 and (one.weights == two.weights).all() and one.bias == two.bias
    with pytest.warns(UserWarning, match="label 0"):
        toxicity.fit_table(spark.createDataFrame(rows, SCHEMA), labels.selectExpr("doc_id", "quality", "0 AS toxic"))


def test_a_text_in_blocks_scores_as_a_whole(monkeypatch):
    rows = sample(200)
    m = toxicity.fit([r[1] for r in rows], [r[2] for r in rows])
    text = " ".join(r[1] for r in rows[:30])
    whole = m.score(text)
    monkeypatch.setattr(toxicity, "AT_ONCE", 37)
    assert m.score(text) == whole


def test_held_out_accuracy_and_rows(spark):
    rows = sample(1500)
    docs = spark.createDataFrame([(i, t, "clash") for i, t, _ in rows] + [(None, None, ""), (1, rows[1][1], ""), (5000, "", ""), (5001, "clean word " * 40000 + "zorgwit blarfun", "")], SCHEMA)
    labels = spark.createDataFrame([(i, 0, y) for i, _, y in rows] + [(None, 0, 1), (3, 0, None), (7, 0, 9)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(docs, labels, most_rows=800).collect()
    assert len(got) == len(rows) + 4
    y = {i: v for i, _, v in rows}
    held = [r for r in got if r.doc_id is not None and r.held_out]
    assert {r.doc_id for r in held} == {r.doc_id for r in got if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0}
    known = [r for r in held if r.doc_id in y]
    assert np.mean([r.predicted == y[r.doc_id] for r in known]) > 0.98
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert {r.doc_id: r.predicted for r in got}[5001] == 1


def test_held_out_labels_are_not_learnt(spark):
    rows = sample(400)
    docs = spark.createDataFrame([(i, t, "") for i, t, _ in rows], SCHEMA)
    flipped = [(i, 0, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, _, y in rows]
    one, two = (toxicity.fit_table(docs, spark.createDataFrame(x, "doc_id long, quality int, toxic int")) for x in ([(i, 0, y) for i, _, y in rows], flipped))
    assert (one.weights == two.weights).all() and one.bias == two.bias


def test_empty_tables(spark):
    docs, labels = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.toxicity(docs, labels).collect() == []
    got = toxicity.toxicity(spark.createDataFrame([(1, "a", "")], SCHEMA), labels).collect()
    assert got[0].score == 0.5
