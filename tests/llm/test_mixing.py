import hashlib
import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from obsengine.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, _rank string"

def levels():
    return {"domain": F.substring("source", 1, 1), "lang": F.col("lang"), "source": F.col("source")}


WEIGHTS = {("a",): 3.0, ("b",): 1.0, ("a", "en"): 2.0, ("c",): 0.0}


def rows(n=2000, seed=0):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        source = rng.choice(["a1", "a1", "a1", "a1", "a2", "a3", "b1", "b2", "c1"])
        out.append((i, " ".join(["w"] * rng.randint(0, 20)), rng.choice(["en", "en", "de", None]), source, "clash"))
    return out


def divide(budget, kids):
    """Water-filling by repeated shares: {name: (weight, cap)} to {name: amount}."""
    got = dict.fromkeys(kids, 0.0)
    open_ = {k for k, (w, c) in kids.items() if w > 0}
    left = budget
    while open_ and left > 1e-9:
        total = sum(kids[k][0] for k in open_)
        full = {k for k in open_ if kids[k][1] <= left * kids[k][0] / total + 1e-9}
        if not full:
            for k in open_:
                got[k] = left * kids[k][0] / total
            return got
        for k in full:
            got[k] = kids[k][1]
            left -= kids[k][1]
        open_ -= full
    return got


def brute(rows, budget, epochs):
    tree = defaultdict(lambda: defaultdict(lambda: defaultdict(list)))
    for r in rows:
        tree[r[3][0]][r[2]][r[3]].append(r)
    size = lambda r: len((r[1] or "").split())
    cap = lambda x: sum(map(cap, x.values())) if isinstance(x, dict) else epochs * sum(map(size, x))
    weight = lambda *p: WEIGHTS.get(tuple("\x1e" if x is None else x for x in p), 1.0)
    out = {}
    top = divide(min(budget, cap(tree)), {d: (weight(d), cap(tree[d])) for d in tree})
    for d in tree:
        langs = divide(top[d], {k: (weight(d, k), cap(tree[d][k])) for k in tree[d]})
        for k in tree[d]:
            leaves = divide(langs[k], {s: (weight(d, k, s), cap(tree[d][k][s])) for s in tree[d][k]})
            for s in leaves:
                out[d, k, s] = (leaves[s], tree[d][k][s])
    return out


def rank(*parts):
    return int(hashlib.sha256("\x1f".join(("42", *map(str, parts))).encode()).hexdigest()[:15], 16)


@pytest.mark.parametrize(("budget", "epochs", "bucket"), [(3000, 1, 2000), (12000, 1, 20), (30000, 2, 100), (10**6, 3, 2000), (1, 1, 2000)])
def test_rows_are_those_of_brute_force(spark, budget, epochs, bucket):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA).repartition(4)
    got = mixing.mix(df, levels(), WEIGHTS, budget=budget, epochs=epochs, rows_a_bucket=bucket, epoch_to="epoch").collect()
    want = []
    for quota, own in brute(data, budget, epochs).values():
        held = sum(len(r[1].split()) for r in own)
        whole = int(min(epochs, quota / held + 1e-9)) if held else 0
        for epoch in range(epochs):
            mask = rank("epoch", epoch)
            done = epoch * held
            for r in sorted(own, key=lambda r: (rank(r[0]) ^ mask, r[0])):
                if epoch < whole or done < quota - 1e-6:
                    want.append((r[0], epoch))
                done += len(r[1].split())
    assert sorted((r.doc_id, r.epoch) for r in got) == sorted(want)
    assert got[0].__fields__ == [*df.columns, "epoch"]


def test_defined_cases(spark):
    odd = [(1, None, None, "a1", ""), (1, None, None, "a1", ""), (None, "x y", "en", None, ""), (None, None, None, None, None), (2, "w " * 50000, "en", "a1", "")]
    df = spark.createDataFrame(odd, SCHEMA)
    assert mixing.mix(df, levels(), WEIGHTS, share=1.0).count() >= 2
    assert mixing.mix(df.limit(0), levels(), WEIGHTS).collect() == []
    plan = mixing.mix(spark.createDataFrame(rows(50), SCHEMA), levels(), WEIGHTS)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


def test_levels_may_hold_the_signs_that_part_them(spark):
    """Two leaves whose levels, put one after another, read alike are two leaves, and null isn't the sign that stands for it."""
    kinds = [("a\x1fb", "c"), ("a", "b\x1fc"), ("\x1b1", "x"), ("\x1f", "x"), ("\x1e", "x"), (None, "x"), ("\x1b2", "x"), ("", "x")]
    docs = spark.createDataFrame([(100 * k + i, "w w", a, b) for k, (a, b) in enumerate(kinds) for i in range(20)], "doc_id long, text string, lang string, source string")
    weights = {("\x1f",): 3.0, (None,): 5.0, ("a\x1fb",): 2.0}
    got = mixing.mix(docs, {"lang": F.col("lang"), "source": F.col("source")}, weights, budget=150.0).groupBy("lang", "source").count().collect()
    # Null is full at 40 words; the other 110 go over weights of 10 in all, and a quota is passed by less than a document.
    want = {k: 20 if k[0] is None else math.ceil(11 * weights.get((k[0],), 1.0) / 2) for k in kinds}
    assert {(r["lang"], r["source"]): r["count"] for r in got} == want
    back = docs.select("lang", mixing.path(F.col("lang"), F.col("source")).alias("p")).select("lang", mixing.level("p", 0).alias("l"), mixing.level("p", 1).alias("s"))
    assert back.where("NOT (lang <=> l)").count() == 0 and {r["s"] for r in back.collect()} == {"c", "b\x1fc", "x"}
