import hashlib
import random

import pytest
from pyspark.sql import functions as F

from obsengine.llm import sketch
from obsengine.llm.common import durable

SCHEMA = "doc_id long, text string, next_text string"


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def rows():
    rng = random.Random(0)
    words = [f"w{i}" for i in range(2000)]
    out = [(i * 3, " ".join(rng.choices(words, k=rng.choice([3, 20, 60, 400, 2000]))), "clash") for i in range(300)]
    return out + [(1, None, ""), (2, "", ""), (4, "é😀 Two", ""), (7, out[9][1], ""), (7, out[9][1], ""), (10, "long " * 60000, "")]


@pytest.mark.parametrize("rows_a_range", [200, 5, 1])
def test_next_is_the_row_after(spark, rows_a_range):
    docs = spark.createDataFrame([*rows(), (None, "last", ""), (None, "latest", "")], SCHEMA).drop("next_text").repartition(5)
    got = sketch.with_next(docs, "doc_id", ["text"], "text", rows_a_range=rows_a_range).collect()
    order = sorted([*((i, t) for i, t, _ in rows()), (None, "last"), (None, "latest")], key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or ""))
    want = sorted(((i, t, n) for (i, t), (_, n) in zip(order, [*order[1:], order[0]], strict=True)), key=str)
    assert sorted(((r.doc_id, r.text, r.next_text) for r in got), key=str) == want


def test_edited_texts_and_likeness(spark):
    got = sketch.edited_likeness(spark.createDataFrame(rows(), SCHEMA)).collect()
    order = sorted(rows(), key=lambda r: (r[0], r[1] is not None, r[1] or ""))
    want, print_of, off = {}, {}, []
    for (i, t, _), (_, n, _) in zip(order, [*order[1:], order[0]], strict=True):
        t, n = t or "", n or ""
        cut = len(t) // 4
        edited = t[: len(t) - cut] + n[:cut]
        a, b, c = shingles(t), shingles(edited), shingles(n)
        want.setdefault(i, []).append((len(t), hashlib.sha256(edited.encode()).hexdigest(), len(a & b) / len(a | b), len(a & c) / len(a | c), t))
    assert len(got) == len(order)
    for r in got:
        same = [w for w in want[r.doc_id] if w[:2] == (r.n_chars, r.edited_sha256)]
        assert same
        off.append(min(abs(r.near_edited - w[2]) for w in same))
        assert min(abs(r.near_next - w[3]) for w in same) < 0.2
        if max(len(shingles(w[4])) for w in same) < 40:
            assert off[-1] < 0.01  # small sets are kept whole
        print_of.setdefault(same[0][4], set()).add(r.fingerprint)
    assert sum(off) / len(off) < 0.03 and max(off) < 0.25
    assert all(len(p) == 1 for p in print_of.values())
    assert len({p for s in print_of.values() for p in s}) == len(print_of)


def test_containment_of_unequal_texts(spark):
    rng = random.Random(1)
    words = [f"v{i}" for i in range(5000)]
    long = rng.choices(words, k=20000)
    short = long[5000:5600]
    df = spark.createDataFrame([(" ".join(short), " ".join(long))], "a string, b string")
    df = sketch.with_sketch(sketch.with_sketch(df, "a", "x"), "b", "y")
    r = df.select(sketch.containment("x", "y").alias("c"), sketch.likeness("x", "y").alias("j")).first()
    assert r.c > 0.95 and r.j < 0.1


@pytest.mark.parametrize("floor", [0, 64])
def test_merge_is_the_sketch_of_the_union(spark, floor):
    rng = random.Random(5)
    sets = [[f"word{rng.randrange(4000)}" for _ in range(n)] for n in (0, 1, 3, 40, 60, 64, 65, 300, 500, 900, 3000)]
    pairs = [(" ".join(a), " ".join(b), " ".join(dict.fromkeys(a + b))) for a in sets for b in sets if a and b]
    df = spark.createDataFrame(pairs, "a string, b string, both string")
    for c in ("a", "b", "both"):
        df = sketch.with_sketch(df, c, f"s_{c}", words=1, floor=floor)
    df = durable(durable(df).withColumn("m", sketch.merge("s_a", "s_b", floor=floor)))
    assert df.where("m.upto <> s_both.upto OR m.hashes <> s_both.hashes").count() == 0
    assert df.where("size(m.hashes) > 64").count() > 10


def test_nothing_leaves_the_jvm(spark):
    plan = sketch.edited_likeness(spark.createDataFrame(rows(), SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan.replace("ArrowEval", "Arrow")


def test_single_and_empty(spark):
    one = spark.createDataFrame([(5, "a b c d e f g h", "")], SCHEMA)
    r = sketch.edited_likeness(one).first()
    assert r.near_next == 1.0
    assert sketch.edited_likeness(one.where(F.lit(False))).collect() == []
