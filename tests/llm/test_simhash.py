import random
import re

import numpy as np
import pytest
import xxhash

from obsengine.llm import simhash

SCHEMA = "doc_id long, text string, fp long, component_id string"


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(fps, radius=4):
    """Root of each number under links of `radius` or fewer differing bits."""
    fps = sorted(set(fps))
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= radius:
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {f: find(f) for f in fps}


def texts():
    rng = random.Random(1)
    words = [f"w{i}Ä" for i in range(60)] + ["A", "b."]
    base = [" ".join(rng.choices(words, k=rng.randint(1, 80))) for _ in range(40)]
    near = [t.replace("w1Ä", "x", 1) for t in base]
    return [None, "", " \t\n", "one", "One", "a b c", "x\x1cy z q", "  nb sp x y", *base, *near, base[0], base[0], "long " * 70000]


def test_fingerprint_is_the_contracts():
    for t in texts():
        assert simhash.fingerprint(t) == plain(t), (t or "")[:40]


def test_embedding_bounds_hamming_from_below():
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 1 << 63, (2, 500), dtype=np.uint64)
    manhattan = np.bitwise_count(simhash.embed(a) ^ simhash.embed(b))
    counts = lambda x: np.array([[int(v) >> 2 * i & 1 + 0 for i in range(32)] for v in x]) + np.array([[int(v) >> 2 * i + 1 & 1 for i in range(32)] for v in x])
    assert (manhattan == np.abs(counts(a) - counts(b)).sum(1)).all()
    assert (manhattan <= np.bitwise_count(a ^ b)).all()


def test_components_are_those_of_all_pairs(spark):
    rows = [(i, t, i, "clash") for i, t in enumerate(texts())]
    rows += [(3, "one", 0, None), (3, "one", 0, None), (None, "one", 0, None), (None, "a text of its own with no other like it", 0, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    fps = {t: plain(t) for _, t, _, _ in rows}
    root = brute(fps.values())
    least = {}
    for i, t, _, _ in rows:
        if i is not None:
            least[root[fps[t]]] = min(i, least.get(root[fps[t]], i))
    want = sorted(((i, fps[t], least.get(root[fps[t]])) for i, t, _, _ in rows), key=str)
    assert sorted(((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in got), key=str) == want


def roots_of(df):
    from obsengine.llm.common import components

    return {r.node & (1 << 64) - 1: r.root & (1 << 64) - 1 for r in components(df).collect()}


@pytest.mark.parametrize("radius", [1, 2, 3, 4, 5, 6])
def test_links_of_chosen_bits(spark, radius):
    rng = random.Random(radius)
    fps = [rng.getrandbits(64) for _ in range(200)]
    for base in fps[:15]:
        for n in range(1, radius + 3):
            fps.append(base ^ sum(1 << b for b in rng.sample(range(64), n)))
    base = rng.getrandbits(64)
    fps += [base ^ sum(1 << b for b in rng.sample(range(64), radius)) for _ in range(80)]  # a crowded group
    want = brute(fps, radius)
    df = spark.createDataFrame([(simhash._signed(f),) for f in set(fps)], "fp long")
    groups = lambda roots: sorted(sorted(f for f in set(fps) if roots.get(f, f) == r) for r in {roots.get(f, f) for f in fps})
    for bands, most in ((None, 4096), (2, 12)) if radius != 4 else ((None, 4096), (2, 12), (3, 20), (5, 4096)):
        assert groups(roots_of(simhash.links(df, radius, bands, most))) == groups(want)


def test_large_cells_by_stretches():
    rng = np.random.default_rng(1)
    x = np.unique(rng.integers(0, 1 << 12, 1500, dtype=np.uint64) << np.uint64(7) | rng.integers(0, 8, 1500, dtype=np.uint64))
    a, b = zip(*((p.tolist(), q.tolist()) for p, q in simhash._cell_links(x, np.array([len(x)]), 2, 5000)), strict=True)
    got = dict(zip(sum(a, []), sum(b, []), strict=True))
    assert {int(f): got.get(int(f), int(f)) for f in x} == brute(x.tolist(), 2)


def test_bands_follow_the_count():
    assert [simhash.bands_for(n, 4) for n in (0, 10**6, 10**8, 10**10)] == [2, 2, 4, 7]
    assert simhash.bands_for(10**15, 30) == 2


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
