"""Collocations against their definition, the tries against a dictionary, and what tasks keep back."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from obsengine.llm import oracle, phrases

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows: list[tuple], least: int, top: int) -> list[tuple]:
    """The definition, with Python's whole numbers."""
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(FOLD)):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            f[lang].update(tuple(words[i : i + k]) for k in range(1, 6) for i in range(len(words) - k + 1))
    out = []
    for lang, own in f.items():
        found, scored = {p: a for p, a in own.items() if len(p) > 1 and a >= least}, []
        for p, a in found.items():
            if any(100 * b >= 100 * a and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in found.items()):
                continue
            score, _, l, r = min((1000 * a * n[lang] // (own[p[:c]] * own[p[c:]]), c, own[p[:c]], own[p[c:]]) for c in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), l, r))
        for i, (s, a, p, l, r) in enumerate(sorted(scored)[:top]):
            out.append((lang, i + 1, p.decode(), -a, l, r, n[lang], -s))
    return sorted(out)


def _rows(seed: int, n: int) -> list[tuple]:
    r = random.Random(seed)
    words = ["the", "The", "cat", "sat", "of", "é", "ÉÀ", "a.b", "no\xa0break", "new york", "new york city", "x\ty", "tick; tock", "q", "🙂"]
    return [(" ".join(r.choice(words) for _ in range(r.randrange(30))), r.choice(["en", "de", None])) for _ in range(n)]


ROWS = [*_rows(1, 300), (None, "en"), ("", None), ("one " * 3000, "en"), ("solo", "fr"), (". . ,", "fr")]


@pytest.mark.parametrize(("least", "top"), [(5, 2000), (30, 7), (1000, 10)])
def test_collocations_are_the_definition(spark, least, top):
    docs = spark.createDataFrame([(*r, 1, "x") for r in ROWS], "text string, lang string, n int, phrase string")
    got = sorted(tuple(r) for r in phrases.collocations(docs.repartition(5), least, top).collect())
    assert got == plain(ROWS, least, top) and got


def test_shards_parts_and_reports_change_nothing(spark, monkeypatch):
    docs = spark.createDataFrame(ROWS, "text string, lang string").repartition(3)
    for name, value in (("PHRASES", 7), ("CHUNK", 6), ("WORDS", 500), ("DISTINCT", 9), ("KEYS", 20)):
        monkeypatch.setattr(phrases, name, value)
    assert sorted(tuple(r) for r in phrases.collocations(docs, 25, 50).collect()) == plain(ROWS, 25, 50)


@pytest.mark.parametrize(("sieve", "block", "least"), [(8, 4096, 25), (1 << 26, 3, 25), (64, 8, 300)])
def test_sieves_that_all_keys_share_and_short_blocks_change_nothing(spark, monkeypatch, sieve, block, least):
    monkeypatch.setattr(phrases, "SIEVE", sieve)
    monkeypatch.setattr(phrases, "BLOCK", block)
    docs = spark.createDataFrame(ROWS, "text string, lang string").repartition(3)
    assert sorted(tuple(r) for r in phrases.collocations(docs, least, 50).collect()) == plain(ROWS, least, 50)


def test_rare_phrases_with_frequent_parts_are_not_reported(spark, monkeypatch):
    """All pairs of 12 words are frequent, hardly a triple is: of 1728 triples in each task a few are told."""
    r = random.Random(5)
    rows = [(" ".join(r.choice("abcdefghijkl") for _ in range(4000)) + ". x y z" * 40, "en") for _ in range(4)]
    said, durable = [], phrases.durable

    def kept(df):
        said.append(durable(df))
        return said[-1]

    monkeypatch.setattr(phrases, "durable", kept)
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(4)
    assert sorted(tuple(x) for x in phrases.collocations(docs, 30, 2000).collect()) == plain(rows, 30, 2000)
    reports = [d.where("next IS NOT NULL").count() for d in said if {"next", "own"} <= set(d.columns)]
    assert len(reports) > 1 and sum(reports[1:]) < 100  # after the pairs


def test_passes_tell_a_phrase_twice_a_core_at_most_however_many_files_there_are(spark, monkeypatch):
    r = random.Random(6)
    rows = [(" ".join(f"{r.choice('abc')} b c d" for _ in range(500)), "en") for _ in range(40)]
    said, durable = [], phrases.durable

    def kept(df):
        # many rows, each a file
        said.append(durable(df.repartition(60) if df.columns == ["lang", "ids", "own"] else df))
        return said[-1]

    monkeypatch.setattr(phrases, "durable", kept)
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.openCostInBytes", "spark.sql.files.maxPartitionBytes")}
    try:
        for k in before:
            spark.conf.set(k, "1m")
        docs = spark.createDataFrame(rows, "text string, lang string").repartition(4)
        assert sorted(tuple(x) for x in phrases.collocations(docs, 30, 2000).collect()) == plain(rows, 30, 2000)
        reports = [d for d in said if {"next", "own"} <= set(d.columns)][1:]
        most = [d.where("next IS NOT NULL").groupBy("phrase", "next").count().selectExpr("max(count)").first()[0] for d in reports]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert reports and max(most) <= 2 * spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("least", [3, 300, 70_000])
def test_buckets_are_bounded(least):
    for places in (0, 1, 10**6, 10**12):
        size = phrases.buckets(places, least)
        assert size & size - 1 == 0 and size * np.min_scalar_type(least).itemsize <= phrases.SIEVE
        keys = np.random.default_rng(0).integers(0, 1 << 50, 1000)
        at = phrases._bucket(keys, size)
        assert at.min() >= 0 and at.max() < size and len(np.unique(at)) > 900


def test_sql_is_the_definition():
    db = duckdb.connect()
    db.execute("CREATE TABLE documents (text VARCHAR, lang VARCHAR)")
    db.executemany("INSERT INTO documents VALUES (?, ?)", ROWS)
    assert sorted(db.execute(oracle.collocations_sql(8, 40)).fetchall()) == plain(ROWS, 8, 40)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "text string, lang string")
    assert phrases.collocations(docs).count() == 0


def test_scores_beyond_64_bits(spark):
    rows = [("lang", [i], "w", 1, 4_000_000_000, 9_000_000_000) for i in (1, 2)] + [("lang", [1, 2], "w w", 2, 3_999_999_999, 9_000_000_000)]
    import unittest.mock as mock

    found = spark.createDataFrame(rows, "lang string, ids array<int>, phrase string, k int, f long, n long")
    with mock.patch.object(phrases, "counts", return_value=found):
        (row,) = phrases.collocations(found).collect()
    assert row.score == 1000 * 3_999_999_999 * 9_000_000_000 // 4_000_000_000**2


@pytest.mark.parametrize("k", [2, 3, 5])
def test_double_array_holds_its_phrases_and_no_others(k):
    r = np.random.default_rng(k)
    inside = np.unique(r.integers(0, 40, (4000, k)) * 7, axis=0)
    trie = phrases.DoubleArray(inside)
    probes = np.concatenate([inside, r.integers(0, 300, (4000, k))])
    flat = np.concatenate([probes, np.full((len(probes), 1), -1)], axis=1).ravel()
    at, state = trie.walk(trie.symbol(flat), np.arange(0, len(flat), k + 1), k)
    number = {tuple(p): i for i, p in enumerate(inside.tolist())}
    assert dict(zip((at // (k + 1)).tolist(), trie.accepts[state].tolist(), strict=True)) == {i: number[tuple(p)] for i, p in enumerate(probes.tolist()) if tuple(p) in number}


def test_reports_are_whole_however_small_the_memory(monkeypatch):
    monkeypatch.setattr(phrases, "KEYS", 8)
    r = np.random.default_rng(0)
    said, true, seen = Counter(), Counter(), phrases.Seen()
    for _ in range(30):
        keys = r.zipf(1.5, r.integers(0, 40)) % 50
        true.update(map(int, keys))
        for lang, k, n in seen.add("en", keys):
            said.update(dict(zip(k.tolist(), n.tolist(), strict=True)))
    for lang, k, n in seen.close():
        said.update(dict(zip(k.tolist(), n.tolist(), strict=True)))
    assert said == true
