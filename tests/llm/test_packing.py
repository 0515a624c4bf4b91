import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from obsengine.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def check_places(rows, capacity):
    bins = defaultdict(list)
    for sequence, offset, length in rows:
        bins[sequence].append((offset, length))
    for placed in bins.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def placed(histogram, capacity):
    rows = []
    for length, first, n, copies, bin_, offset in packing.plan(histogram, capacity):
        rows += [(length, first + i, bin_ + i // copies, offset + i % copies * length) for i in range(n * copies)]
    return rows


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 40), max_size=30))
def test_plan_places_every_rank_once(histogram):
    rows = placed(histogram, 30)
    assert sorted((r[0], r[1]) for r in rows) == sorted((k, i) for k, n in histogram.items() for i in range(n))
    bins = check_places([(r[2], r[3], r[0]) for r in rows], 30)
    assert bins <= 1.25 * -(-sum(k * n for k, n in histogram.items()) // 30) + sum(n for k, n in histogram.items() if 3 * k > 30)


def test_large_items_pair_at_most_twice_and_gaps_are_filled():
    rng = random.Random(5)
    histogram = defaultdict(int)
    for _ in range(50_000):
        histogram[min(4096, 1 + int(rng.expovariate(1 / 700)))] += 1
    rows = placed(histogram, 4096)
    bins = check_places([(r[2], r[3], r[0]) for r in rows], 4096)
    assert bins <= 1.002 * sum(k * n for k, n in histogram.items()) / 4096 + 1
    large = defaultdict(int)
    for length, _, sequence, _ in rows:
        large[sequence] += 3 * length > 4096
    assert max(large.values()) <= 2


def texts():
    rng = random.Random(2)
    odd = ["", " ", "don't  STOP<|endoftext|>now", "a\x1cb c\x1fd", "ΟΔΟΣ ΣΑΣ. ς", "é ́x İI ﬁ", " nb sp\u0085x", "日本語 テキスト 123 4½", "_a__b 's'S it's", "Straße!! ÉTÉ... naïve## ªº µm ÿÀ× Ārger ½x --- a-b it's. (x) x'' Ünïcode_ ß", "word " * 9000]
    return odd + [" ".join("".join(rng.choices("abcdeé.,'ß1", k=rng.randint(1, 9))) for _ in range(rng.randint(1, 400))) for _ in range(60)]


def test_ids_are_the_tokenizers():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    for text, raw in zip(texts(), packing.encode(texts(), PATH), strict=True):
        assert np.frombuffer(raw, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, text[:40]


def test_documents_are_packed_whole(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    rows = [(i, x, "clash", 1) for i, x in enumerate([None, *texts()])] + [(3, "same row", "", 0)] * 3 + [(None, "no id", "", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length string, _rank int")
    got = packing.pack_documents(docs, PATH, 512).collect()
    want = []
    for i, x, _, _ in rows:
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), 512)):
            own = ids[at : at + 512]
            want.append((i, k, at, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=str) == sorted(want, key=str)
    bins = check_places([(r.sequence_id, r.offset, r.length) for r in got], 512)
    assert bins <= sum(w[3] for w in want) // 512 + 2
    assert packing.pack_documents(docs.limit(0), PATH).collect() == []
    ids = packing.pack_documents(docs, PATH, 512, with_ids=True).collect()
    assert all(len(r.ids) == r.length for r in ids)


def test_ranks_are_gapless_in_salted_groups(spark):
    items = spark.range(1000).selectExpr("id % 3 as length", "id as doc_id", "0 as piece")
    got = packing.ranked(items, "length", ["doc_id", "piece"], rows_a_group=10).collect()
    for k in range(3):
        ranks = sorted(r["_rank"] for r in got if r.length == k)
        assert ranks == list(range(len(ranks)))


def test_lengths_out_of_range_are_refused(spark):
    for length in (0, 11, None):
        with pytest.raises(ValueError, match="outside"):
            packing.pack(spark.createDataFrame([(1, 0, length)], "doc_id long, piece int, length long"), 10)


def test_signs_beside_words_make_no_new_entry_and_all_of_latin_1_is_cut_as_the_tokenizer_does():
    tokenizer, kept = packing._tokenizer(PATH)
    kept.clear()
    packing.encode(["zorbig zorbig, zorbig) ZORBIG! zorbig..."], PATH)
    assert [w for w in kept if "zorbig" in w] == ["zorbig"]
    signs = [chr(c) for c in range(256)]
    rng = random.Random(3)
    texts = ["", *("".join(rng.choices(signs + ["'s", "it's", "'LL", "12"], k=30)) for _ in range(500)), "漢字 Don't, ½'re", "<|endoftext|> a,b"]
    own = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(raw, "<u4").tolist() for raw in packing.encode(texts, PATH)] == own
    assert packing.encode([], PATH) == [] and packing.encode(["漢字"], PATH) == [np.array(tokenizer.encode("漢字", add_special_tokens=False).ids, "<u4").tobytes()]


def test_words_met_first_stay_when_too_many_are_kept(monkeypatch):
    kept = packing._tokenizer(PATH)[1]
    kept.clear()
    monkeypatch.setattr(packing, "CACHED", 8)
    packing.encode(["aa bb cc dd ee ff gg hh ii"], PATH)
    packing.encode(["zz"], PATH)
    assert list(kept) == ["aa", "bb", "zz"]
