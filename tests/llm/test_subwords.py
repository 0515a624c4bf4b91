"""Pieces, their source ranges and decoding against the sentencepiece library, with and without a character map."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from sentencepiece import SentencePieceNormalizer, SentencePieceProcessor

from obsengine.llm import subwords
from obsengine.llm.queries import op12_sentencepiece

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "  ", "a", " a", "a ", "a  b", "▁", "▁a ▁▁b", "naïve café", "日本語 テキスト", "x\ny\t z", "\x00a\x00", "b \x00a c", "𝔘𝔫𝔦", "é ﬁ ½ Ⅷ", "Ａｂｃ　ｄ", "<s> </s> <unk>", "a" * 3000, "<0x41>", "​﻿z", "  lead and trail  ", "a b", "ガ"]


def _with(**normaliser: object) -> bytes:
    """The public model with another normaliser: the fields of a later message count."""
    with open(PATH, "rb") as f:
        raw = f.read()

    def number(n: int) -> bytes:
        return bytes([n & 127 | 128]) + number(n >> 7) if n > 127 else bytes([n])

    body = b""
    for field, value in normaliser.values():
        body += number(field << 3 | 2) + number(len(value)) + value if isinstance(value, bytes) else number(field << 3) + number(value)
    return raw + number(3 << 3 | 2) + number(len(body)) + body


def _compiled(rule: str) -> bytes:
    proto = SentencePieceNormalizer(rule_name=rule).serialized_model_proto()
    return next(dict(subwords._fields(v))[2] for f, v in subwords._fields(proto) if f == 3)


def _texts(n: int, seed: int) -> list[str]:
    r = random.Random(seed)
    signs = "ab cdeé ñ  ▁ß\n\tﬁ½Ａ　éガ中𝔘0…"
    return [*ODD, *("".join(r.choice(signs) for _ in range(r.randrange(40))) for _ in range(n))]


def _same(raw: bytes, texts: list[str]) -> None:
    own, theirs = subwords.Model(raw), SentencePieceProcessor(model_proto=raw)
    for t, (ids, starts, ends) in zip(texts, own.encode([t.encode() for t in texts], False, False), strict=True):
        ids = np.frombuffer(ids, "<u4").tolist()
        assert ids == theirs.encode(t), t
        proto = theirs.encode(t, return_type="proto")
        assert [(p.begin, p.end) for p in proto.pieces] == list(zip(starts, ends, strict=True)), t
        assert own.decode(ids).decode() == theirs.decode(ids), t


def test_public_model_is_the_librarys():
    with open(PATH, "rb") as f:
        _same(f.read(), _texts(400, 1))


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf"])
@pytest.mark.parametrize(("prefix", "squeeze"), [(1, 1), (1, 0), (0, 1), (0, 0)])
def test_character_maps_are_followed(rule, prefix, squeeze):
    _same(_with(name=(1, rule.encode()), map=(2, _compiled(rule)), prefix=(3, prefix), squeeze=(4, squeeze)), _texts(150, 2))


def test_longest_key_wins():
    m = subwords.CharacterMap(_compiled("nmt_nfkc"))
    assert m.longest("ガx".encode(), 0) == (6, "ガ".encode())
    assert m.longest("カx".encode(), 0)[0] in (0, 3)
    assert subwords.CharacterMap(b"").longest(b"abc", 0) == (0, b"")


def test_any_ids_decode_as_the_library_has_them():
    with open(PATH, "rb") as f:
        raw = f.read()
    own, theirs, r = subwords.Model(raw), SentencePieceProcessor(model_proto=raw), random.Random(3)
    pool = [*range(0, 300), *(r.randrange(32000) for _ in range(300)), own.pieces.index("▁"), own.pieces.index("▁▁")]
    for _ in range(1500):
        ids = [r.choice(pool) for _ in range(r.randrange(8))]
        assert own.decode(ids).decode() == theirs.decode(ids), ids


def test_bytes_that_are_no_text_are_replaced_one_by_one():
    with open(PATH, "rb") as f:
        own = subwords.Model(f.read())
    (ids, starts, ends), = own.encode([b"a\xff\xe4\xb8b"], False, False)
    assert own.decode(np.frombuffer(ids, "<u4").tolist()).decode() == "a���b"
    assert ends[-1] == 5 and (starts[1:] == ends[:-1]).all()


def test_small_caches_change_nothing(monkeypatch):
    with open(PATH, "rb") as f:
        raw = f.read()
    texts = [t.encode() for t in _texts(100, 4)]
    wanted = [x[0] for x in subwords.Model(raw).encode(texts)]
    monkeypatch.setattr(subwords, "CACHED", 3)
    monkeypatch.setattr(subwords, "LONGEST", 2)
    own = subwords.Model(raw)
    assert [own.encode([t])[0][0] for t in texts] == wanted


def test_operator_on_nulls_repeats_clashes_and_nothing(spark):
    rows = [(1, "a b", "x"), (1, "a b", "y"), (None, None, None), (2, "", "z"), (3, "long " * 50_000, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = subwords.decode(subwords.encode(docs, PATH), PATH).collect()
    assert len(out) == 5
    by = {(r.doc_id, r.decoded): r for r in out}
    assert by[None, ""].ids == [1, 2] and by[2, ""].ends == [0, 0]
    one = by[1, "a b"]
    assert [b"a b"[s:e] for s, e in zip(one.starts, one.ends, strict=True)] == [b"", b"a", b" b", b""]
    assert (3, "long " * 50_000) in by
    assert subwords.encode(docs.limit(0), PATH).count() == 0


def test_query_equals_the_library(spark):
    theirs = SentencePieceProcessor(model_file=PATH)
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    out = op12_sentencepiece(spark, SF).collect()
    assert len(out) == len(docs)
    for r in out:
        ids = [1, *theirs.encode(docs[r.doc_id] or ""), 2]
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(theirs.decode(ids).encode()).hexdigest()
