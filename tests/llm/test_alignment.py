"""Groups, links and counts of two tokenizers against their definition, token by token."""

import bisect
import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import public_tokenizers
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from obsengine.llm import alignment
from obsengine.llm.queries import op11_alignment

SF = "/root/testdata/sf0.001"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", None, " ", "a", "  two  spaces ", "\n lead", "tab\t here", "x \n y", "end \n", "▁", "a ▁b", "日本語テキスト 🙂🙂", "naïve café's don't", "<|endoftext|> <s></s>", "a  b", "0123 4567\r\n\r\n89", "=" * 500, "é" * 300, "\x1c a", "a\x85 b", " nbsp a"]


class Plain:
    """The definition: whole texts, common ends, all pairs of a group."""

    def __init__(self) -> None:
        self.a, self.b = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
        self.a.encode_special_tokens = True
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        hidden = [b for b in range(256) if b not in shown]
        self.pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.is_byte = [self.b.is_byte(i) for i in range(len(self.pieces))]
        self.byte = {**{chr(b): b for b in shown}, **{chr(256 + i): b for i, b in enumerate(hidden)}}

    def groups(self, text: str | None) -> list[tuple[list[int], list[int]]]:
        if not text:
            return []
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        raw_a = [bytes(self.byte[c] for c in self.a.id_to_token(i)) for i in a]
        raw_b = [bytes([int(p[3:-1], 16)]) if self.is_byte[i] else p.replace("▁", " ").encode() for i in b for p in [self.pieces[i]]]
        if not b"".join(raw_a) == b"".join(raw_b) == (" " + text).encode():
            return []
        ends_a, ends_b = np.cumsum([len(x) for x in raw_a]), np.cumsum([len(x) for x in raw_b])
        common = sorted(set(ends_a) & set(ends_b))
        out = [([], []) for _ in common]
        for side, ids, ends in ((0, a, ends_a), (1, b, ends_b)):
            for i, e in zip(ids, ends, strict=True):
                out[bisect.bisect_left(common, e)][side].append(i)
        return out

    def table(self, rows: list[tuple]) -> list[tuple]:
        held, groups = defaultdict(int), [self.groups(t) for _, t in rows]
        links = [Counter((x, y) for a, b in g for x in a for y in b) for g in groups]
        for own in links:
            for p in own:
                held[p] += 1
        most = defaultdict(int)
        for (x, _), n in held.items():
            most[x] = max(most[x], n)
        out = []
        for (doc, _), g, own in zip(rows, groups, links, strict=True):
            said = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
            best = sum(n for (x, y), n in own.items() if held[x, y] == most[x])
            out.append((doc, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(own.values()), best, sum(n * held[p] for p, n in own.items()), said))
        return out


def _key(row: tuple) -> tuple:
    return (row[0] is None, row[0] or 0, str(row[1:]))


def test_query_equals_the_definition(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    wanted = [(*r[:7], hashlib.sha256(r[7].encode()).hexdigest() if r[7] else "") for r in Plain().table(rows)]
    columns = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    assert sorted(tuple(r) for r in op11_alignment(spark, SF).select(*columns).collect()) == sorted(wanted)


def test_odd_texts_nulls_repeats_and_clashing_names(spark, monkeypatch):
    r = random.Random(5)
    signs = "ab é ñ  \n\t'.1▁中🙂"
    texts = [*ODD, "a b", "a b", *("".join(r.choice(signs) for _ in range(r.randrange(60))) for _ in range(150))]
    rows = [(i if i % 7 else None, t, "x", 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, groups string, part int")
    got = [tuple(x) for x in alignment.align(docs, A, B).collect()]
    assert sorted(got, key=_key) == sorted(Plain().table([x[:2] for x in rows]), key=_key)
    assert alignment.align(docs.limit(0), A, B).count() == 0


def test_small_parts_and_caches_change_nothing(monkeypatch):
    texts = [t or "" for t in ODD] + ["the cat sat", "the cat", "cat the the"]
    one = alignment.Pair(A, B)
    whole = one.documents(texts)
    monkeypatch.setattr(alignment, "CACHED", 2)
    other = alignment.Pair(A, B)
    for i, t in enumerate(texts):
        sizes, shown, _, pairs, times = other.documents([t])
        own = whole[2] == i
        assert (sizes[:, 0] == whole[0][:, i]).all() and shown[0] == whole[1][i]
        assert (pairs == whole[3][own]).all() and (times == whole[4][own]).all()


def test_overlaps_are_found_in_both_directions():
    a = pd.DataFrame({"doc": [0, 0, 1], "at": [0, 5, 9]})
    b = pd.DataFrame({"doc": [0, 0, 0, 1, 1], "at": [0, 2, 7, 9, 11]})
    assert alignment.overlaps(a, b).tolist() == [[0, 0], [0, 1], [1, 1], [1, 2], [2, 3], [2, 4]]


def test_uncut_texts_agree(monkeypatch):
    texts = [t for t in ODD if t] + ["some words, and more  words"]
    cut, whole = alignment.Pair(A, B), alignment.Pair(A, B)
    whole.cuts = False
    x, y = cut.documents(texts), whole.documents(texts)
    assert (x[0] == y[0]).all() and x[1] == y[1] and all((p == q).all() for p, q in zip(x[2:], y[2:], strict=True))
