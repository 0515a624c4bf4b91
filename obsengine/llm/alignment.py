"""Two tokenizers' tokens of the same text, aligned by the bytes they cover, and how often tokens of both go together.

Tokenizer A is byte-level, B a SentencePiece model; both read a space and the text. In each batch `pandas.merge_asof`,
keyed by document, gives every token start the other side's token that covers it; both directions together are all
overlaps, and overlaps with equal ends close a group. Tokens of one group are linked, each of A with each of B.

Neither tokenizer lets a token run across a single space before a sign that is no white space, so a document is cut
there. A stretch that a worker has met keeps its alignment; only new ones are matched, one after another in the
document that brought them. How many documents hold a pair is counted from a dictionary of pairs for each part of the table,
so a pair is shuffled once a part and not once a document, and a part gets back the counts of its own pairs alone.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import subwords
from .common import durable
from .packing import BYTE_SIGNS

CACHED = 400_000  # stretches that a worker keeps
AT_ONCE = 1_500_000  # bytes of text that are aligned together
PART = 1_500_000  # (document, pair) entries of a part
BITS = 20  # of an id; a pair is A's id, then B's
_kept: dict[tuple[str, str], Pair] = {}


def ranges(counts: np.ndarray) -> np.ndarray:
    """0 up to each count, one after another."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def overlaps(a: pd.DataFrame, b: pd.DataFrame) -> np.ndarray:
    """Row numbers (of a, of b) of the tokens that overlap, each pair once.

    Both sides hold `doc` and `at`, a token's first byte in a count that runs on from document to document, and are
    sorted by it; in each document both cover the same bytes without gaps.
    """
    a, b = a.assign(a=np.arange(len(a))), b.assign(b=np.arange(len(b)))
    both = [pd.merge_asof(a, b, on="at", by="doc"), pd.merge_asof(b, a, on="at", by="doc")]
    pairs = np.concatenate([(m["a"].to_numpy(np.int64) << 32) | m["b"].to_numpy(np.int64) for m in both])
    pairs = np.unique(pairs)
    return np.stack([pairs >> 32, pairs & 0xFFFFFFFF], axis=1)


def counted(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and how often, or with what sum, each stands there."""
    if weights is None:
        return np.unique(keys, return_counts=True)
    order = np.argsort(keys, kind="stable")
    keys, weights = keys[order], weights[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(weights, first) if len(first) else np.zeros(0, np.int64)


class Pair:
    """Both tokenizers, and the alignments of stretches met so far."""

    def __init__(self, a: str, b: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task is one core
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a), subwords.model(b)
        self.a.encode_special_tokens = True
        with open(a, encoding="utf-8") as f:
            said = json.load(f)
        before = said.get("pre_tokenizer") or {}
        own = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        self.cuts = own and not said.get("normalizer") and all(t["special"] for t in said.get("added_tokens", [])) and self.b.cuts and self.b.plain and self.b.prefix
        byte = {**{chr(b): b for b in range(256) if b not in BYTE_SIGNS}, **{chr(s): b for b, s in BYTE_SIGNS.items()}}
        size = self.a.get_vocab_size(with_added_tokens=True)
        self.a_bytes = [bytes(byte.get(c, 63) for c in self.a.id_to_token(i) or "") for i in range(size)]
        self.b_bytes = [p.encode() if k == subwords.UNKNOWN else w for p, k, w in zip(self.b.pieces, self.b.kinds, self.b.written, strict=True)]
        if max(len(self.a_bytes), len(self.b_bytes)) >> BITS:
            raise ValueError(f"a vocabulary has more than {1 << BITS} ids")
        self.a_size, self.b_size = (np.array([len(x) for x in side], np.int64) for side in (self.a_bytes, self.b_bytes))
        self.signs = [f"{i}{c}" for side, close in ((self.a_bytes, "|"), (self.b_bytes, ";")) for i in range(len(side)) for c in (",", close)]
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}  # of a stretch without its first space; below 0 where the bytes differ
        self.shown: list[str] = []
        self.sizes = [array("q") for _ in range(4)]  # tokens of A, of B, groups, links
        self.pairs, self.times, self.ends = array("q"), array("q"), array("q", [0])

    def stretches(self, text: str) -> list[str]:
        """A text in parts that both tokenizers treat apart, each without the space before it."""
        if not self.cuts:
            return [text]
        if not re.search(r" (?:\s|$)", text) and not text[0].isspace():
            return text.split(" ")
        found = re.split(r"(?<! ) (?=\S)", " " + text)
        return [*([found[0][1:]] if found[0] else []), *found[1:]]

    def _encoded(self, said: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of A, how many each stretch has, and the same of B. Stretches begin with a space."""
        e = self.a.encode(said, is_pretokenized=True, add_special_tokens=False)
        na = np.bincount(np.array(e.word_ids, np.int64), minlength=len(said))
        if self.cuts and self.b.fallback:
            found = self.b.merges.encode([s.replace(" ", subwords.SPACE) for s in said], num_threads=1)
        else:
            found = [np.frombuffer(raw, "<u4").tolist() for raw, _ in self.b.ids([self.b.normalise(s[1:].encode())[0] for s in said])]
        nb = np.fromiter(map(len, found), np.int64, len(said))
        return np.array(e.ids, np.int64), na, np.fromiter(chain.from_iterable(found), np.int64, int(nb.sum())), nb

    def _faithful(self, said: list[str], ids_a: np.ndarray, na: np.ndarray, ids_b: np.ndarray, nb: np.ndarray) -> np.ndarray:
        """Whether both sides' bytes are those of the stretch."""
        sides = [list(map(table.__getitem__, ids.tolist())) for table, ids in ((self.a_bytes, ids_a), (self.b_bytes, ids_b))]
        raw = [s.encode() for s in said]
        good = np.ones(len(said), bool)
        for parts, n in zip(sides, (na, nb), strict=True):
            cut = np.concatenate([[0], np.cumsum(n)]).tolist()
            good &= np.fromiter((b"".join(parts[i:j]) == r for i, j, r in zip(cut, cut[1:], raw, strict=False)), bool, len(said))
        return good

    def learn(self, keys: list[str], docs: list[int]) -> None:
        """Align new stretches, in the order of the documents that brought them."""
        said = [" " + k for k in keys]
        ids_a, na, ids_b, nb = self._encoded(said)
        good = self._faithful(said, ids_a, na, ids_b, nb)
        if not good.all():
            for i in np.flatnonzero(~good).tolist():
                self.number[keys[i]] = -1
            ids_a, ids_b = ids_a[np.repeat(good, na)], ids_b[np.repeat(good, nb)]
            na, nb = na[good], nb[good]
            keys = [k for k, g in zip(keys, good.tolist(), strict=True) if g]
            if not keys:
                return
        doc = np.array(docs, np.int64)[good]

        def laid(n: np.ndarray, sizes: np.ndarray) -> tuple[pd.DataFrame, np.ndarray]:
            end = np.cumsum(sizes)
            return pd.DataFrame({"doc": np.repeat(doc, n), "at": end - sizes}), end

        frame_a, end_a = laid(na, self.a_size[ids_a])
        frame_b, end_b = laid(nb, self.b_size[ids_b])
        over = overlaps(frame_a, frame_b)
        closing = over[end_a[over[:, 0]] == end_b[over[:, 1]]]
        shut_a, shut_b = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64)
        shut_a[closing[:, 0]] = 1
        shut_b[closing[:, 1]] = 1
        group_a, group_b = np.cumsum(shut_a) - shut_a, np.cumsum(shut_b) - shut_b
        n_groups = len(closing)
        per_a, per_b = np.bincount(group_a, minlength=n_groups), np.bincount(group_b, minlength=n_groups)
        of_group = np.repeat(np.arange(len(na)), na)[np.cumsum(per_a) - 1]  # the stretch of each group
        # every A id of a group with every B id of it, each side's repeats taken together first
        ka, ca = counted(group_a << BITS | ids_a)
        kb, cb = counted(group_b << BITS | ids_b)
        da, db = np.bincount(ka >> BITS, minlength=n_groups), np.bincount(kb >> BITS, minlength=n_groups)
        within, g = ranges(da * db), np.repeat(np.arange(n_groups), da * db)
        ia, ib = (np.cumsum(da) - da)[g] + within // db[g], (np.cumsum(db) - db)[g] + within % db[g]
        mask = (1 << BITS) - 1
        pair, times, stretch = (ka[ia] & mask) << BITS | kb[ib] & mask, ca[ia] * cb[ib], of_group[g]
        order = np.lexsort((pair, stretch))
        pair, times, stretch = pair[order], times[order], stretch[order]
        first = np.flatnonzero(np.concatenate([[True], (pair[1:] != pair[:-1]) | (stretch[1:] != stretch[:-1])]))
        times = np.add.reduceat(times, first)
        pair, stretch = pair[first], stretch[first]
        base = self.ends[-1]
        self.pairs.frombytes(pair.tobytes())
        self.times.frombytes(times.tobytes())
        self.ends.frombytes((base + np.cumsum(np.bincount(stretch, minlength=len(na)))).astype(np.int64).tobytes())
        groups = np.bincount(of_group, minlength=len(na))
        links = np.bincount(of_group, weights=per_a * per_b, minlength=len(na))
        for to, values in zip(self.sizes, (na, nb, groups, links), strict=True):
            to.frombytes(values.astype(np.int64).tobytes())
        # in each group A's tokens, then B's; a token is written with the sign behind it
        last_a, last_b = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64)
        last_a[np.cumsum(per_a) - 1] = 1
        last_b[np.cumsum(per_b) - 1] = 1
        size = len(self.a_bytes)
        code = np.concatenate([2 * ids_a + last_a, 2 * (size + ids_b) + last_b])
        order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
        signs = list(map(self.signs.__getitem__, code[order].tolist()))
        cut = np.concatenate([[0], np.cumsum(na + nb)]).tolist()
        at = len(self.shown)
        self.shown.extend(["".join(signs[i:j])[:-1] for i, j in zip(cut, cut[1:], strict=False)])
        self.number.update(zip(keys, range(at, at + len(keys)), strict=True))

    def documents(self, texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Four sizes and the groups of each text, then of each (text, pair) the text's number, the pair and how often."""
        if len(self.number) > CACHED:
            self.clear()
        cut = [self.stretches(t) if t else [] for t in texts]
        keys, docs, known = [], [], self.number
        for d, parts in enumerate(cut):
            new = [p for p in dict.fromkeys(parts) if p not in known]
            known.update(dict.fromkeys(new, -1))
            keys += new
            docs += [d] * len(new)
        if keys:
            self.learn(keys, docs)
        own = [np.fromiter(map(self.number.__getitem__, parts), np.int64, len(parts)) for parts in cut]
        own = [x if len(x) and x.min() >= 0 else x[:0] for x in own]
        shown = [";".join(map(self.shown.__getitem__, x.tolist())) for x in own]
        of = np.repeat(np.arange(len(own)), [len(x) for x in own])
        flat = np.concatenate(own) if own else np.zeros(0, np.int64)
        sizes = np.stack([np.bincount(of, weights=np.frombuffer(s, np.int64)[flat] if len(s) else None, minlength=len(own)) for s in self.sizes]).astype(np.int64)
        key, n = counted(of << 32 | flat)
        of, flat = key >> 32, key & 0xFFFFFFFF
        ends = np.frombuffer(self.ends, np.int64)
        each = ends[flat + 1] - ends[flat]
        at = np.repeat(ends[flat], each) + ranges(each)
        pairs, times = (np.frombuffer(x, np.int64)[at] if len(at) else np.zeros(0, np.int64) for x in (self.pairs, self.times))
        # texts of a call are few enough for their number to stand before a pair
        key, times = counted(np.repeat(of, each) << 2 * BITS | pairs, times * np.repeat(n, each))
        return sizes, shown, key >> 2 * BITS, key & (1 << 2 * BITS) - 1, times


def _pair(a: str, b: str) -> Pair:
    if (a, b) not in _kept:
        _kept[a, b] = Pair(a, b)
    return _kept[a, b]


ROWS = pa.schema([("part", pa.int64()), ("doc_id", pa.int64()), *[(n, pa.int64()) for n in ("n_a", "n_b", "n_groups", "n_links")], ("groups", pa.string()), ("own", pa.list_(pa.int32())), ("times", pa.list_(pa.int32())), ("place", pa.int32()), ("pair", pa.int64()), ("docs", pa.int32())])
SCHEMA = "part long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, own array<int>, times array<int>, place int, pair long, docs int"
TO = pa.schema([("doc_id", pa.int64()), *[(n, pa.int64()) for n in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")], ("groups", pa.string())])


def parts(docs: DataFrame, a: str, b: str, digest: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of two kinds: a document with its sizes, its groups and its pairs' places in its part's dictionary, and that dictionary's pairs.

    Of a document `pair` is null, of an entry of a dictionary `groups`. `digest` puts the groups' SHA-256 in their place.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = _pair(a, b)
        task, number = TaskContext.get().partitionId(), 0
        held: list[tuple] = []
        entries = 0

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal number, entries
            part = task << 24 | number
            pair, place = np.unique(np.concatenate([h[4] for h in held]), return_inverse=True)
            docs_of = np.bincount(place, minlength=len(pair))
            at = 0
            for ids, sizes, shown, of, own, times in held:
                n = len(shown)
                cuts = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=n))]).astype(np.int32)
                here = place[at : at + len(own)].astype(np.int32)
                at += len(own)
                lists = [pa.ListArray.from_arrays(pa.array(cuts), pa.array(x)) for x in (here, times.astype(np.int32))]
                none = [pa.nulls(n, k) for k in (pa.int32(), pa.int64(), pa.int32())]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part)), ids, *map(pa.array, sizes), pa.array(shown, pa.string()), *lists, *none], schema=ROWS)
            for i in range(0, len(pair), 50_000):
                p = pair[i : i + 50_000]
                n = len(p)
                none = [pa.nulls(n, f.type) for f in list(ROWS)[1:9]]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part)), *none, pa.array(np.arange(i, i + n, dtype=np.int32)), pa.array(p), pa.array(docs_of[i : i + n].astype(np.int32))], schema=ROWS)
            held.clear()
            number, entries = number + 1, 0

        for whole in batches:
            for batch in subwords.slices(whole, 1, AT_ONCE):
                sizes, shown, of, own, times = both.documents([t or "" for t in batch.column(1).to_pylist()])
                if digest:
                    shown = [hashlib.sha256(s.encode()).hexdigest() if s else "" for s in shown]
                held.append((batch.column(0), sizes, shown, of, own, times))
                entries += len(own)
                if entries >= PART:
                    yield from close()
        if held:
            yield from close()

    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return own.mapInArrow(run, SCHEMA)


def pair_counts(found: DataFrame) -> DataFrame:
    """How many documents hold each pair linked, `(pair, a, b, n, best)`: `best` where no other pair of its A id has more."""
    n = durable(found.where("pair IS NOT NULL").groupBy("pair").agg(F.sum("docs").alias("n")))
    n = n.select("pair", F.shiftright("pair", BITS).alias("a"), F.col("pair").bitwiseAND((1 << BITS) - 1).alias("b"), "n")
    most = n.groupBy("a").agg(F.max("n").alias("most"))  # a row for an id of the vocabulary at most
    return n.join(F.broadcast(most), "a").select("pair", "a", "b", "n", (F.col("n") == F.col("most")).alias("best"))


def align(docs: DataFrame, a: str, b: str, digest: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups)` of every whole text, a row for each row.

    `groups` writes each group's ids of A, a bar and its ids of B, groups parted by `;`; with `digest` it is that
    text's SHA-256. `n_links` counts linked pairs of tokens; `count_sum` adds up over them in how many documents a pair
    of ids is linked, `n_best` counts those for which that number is the highest of their A id.

    Texts that are null or empty, or that the tokens' bytes don't give back, have no tokens: zeros and an empty string.
    Rows that repeat are documents of their own, null doc_ids are kept, other columns are left aside whatever their
    names, and an empty table gives an empty result.
    """
    found = durable(parts(docs, a, b, digest, doc_id, text))
    said = found.where("pair IS NOT NULL").select("part", "place", "pair").join(pair_counts(found), "pair").select(F.col("part").alias("of_part"), "place", "n", "best")
    own = found.where("pair IS NULL").select("part", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "own", "times")

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        n = np.zeros(right.num_rows, np.int64)
        best = np.zeros(right.num_rows, bool)
        place = right.column("place").to_numpy()
        n[place] = right.column("n").to_numpy()
        best[place] = right.column("best").to_numpy()
        lists = [left.column(c).combine_chunks() for c in ("own", "times")]
        if isinstance(lists[0], pa.ChunkedArray):
            lists = [pa.concat_arrays(x.chunks) for x in lists]
        sizes = pa.compute.list_value_length(lists[0]).to_numpy(zero_copy_only=False)
        at, times = (x.flatten().to_numpy().astype(np.int64) for x in lists)
        of = np.repeat(np.arange(left.num_rows), sizes)
        sums = []
        for values in (best[at] * times, n[at] * times):
            total = np.concatenate([[0], np.cumsum(values)])  # whole numbers all the way
            ends = np.cumsum(sizes)
            sums.append(pa.array(total[ends] - total[ends - sizes], pa.int64()))
        assert len(of) == len(at)
        columns = [left.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")] + sums + [left.column("groups")]
        return pa.Table.from_arrays(columns, schema=TO)

    return own.groupBy("part").cogroup(said.groupBy("of_part")).applyInArrow(finish, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string")
