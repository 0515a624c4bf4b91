"""Best-fit packing of documents into sequences of a fixed number of tokens.

Documents above a third of the capacity fit at most twice into a bin: they are matched greedily, the longest first
with the longest that still fits. The rest best-fits the gaps, longest first, and opens bins when no gap holds it.

Lengths are whole numbers up to the capacity, so the plan is made from their histogram, which has at most `capacity`
rows however large the table is. Runs of equal bins are handled at once: the plan is a list of runs, each of which
says where a range of the ranks of a length goes. A run's gap falls below half at each use (it is a remainder), so
the plan has at most about `3 * capacity * log2(capacity)` runs. Rows find their place by length and rank.
"""

from __future__ import annotations

import bisect
import re
import struct
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import durable

CACHED = 500_000
SPLITS_ONLY_IN_PYTHON = ("\x1c", "\x1d", "\x1e", "\x1f")
_LATIN = [chr(c) for c in range(256)]
_LETTERS, _NUMBERS, _SIGNS = ("".join(c for c in _LATIN if unicodedata.category(c)[0] in kinds and not c.isspace()) for kinds in ("L", "N", "CMPSZ"))
#: The tokenizer's pre-tokens in a lower-case text of Latin-1: letters, an apostrophe's ending, any other signs together, one number.
PRE_TOKENS = re.compile(f"[{_LETTERS}]+|'(?:s|t|re|ve|m|ll|d)|[{re.escape(_SIGNS)}]+|[{_NUMBERS}]")
IS_SIGN = np.array([c in _SIGNS for c in _LATIN])


def _byte_signs() -> dict[int, int]:
    """The byte-level alphabet: bytes that print stand for themselves, the rest for the code points from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in shown]
    return {b: 256 + i for i, b in enumerate(hidden)}


BYTE_SIGNS = _byte_signs()


def _raw(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Encoded(dict):
    """The ids of what lies between white space, and of pre-tokens; what is new in Latin-1 goes to the tokenizer's model alone."""

    def __init__(self, model: object) -> None:
        super().__init__()
        self.model = model

    def __missing__(self, word: str) -> bytes:
        parts = [word] if word.isalpha() else PRE_TOKENS.findall(word)
        if len(parts) > 1:
            raw = b"".join([self[p] for p in parts])
        else:
            signs = word if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(BYTE_SIGNS)
            raw = _raw([t.id for t in self.model.tokenize(signs)])
        self[word] = raw
        return raw

    def shrink(self) -> None:
        """Leave those that were met first, among which the frequent ones are."""
        for word in list(self)[CACHED // 4 :]:
            del self[word]


_kept: dict[str, tuple[object, Encoded]] = {}


def _tokenizer(path: str) -> tuple[object, Encoded]:
    if path not in _kept:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        _kept[path] = tokenizer, Encoded(tokenizer.model)
    return _kept[path]


def _latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def _cut(texts: list[str]) -> list[list[str]]:
    """Texts of Latin-1 in lower case, cut at white space and before signs, where a pre-token begins in any case."""
    code = np.frombuffer("\x1c".join(texts).lower().encode("latin-1"), np.uint8)
    sign = IS_SIGN[code]
    code = np.insert(code, np.flatnonzero(sign[1:] & ~sign[:-1]) + 1, ord(" "))
    return [t.split() for t in code.tobytes().decode("latin-1").split("\x1c")]


def encode(texts: list[str], path: str) -> list[bytes]:
    """The ids of each whole text as little-endian unsigned 32-bit numbers.

    Texts of Latin-1 are cut at white space and before signs, so signs after a word make no new entry of what is kept.
    Others are cut at white space, as the tokenizer does first; their words beyond Latin-1 go through all of it, once
    each. A text with a special token's string or a separator that only Python takes for white space is encoded as it is.
    """
    tokenizer, kept = _tokenizer(path)
    apart = (*SPLITS_ONLY_IN_PYTHON, *(t.content for t in tokenizer.get_added_tokens_decoder().values()))
    if len(kept) > CACHED:
        kept.shrink()
    get = kept.__getitem__
    out: list[bytes | None] = [_raw(tokenizer.encode(t, add_special_tokens=False).ids) if any(s in t for s in apart) else None for t in texts]
    left = [i for i, raw in enumerate(out) if raw is None]
    plain = [i for i in left if _latin(texts[i])]
    for i, words in zip(plain, _cut([texts[i] for i in plain]), strict=False):
        out[i] = b"".join(map(get, words))
    cut = {i: texts[i].split() for i in left if out[i] is None}
    if cut:
        new = list(set().union(*cut.values()) - kept.keys())
        plain = [w for w in new if _latin(w)]
        for w, words in zip(plain, _cut(plain), strict=False):
            kept[w] = b"".join(map(get, words))
        rest = [w for w in new if w not in kept]
        if rest:
            e = tokenizer.encode(rest, is_pretokenized=True, add_special_tokens=False)
            of = np.array([-1 if w is None else w for w in e.word_ids], np.int64)
            raw = np.array(e.ids, "<u4").tobytes()
            at = np.searchsorted(of, np.arange(len(rest) + 1)).tolist()
            kept.update((w, raw[4 * i : 4 * j]) for w, i, j in zip(rest, at, at[1:], strict=False))
        for i, words in cut.items():
            out[i] = b"".join(map(get, words))
    return out


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Whole texts as token pieces: `(doc_id, piece, start, length, ids_crc32[, ids])`.

    A text's ids end with `end_id`, so an empty or null text is one piece of one token. Only texts beyond `capacity`
    are cut, into pieces of `capacity` with a shorter last one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows: list[list] = [[], [], [], [], [], []]
                texts = ["" if t is None else t for t in part.column(1).to_pylist()]
                for key, raw in zip(part.column(0).to_pylist(), encode(texts, tokenizer), strict=True):
                    raw += end
                    for k, i in enumerate(range(0, len(raw), 4 * capacity)):
                        own = raw[i : i + 4 * capacity]
                        for to, value in zip(rows, (key, k, i // 4, len(own) // 4, zlib.crc32(own), np.frombuffer(own, "<u4").astype("<i4") if with_ids else None), strict=True):
                            to.append(value)
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.list_(pa.int32())] * with_ids
                names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(rows, kinds, strict=False)], names)

    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Runs `(length, first rank, bins, copies a bin, first bin, offset)` that hold every rank of every length once."""
    runs: list[tuple[int, int, int, int, int, int]] = []
    gaps: list[int] = []  # sorted, those in `free` only
    free: dict[int, list[tuple[int, int]]] = {}  # gap: first bin, bins
    bins = 0

    def add(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in free:
                bisect.insort(gaps, gap)
                free[gap] = []
            free[gap].append((first, n))

    def take(gap: int, most: int) -> tuple[int, int]:
        first, n = free[gap].pop()
        if n > most:
            free[gap].append((first + most, n - most))
            n = most
        if not free[gap]:
            del free[gap]
            gaps.pop(bisect.bisect_left(gaps, gap))
        return first, n

    def place(length: int, rank: int, left: int, gap: int) -> int:
        """Put up to `left` items into bins of this gap; how many."""
        copies = min(gap // length, 1 if 3 * length > capacity else left)
        first, n = take(gap, max(1, left // copies))
        runs.append((length, rank, n, copies, first, capacity - gap))
        add(gap - copies * length, first, n)
        return n * copies

    large = {k: v for k, v in histogram.items() if 3 * k > capacity}
    ranks = dict.fromkeys(large, 0)
    rest = sorted(large)
    while rest:  # match the longest left with the longest that still fits beside it
        length = rest[-1]
        at = bisect.bisect_right(rest, capacity - length)
        if not at:
            n, mate = large[length], 0
        elif (mate := rest[at - 1]) == length:
            n = large[length] // 2
            mate = mate if n else rest[at - 2] if at > 1 else 0
            n = n or 1
        else:
            n = min(large[length], large[mate])
        runs.append((length, ranks[length], n, 1, bins, 0))
        ranks[length] += n
        large[length] -= n
        if mate:
            runs.append((mate, ranks[mate], n, 1, bins, length))
            ranks[mate] += n
            large[mate] -= n
        add(capacity - length - mate, bins, n)
        bins += n
        rest = [k for k in rest if large[k]]
    for length in sorted((k for k in histogram if 3 * k <= capacity), reverse=True):
        rank, left = 0, histogram[length]
        while left:
            at = bisect.bisect_left(gaps, length)
            if at == len(gaps):
                new = -(-left // (capacity // length))
                add(capacity, bins, new)
                bins += new
                at = len(gaps) - 1
            done = place(length, rank, left, gaps[at])
            rank, left = rank + done, left - done
    return runs


def ranked(items: DataFrame, length: str, order: list[str], rows_a_group: int = 20_000) -> DataFrame:
    """`items` with `_rank`, its place from 0 among the rows of the same length; no group grows with the table."""
    n = items.count()
    salts = max(16, n // rows_a_group)
    salted = items.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)))
    sizes = salted.groupBy(length, "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(length).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col(length).alias("_length"), F.col("_salt").alias("_at"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(length, "_salt").orderBy(*order)
    counted = salted.withColumn("_row", F.row_number().over(inside))
    return counted.join(starts, (F.col(length) == F.col("_length")) & (F.col("_salt") == F.col("_at"))).withColumn("_rank", F.col("_row") - 1 + F.col("_before")).drop("_salt", "_row", "_length", "_at", "_before")


def pack(items: DataFrame, capacity: int = 4096, length: str = "length", order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """`items` with `sequence_id` and `offset`: every row in one sequence of at most `capacity`, gapless from 0.

    `order` names columns that tell rows of a length apart; rows that they don't tell apart are interchangeable, so
    the packing is the same whichever comes first. Columns of `items` pass unchanged whatever their names. Lengths below 1, above the capacity or null are refused.
    """
    histogram = {r[0]: r[1] for r in items.groupBy(length).agg(F.count(F.lit(1))).where(F.coalesce(F.col(length).between(1, capacity), F.lit(False))).limit(capacity).collect()}
    if items.where(~F.coalesce(F.col(length).between(1, capacity), F.lit(False))).limit(1).count():
        raise ValueError(f"a length is null or outside 1 to {capacity}")
    runs = np.array(sorted(plan(histogram, capacity)), np.int64).reshape(-1, 6)
    starts = (runs[:, 0] << 44) + runs[:, 1]

    placed_at = T.StructType([T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    @F.pandas_udf(placed_at)
    def place(lengths: pd.Series, ranks: pd.Series) -> pd.DataFrame:
        run = runs[np.searchsorted(starts, (lengths.to_numpy(np.int64) << 44) + ranks.to_numpy(np.int64), "right") - 1]
        at = ranks.to_numpy(np.int64) - run[:, 1]
        return pd.DataFrame({"sequence_id": run[:, 4] + at // run[:, 3], "offset": run[:, 5] + at % run[:, 3] * run[:, 0]})

    own = items.select(F.struct(*items.columns).alias("row"), F.col(length).cast("long").alias("length"), *[F.col(c).alias(f"order{i}") for i, c in enumerate(order)])
    out = ranked(own, "length", [f"order{i}" for i in range(len(order))]).withColumn("_place", place(F.col("length"), F.col("_rank")))
    return out.select("row.*", F.col("_place.sequence_id").alias("sequence_id"), F.col("_place.offset").alias("offset"))


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """`(doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids])` of all documents.

    Null texts count as empty, repeated rows are packed once each, null doc_ids are kept, other columns are left
    aside whatever their names, and an empty table gives an empty result.
    """
    return pack(durable(pieces(docs, tokenizer, capacity, end_id, doc_id, text, with_ids)), capacity)
