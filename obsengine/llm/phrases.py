"""Phrases whose words go together more often than their parts would by chance, counted by tries over word numbers.

1. A task numbers the words that it reads, each language apart, and writes them as numbers; a `part` is what one such
   dictionary covers. Words with enough occurrences over all parts get a number for the whole table, and each part
   its own words' numbers, so no dictionary of the whole table is sent anywhere.
2. Level by level, candidates of k words are found that no phrase with enough occurrences can miss. Their first and
   last k - 1 words must be candidates too (Apriori), and the tasks' reports of it must leave room for the number asked.
3. The candidates become double-array tries of a bounded size, each broadcast for a pass over the numbered words. Numpy
   takes all positions of a task one level down at a time; a bincount over the accepting states counts them, and the
   tasks' counts are added up as vectors. The same pass counts what would be the next level's reports by buckets of a
   hash (Park, Chen and Yu); a second pass reports those alone whose bucket reaches the number asked.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import durable

LONGEST = 5
#: Signs that part pieces. The full stop stands for all of them between words, which can't hold it.
SIGNS = b".,;:!?\n\x0b\x0c\r"
FOLDED = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ" + SIGNS + b"\t", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * len(SIGNS) + b" ")
CHUNK = 1000  # words of a row of numbers, and up to LONGEST - 1 of context
WORDS = 2_000_000  # of a part
DISTINCT = 250_000  # words in a part's dictionary
KEYS = 2_000_000  # distinct phrases that a task holds before it reports
PHRASES = 500_000  # of a trie
BLOCK = 4096  # counts of a vector in a row
SIEVE = 1 << 26  # bytes of a task's buckets at most
ROOT = 0


def words(text: str) -> list[bytes]:
    """The words of a text in lower case (A to Z alone), a full stop where a piece ends."""
    return text.encode().translate(FOLDED).replace(b"\n", b" . ").split()


class Numbers(dict):
    """Numbers words by first appearance from 0; the full stop is -1."""

    def __init__(self) -> None:
        super().__init__({b".": -1})

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self) - 1
        return n


def chunks(ids: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
    """Rows of `CHUNK` numbers with the LONGEST - 1 that follow as context, and how many are the row's own."""
    for i in range(0, len(ids), CHUNK):
        yield ids[i : i + CHUNK + LONGEST - 1], min(CHUNK, len(ids) - i)


def numbered(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """Rows `(part, lang, ids, own, n)` of numbered words and rows `(part, lang, word, place, n)` of the parts' dictionaries.

    Numbers are places in the part's dictionary and -1 where a piece ends; `n` counts words, or a word's occurrences.
    """
    schema = pa.schema([("part", pa.int64()), ("lang", pa.string()), ("ids", pa.list_(pa.int32())), ("own", pa.int32()), ("word", pa.binary()), ("place", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, closed = TaskContext.get().partitionId(), 0
        open_: dict[str, tuple[Numbers, list[np.ndarray]]] = {}
        held: dict[str, int] = {}

        def close(lang: str) -> Iterator[pa.RecordBatch]:
            nonlocal closed
            numbers, texts = open_.pop(lang)
            held.pop(lang)
            part = task << 24 | closed
            closed += 1
            ids = np.concatenate(texts)
            rows = list(chunks(ids))
            n = [int((r[:own] >= 0).sum()) for r, own in rows]
            for i in range(0, len(rows), 500):
                some = rows[i : i + 500]
                m = len(some)
                yield pa.RecordBatch.from_arrays([pa.array([part] * m), pa.array([lang] * m), pa.array([r for r, _ in some], pa.list_(pa.int32())), pa.array([o for _, o in some], pa.int32()), pa.nulls(m, pa.binary()), pa.nulls(m, pa.int32()), pa.array(n[i : i + 500], pa.int64())], schema=schema)
            counts = np.bincount(ids[ids >= 0], minlength=len(numbers) - 1)
            known = list(numbers)[1:]
            for i in range(0, len(known), 20_000):
                m = len(known[i : i + 20_000])
                yield pa.RecordBatch.from_arrays([pa.array([part] * m), pa.array([lang] * m), pa.nulls(m, pa.list_(pa.int32())), pa.nulls(m, pa.int32()), pa.array(known[i : i + m], pa.binary()), pa.array(range(i, i + m), pa.int32()), pa.array(counts[i : i + m], pa.int64())], schema=schema)

        for batch in batches:
            for t, where in zip(batch.column(0), batch.column(1), strict=True):
                found = words(t.as_py())
                if not found:
                    continue
                where = where.as_py()
                numbers, texts = open_.setdefault(where, (Numbers(), []))
                texts.append(np.fromiter(map(numbers.__getitem__, found), np.int32, len(found)))
                texts.append(np.array([-1], np.int32))
                held[where] = held.get(where, 0) + len(found)
                if held[where] >= WORDS or len(numbers) > DISTINCT:
                    yield from close(where)
            while sum(held.values()) >= 2 * WORDS:
                yield from close(max(held, key=held.get))
        for where in list(open_):
            yield from close(where)

    own = docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"))
    return own.mapInArrow(run, "part long, lang string, ids array<int>, own int, word binary, place int, n long")


class Seen:
    """Phrases of a task by language, as pairs of numbers in one key, with how often the task met them.

    Tasks report everything: a report that a task may keep back has to fall under `least` in all tasks together, which
    leaves nothing to keep back once there are `least` tasks.
    """

    def __init__(self) -> None:
        self.keys: dict[str, list[np.ndarray]] = {}
        self.counts: dict[str, list[np.ndarray]] = {}
        self.held: dict[str, int] = {}

    def add(self, lang: str, keys: np.ndarray) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
        keys, counts = np.unique(keys, return_counts=True)
        self.keys.setdefault(lang, []).append(keys)
        self.counts.setdefault(lang, []).append(counts)
        self.held[lang] = self.held.get(lang, 0) + len(keys)
        if self.held[lang] > KEYS:
            self._merge(lang)
            if self.held[lang] > KEYS // 2:
                yield self._report(lang)

    def _merge(self, lang: str) -> None:
        keys, counts = np.concatenate(self.keys[lang]), np.concatenate(self.counts[lang])
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        self.keys[lang] = [keys[first]]
        self.counts[lang] = [np.add.reduceat(counts, first) if len(first) else counts]
        self.held[lang] = len(first)

    def _report(self, lang: str) -> tuple[str, np.ndarray, np.ndarray]:
        self._merge(lang)
        del self.held[lang]
        return lang, self.keys.pop(lang)[0], self.counts.pop(lang)[0]

    def close(self) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
        for lang in list(self.keys):
            yield self._report(lang)


REPORT = pa.schema([("lang", pa.string()), ("ids", pa.list_(pa.int32())), ("own", pa.int32()), ("phrase", pa.int64()), ("next", pa.int32()), ("n", pa.int64())])
SAID = "lang string, ids array<int>, own int, phrase long, next int, n long"


def _batch(size: int, /, **columns: object) -> pa.RecordBatch:
    """Rows with these columns, the rest null; a single value stands in every row."""
    arrays = []
    for f in REPORT:
        x = columns.get(f.name)
        x = pa.nulls(size, f.type) if x is None else pa.array(x if isinstance(x, (list, np.ndarray)) else [x] * size, f.type)
        arrays.append(x)
    return pa.RecordBatch.from_arrays(arrays, schema=REPORT)


def _reports(found: Iterable[tuple[str, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    for lang, keys, counts in found:
        for i in range(0, len(keys), 50_000):
            k = keys[i : i + 50_000]
            yield _batch(len(k), lang=lang, phrase=k >> 32, next=(k & 0xFFFFFFFF).astype(np.int32), n=counts[i : i + 50_000])


def renumbered(found: DataFrame, frequent: DataFrame) -> DataFrame:
    """The numbered words by the whole table's numbers, -1 where a piece ends and -2 for rarer words, and reports of neighbours."""
    rows = found.where("word IS NULL").select("part", "lang", "ids", "own")
    known = found.where("word IS NOT NULL").select("part", "lang", "word", "place").join(frequent, ["lang", "word"]).select(F.col("part").alias("of_part"), "place", "id")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return REPORT.empty_table()
        left = left.combine_chunks()
        most = max((int(_flat(b.column("ids"))[0].max(initial=-1)) for b in left.to_batches()), default=-1)
        to = np.full(most + 2, -2, np.int32)
        to[right.column("place").to_numpy()] = right.column("id").to_numpy()
        to[-1] = -1  # what ends a piece
        seen, reports, out = Seen(), [], []
        lang = left.column("lang")[0].as_py()
        for batch in left.to_batches(500):
            ids, sizes = _flat(batch.column("ids"))
            ids, row = to[ids], _row(sizes)
            at = np.flatnonzero(_mine(sizes, batch.column("own").to_numpy())[:-1] & (row[1:] == row[:-1]) & (ids[1:] >= 0) & (ids[:-1] >= 0))
            reports += seen.add(lang, ids[at].astype(np.int64) << 32 | ids[at + 1])
            cuts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            own = [batch.column("lang"), pa.ListArray.from_arrays(pa.array(cuts), pa.array(ids)), batch.column("own")]
            out.append(pa.RecordBatch.from_arrays([*own, *[pa.nulls(batch.num_rows, f.type) for f in list(REPORT)[3:]]], schema=REPORT))
        return pa.Table.from_batches([*out, *_reports([*reports, *seen.close()])], schema=REPORT)

    return rows.groupBy("part").cogroup(known.groupBy("of_part")).applyInArrow(run, SAID)


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return lists.flatten().to_numpy(zero_copy_only=False), pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False)


def _row(sizes: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(sizes)), sizes)


def _mine(sizes: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Which places of rows laid one behind another aren't context."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes) < np.repeat(own, sizes)


class DoubleArray:
    """A trie over word numbers: the child of state s by symbol x is `base[s] + x`, if `check` there says s.

    `symbols` are the sorted word numbers that occur; a word's symbol is its place among them. Phrases have one length
    and come sorted and distinct; `accepts` gives the phrase of a last state, -1 elsewhere.
    """

    def __init__(self, phrases: np.ndarray) -> None:
        n, k = phrases.shape
        self.symbols = np.unique(phrases)
        coded = np.searchsorted(self.symbols, phrases)
        wide = len(self.symbols)
        self.base = np.zeros(wide + 1, np.int64)
        self.check = np.full(wide + 1, -1, np.int64)
        state = np.zeros(n, np.int64)  # of each phrase, so far
        self.base[ROOT] = 1
        low = 1  # below it all places are taken, or too few are free to be tried again
        for depth in range(k):
            new = np.ones(n, bool)
            if depth or n > 1:
                new[1:] = (state[1:] != state[:-1]) | (coded[1:, depth] != coded[:-1, depth])
            first = np.flatnonzero(new)
            parents, child = state[first], coded[first, depth]
            starts = np.flatnonzero(np.concatenate([[True], parents[1:] != parents[:-1]])) if len(parents) else np.zeros(0, np.int64)
            sizes = np.diff(np.append(starts, len(parents)))
            if depth == 0:
                self.check[1 + child] = ROOT
            else:
                for j in np.argsort(-sizes, kind="stable")[: int((sizes > 1).sum())].tolist():
                    own = child[starts[j] : starts[j] + sizes[j]]
                    low = self._place(parents[starts[j]], own, low)
                single = starts[sizes == 1]
                self._place_single(parents[single], child[single])
            spot = self.base[parents] + child
            state = np.repeat(spot, np.diff(np.append(first, n)))
        self.accepts = np.full(len(self.check), -1, np.int64)
        self.accepts[state] = np.arange(n)

    def _grow(self, size: int) -> None:
        if size > len(self.check):
            more = max(size, len(self.check) * 5 // 4) - len(self.check)
            self.base = np.concatenate([self.base, np.zeros(more, np.int64)])
            self.check = np.concatenate([self.check, np.full(more, -1, np.int64)])

    def _place(self, parent: int, own: np.ndarray, low: int) -> int:
        """Put children where all their places are free; where a stretch has no room the search doesn't come back to it."""
        while True:
            self._grow(low + 2048 + len(self.symbols))
            at = low + np.flatnonzero(self.check[low : low + 1024] < 0)
            fits = np.ones(len(at), bool)
            for x in (own[1:] - own[0]).tolist():
                fits &= self.check[at + x] < 0
                if not fits.any():
                    break
            if fits.any():
                base = int(at[np.argmax(fits)] - own[0])
                self.base[parent] = base
                self.check[base + own] = parent
                return low
            low += 1024

    def _place_single(self, parents: np.ndarray, own: np.ndarray) -> None:
        """Lone children take any free places."""
        free = np.flatnonzero(self.check[1:] < 0) + 1
        if len(free) < len(own):
            at = len(self.check)
            self._grow(at + len(own))
            free = np.append(free, np.arange(at, len(self.check)))
        free = free[: len(own)]
        self.base[parents] = free - own
        self.check[free] = parents

    def symbol(self, ids: np.ndarray) -> np.ndarray:
        """Word numbers as symbols, -1 for words that the trie doesn't hold."""
        if not len(self.symbols):
            return np.full(len(ids), -1, np.int64)
        at = np.minimum(np.searchsorted(self.symbols, ids), len(self.symbols) - 1)
        return np.where(self.symbols[at] == ids, at, -1)

    def walk(self, symbols: np.ndarray, at: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray]:
        """Of the places in `at` those from which `levels` symbols lead down the trie, and the states that they reach."""
        state = np.zeros(len(at), np.int64)
        for level in range(levels):
            inside = at + level < len(symbols)
            at, state = at[inside], state[inside]
            x = symbols[at + level]
            to = self.base[state] + x
            there = (x >= 0) & (to >= 0) & (to < len(self.check))
            at, state, to = at[there], state[there], to[there]
            there = self.check[to] == state
            at, state = at[there], to[there]
        return at, state


def _places(batches: Iterator[pa.RecordBatch], own: DoubleArray, k: int, whole: bool) -> Iterator[tuple[np.ndarray, list[tuple[str, np.ndarray]]]]:
    """Of some rows at a time the trie's phrases, one for each place, and by language the keys of those with a word behind.

    A key is the phrase's number in the trie and the word that follows. With the `whole` level in one trie the last k
    words have to be a candidate as well.
    """
    for batch in (rows.slice(i, 250) for rows in batches for i in range(0, rows.num_rows, 250)):
        ids, sizes = _flat(batch.column("ids"))
        if not len(ids):
            continue
        # a sign before each row but the first: nothing runs from one row into the next
        before = np.cumsum(sizes)[:-1]
        row = np.insert(_row(sizes), before, -1)
        mine = np.insert(_mine(sizes, batch.column("own").to_numpy()), before, False)
        ids = np.insert(ids, before, -1)
        symbols = own.symbol(ids)
        at = np.flatnonzero(symbols >= 0)
        at, state = own.walk(symbols, at, k)
        phrase = own.accepts[state]
        here = mine[at]
        met, keys = phrase[here], []
        if k < LONGEST:
            of = np.full(len(ids) + 1, -1, np.int64)
            of[at] = phrase
            at, phrase = at[here], phrase[here]
            follows = at + k < len(ids)
            at, phrase = at[follows], phrase[follows]
            follows = (of[at + 1] >= 0) if whole else ids[at + k] >= 0
            at, phrase = at[follows], phrase[follows]
            key = phrase << 32 | ids[at + k]
            langs = pa.compute.dictionary_encode(batch.column("lang"))
            lang_of = langs.indices.to_numpy()[row[at]]
            keys = [(name, key[lang_of == i]) for i, name in enumerate(langs.dictionary.to_pylist())]
        yield met, keys


def buckets(places: int, least: int) -> int:
    """How many buckets keep the mean of so many places to a quarter of `least`: a power of two, within `SIEVE` bytes."""
    most = SIEVE // np.min_scalar_type(least).itemsize
    return min(1 << max(BLOCK.bit_length() + 2, (4 * places // least).bit_length()), 1 << most.bit_length() - 1)


def _bucket(keys: np.ndarray, size: int) -> np.ndarray:
    h = keys.astype(np.uint64)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x9E3779B97F4A7C15)
    return (h >> np.uint64(65 - size.bit_length())).astype(np.int64)


VECTORS = pa.schema([("sieve", pa.bool_()), ("block", pa.int64()), ("counts", pa.binary())])


def _vectors(sieve: bool, counts: np.ndarray, wide: int) -> Iterator[pa.RecordBatch]:
    """The blocks of a vector that aren't all zero, up to 64 at a time."""
    for i in range(0, len(counts), 64 * wide):
        some = [(j // wide, c.tobytes()) for j in range(i, min(i + 64 * wide, len(counts)), wide) if (c := counts[j : j + wide]).any()]
        yield pa.RecordBatch.from_arrays([pa.array([sieve] * len(some), pa.bool_()), pa.array([b for b, _ in some], pa.int64()), pa.array([c for _, c in some], pa.binary())], schema=VECTORS)


def counted(chunks_: DataFrame, trie: object, k: int, whole: bool, size: int, least: int) -> DataFrame:
    """`(sieve, block, phrase, n, bits)`: counts of a trie's phrases, and which of `size` buckets of what follows them reach `least`.

    A task tells its counts as vectors in blocks, which are added up block by block. A task's bucket counts to `least` at
    most; of the sums only a bit is left.
    """
    kind = np.min_scalar_type(least)
    wide = BLOCK * 8 // kind.itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: DoubleArray = trie.value
        counts = np.zeros(int(own.accepts.max(initial=-1)) + 1, np.int64)
        sieve = np.zeros(size if k < LONGEST else 0, kind)
        for met, found in _places(batches, own, k, whole):
            counts += np.bincount(met, minlength=len(counts))
            for _, keys in found:
                at, n = np.unique(_bucket(keys, size), return_counts=True)
                sieve[at] = np.minimum(sieve[at] + n, least)
        yield from _vectors(False, counts, BLOCK)
        yield from _vectors(True, sieve, wide)

    def add(key: tuple, rows: pa.Table) -> pa.Table:
        sieve, block = (x.as_py() for x in key)
        total = 0
        for c in rows.column("counts"):
            total = total + np.frombuffer(c.as_buffer(), kind if sieve else np.int64).astype(np.int64)
        if sieve:
            return pa.table({"sieve": [True], "block": pa.array([block]), "phrase": pa.nulls(1, pa.int64()), "n": pa.nulls(1, pa.int64()), "bits": pa.array([np.packbits(total >= least).tobytes()], pa.binary())})
        found = np.flatnonzero(total)
        m = len(found)
        return pa.table({"sieve": pa.array([False] * m, pa.bool_()), "block": pa.array([block] * m, pa.int64()), "phrase": block * BLOCK + found, "n": total[found], "bits": pa.nulls(m, pa.binary())})

    told = chunks_.mapInArrow(run, "sieve boolean, block long, counts binary")
    return told.groupBy("sieve", "block").applyInArrow(add, "sieve boolean, block long, phrase long, n long, bits binary")


def sieve_of(sums: DataFrame, size: int, least: int) -> np.ndarray:
    """The buckets' bits in one array of `size / 8` bytes, which `SIEVE` bounds."""
    wide = BLOCK // np.min_scalar_type(least).itemsize
    bits = np.zeros(size // 8, np.uint8)
    found = sums.where("sieve").select("block", "bits").toArrow()
    for block, b in zip(found.column("block").to_pylist(), found.column("bits"), strict=True):
        bits[block * wide : (block + 1) * wide] = np.frombuffer(b.as_buffer(), np.uint8)
    return bits


def passed(chunks_: DataFrame, trie: object, sieve: object, first: int, k: int, whole: bool) -> DataFrame:
    """Reports `(lang, phrase, next, n)` of what follows a trie's phrases, numbered from `first`, where the sieve's bit is set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = sieve.value
        seen = Seen()
        for _, found in _places(batches, trie.value, k, whole):
            for lang, keys in found:
                at = _bucket(keys, 8 * len(bits))
                keys = keys[bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1 == 1]
                yield from _reports(seen.add(lang, keys + (first << 32)))
        yield from _reports(seen.close())

    return chunks_.mapInArrow(run, SAID)


def bounded(found: DataFrame, least: int) -> DataFrame:
    """Reported phrases `(phrase, next, n)` whose reports leave room for `least` occurrences, with their language."""
    most = found.where("next IS NOT NULL").groupBy("lang", "phrase", "next").agg(F.sum("n").alias("n"))
    return most.where(F.col("n") >= least).select("lang", "phrase", "next", "n")


def with_number(df: DataFrame, to: str, *order: str) -> DataFrame:
    """`df` with numbers from 0 in some order, dense, without a window over all rows."""
    own = durable(df.withColumn("_task", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id()))
    sizes = own.groupBy("_task").agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_least"))
    before = sizes.select("_task", F.col("_least"), (F.coalesce(F.sum("_n").over(Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("_before"))  # a row a task
    return own.join(before, "_task").withColumn(to, F.col("_row") - F.col("_least") + F.col("_before")).drop("_task", "_row", "_n", "_least", "_before")


def counts(docs: DataFrame, least: int = 100, text: str = "text", lang: str = "lang") -> DataFrame:
    """`(lang, phrase, k, f, n)`: phrases of one to five words with at least `least` occurrences, and the language's words."""
    spark, least = docs.sparkSession, max(least, 1)  # what doesn't occur is no phrase
    found = durable(numbered(docs, text, lang))
    totals = durable(found.where("word IS NULL").groupBy("lang").agg(F.sum("n").alias("total")))
    often = found.where("word IS NOT NULL").groupBy("lang", "word").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
    frequent = durable(with_number(often, "id").withColumn("id", F.col("id").cast("int")))
    said = durable(renumbered(found, frequent.select("lang", "word", "id")))
    # apart from the reports and by language: a phrase is in the tasks of its own language alone
    chunks_ = said.where("ids IS NOT NULL").select("lang", "ids", "own", F.spark_partition_id().alias("_of"))
    # a pass is two tasks a core, however long the text: what tasks tell of a phrase or bucket grows with the cores alone
    chunks_ = durable(chunks_.repartitionByRange("lang", "_of").drop("_of")).coalesce(2 * spark.sparkContext.defaultParallelism)
    # a phrase of each level as its words' numbers
    level = frequent.select("lang", F.col("id").cast("long").alias("phrase"), F.array("id").alias("ids"), "f")
    levels = [level.select("lang", "ids", "f")]
    for k in range(2, LONGEST + 1):
        new = bounded(said, least).join(level.select(F.col("phrase").alias("_head"), "ids"), F.col("phrase") == F.col("_head")).select("lang", F.concat("ids", F.array("next")).alias("ids"), "n")
        candidates = durable(new)
        n = candidates.count()
        shards = -(-n // PHRASES)
        if not n:
            break
        # a shard is the phrases of some first words: a bounded table, from which the driver lays one trie
        spread = candidates.withColumn("_shard", F.pmod(F.xxhash64(F.slice("ids", 1, 2)), F.lit(shards)))
        spread = durable(spread) if shards > 1 else spread
        passes, table, exact, first = [], [], [], 0
        for shard in range(shards):
            rows = spread.where(F.col("_shard") == shard).select("ids", "lang", "n").toArrow()
            flat, _ = _flat(rows.column("ids").combine_chunks())
            phrases = flat.reshape(-1, k)
            order = np.lexsort(phrases.T[::-1])
            phrases = phrases[order]
            trie = spark.sparkContext.broadcast(DoubleArray(phrases))
            table.append(durable(spark.createDataFrame(pa.table({"phrase": np.arange(first, first + len(phrases)), "ids": pa.FixedSizeListArray.from_arrays(pa.array(phrases.ravel()), k).cast(pa.list_(pa.int32())), "lang": rows.column("lang").take(pa.array(order))}))))
            size = buckets(pa.compute.sum(rows.column("n")).as_py() or 0, least)
            sums = durable(counted(chunks_, trie, k, shards == 1, size, least))
            exact.append(sums.where("NOT sieve").select((F.col("phrase") + first).alias("phrase"), F.col("n").alias("f")))
            if k < LONGEST:
                sieve = spark.sparkContext.broadcast(sieve_of(sums, size, least))
                passes.append(durable(passed(chunks_, trie, sieve, first, k, shards == 1)))
                sieve.unpersist()
            trie.unpersist()
            first += len(phrases)
        known = reduce(DataFrame.unionByName, exact).where(F.col("f") >= least)
        level = durable(reduce(DataFrame.unionByName, table).join(known, "phrase").select("lang", "phrase", "ids", "f"))
        levels.append(level.select("lang", "ids", "f"))
        if passes:
            said = reduce(DataFrame.unionByName, passes)
    all_ = durable(reduce(DataFrame.unionByName, levels))
    places = all_.select("lang", "ids", "f", F.posexplode("ids").alias("_at", "id")).join(frequent.select("id", "word"), "id")
    spelled = places.groupBy("lang", "ids", "f").agg(F.array_sort(F.collect_list(F.struct("_at", F.col("word").cast("string").alias("word")))).alias("_words"))
    return spelled.join(totals, "lang").select("lang", "ids", F.array_join("_words.word", " ").alias("phrase"), F.size("ids").alias("k"), "f", F.col("total").alias("n"))


def collocations(docs: DataFrame, least: int = 100, top: int = 2000, text: str = "text", lang: str = "lang") -> DataFrame:
    """`(lang, rank, phrase, a, l, r, n, score)`: of each language the `top` phrases of two to five words by score.

    A phrase of `a >= least` occurrences, cut after its first words into parts of l and r, scores
    `floor(1000 * a * n / (l * r))` with the language's n words; its lowest cut counts, of equal ones that with the
    shortest first part. Phrases inside a longer one with as many occurrences are left out. Ties go by `a`, then the
    phrase's bytes. Texts are lower-cased in A to Z, pieces end at `. , ; : ! ?` and line ends, words at spaces and tabs.

    Null texts are empty, null languages `und`, repeated rows count each, other columns are left aside whatever their
    names, and an empty table gives an empty result. Sums and products are exact up to 38 digits.
    """
    found = durable(counts(docs, least, text, lang))
    part = found.select("lang", F.col("ids").alias("_part"), F.col("f"))
    own = found.where("k > 1")
    cuts = own.withColumn("_cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    cuts = cuts.withColumns({"_head": F.slice("ids", 1, F.col("_cut")), "_tail": F.slice("ids", F.col("_cut") + 1, F.col("k") - F.col("_cut"))})
    heads, tails = (part.withColumnsRenamed({"_part": name, "f": f}).drop("lang") for name, f in (("_head", "l"), ("_tail", "r")))
    exact = lambda c: F.col(c).cast("decimal(18,0)")
    scored = cuts.join(heads, "_head").join(tails, "_tail").withColumns({"_top": F.lit(1000).cast("decimal(4,0)") * exact("f") * exact("n").cast("decimal(16,0)"), "_below": exact("l") * exact("r")}).withColumn("score", F.expr("_top div _below"))
    best = scored.groupBy("lang", "ids", "phrase", F.col("f").alias("a"), "n").agg(F.min_by(F.struct("score", "l", "r"), F.struct("score", "_cut")).alias("_best"))
    # a longer phrase with as many occurrences has one of the next length between them
    longer = own.where("k > 2").select(F.explode(F.array(F.expr("slice(ids, 1, k - 1)"), F.expr("slice(ids, 2, k - 1)"))).alias("_inside"), F.col("f").alias("_f")).distinct()
    kept = best.join(longer, (F.col("ids") == F.col("_inside")) & (F.col("a") == F.col("_f")), "left_anti").select("lang", "phrase", "a", "_best.l", "_best.r", "n", "_best.score")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    some = kept.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    some = some.withColumn("_rank", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order))).where(F.col("_rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
