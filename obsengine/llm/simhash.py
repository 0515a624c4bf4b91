"""SimHash near-duplicates: fingerprints, and their links within a few bits through a segment-popcount grid.

Fingerprints are cut into two-bit segments and mapped to the vector of their segments' bit counts. The Manhattan
distance of two such vectors never exceeds the Hamming distance of the fingerprints. So vectors further apart than
the radius can't link. The segments are dealt to `bands + radius` grid axes: vectors within the radius agree on at
least `bands` axes, hence share a grid cell for some choice of `bands` axes. Members of a cell are compared exactly.

The number of bands follows from the number of fingerprints, so that cells stay small however many there are. A cell
that is crowded all the same (texts much alike) is split by further axes, over the bits themselves in another order:
the argument holds for any axes. A cell returns a spanning forest of its links, never the pairs, so a group of n near
copies costs n rows per cell.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, durable

SEED = 42
WORDS_AT_ONCE = 1 << 16
LOW = 0x5555555555555555  # the lower bit of each segment
#: Bits of a segment's count that two random fingerprints share by chance: -log2(1/16 + 1/4 + 1/16).
SEGMENT_BITS = 1.415
EXPECTED_IN_CELL = 32
#: Odd steps that put the 64 bits in another order for each further split.
STEPS = (5, 11, 23, 29, 37, 43, 53)


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """The unsigned 64-bit SimHash of the whole text: words split at ASCII white space, A-Z lower-cased, repeats counted.

    A text of fewer than `shingle` words is one shingle; one without words, or null, has fingerprint 0.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    stops = ends[min(shingle, len(words)) - 1 :].tolist()
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, WORDS_AT_ONCE):
        hashes = [digest(line[i:j], SEED) for i, j in zip(starts[at : at + WORDS_AT_ONCE], stops[at : at + WORDS_AT_ONCE], strict=True)]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 4) -> DataFrame:
    """`(doc_id, fp)` for every row, fp as a signed long. Null and empty texts have 0; repeated rows stay repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], ["doc_id", "fp"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def axes(bands: int, radius: int) -> list[tuple[int, int]]:
    """The first and past-the-last two-bit segment of each grid axis."""
    n = bands + radius
    cut = [round(32 * i / n) for i in range(n + 1)]
    return list(zip(cut, cut[1:], strict=False))


def bands_for(n: int, radius: int) -> int:
    """The fewest bands, two at least, for which `n` random fingerprints make cells of some 32."""
    bands = 2
    while bands + radius < 32 and n > EXPECTED_IN_CELL * 2 ** (SEGMENT_BITS * 32 * bands / (bands + radius)):
        bands += 1
    return bands


def embed(fp: np.ndarray) -> np.ndarray:
    """The bit count of each two-bit segment in unary (00, 01, 11), so that differing bits are the Manhattan distance."""
    low, one = np.uint64(LOW), np.uint64(1)
    return ((fp | fp >> one) & low) | ((fp & fp >> one) & low) << one


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _masks(pieces: list[int], bands: int) -> list[int]:
    """The union of each choice of `bands` pieces, as signed longs."""
    return [_signed(sum(some)) for some in combinations(pieces, bands)]


def grid_cells(fps: DataFrame, bands: int = 2, radius: int = 4) -> DataFrame:
    """`(cell, fp)`: every fingerprint in one cell for each choice of `bands` axes."""
    pieces = [((1 << 2 * j) - 1) ^ ((1 << 2 * i) - 1) for i, j in axes(bands, radius)]
    next_bit = F.shiftrightunsigned("fp", 1)
    some = F.col("fp").bitwiseOR(next_bit).bitwiseAND(F.lit(LOW))
    both = F.col("fp").bitwiseAND(next_bit).bitwiseAND(F.lit(LOW))
    counts = fps.select("fp", some.bitwiseOR(F.shiftleft(both, 1)).alias("counts"))
    posted = counts.select("fp", "counts", F.posexplode(F.array(*[F.lit(m) for m in _masks(pieces, bands)])).alias("axes", "mask"))
    return posted.select(F.xxhash64("axes", F.col("counts").bitwiseAND(F.col("mask"))).alias("cell"), "fp")


def split_cells(cells: DataFrame, step: int, bands: int = 2, radius: int = 4) -> DataFrame:
    """`(cell, fp)`: each member of a cell in one smaller cell for each choice of `bands` of the axes that `step` orders.

    Members of a cell within the radius share a smaller one, as they differ on `radius` of its axes at most.
    """
    pieces = [0] * (bands + radius)
    for bit in range(64):
        pieces[bit * step % 64 * len(pieces) // 64] |= 1 << bit
    posted = cells.select("cell", "fp", F.posexplode(F.array(*[F.lit(m) for m in _masks(pieces, bands)])).alias("axes", "mask"))
    return posted.select(F.xxhash64("cell", "axes", F.col("fp").bitwiseAND(F.col("mask"))).alias("cell"), "fp")


def _forest(n: int, a: np.ndarray, b: np.ndarray, root: np.ndarray | None = None) -> np.ndarray:
    """The least position that each of `n` reaches by the links a-b, and by those that `root` stands for."""
    root = np.arange(n) if root is None else root
    while len(a):
        low = np.minimum(root[a], root[b])
        new = root.copy()
        for at in (a, b, root[a], root[b]):
            np.minimum.at(new, at, low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    return root


def _near(x: np.ndarray, y: np.ndarray, radius: int) -> np.ndarray:
    """Which pairs are within the radius: Manhattan distance of the counts first, then the bits themselves."""
    near = np.bitwise_count(embed(x) ^ embed(y)) <= radius
    near[near] = np.bitwise_count((x ^ y)[near]) <= radius
    return near


def _cell_links(members: np.ndarray, sizes: np.ndarray, radius: int, pairs_at_once: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links of many cells: `members` holds their fingerprints one cell after another. Each linked one beside its root."""
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    order = np.argsort(sizes, kind="stable")
    at = 0
    while at < len(order):
        size = int(sizes[order[at]])
        if size * size <= pairs_at_once:  # cells of one size together
            some = order[at : min(int(np.searchsorted(sizes[order], size, "right")), at + max(1, pairs_at_once // (size * size)))]
            rows = members[starts[some][:, None] + np.arange(size)]
            i, j = np.triu_indices(size, 1)
            cell, pair = np.nonzero(_near(rows[:, i], rows[:, j], radius))
            flat = rows.ravel()
            root = _forest(len(flat), cell * size + i[pair], cell * size + j[pair])
        else:  # a large cell by stretches of its rows
            some, flat = order[at : at + 1], members[starts[order[at]] : starts[order[at]] + size]
            root, stretch = np.arange(size), max(1, pairs_at_once // size)
            for k in range(0, size, stretch):
                a, b = np.nonzero(_near(flat[k : k + stretch, None], flat[None, k:], radius))
                root = _forest(size, a + k, b + k, root)
        at += len(some)
        moved = np.flatnonzero(root != np.arange(len(flat)))
        yield flat[moved], flat[root[moved]]


def links(fps: DataFrame, radius: int = 4, bands: int | None = None, most_in_cell: int = 4096) -> DataFrame:
    """`(a, b)`: links between distinct fingerprints whose components are those of all pairs within `radius` bits.

    `bands` follows from the count of `fps` unless given. A cell of more than `most_in_cell` is split, again and again:
    many different fingerprints differ in many bits, so each split leaves a group of them smaller by half or more.
    """
    bands = bands or bands_for(fps.count(), radius)
    cells, done = grid_cells(fps, bands, radius), []
    for step in STEPS:
        crowded = durable(cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most_in_cell).select("cell"))
        if not crowded.limit(1).count():
            break
        done.append(cells.join(crowded, "cell", "left_anti"))
        cells = durable(split_cells(cells.join(crowded, "cell", "left_semi"), step, bands, radius))
    for part in done:
        cells = cells.unionByName(part)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            found = list(_cell_links(lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64), sizes, radius))
            if found:
                a, b = (np.concatenate(x).view(np.int64) for x in zip(*found, strict=True))
                kept = np.unique(np.stack([a, b]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(kept[0]), pa.array(kept[1])], ["a", "b"])

    held = cells.groupBy("cell").agg(F.collect_list("fp").alias("fps")).where("size(fps) > 1").select("fps")
    return held.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 4, radius: int = 4, bands: int | None = None, most_in_cell: int = 4096) -> DataFrame:
    """`(doc_id, fp, component_id)` for every row; component_id is the least doc_id that links of `radius` bits reach.

    Texts without words have fingerprint 0 and link as any other. Equal fingerprints are one node of the graph, so
    exact copies cost nothing beyond their rows. Repeated rows stay; a row whose doc_id is null keeps it and takes
    part, and a component of such rows only has a null component_id. Other columns are left aside whatever their
    names. An empty table gives an empty result.
    """
    own = durable(fingerprints(docs, doc_id, text, shingle))
    nodes = durable(own.groupBy("fp").agg(F.min("doc_id").alias("low")))
    # nodes are named by their least doc_id first, so that the root of a component holds its least doc_id
    named = nodes.select("fp", F.struct(F.col("low").isNull().alias("none"), "low", "fp").alias("key"))
    found = links(nodes.select("fp"), radius, bands, most_in_cell)
    keyed = found.join(named.select(F.col("fp").alias("a"), F.col("key").alias("key_a")), "a").join(named.select(F.col("fp").alias("b"), F.col("key").alias("key_b")), "b")
    roots = components(keyed, "key_a", "key_b").select(F.col("node.fp").alias("node"), F.col("root.low").alias("least"))
    placed = nodes.join(roots, F.col("fp") == F.col("node"), "left").select(F.col("fp").alias("node"), F.when(F.col("node").isNull(), F.col("low")).otherwise(F.col("least")).alias("component_id"))
    placed = durable(placed)  # so that the join below has nothing but its two exchanges, and Spark splits hot fingerprints
    return own.join(placed, F.col("fp") == F.col("node"), "left").select("doc_id", "fp", "component_id")
