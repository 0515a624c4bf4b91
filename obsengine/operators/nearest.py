"""Exact nearest rows by Euclidean distance, found block by block: no task sees more than two blocks."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PAIRS = 1 << 16  # whose exact distances are computed at once
TASKS = 24  # that small tables are spread over
ROWS, TILE = 256, 2048  # of a product, which stays in a core's cache


def _vectors(rows: pa.Table) -> tuple[pa.Table, np.ndarray]:
    """Rows whose vector has a finite square, by id, and their vectors."""
    rows = rows.take(pa.compute.sort_indices(rows.column("id")))
    v = rows.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(rows.num_rows, -1)
    with np.errstate(over="ignore"):
        fine = np.isfinite((v**2).sum(1))
    return (rows, v) if fine.all() else (rows.filter(pa.array(fine)), v[fine])


def _own(ids: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the sorted `others` are a query itself: query and place."""
    low, high = np.searchsorted(others, ids), np.searchsorted(others, ids, "right")
    row = np.repeat(np.arange(len(ids)), high - low)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(high - low) - high, high - low)


def _near(ids: np.ndarray, x: np.ndarray, others: np.ndarray, tiles: list[np.ndarray], k: int, slack: float) -> tuple[np.ndarray, np.ndarray]:
    """Query and place of all that may be among the k next, sorted by query: those under a bound that k rows are known to keep."""
    own, of_own = _own(ids, others)
    left, cut = np.hstack([x, np.ones((len(x), 1))]).astype(tiles[0].dtype), np.full(len(x), np.inf, tiles[0].dtype)
    found, at = [], 0
    for tile in tiles:
        d = left @ tile
        n = d.shape[1]
        inside = (of_own >= at) & (of_own < at + n)
        d[own[inside], of_own[inside] - at] = np.inf
        least = d[:, : n // 64 * 64].reshape(len(d), -1, 64).min(1) if k <= 64 <= n else d  # the least of each of 64 groups
        if k <= least.shape[1]:
            cut = np.minimum(cut, np.partition(least, k - 1, axis=1)[:, k - 1])
        row, col = np.divmod(np.flatnonzero(d <= (cut + slack)[:, None]), n)
        found.append((row, col + at, d[row, col]))
        at += n
    row, col, d = map(np.concatenate, zip(*found, strict=True))
    may = np.flatnonzero((d <= (cut + slack)[row]) & np.isfinite(d))
    may = may[np.argsort(row[may], kind="stable")]
    return row[may], col[may]


def _closest(ids: np.ndarray, x: np.ndarray, others: np.ndarray, y: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, place in `y` and distance of the k rows of `y` next to each of `x`, ties to the earlier place.

    Products in single precision leave what may be among the k, up to their rounding; that is measured exactly. Where
    they leave much, as with vectors of very different length, products in double precision take their place.
    """
    scale = np.sqrt(max((x**2).sum(1).max(), (y**2).sum(1).max())) or 1.0
    right = np.vstack([-2 * (y / scale).T, ((y / scale) ** 2).sum(1)])
    tiles = {t: [np.ascontiguousarray(right[:, i : i + TILE].astype(t)) for i in range(0, len(y), TILE)] for t in (np.float32, np.float64)}
    out = []
    for at in range(0, len(x), ROWS):
        part, own = x[at : at + ROWS], ids[at : at + ROWS]
        for kind, own_tiles in tiles.items():  # no square passes 3, so no sum is off by more than a quarter of the slack
            row, col = _near(own, part / scale, others, own_tiles, k, 16 * (x.shape[1] + 4) * float(np.finfo(kind).eps))
            if len(row) <= 32 * (k + 1) * len(part):
                break
        exact = [np.sqrt(((part[row[i : i + PAIRS]] - y[col[i : i + PAIRS]]) ** 2).sum(1)) for i in range(0, len(row), PAIRS)]
        exact = np.concatenate(exact) if exact else np.zeros(0)
        order = np.lexsort((col, exact, row))
        nth = np.arange(len(row)) - np.searchsorted(row, row)
        order = order[nth < k]
        out.append((at + row[order], col[order], exact[order]))
    return tuple(map(np.concatenate, zip(*out, strict=True)))


def nearest(queries: DataFrame, library: DataFrame, k: int, by: Sequence[str] = (), block: int = 16384) -> DataFrame:
    """`(by, id, rank, other, distance)`: of each query `(by, id, v)` the k nearest rows `(by, id, v)` of the library.

    Rows meet within `by` only; ties go to the lesser id, and a query doesn't find its own id. Both sides are dealt to
    blocks of about `block` rows by a hash of their id, each pair of blocks is compared in one group and keeps k rows a
    query, so that the data is repeated as often as the other side has blocks. Few queries are cut into smaller blocks,
    down to a sixteenth, so that `TASKS` tasks have work. Vectors null or without a finite square take no part.
    """
    blocks = lambda n, size: max(1, -(-n // max(1, size)))
    left, right = (df.select(*by, "id", "v").where("v IS NOT NULL") for df in (queries, library))
    nq, fn = left.count(), blocks(right.count(), block)
    qn = max(blocks(nq, block), min(blocks(nq, block // 16), blocks(TASKS, fn)))
    keys = [*by, "_q", "_f"]
    deal = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    spread = lambda df: df.repartition(min(4096, max(TASKS, 2 * qn * fn)), *keys)  # noqa: E731  not by size: small blocks are much work
    left = spread(left.withColumn("_q", deal(qn)).withColumn("_f", every(fn)))
    right = spread(right.withColumn("_f", deal(fn)).withColumn("_q", every(qn)))
    kinds = dict(queries.dtypes)
    schema = ", ".join([*[f"{c} {kinds[c]}" for c in by], f"id {kinds['id']}, other {kinds['id']}, distance double"])

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        names = [*by, "id", "other", "distance"]
        kept = None
        if a.num_rows and b.num_rows:
            (a, x), (b, y) = _vectors(a), _vectors(b)
            if len(x) and len(y):
                numbers = lambda t: t.column("id").to_numpy()
                row, col, distance = _closest(numbers(a), x, numbers(b), y, k)
                kept = [a.column("id").take(pa.array(row)), b.column("id").take(pa.array(col)), pa.array(distance)]
                kept = pa.table([*[a.column(c).take(pa.array(row)) for c in by], *kept], names)
        return pa.table([*[a.column(c).slice(0, 0) for c in [*by, "id", "id"]], pa.array([], pa.float64())], names) if kept is None else kept

    met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, schema)
    rank = F.row_number().over(Window.partitionBy(*by, "id").orderBy("distance", "other"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k).select(*by, "id", "rank", "other", "distance")


def nearest_neighbour_detector(rows: DataFrame, fitting: DataFrame, k: int) -> DataFrame:
    """`(id, score)`: the mean distance of rows `(id, v)` to their k nearest fitting rows, a fitting row's own aside."""
    return nearest(rows, fitting, k).groupBy("id").agg(F.avg("distance").alias("score"))
