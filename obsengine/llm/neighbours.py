"""Approximate nearest neighbours by a permutation index.

A vector is represented by its nearest pivots in order, found once for each row. Pivots are vectors drawn by seeded
rank. Rows are dealt to blocks; a block's inverted file lists its rows under each of their pivots, with the pivot's
place in the row's order. A query reads its own pivots' lists only and adds up how far the footrule distance falls
below that of orders with no pivot in common; cosines are computed for the nearest share by footrule alone.

Equal vectors are one entry with their smallest ids, so a vector that fills much of the table takes one place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import durable, seeded


def orders(vectors: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The numbers of each row's `prefix` nearest pivots, nearest first; unit rows and pivots."""
    near = vectors @ pivots.T
    prefix = min(prefix, len(pivots))
    some = np.argpartition(-near, prefix - 1, axis=1)[:, :prefix] if prefix < len(pivots) else np.broadcast_to(np.arange(len(pivots)), near.shape)
    return np.take_along_axis(some, np.argsort(-np.take_along_axis(near, some, 1), axis=1, kind="stable"), 1)


def postings(row_orders: np.ndarray, n_pivots: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The inverted file of a block: rows and their places under each pivot, and where each pivot's list begins and ends."""
    prefix = row_orders.shape[1]
    flat = row_orders.ravel()
    order = np.argsort(flat, kind="stable")
    return order // prefix, order % prefix, np.searchsorted(flat[order], np.arange(n_pivots + 1))


def footrule_gain(query_orders: np.ndarray, lists: tuple[np.ndarray, np.ndarray, np.ndarray], n_rows: int) -> np.ndarray:
    """`prefix * (prefix + 1)` less the footrule distance, for every query and row, from the queries' own pivots' lists.

    A pivot outside an order stands at place `prefix`; so only shared pivots count, by `2 * (prefix - later place)`.
    """
    rows, place, cut = lists
    n, prefix = query_orders.shape
    flat = query_orders.ravel()
    sizes = cut[flat + 1] - cut[flat]
    total = int(sizes.sum())
    ends = np.cumsum(sizes)
    at = np.arange(total) + np.repeat(cut[flat] - (ends - sizes), sizes)
    own = np.repeat(np.tile(np.arange(prefix), n), sizes)
    gain = 2 * (prefix - np.maximum(own, place[at]))
    return np.bincount(np.repeat(np.repeat(np.arange(n), prefix), sizes) * n_rows + rows[at], gain, n * n_rows).reshape(n, n_rows)


def nearest(q: np.ndarray, x: np.ndarray, gain: np.ndarray, take: int, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """`(query, row, cosine)` of each query's `keep` best, ties included, and how many cosines that took.

    Cosines are computed for the `take` rows of greatest footrule gain alone, and all that tie with the last of them.
    """
    q_norm, x_norm = np.sqrt((q * q).sum(1)), np.sqrt((x * x).sum(1))
    take = min(len(x), take)
    edge = np.partition(gain, len(x) - take, axis=1)[:, len(x) - take]
    a, b, score, scored = [], [], [], 0
    for i in range(len(q)):
        rows = np.flatnonzero(gain[i] >= edge[i])
        own = np.clip((x[rows] * q[i]).sum(1) / (q_norm[i] * x_norm[rows]), -1.0, 1.0)
        scored += len(rows)
        best = np.flatnonzero(own >= np.partition(own, -min(keep, len(own)))[-min(keep, len(own))])
        a.append(np.full(len(best), i))
        b.append(rows[best])
        score.append(own[best])
    return np.concatenate(a), np.concatenate(b), np.concatenate(score), scored


def usable(vector: str) -> Column:
    """Whether a vector has components, all of them finite, and is not zero."""
    v = F.col(vector).cast("array<double>")
    return v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)


def search(vectors: DataFrame, is_query: Column, k: int = 5, pivots: int = 2048, prefix: int = 64, share: float = 0.1, least: int = 64, seed: int = 42, block: int = 4096, query_block: int = 512, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """`(query_id, rank, vec_id, score)`: of each query row the k nearest others found, by cosine in double precision.

    `is_query` reads `vec_id`. Every usable row is indexed; only the pivots are a sample: of each length of vectors
    the `pivots` distinct ones of least seeded rank. A query's candidates are the `share` of each block nearest by
    footrule, `least` of them at least, and all ties at the edge; cosines are computed for these alone. A cosine needs
    equal lengths, so vectors of each length are an index of their own. Rows that aren't `usable` and rows without id
    take no part. Repeated rows count once; rows of one id with different vectors count each, none of them a
    candidate of the others. Other columns are left aside whatever their names; an empty table gives an empty result.
    """
    own = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).where(F.col("vec_id").isNotNull() & usable("v")).distinct()
    nth = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    entries = durable(own.withColumn("nth", nth).where(F.col("nth") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))
    ranked = entries.select(F.size("v").alias("d"), "v", seeded(seed, F.element_at("ids", 1)).alias("r"))
    drawn = F.lit(False)  # what can be among the least ranks, some more than `pivots`, so that no task ranks all rows
    for d, n in entries.groupBy(F.size("v")).count().collect():
        drawn = drawn | ((F.col("d") == d) & (F.col("r") <= int(min(1.0, (pivots + 8 * pivots**0.5 + 64) / n) * 2**60)))
    chosen = ranked.where(drawn).withColumn("nth", F.row_number().over(Window.partitionBy("d").orderBy("r", "v")))
    by_length: dict[int, list] = {}
    for r in chosen.where(F.col("nth") <= pivots).select("d", "v").toLocalIterator():
        by_length.setdefault(r["d"], []).append(r["v"])
    units = {d: (lambda u: u / np.linalg.norm(u, axis=1, keepdims=True))(np.array(v)) for d, v in by_length.items()}
    shared = vectors.sparkSession.sparkContext.broadcast(units)  # at most `pivots` vectors of each length

    def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
        flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)

    def ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                lengths = batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
                for d in np.unique(lengths):
                    part = batch.filter(pa.array(lengths == d))
                    v = matrix(part.column(1))
                    found = orders(v / np.sqrt((v * v).sum(1, keepdims=True)), shared.value[int(d)], prefix).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * found.shape[1], pa.int32()), pa.array(found.ravel()))
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), lists], ["ids", "v", "o"])

    index = durable(entries.select("ids", "v").mapInArrow(ordered, "ids array<long>, v array<double>, o array<int>"))
    asked = durable(own.where(is_query).select(F.array("vec_id").alias("ids"), "v").mapInArrow(ordered, "ids array<long>, v array<double>, o array<int>"))
    blocks, query_blocks = max(1, -(-index.count() // block)), max(1, -(-asked.count() // query_block))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    dealt = index.withColumn("d", F.size("v")).withColumn("b", F.pmod(F.xxhash64(F.element_at("ids", 1)), F.lit(blocks))).withColumn("j", every(query_blocks))
    asked = asked.withColumn("d", F.size("v")).withColumn("j", F.pmod(F.xxhash64("ids"), F.lit(query_blocks))).withColumn("b", every(blocks))
    kinds = pa.schema([("query_id", pa.int64()), ("ids", pa.list_(pa.int64())), ("score", pa.float64())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return kinds.empty_table()
        x, q = matrix(left["v"]), matrix(right["v"])
        of, asks, lists = left["ids"].combine_chunks(), right["ids"].combine_chunks().flatten(), postings(matrix(left["o"]), pivots)
        o, out = matrix(right["o"]), []
        for at in range(0, len(q), 64):
            gain = footrule_gain(o[at : at + 64], lists, len(x))
            a, b, score, _ = nearest(q[at : at + 64], x, gain, max(least, int(np.ceil(share * len(x)))), k + 1)
            out.append(pa.table([asks.take(pa.array(a + at)), of.take(pa.array(b)), pa.array(score)], kinds))
        return pa.concat_tables(out)

    found = dealt.groupBy("d", "b", "j").cogroup(asked.groupBy("d", "b", "j")).applyInArrow(run, "query_id long, ids array<long>, score double")
    each = found.select("query_id", F.explode("ids").alias("vec_id"), "score").where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return each.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
