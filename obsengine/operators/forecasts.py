"""Answers for the next hour of a channel that read its own past, other channels, or a library of other series."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ordering import kept
from .draws import ranked, sample_per_group
from .impute import huber
from .learners import ridge, ridge_answers
from .nearest import nearest

SERIES = ["unit", "channel"]


def history(hourly: DataFrame, context: int) -> DataFrame:
    """Hourly rows with `past`: the means of the `context` hours before, oldest first, null where nothing was read."""
    w = Window.partitionBy(*SERIES).orderBy("hour").rangeBetween(-context, -1)
    read = hourly.withColumn("_read", F.map_from_entries(F.collect_list(F.struct("hour", "mean")).over(w)))
    return read.withColumn("past", F.transform(F.sequence(F.col("hour") - context, F.col("hour") - 1), lambda h: F.try_element_at("_read", h))).drop("_read")


def filled(past: str) -> Column:
    """An array with each gap carrying the number before it, and the gap at the start the first number."""
    first = F.get(F.filter(past, lambda x: x.isNotNull()), F.lit(0))
    start = F.struct(first.alias("last"), F.array().cast("array<double>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        return F.struct(F.coalesce(x, s["last"]).alias("last"), F.concat(s["out"], F.array(F.coalesce(x, s["last"]))).alias("out"))

    return F.aggregate(past, start, step, lambda s: s["out"])


def same_phase(rows: DataFrame, context: int, least: int = 6) -> DataFrame:
    """I4: rows of `history` with `lag` and `same_phase`: the reading one lag back, where the lag up to half the window
    repeated the channel best over at least `least` earlier pairs of hours (mean Huber error, ties to the shorter);
    without such a lag the latest reading. Errors are compared to nine places. Rows without any past are left out.
    """
    size = F.lit(context)

    def scored(lag: Column) -> Column:
        pairs = F.transform(F.sequence(lag, size - 1), lambda i: F.get("past", i) - F.get("past", i - lag))
        read = F.filter(pairs, lambda e: e.isNotNull())
        error = F.try_divide(F.aggregate(read, F.lit(0.0), lambda s, e: s + huber(e)), F.size(read))
        return F.struct(F.round(error, 9).alias("error"), lag.alias("lag"), F.size(read).alias("pairs"), F.get("past", size - lag).alias("answer"))

    tried = F.filter(F.transform(F.sequence(F.lit(1), F.lit((context + 1) // 2)), scored), lambda t: (t["pairs"] >= least) & t["answer"].isNotNull())
    last = F.element_at(F.filter("past", lambda x: x.isNotNull()), -1)
    out = rows.where(F.exists("past", lambda x: x.isNotNull())).withColumn("_best", F.array_min(tried))
    return out.withColumn("lag", F.col("_best.lag")).withColumn("same_phase", F.coalesce(F.col("_best.answer"), last)).drop("_best")


def season_of(lag: Column, hours: int) -> Column:
    """A lag as a season: kept if it fits twice in the hours, else 1."""
    return F.when((lag >= 2) & (lag <= hours // 2), lag).otherwise(1)


def ridge_rows(hourly: DataFrame, context: int, others: Sequence[str] = ()) -> tuple[DataFrame, list[str]]:
    """Each channel-hour with a past as features: its filled hours, and with `others` the latest reading of each
    other channel of the unit within the context (0 if unread, and in place of its own)."""
    names = [f"h{i}" for i in range(context)]
    rows = history(hourly, context).where(F.exists("past", lambda x: x.isNotNull())).withColumn("_filled", filled("past"))
    rows = rows.select(*SERIES, "hour", "mean", *[F.get("_filled", F.lit(i)).alias(n) for i, n in enumerate(names)])
    if not others:
        return rows, names
    wide = hourly.groupBy("unit", "hour").pivot("channel", list(others)).agg(F.first("mean"))
    w = Window.partitionBy("unit").orderBy("hour").rangeBetween(-context, -1)
    latest = wide.select("unit", "hour", *[F.coalesce(F.last(c, ignorenulls=True).over(w), F.lit(0.0)).alias(f"o_{c}") for c in others])
    rows = rows.join(latest, ["unit", "hour"]).withColumns({f"o_{c}": F.when(F.col("channel") == c, 0.0).otherwise(F.col(f"o_{c}")) for c in others})
    return rows, [*names, *[f"o_{c}" for c in others]]


def clipped_ridge(rows: DataFrame, scored: DataFrame, keys: Sequence[str], x: Sequence[str], y: str, penalties: Sequence[float], fold: str = "fold") -> DataFrame:
    """`scored` with `predicted` by ridges (one per key, penalty by cross-fit) fitted on `rows`; features
    are held to the range that their key was fitted on."""
    rows = kept(rows.select(*keys, *x, y, fold))  # its many columns are computed once and planned apart
    fits = kept(ridge(rows, keys, x, y, penalties, fold))
    sides = rows.dropna(subset=[*x, y]).groupBy(*keys).agg(*[f(c).alias(f"_{n}_{c}") for c in x for n, f in (("lo", F.min), ("hi", F.max))])
    own = [c for c in scored.columns if c not in x]
    held = scored.join(F.broadcast(kept(sides)), list(keys)).select(*own, *[F.least(F.greatest(F.col(c), F.col(f"_lo_{c}")), F.col(f"_hi_{c}")).alias(c) for c in x])
    return ridge_answers(held, fits, keys, x)


def own_and_cross_rows(masked: DataFrame, channels: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Hidden cells `(unit, position, channel, bin, kind, value, line, hidden)` beside, for each channel, its
    visible mean in the same bin and a mark of whether it read; a cell's own channel says nothing there."""
    seen = masked.where("NOT hidden").groupBy("unit", "position", "bin").pivot("channel", list(channels)).agg(F.avg("value"))
    rows = masked.where("hidden").join(seen, ["unit", "position", "bin"], "left")
    x = {}
    for c in channels:
        own = F.when(F.col("channel") != c, F.col(c))
        x[f"v_{c}"], x[f"m_{c}"] = F.coalesce(own, F.lit(0.0)), own.isNotNull().cast("double")
    return rows.withColumns(x).drop(*channels), list(x)


#: What a cell says of its readings, and the five of it that a forecast answers.
CELL = ("presence", "log_count", "mean", "minimum", "maximum", "first", "last", "last_offset", "since")
FIVE = ("mean", "minimum", "maximum", "first", "last")


def cell_history_rows(cells: DataFrame, bins: int, context: int, channels: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Each read cell with its five values, and as features the nine of each of the `context` cells before it on
    its unit's own axis and, for each of them, the other channels' means; 0 where there is nothing.

    Windows follow one another, `bins` cells each, so a cell's place is `position * bins + bin`.
    A unit's cells meet in one task in the order of their hours and each batch is laid out in arrays, with the hours
    that the batch before it leaves for its last unit.
    """
    rows = cells.withColumn("hour", F.col("position") * bins + F.col("bin")).select("unit", "channel", "position", "bin", "hour", "presence", *[F.col(c).cast("double").alias(c) for c in CELL if c != "presence"]).where("unit IS NOT NULL AND hour IS NOT NULL")
    x = [f"f{i}_{c}" for i in range(1, context + 1) for c in CELL] + [f"o{i}_{c}" for i in range(1, context + 1) for c in channels]
    kinds = dict(rows.dtypes)
    own = ["unit", "channel", "position", "bin", "hour", *FIVE]
    place = {c: i for i, c in enumerate(channels)}

    def before(group: np.ndarray, hour: np.ndarray, i: int) -> np.ndarray:
        """Of rows in the order of groups and hours the place of the one `i` hours before, -1 where a group has none."""
        at = np.arange(len(hour)) - i
        there = np.maximum(at, 0)
        return np.where((at >= 0) & (group[there] == group) & (hour[there] + i == hour), there, -1)

    def laid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = None
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch] if left is None else [*left.to_batches(), batch]).combine_chunks()
            new = np.arange(t.num_rows) >= (0 if left is None else left.num_rows)
            hour = t.column("hour").to_numpy().astype(np.int64)
            unit = pa.compute.dictionary_encode(t.column("unit"), null_encoding="encode").combine_chunks().indices.to_numpy(zero_copy_only=False)
            named = pa.compute.dictionary_encode(t.column("channel"), null_encoding="encode").combine_chunks()
            channel = named.indices.to_numpy(zero_copy_only=False)
            column = np.array([place.get(c, -1) for c in named.dictionary.to_pylist()])[channel]
            value = np.column_stack([pa.compute.fill_null(t.column(c).cast(pa.float64()), 0.0).to_numpy() for c in CELL])
            out = np.zeros((t.num_rows, len(x)))
            order = np.lexsort((hour, channel, unit))
            series = np.cumsum(np.concatenate([[False], (unit[order][1:] != unit[order][:-1]) | (channel[order][1:] != channel[order][:-1])]))
            first = np.flatnonzero(np.concatenate([[True], (unit[1:] != unit[:-1]) | (hour[1:] != hour[:-1])]))
            instant = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(hour))))
            wide = np.zeros((len(first), len(channels)))
            known = column >= 0
            wide[instant[known], column[known]] = value[known, CELL.index("mean")]
            for i in range(1, context + 1):
                at = before(series, hour[order], i)
                out[order[at >= 0], (i - 1) * len(CELL) : i * len(CELL)] = value[order[at[at >= 0]]]
                at = before(unit[first], hour[first], i)
                others = np.where((at >= 0)[:, None], wide[at], 0.0)[instant]
                others[known, column[known]] = 0.0
                start = context * len(CELL) + (i - 1) * len(channels)
                out[:, start : start + len(channels)] = others
            told = new & (t.column("presence").to_numpy() == 1)
            held = t.select(own).filter(pa.array(told)).combine_chunks()
            yield pa.RecordBatch.from_arrays([*[held.column(c).combine_chunks() for c in own], *[pa.array(v) for v in out[told].T]], [*own, *x])
            left = t.filter(pa.array((unit == unit[-1]) & (hour >= hour[-1] - context)))

    schema = ", ".join([*[f"{c} {kinds[c]}" for c in own], *[f"{c} double" for c in x]])
    return rows.repartition("unit").sortWithinPartitions("unit", "hour", "channel").mapInArrow(laid, schema), x


def segments(hourly: DataFrame, context: int, floor: float = 1e-6) -> DataFrame:
    """Every `context` hours of a series fully read, with the hour after read too: `(unit, channel, hour, mean, v)`, v
    z-scored; `hour` and `mean` are of the hour that met it."""
    rows = history(hourly, context).where(F.forall("past", lambda x: x.isNotNull()))
    mean = F.aggregate("past", F.lit(0.0), lambda s, x: s + x) / context
    rows = rows.withColumn("_m", mean)
    spread = F.greatest(F.sqrt(F.aggregate("past", F.lit(0.0), lambda s, x: s + (x - F.col("_m")) * (x - F.col("_m"))) / context), F.lit(floor))
    return rows.withColumn("_s", spread).withColumn("v", F.transform("past", lambda x: (x - F.col("_m")) / F.col("_s"))).select(*SERIES, "hour", "mean", "v")


def analog_forecast(queries: DataFrame, library: DataFrame) -> DataFrame:
    """`(kind, id, other, distance)`: of each query `(kind, id, v)` the nearest library segment of its kind."""
    return nearest(queries, library, 1, ["kind"]).drop("rank")


def library_draw(queries: DataFrame, library: DataFrame, seed: int) -> DataFrame:
    """`(id, kind, other)`: for each query `(id, kind)` one segment `(id, kind)` of its kind, drawn by the digest of
    (seed, id); a control. Join `kind` to another kind's name first to draw from that. A kind without segments gives none.
    """
    placed = ranked(library.select("kind", F.col("id").alias("other")), ["other"], seed, by=["kind"]).drop("digest")
    sizes = library.groupBy("kind").agg(F.count(F.lit(1)).alias("_n"))
    digest = F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col("id").cast("string")), 256)
    at = F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), F.col("_n")) + 1
    return queries.select("id", "kind").join(F.broadcast(sizes), "kind").withColumn("place", at).join(placed, ["kind", "place"]).select("id", "kind", "other")


def cold_start_cells(hourly: DataFrame, days: Sequence[int], count: int, seed: int, last_block: int = 30) -> DataFrame:
    """Forecast cells of each day N: `count` hours drawn of those read from day N until the next day of the list
    (`last_block` days after the last), with every channel read in them; a learner for N sees only hours before it.
    """
    if list(days) != sorted(set(days)):
        raise ValueError("the days must be distinct and rising")
    ends = [*days[1:], days[-1] + last_block]
    block = F.coalesce(*[F.when((F.col("hour") >= n * 24) & (F.col("hour") < e * 24), n) for n, e in zip(days, ends, strict=True)])
    rows = hourly.withColumn("days", block).where("days IS NOT NULL")
    drawn = sample_per_group(rows.select("days", "hour").distinct(), ["days"], ["hour"], count, seed)
    return rows.join(F.broadcast(drawn), ["days", "hour"])
