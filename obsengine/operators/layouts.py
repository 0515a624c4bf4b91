"""Layouts over a corpus's channels, hidden parts, levels, alarms by channel, and tallies of answers."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ordering import digest_position, kept, percentiles

WIN = ["unit", "position"]


def corpus_cells(cells: DataFrame, channels: DataFrame, bins: int) -> DataFrame:
    """A row for each channel of the corpus and bin of each window; channels that a window lacks have presence 0.

    `channels` `(channel)` is the vocabulary, a row per channel. A channel that isn't in it is refused.
    """
    names = F.broadcast(channels.select("channel"))
    stray = cells.join(names, "channel", "left_anti").select(F.raise_error(F.concat(F.lit("not a channel of the corpus: "), F.col("channel"))).cast("string").alias("unit"), F.lit(None).cast("int").alias("position"))
    frames = cells.select("unit", "position").distinct().unionByName(stray.select("unit", F.col("position").cast(cells.schema["position"].dataType)))
    held = frames.crossJoin(names).withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return held.join(cells, [*WIN, "channel", "bin"], "left").fillna({"presence": 0, "log_count": 0.0})


def readable_rows(grid: DataFrame) -> DataFrame:
    """Of each channel whether any window observed it and whether any step was missed."""
    return grid.groupBy("channel").agg((F.max("observed") == 1).alias("ever_observed"), (F.min("observed") == 0).alias("ever_missed"))


def gridded_tokens(grid: DataFrame, steps: int) -> DataFrame:
    """A grid as tokens at the steps' starts; the gap is the share of a window since the last real reading, else since the start."""
    last = F.last(F.when(F.col("observed") == 1, F.col("step")), ignorenulls=True).over(Window.partitionBy(*WIN, "channel").orderBy("step").rowsBetween(Window.unboundedPreceding, -1))
    return grid.select(*WIN, "channel", "value", (F.col("step") / steps).alias("time"), ((F.col("step") - F.coalesce(last, F.lit(0))) / steps).alias("gap"))


def concat_windows(tokens: DataFrame, count: int) -> DataFrame:
    """Each `count` consecutive windows as one: times rescaled, gaps counted anew."""
    whole = F.floor(F.col("position") / count)
    rows = tokens.select("unit", whole.alias("position"), "channel", "value", ((F.col("position") - whole * count + F.col("time")) / count).alias("time"))
    before = F.lag("time").over(Window.partitionBy(*WIN, "channel").orderBy("time", "value"))
    return rows.withColumn("gap", F.col("time") - F.coalesce(before, F.lit(0.0)))


def prepared_summaries(sample: DataFrame, scored: DataFrame, columns: Sequence[str]) -> DataFrame:
    """scored values within the sample's range, gaps filled with its mean; columns of under two distinct values go."""
    facts = sample.agg(*[f(c).alias(f"{c}_{n}") for c in columns for n, f in (("lo", F.min), ("hi", F.max), ("m", F.avg))]).first()  # a number or three per column
    kept = [c for c in columns if facts[f"{c}_lo"] is not None and facts[f"{c}_lo"] < facts[f"{c}_hi"]]
    others = [c for c in scored.columns if c not in columns]
    return scored.select(*others, *[F.least(F.greatest(F.coalesce(F.col(c), F.lit(facts[f"{c}_m"])), F.lit(facts[f"{c}_lo"])), F.lit(facts[f"{c}_hi"])).alias(c) for c in kept])


def hidden_summaries(masked: DataFrame) -> DataFrame:
    """of each channel's hidden part its mean, least, largest and slope, and its schedule: count, span and centre."""
    own = masked.where("hidden").groupBy(*WIN, "channel")
    return own.agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.min("value").alias("minimum"), F.max("value").alias("maximum"), F.regr_slope("value", "time").alias("slope"), (F.max("time") - F.min("time")).alias("span"), F.avg("time").alias("centre"))


def level_free(cells: DataFrame, levels: DataFrame) -> DataFrame:
    """values less their channel's level once it has read, log counts less theirs where present, 0 before."""
    rows = cells.join(F.broadcast(levels.select("channel", "level", "log_level")), "channel")
    return rows.select(*WIN, "channel", "bin", F.coalesce(F.col("last") - F.col("level"), F.lit(0.0)).alias("value"), F.when(F.col("presence") == 1, F.col("log_count") - F.col("log_level")).otherwise(0.0).alias("log_count"))


def diff_preparations(a: DataFrame, b: DataFrame) -> DataFrame:
    """of each variable the surplus triplets of either side and the largest gap, matched by unit, minute and order of value."""
    nth = F.row_number().over(Window.partitionBy("unit", "minute", "channel").orderBy("value"))
    rows = a.withColumn("nth", nth).join(b.withColumn("nth", nth).withColumnRenamed("value", "value_b"), ["unit", "minute", "channel", "nth"], "full_outer")
    return rows.groupBy("channel").agg(F.count_if(F.col("value_b").isNull()).alias("only_a"), F.count_if(F.col("value").isNull()).alias("only_b"), F.max(F.abs(F.col("value") - F.col("value_b"))).alias("largest_gap"))


def channel_alarms(departures: DataFrame, share: float) -> DataFrame:
    """Each channel's own alarm level, which a share of its windows exceeds."""
    return percentiles(departures, "departure", [1 - share], ["channel"], "p").select("channel", F.get("p", 0).alias("alarm"))


def envelope_departures(now: DataFrame, floor: float) -> DataFrame:
    """Distance of `mean` from `mid` over the spread of a 10-90 % range, at least `floor`, beside own history `own`."""
    spread = F.greatest((F.col("high") - F.col("low")) / 2.563, F.lit(floor))
    off = F.abs(F.col("mean") - F.col("mid")) / spread
    return now.withColumn("envelope", off).withColumn("departure", F.greatest(off, F.col("own")))


def gap_tallies(answers: DataFrame, answer: str, baselines: Sequence[str]) -> DataFrame:
    """M3: per kind and unit the squared losses of an answer and its baselines, on the cells that all answer."""
    rows = answers.dropna(subset=["target", answer, *baselines])
    return rows.groupBy("kind", "unit").agg(F.count(F.lit(1)).alias("cells"), *[F.sum(F.pow(F.col(c) - F.col("target"), F.lit(2))).alias(c) for c in (answer, *baselines)])


def window_losses(answers: DataFrame, names: Sequence[str]) -> DataFrame:
    """The mean squared error of each answer per window, on the cells that all of them cover."""
    return answers.dropna(subset=["target", *names]).groupBy(*WIN).agg(*[F.avg(F.pow(F.col(c) - F.col("target"), F.lit(2))).alias(c) for c in names])


def tally_by_unit(predictions: DataFrame, runs: DataFrame) -> DataFrame:
    """K8: of each unit its events, those found, false runs, and normal windows and quiet ones."""
    p = predictions.groupBy("unit").agg(F.countDistinct(F.when(F.col("event") > 0, F.col("event"))).alias("events"), F.countDistinct(F.when(F.col("flagged") & (F.col("event") > 0), F.col("event"))).alias("found"), F.count_if(F.col("event") == 0).alias("normal"), F.count_if((F.col("event") == 0) & ~F.col("flagged")).alias("quiet"))
    false = runs.where("NOT true_alarm").groupBy("unit").agg(F.count(F.lit(1)).alias("false_runs"))
    return p.join(false, "unit", "left").fillna(0, ["false_runs"])


def curve(predictions: DataFrame) -> DataFrame:
    """The error of each candidate and budget pooled over repeats, and its spread over them; lower is better."""
    each = predictions.groupBy("candidate", "budget", "repeat").agg(F.sum(F.pow(F.col("predicted") - F.col("target"), F.lit(2))).alias("se"), F.count(F.lit(1)).alias("n"))
    return each.groupBy("candidate", "budget").agg(F.sqrt(F.sum("se") / F.sum("n")).alias("error"), F.stddev_samp(F.sqrt(F.col("se") / F.col("n"))).alias("spread"))


def window_regime(tokens: DataFrame, channels: int) -> DataFrame:
    """Of each window its tokens, the share of the channels it reads, readings a channel, and channels read once."""
    each = tokens.groupBy(*WIN, "channel").agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy(*WIN).agg(F.sum("n").alias("tokens"), (F.count(F.lit(1)) / channels).alias("channel_share"), F.avg("n").alias("readings_a_channel"), F.count_if(F.col("n") == 1).alias("read_once"))


def fleet_correlations(hourly: DataFrame) -> DataFrame:
    """Of each channel the correlation of hourly changes with the fleet's mean change of that hour, and the readings behind it.

    A change is against the hour before. The fleet's mean stands for all pairs of units, so no pair of units is listed.
    """
    w = Window.partitionBy("unit", "channel").orderBy("hour")
    rows = hourly.withColumn("change", F.when(F.lag("hour").over(w) == F.col("hour") - 1, F.col("mean") - F.lag("mean").over(w))).where("change IS NOT NULL")
    fleet = rows.groupBy("channel", "hour").agg(F.avg("change").alias("fleet"))
    return rows.join(fleet, ["channel", "hour"]).groupBy("channel").agg(F.count(F.lit(1)).alias("changes"), F.corr("change", "fleet").alias("correlation"))


UNITS_A_BLOCK, HOURS_A_BLOCK, VALUES_A_BLOCK = 4096, 2048, 1 << 20
BLOCKS = 8  # of a channel's units, so that few units are many tasks too
ROWS_AT_ONCE = 1 << 16
MEETINGS_AT_ONCE = 1 << 18  # of two units in one hour
SPARSE = 24  # a meeting takes as long as so many cells of matrix products


def hourly_changes(hourly: DataFrame) -> DataFrame:
    """Hourly means with `change` against the hour before, null where that hour wasn't read."""
    w = Window.partitionBy("unit", "channel").orderBy("hour")
    return hourly.withColumn("change", F.when(F.lag("hour").over(w) == F.col("hour") - 1, F.col("mean") - F.lag("mean").over(w)))


def _flat(side: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The series `(hours, changes)` one after another: which series, hours, changes."""
    return np.repeat(np.arange(len(side)), [len(h) for h, _ in side]), np.concatenate([h for h, _ in side]), np.concatenate([v for _, v in side])


def _pair_sums(left: list[tuple[np.ndarray, np.ndarray]], right: list[tuple[np.ndarray, np.ndarray]], least: int, strip: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For strips of the `left` series `(hours, changes)`: the pairs that share at least `least` hours, as numbers of left
    and right, and their sums n, x, y, xy, xx and yy `(6, pairs)` over these hours.

    Where series seldom meet, sums run over their meetings, else they are products of matrices, over spans of hours.
    """
    j, hours, y = _flat(right)
    i, own, x = _flat(left)
    axis, held = np.unique(hours, return_counts=True)
    place = np.searchsorted(axis, own)
    met = axis[np.minimum(place, len(axis) - 1)] == own
    i, place, x = i[met], place[met], x[met]
    if SPARSE * int(held[place].sum()) <= len(left) * len(right) * len(axis):
        yield from _sums_of_meetings((i, place, x), (j, hours, y), held, len(left), len(right), least)
        return
    at = np.searchsorted(axis, hours)
    for low in range(0, len(left), strip):
        part = slice(*np.searchsorted(i, (low, low + strip)))
        size = min(strip, len(left) - low)
        sums = np.zeros((6, size, len(right)))
        for start in range(0, len(axis), HOURS_A_BLOCK):
            n = min(HOURS_A_BLOCK, len(axis) - start)
            a, b = (place[part] >= start) & (place[part] < start + n), (at >= start) & (at < start + n)
            p, xs, q, ys = (np.zeros((n, k)) for k in (size, size, len(right), len(right)))
            cells = place[part][a] - start, i[part][a] - low
            p[cells], xs[cells] = 1, x[part][a]
            q[at[b] - start, j[b]], ys[at[b] - start, j[b]] = 1, y[b]
            for s, (u, v) in zip(sums, ((p, q), (xs, q), (p, ys), (xs, ys), (xs**2, q), (p, ys**2)), strict=True):
                s += u.T @ v
        found = np.nonzero(sums[0] >= least)
        yield low + found[0], found[1], sums[:, found[0], found[1]]


def _sums_of_meetings(left: tuple[np.ndarray, ...], right: tuple[np.ndarray, ...], held: np.ndarray, lefts: int, rights: int, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """`_pair_sums` by counting: shared hours are counted first, and changes of the pairs with enough of them are added up."""
    i, place, x = left
    j, hours, y = right
    order = np.argsort(hours, kind="stable")
    j, y = j[order], y[order]
    n, starts = held[place], (np.cumsum(held) - held)[place]
    ends = np.searchsorted(i, np.arange(lefts + 1))
    before = np.concatenate(([0], np.cumsum(n)))[ends]  # meetings of all series before
    low = 0
    while low < lefts:
        high = max(low + 1, int(np.searchsorted(before, before[low] + MEETINGS_AT_ONCE, "right")) - 1)
        part = slice(ends[low], ends[high])
        m = n[part]
        at = np.arange(m.sum()) + np.repeat(starts[part] - (np.cumsum(m) - m), m)
        pair = np.repeat((i[part] - low) * rights, m) + j[at]
        shared = np.bincount(pair, minlength=(high - low) * rights)
        enough = shared >= least
        pairs, some = np.flatnonzero(enough), np.flatnonzero(enough[pair])
        number = (np.cumsum(enough) - 1)[pair[some]]
        xs, ys = np.repeat(x[part], m)[some], y[at[some]]
        yield low + pairs // rights, pairs % rights, np.stack([shared[pairs].astype(float), *[np.bincount(number, v, len(pairs)) for v in (xs, ys, xs * ys, xs * xs, ys * ys)]])
        low = high


def unit_pair_correlations(hourly: DataFrame, least: int = 3) -> DataFrame:
    """`(channel, a, b, shared, correlation)`: of every two units the correlation of their hourly changes over the
    hours in which both changed; pairs with fewer than `least` are left out, a unit that never varies there gives null.

    A unit's changes are one row, units stand in blocks, and two blocks meet once. Where their units seldom change in the
    same hour, sums run over the meetings alone and only for pairs that share enough; else the blocks are matrices of values
    and of presence, whose products are all sums that a correlation with gaps needs. A pair is told where its blocks meet, so
    no row of a pair is shuffled; a block is sent once for each block, and the longer the series the smaller the blocks.
    """
    rows = hourly_changes(hourly).where("change IS NOT NULL AND unit IS NOT NULL AND channel IS NOT NULL")
    series = rows.groupBy("channel", "unit").agg(F.sort_array(F.collect_list(F.struct(F.col("hour").cast("long").alias("hour"), F.col("change").cast("double").alias("change")))).alias("_s"))
    series = kept(series.where(F.size("_s") >= least).select("channel", "unit", F.col("_s.hour").alias("hours"), F.col("_s.change").alias("changes")))
    longest, most = series.groupBy("channel").agg(F.max(F.size("hours")).alias("l"), F.count("*").alias("n")).agg(F.max("l"), F.max("n")).first()
    a_block = max(1, min(UNITS_A_BLOCK, VALUES_A_BLOCK // (longest or 1), max(256, -(-(most or 1) // BLOCKS))))
    placed = digest_position(series.withColumn("_d", F.sha2(F.col("unit").cast("string"), 256)), "_d", ["unit"], ["channel"], "_at")
    placed = placed.withColumn("_block", F.floor((F.col("_at") - 1) / a_block).cast("int"))
    last = placed.groupBy("channel").agg(F.max("_block").alias("_last"))
    own = placed.join(F.broadcast(last), "channel")
    told = ["channel", "_i", "_j", "unit", "hours", "changes", "_left"]
    low = own.select("*", F.explode(F.sequence("_block", "_last")).alias("_j"), F.col("_block").alias("_i"), F.lit(True).alias("_left")).select(told)
    high = own.where("_block > 0").select("*", F.explode(F.sequence(F.lit(0), F.col("_block") - 1)).alias("_i"), F.col("_block").alias("_j"), F.lit(False).alias("_left")).select(told)
    kinds = dict(rows.dtypes)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = pa.Table.from_batches(list(batches)).combine_chunks()
        unit, side, channel = pa.concat_arrays(part["unit"].chunks), part["_left"].to_numpy(), part["channel"][0]
        names = unit.to_pylist()
        series = [(h.values.to_numpy(), v.values.to_numpy()) for h, v in zip(part["hours"], part["changes"], strict=True)]
        place = np.empty(len(names), np.int64)
        place[sorted(range(len(names)), key=names.__getitem__)] = np.arange(len(names))
        left = np.flatnonzero(side)
        right, same = (left, True) if side.all() else (np.flatnonzero(~side), False)
        for i, j, sums in _pair_sums([series[k] for k in left], [series[k] for k in right], least) if len(left) and len(right) else ():
            x, y = left[i], right[j]
            if same:
                keep = place[x] < place[y]
                x, y, sums = x[keep], y[keep], sums[:, keep]
            n, sx, sy, sxy, sxx, syy = sums
            vx, vy = sxx - sx * sx / n, syy - sy * sy / n
            varies = (vx > 1e-9 * sxx) & (vy > 1e-9 * syy)  # else it is rounding
            r = np.divide(sxy - sx * sy / n, np.sqrt(vx * vy, where=varies, out=np.ones_like(vx)))
            turned = place[x] > place[y]
            ends = [unit.take(pa.array(np.where(turned, *at))) for at in ((y, x), (x, y))]
            told = [pa.repeat(channel, len(x)), *ends, pa.array(n.astype(np.int64)), pa.array(r, mask=~varies)]
            for at in range(0, len(x), ROWS_AT_ONCE):
                yield pa.RecordBatch.from_arrays([c.slice(at, ROWS_AT_ONCE) for c in told], ["channel", "a", "b", "shared", "correlation"])

    return low.unionByName(high).groupBy("channel", "_i", "_j").applyInArrow(meet, f"channel {kinds['channel']}, a {kinds['unit']}, b {kinds['unit']}, shared long, correlation double")


def unit_autocorrelations(hourly: DataFrame, level_lag: int = 1, change_lag: int = 24, least: int = 2) -> DataFrame:
    """`(channel, unit, level, change)`: of each unit the correlation of its hourly level with that `level_lag` hours
    before, and of its change with that `change_lag` hours before, over the hours read at both ends; null where those are
    fewer than `least` or one end never varies.

    The earlier ends are read by frames of one order of each series, so no reading is repeated or dealt again.
    """
    w = Window.partitionBy("unit", "channel").orderBy("hour")
    before = lambda c, lag: F.max(c).over(w.rangeBetween(-lag, -lag))
    rows = hourly_changes(hourly.withColumn("hour", F.col("hour").cast("long")))
    pairs = rows.select("channel", "unit", F.col("mean").alias("m"), before("mean", level_lag).alias("m_before"), F.col("change").alias("c"), before("change", change_lag).alias("c_before"))

    def both(x: str, y: str) -> Column:
        a, b = F.when(F.col(y).isNotNull(), F.col(x)), F.when(F.col(x).isNotNull(), F.col(y))
        varies = (F.var_pop(a) > 1e-9 * F.avg(a * a)) & (F.var_pop(b) > 1e-9 * F.avg(b * b))  # else it is rounding
        return F.when((F.count(a) >= least) & varies, F.try_divide(F.covar_pop(a, b), F.sqrt(F.var_pop(a) * F.var_pop(b))))

    return pairs.groupBy("channel", "unit").agg(both("m", "m_before").alias("level"), both("c", "c_before").alias("change"))


def participation_ratio(wide: DataFrame, columns: Sequence[str]) -> DataFrame:
    """How many signals the columns behave as: squared trace over squared norm of their correlations, from one pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    sums = wide.agg(*[F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    norm = F.lit(float(len(columns)))
    for i in range(len(pairs)):
        norm = norm + 2 * F.pow(F.coalesce(F.col(f"c{i}"), F.lit(0.0)), F.lit(2))
    return sums.select((F.lit(float(len(columns) ** 2)) / norm).alias("signals"))


def corpus_facts(readings: DataFrame, counts: DataFrame) -> DataFrame:
    """Units, channels and values of a corpus, and its windows."""
    return readings.agg(F.countDistinct("unit").alias("units"), F.countDistinct("channel").alias("channels"), F.count(F.lit(1)).alias("values")).crossJoin(counts.agg(F.sum("windows").alias("windows")))


def corpus_variants(readings: DataFrame, units: DataFrame, variants: Sequence[tuple[float, float]]) -> DataFrame:
    """`(length, stride, units, channels, values, windows, tokens)` of a corpus for each window variant, in one scan.

    A token is a reading in a window. How many windows hold a reading follows from its place in its unit, so no reading
    is repeated and no variant has a pass of its own; sums are taken by unit and channel before they are added up.
    """
    at = F.col("time") - F.col("extent_start")
    fit = lambda n, s: F.floor((F.col("extent_end") - F.col("extent_start") - n) / s + 1e-9)
    of = lambda n, s: F.greatest(F.least(F.floor(at / s), fit(n, s)) - F.greatest(F.floor((at - n) / s) + 1, F.lit(0)) + 1, F.lit(0))
    held = readings.join(units, "unit").groupBy("unit", "channel").agg(F.count(F.lit(1)).alias("values"), *[F.sum(of(n, s)).alias(f"t{i}") for i, (n, s) in enumerate(variants)])
    told = held.agg(F.countDistinct("unit").alias("units"), F.countDistinct("channel").alias("channels"), F.sum("values").alias("values"), *[F.sum(f"t{i}").alias(f"t{i}") for i in range(len(variants))])
    counted = units.agg(*[F.sum(F.greatest(fit(n, s) + 1, F.lit(0))).alias(f"w{i}") for i, (n, s) in enumerate(variants)])
    each = F.array(*[F.struct(F.lit(float(n)).alias("length"), F.lit(float(s)).alias("stride"), F.col(f"w{i}").alias("windows"), F.col(f"t{i}").alias("tokens")) for i, (n, s) in enumerate(variants)])
    return told.crossJoin(counted).select("units", "channels", "values", F.inline(each)).select("length", "stride", "units", "channels", "values", "windows", "tokens")


def strata(predictions: DataFrame) -> DataFrame:
    """Units with and without an event, and how many there are."""
    return predictions.groupBy("unit").agg(F.bool_or(F.col("event") > 0).alias("with_event")).groupBy("with_event").agg(F.count(F.lit(1)).alias("units"))


def verdict(rows: DataFrame, part: float) -> DataFrame:
    """`floor` is a part of the error, at least its spread; the interval `low`-`high` of a gain is read against it."""
    floor = F.greatest(part * F.col("error"), F.coalesce(F.col("spread"), F.lit(0.0)))
    word = F.when(F.col("low") > floor, "confirmed").when(F.col("low") > 0, F.when(F.col("high") < floor, "practically nil").otherwise("distinguishable")).when(F.col("high") < 0, "worse")
    return rows.withColumn("floor", floor).withColumn("verdict", word.otherwise(F.when((F.col("high") < floor) & (F.col("low") > -floor), "practically nil").otherwise("indistinguishable")))
