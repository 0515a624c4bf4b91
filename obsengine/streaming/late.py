"""Windows of a stream that says how many readings came too late for them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "latest long, starts array<long>, n array<long>, total array<double>, minimum array<double>, maximum array<double>, at array<long>, last array<double>"
OUT = "unit string, channel string, starts long, n long, mean double, minimum double, maximum double, last double, late long"


def counted_windows(readings: DataFrame, length: float, stride: float, lateness: float) -> DataFrame:
    """Windows of `length` seconds, one each `stride`, and counts of the readings that came after theirs had closed.

    Each unit's channel has a clock of its own, the latest event time of the batches before, less `lateness` seconds. A
    window is a row once the clock has passed its end. A reading all of whose windows are closed is in none: each batch
    gives the number of these as a row `late` without a window (`win_start` is null, `n` 0). With a stride of the length every
    reading with an instant and a value is in one window, open or given, or counted as late. Write in append mode. The
    state, the clock and the open windows' sums, is in the checkpoint, so a restart goes on where the stream stood.
    A channel that falls silent keeps its open windows, at most (length + lateness) / stride + 1, until it speaks again.
    """
    size, step, slack = (round(s * 1e6) for s in (length, stride, lateness))
    if not 0 < step <= size or slack < 0:
        raise ValueError("the stride is above 0 and at most the length, and the lateness isn't below 0")

    def advance(key: tuple[str, str], parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        latest, *held = state.get if state.exists else (None, [], [], [], [], [], [], [])
        closed = None if latest is None else latest - slack
        kept, late = {s: v for s, *v in zip(*held, strict=True)}, 0
        for part in parts:
            t, x = part["at"].to_numpy(np.int64), part["value"].to_numpy(float)
            newest = t // step * step
            if closed is not None:
                gone = newest + size <= closed
                late += int(gone.sum())
                t, x, newest = t[~gone], x[~gone], newest[~gone]
            if not len(t):
                continue
            latest = int(t.max()) if latest is None else max(latest, int(t.max()))
            for back in range(-(-size // step)):
                start = newest - back * step
                there = (start + size > t) & (closed is None or start + size > closed)
                rows = pd.DataFrame({"s": start[there], "t": t[there], "x": x[there]}).sort_values(["t", "x"])
                for s, n, total, low, high, at, last in rows.groupby("s").agg(n=("x", "size"), total=("x", "sum"), low=("x", "min"), high=("x", "max"), at=("t", "last"), last=("x", "last")).itertuples():
                    old = kept.get(int(s))
                    new = [int(n), float(total), float(low), float(high), int(at), float(last)]
                    if old is not None:
                        at, last = max((old[4], old[5]), (new[4], new[5]))
                        new = [old[0] + new[0], old[1] + new[1], min(old[2], new[2]), max(old[3], new[3]), at, last]
                    kept[int(s)] = new
        done = sorted(s for s in kept if latest is not None and s + size <= latest - slack)
        rows = [(*key, s, kept[s][0], kept[s][1] / kept[s][0], kept[s][2], kept[s][3], kept[s][5], 0) for s in done]
        if late:
            rows.append((*key, None, 0, None, None, None, None, late))
        still = sorted((s, *v) for s, v in kept.items() if s not in set(done))
        if latest is not None:
            state.update((latest, *([list(c) for c in zip(*still, strict=True)] or [[] for _ in range(7)])))
        if rows:
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in OUT.split(", ")])
            yield out.astype({"starts": "Int64"})

    own = readings.where("ts IS NOT NULL AND value IS NOT NULL").select("unit", "channel", F.unix_micros("ts").alias("at"), F.col("value").cast("double").alias("value"))
    found = own.groupBy("unit", "channel").applyInPandasWithState(advance, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
    start = F.timestamp_micros("starts")
    return found.select("unit", "channel", start.alias("win_start"), F.timestamp_micros(F.col("starts") + size).alias("win_end"), "n", "mean", "minimum", "maximum", "last", "late")
