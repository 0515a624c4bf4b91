"""Streams with a memory of their own: departures from the last windows, and requests answered batch by batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.detect import VALUES


def stream_departures(summaries: DataFrame, floor: DataFrame, span: int = 6, idle_ms: int | None = None) -> DataFrame:
    """T4: A3 on window summaries as they arrive: `(unit, position, channel, departure)`.

    A channel of a unit remembers its last `span - 1` summaries; with `idle_ms`, for streams that run on, nothing once it
    was idle for so long. `floor` `(channel, kind, floor)` is a static table. A summary at or before its channel's latest position gets null.
    """
    wide = floor.groupBy("channel").pivot("kind", list(VALUES)).agg(F.first("floor")).select("channel", *[F.col(v).alias(f"f_{v}") for v in VALUES])
    rows = summaries.join(F.broadcast(wide), "channel").select("unit", "position", "channel", *[F.col(v).cast("double").alias(v) for v in VALUES], *[f"f_{v}" for v in VALUES])
    kinds, least = dict(rows.dtypes), span - 1
    schema = f"unit {kinds['unit']}, position {kinds['position']}, channel {kinds['channel']}, departure double"

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = list(zip(*(np.array(state.get[0]), np.array(state.get[1]).reshape(-1, len(VALUES))), strict=True)) if state.exists else []
        new = pd.concat(list(batches)).sort_values("position", kind="stable")
        out = []
        for row in new.itertuples(index=False):
            x, low = np.array([getattr(row, v) for v in VALUES]), np.array([getattr(row, f"f_{v}") for v in VALUES])
            if held and row.position <= held[-1][0]:
                out.append((key[0], row.position, key[1], None))
                continue
            past = np.array([v for p, v in held if p >= row.position - least])
            departure = 0.0
            if 2 * len(past) >= least:
                mid = np.median(past, axis=0)
                departure = float((np.abs(x - mid) / np.maximum(1.4826 * np.median(np.abs(past - mid), axis=0), low)).max())
            out.append((key[0], row.position, key[1], departure))
            held = [*held, (row.position, x)][-least:]
        state.update(([int(p) for p, _ in held], [float(v) for _, x in held for v in x]))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=["unit", "position", "channel", "departure"])

    return rows.groupBy("unit", "channel").applyInPandasWithState(step, schema, "positions array<long>, held array<double>", "append", GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout)


def admitted(requests: DataFrame, channels: Sequence[str]) -> DataFrame:
    """Requests `(request, channel, time, value)` with `refused`: why a request is not answered, else null.

    A request is refused whole for a channel that the model doesn't know, a value that is no number, or a time outside
    its window, in this order.
    """
    rows = requests.withColumn("_why", F.when(~F.coalesce(F.col("channel").isin(*channels), F.lit(False)), F.struct(F.lit(1).alias("nth"), F.lit("unknown channel").alias("why"))).when(F.col("value").isNull() | F.isnan("value") | (F.abs("value") == float("inf")), F.struct(F.lit(2).alias("nth"), F.lit("no number").alias("why"))).when(~F.coalesce(F.col("time").between(0, 1), F.lit(False)), F.struct(F.lit(3).alias("nth"), F.lit("outside the window").alias("why"))))
    first = rows.groupBy("request").agg(F.min("_why")["why"].alias("refused"))
    return requests.join(first, "request")


def stream_score(requests: DataFrame, channels: Sequence[str], score: Callable[[DataFrame], DataFrame], to: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch's requests are admitted or refused, and the admitted ones answered by `score`.

    A request lies in one batch. Answers go to `to/answers/batch=<n>`, refusals to `to/refused/batch=<n>`; a batch that is
    done again overwrites its own. Every request of what is there is answered once, then the query stops.
    """

    def one(batch: DataFrame, n: int) -> None:
        rows = admitted(batch, channels).persist()
        score(rows.where("refused IS NULL").drop("refused")).write.mode("overwrite").parquet(f"{to}/answers/batch={n}")
        rows.where("refused IS NOT NULL").select("request", "refused").distinct().write.mode("overwrite").parquet(f"{to}/refused/batch={n}")
        rows.unpersist()

    return requests.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
