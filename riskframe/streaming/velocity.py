"""Live velocity per entity (ST2): equal to the batch operator once the watermark has passed."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from riskframe.operators.features import FIRST_SEEN_GAP_DAYS, WINDOWS

TICK_MS = 1000


class VelocityProcessor(StatefulProcessor):
    """Holds rows back until the watermark passes them, then counts in `(ts, id)` order.

    State per entity: waiting rows, instants of the longest window with their counts, and the
    last instant seen. Emission follows event time, so arrival order cannot change a count.
    """

    def __init__(self, key: str, windows: Mapping[str, int], first_seen_gap_days: float):
        self.key, self.windows, self.gap = key, dict(windows), first_seen_gap_days * 86_400
        self.longest = max(self.windows.values())

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        waiting = T.StructType([T.StructField("t", T.LongType()), T.StructField("id", T.LongType())])
        seen = T.StructType([T.StructField("n", T.LongType())])
        instant = T.StructType([T.StructField("t", T.LongType())])
        self.waiting = handle.getListState("waiting", waiting)
        # one entry an instant, not a row: ties at one second cost nothing
        self.instants = handle.getMapState("instants", instant, seen)
        self.last = handle.getValueState("last", instant)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for batch in rows:
            if len(batch):
                pairs = list(zip(batch["seconds"].tolist(), batch["id"].tolist()))
                self.waiting.appendList(pairs)
                low = min(t for t, _ in pairs)
                first = low if first is None else min(first, low)
        if first is not None:
            self.handle.registerTimer((first + 1) * TICK_MS)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        bound = timerValues.getCurrentWatermarkInMs() // TICK_MS
        queue = sorted((int(t), int(i)) for t, i in self.waiting.get())
        ready = [(t, i) for t, i in queue if t < bound]
        rest = [(t, i) for t, i in queue if t >= bound]
        if not ready:
            return iter([])
        self.waiting.clear()
        if rest:
            self.waiting.put(rest)
            self.handle.registerTimer((rest[0][0] + 1) * TICK_MS)
        history = sorted((int(k[0]), int(v[0])) for k, v in self.instants.iterator())
        moments = np.array([t for t, _ in history], dtype="int64")
        upto = np.concatenate(([0], np.cumsum([n for _, n in history]))).astype("int64")
        last = self.last.get()[0] if self.last.exists() else None
        t_new = np.array([t for t, _ in ready], dtype="int64")
        out = {
            self.key: [key[0]] * len(ready),
            "id": [i for _, i in ready],
            "seconds": t_new,
        }
        for name, seconds in self.windows.items():
            old = upto[-1] - upto[np.searchsorted(moments, t_new - seconds, side="right")]
            new = np.arange(len(t_new)) - np.searchsorted(t_new, t_new - seconds, side="right") + 1
            out[f"vel_n{name}_{self.key}"] = (old + new).astype("float32")
        previous = np.concatenate(([np.nan if last is None else last], t_new[:-1].astype("float64")))
        gap = np.where(np.isnan(previous), self.gap, t_new - previous)
        out[f"vel_recency_{self.key}"] = np.log1p(gap).astype("float32")

        floor = int(t_new[-1]) - self.longest
        for t, _ in history:
            if t <= floor:
                self.instants.removeKey((t,))
        fresh, counts = np.unique(t_new[t_new > floor], return_counts=True)
        known = dict(history)
        for t, n in zip(fresh.tolist(), counts.tolist()):
            self.instants.updateValue((t,), (known.get(t, 0) + n,))
        self.last.update((int(t_new[-1]),))
        return iter([pd.DataFrame(out)])

    def close(self) -> None:
        pass


def velocity_stream(
    sdf: DataFrame, delay: str = "1 hour", key: str = "card", ts: str = "dt", windows: Mapping[str, int] = WINDOWS,
    first_seen_gap_days: float = FIRST_SEEN_GAP_DAYS,
) -> DataFrame:
    """`(key, id, dt, vel_…)` per row of the stream, emitted when the watermark passes it.

    State per entity is bounded by the distinct instants of the longest window and the rows
    inside the lateness allowance.
    """
    timed = sdf.select(
        F.col(key).cast("long").alias(key),
        F.col("id").cast("long").alias("id"),
        F.col(ts).cast("long").alias("seconds"),
        F.timestamp_seconds(F.col(ts)).alias("event_time"),
    ).withWatermark("event_time", delay)
    fields = [T.StructField(key, T.LongType()), T.StructField("id", T.LongType()), T.StructField("seconds", T.LongType())]
    fields += [T.StructField(f"vel_n{n}_{key}", T.FloatType()) for n in windows]
    fields.append(T.StructField(f"vel_recency_{key}", T.FloatType()))
    out = timed.groupBy(key).transformWithStateInPandas(
        VelocityProcessor(key, windows, first_seen_gap_days),
        outputStructType=T.StructType(fields),
        outputMode="Append",
        timeMode="EventTime",
    )
    return out.withColumnRenamed("seconds", ts)
