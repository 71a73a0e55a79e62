"""Score and decide a stream with static fitted tables (ST1), and clean its input (ST3, ST7)."""

from __future__ import annotations

import threading
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from riskframe.config import Costs
from riskframe.operators.calibration import Isotonic, Platt
from riskframe.operators.cost import decide
from riskframe.operators.horizon import Fitted, transform


def score_stream(
    sdf: DataFrame,
    fitted: Fitted,
    scorer: Callable[[DataFrame], DataFrame],
    calibrator: Platt | Isotonic,
    costs: Costs,
    coverage_of: Sequence[str] = (),
    keep: Sequence[str] = ("id", "day", "amount"),
) -> DataFrame:
    """Transform, score, calibrate and decide; the batch functions, on a stream.

    Every join is stream-static against fitted tables; `scorer` adds a `score` column.
    """
    scored = scorer(transform(sdf, fitted))
    calibrated = calibrator.apply(scored, "score", "probability")
    decided = decide(calibrated, costs, "probability", "amount", coverage_of)
    return decided.select(
        *keep, "probability", "decision", "break_even", "review_eligible", "review_priority", "mode",
        "inputs_present", "inputs_expected",
    )


def watermarked(sdf: DataFrame, ts: str, delay: str) -> DataFrame:
    """Event-time bound: stateful steps below it drop rows later than `delay` and count them
    in their progress metrics."""
    return sdf.withWatermark(ts, delay)


class LateRows(StreamingQueryListener):
    """Rows that stateful steps dropped as late, added up batch by batch.

    A query keeps its last progress reports only; a listener hears of every batch. A deduplication
    counts rows, an aggregate what is left of them after each task has combined its own. Usable as
    a context: `with LateRows(spark) as late: ...; late.total(query)`.
    """

    def __init__(self, spark: SparkSession) -> None:
        self._spark, self._dropped, self._ended = spark, {}, {}
        self._lock = threading.Condition()

    def __enter__(self) -> LateRows:
        self._spark.streams.addListener(self)
        return self

    def __exit__(self, *_) -> None:
        self._spark.streams.removeListener(self)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        late = sum(int(op.numRowsDroppedByWatermark) for op in event.progress.stateOperators)
        with self._lock:
            run = str(event.progress.runId)
            self._dropped[run] = self._dropped.get(run, 0) + late

    def onQueryTerminated(self, event) -> None:
        with self._lock:
            self._ended[str(event.runId)] = True
            self._lock.notify_all()

    def total(self, query, wait: float = 60.0) -> int:
        """Late rows of a query that has ended, once its last event has arrived."""
        run = str(query.runId)
        with self._lock:
            if not self._lock.wait_for(lambda: run in self._ended, wait):
                raise TimeoutError(f"the end of query {run} was not heard of in {wait:g} s")
            return self._dropped.get(run, 0)


def dedup(sdf: DataFrame, id_: str, ts: str, delay: str) -> DataFrame:
    """First copy of each id; state is kept no longer than the watermark needs."""
    return sdf.withWatermark(ts, delay).dropDuplicatesWithinWatermark([id_])


def event_time(df: DataFrame, seconds: str = "dt", out: str = "event_time") -> DataFrame:
    """Integer seconds as an event-time column."""
    return df.withColumn(out, F.timestamp_seconds(F.col(seconds)))
