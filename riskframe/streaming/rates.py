"""Windowed rates, review queues and label maturity (ST4-ST6)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.config import BLOCK, Costs
from riskframe.operators.cost import ev_policy
from riskframe.operators.drift import ReferenceBins, binned_cells
from riskframe.plans.gates import unless


def windowed_rates(sdf: DataFrame, width: str, slide: str | None = None, ts: str = "event_time", keys: tuple[str, ...] = ()) -> DataFrame:
    """Rows, blocked rows and mean probability per tumbling or sliding window of decided rows."""
    span = F.window(ts, width, slide) if slide else F.window(ts, width)
    return (
        sdf.groupBy(span.alias("w"), *keys)
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.count_if(F.col("decision") == BLOCK).alias("blocked"),
            F.avg("probability").alias("mean_probability"),
        )
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "rows", "blocked", "mean_probability")
    )


def session_counts(sdf: DataFrame, gap: str, key: str = "card", ts: str = "event_time") -> DataFrame:
    """Rows of each burst of activity of an entity: a row `gap` or more after the last one starts a
    new session, which ends `gap` after its own last row."""
    # session windows that touch are merged: the gap is short of its end by the smallest step of time
    return (
        sdf.groupBy(F.session_window(ts, f"{gap} -1 microseconds").alias("w"), key)
        .agg(F.count(F.lit(1)).alias("rows"), F.sum("amount").alias("amount"))
        .select(
            F.col("w.start").alias("session_start"),
            (F.col("w.end") + F.expr("INTERVAL 1 MICROSECOND")).alias("session_end"),
            key, "rows", "amount",
        )
    )


def windowed_bins(sdf: DataFrame, bins: ReferenceBins, width: str, ts: str = "event_time") -> DataFrame:
    """Bin counts per window and column, ready for the stability index."""
    cells = binned_cells(sdf, bins, [ts])
    return (
        cells.groupBy(F.window(ts, width).alias("w"), "column", "bin")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(unless(F.col("bin").isNull(), F.concat("column", F.lit(" holds an unrouted value"))))
        .select(F.col("w.start").alias("window_start"), "column", "bin", "n")
    )


def closed_days(sdf: DataFrame, ts: str = "event_time", day: str = "day") -> DataFrame:
    """Rows per day, emitted once the watermark says the day is over."""
    return (
        sdf.groupBy(F.window(ts, "1 day").alias("w"))
        .agg(F.count(F.lit(1)).alias("rows"))
        .select(F.col("w.start").alias("day_start"), F.col("w.end").alias("day_end"), "rows")
    )


def review_queue_writer(rows_path: str, out: str, costs: Costs, capacity: float) -> Callable[[DataFrame, int], None]:
    """A `foreachBatch` sink that ranks each day as it closes.

    The stream of closed days names the days; their rows are read from the landed table, so
    the queue of a day is final. A day's directory is overwritten whole, which makes a
    replayed batch harmless.
    """

    def write(days: DataFrame, batch: int) -> None:
        spark = days.sparkSession
        closed = [r["day"] for r in days.select(_day_number("day_start").alias("day")).distinct().collect()]
        if not closed:
            return
        rows = spark.read.parquet(rows_path).where(F.col("day").isin(closed))
        queued = ev_policy(rows, costs, capacity, day_bound=len(closed)).where("review_share > 0")
        (
            queued.select("id", "gain", "review_share", "day")
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("day")
            .parquet(out)
        )

    return write


def _day_number(start: str):
    return F.floor(F.unix_seconds(F.col(start)) / 86_400).cast("int")


def mature_labels(predictions: DataFrame, labels: DataFrame, days: int = 30, delay: str = "1 day", id_: str = "id") -> DataFrame:
    """Predictions joined to labels that arrive up to `days` later; unmatched ones come out with
    a null label once both watermarks have passed."""
    left = predictions.withWatermark("event_time", delay).alias("p")
    right = labels.select(
        F.col(id_).alias("label_id"), F.col("label_time"), F.col("is_fraud").alias("label")
    ).withWatermark("label_time", delay).alias("l")
    within = (
        (F.col(f"p.{id_}") == F.col("l.label_id"))
        & (F.col("l.label_time") >= F.col("p.event_time"))
        & (F.col("l.label_time") <= F.col("p.event_time") + F.expr(f"INTERVAL {days} DAYS"))
    )
    return left.join(right, within, "left_outer").select("p.*", "label_time", "label")
