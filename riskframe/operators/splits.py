"""Temporal splits, their summaries and the causal order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from riskframe.config import SECTIONS, SplitBounds
from riskframe.functions import scalar as S
from riskframe.plans.gates import unless
from riskframe.plans.sizing import bounded, literal_table
from riskframe.session import materialise


def add_time_columns(df: DataFrame, seconds: str = "dt") -> DataFrame:
    return df.withColumns(
        {"day": S.day_of(seconds), "hour": S.hour_of(seconds), "weekday": S.weekday_of(seconds)}
    )


def split_of(day: Column | str, bounds: SplitBounds) -> Column:
    """Split whose closed day range holds the day; null in the gap and outside the span."""
    d = F.col(day) if isinstance(day, str) else day
    chosen = F.lit(None).cast("string")
    for name, (first, last) in bounds.ranges.items():
        chosen = F.when(d.between(first, last), F.lit(name)).otherwise(chosen)
    return chosen


def assign_splits(df: DataFrame, bounds: SplitBounds, day: str = "day") -> DataFrame:
    return df.withColumn("split", split_of(day, bounds))


def section_of(split: str = "split") -> Column:
    return F.coalesce(F.col(split), F.lit("gap"))


def split_violations(df: DataFrame, bounds: SplitBounds, day: str = "day") -> DataFrame:
    """Everything wrong with an assignment `(section, problem)`: span not as declared, a split
    empty or out of its range, or unclaimed days outside the gap."""
    found = df.groupBy(section_of().alias("section")).agg(
        F.min(day).alias("lo"), F.max(day).alias("hi"), F.count(F.lit(1)).alias("rows")
    )
    ranges = {**bounds.ranges, "gap": (bounds.train_end + 1, bounds.val_fit_start - 1)}
    expected = literal_table(
        df.sparkSession, [(s, *ranges[s]) for s in SECTIONS], "section string, first int, last int"
    )
    joined = bounded(expected, len(SECTIONS)).join(found, "section", "full_outer")
    first, last = F.col("first"), F.col("last")
    problem = (
        F.when(first.isNull(), "unknown split")
        .when(F.col("rows").isNull() & (first <= last), "empty")
        .when(F.col("rows").isNotNull() & ((F.col("lo") < first) | (F.col("hi") > last)), "outside its range")
        .when((F.col("section") == "train") & (F.col("lo") != bounds.train_start), "span starts late")
        .when((F.col("section") == "test") & (F.col("hi") != bounds.test_end), "span ends early")
    )
    return joined.select("section", problem.alias("problem")).where("problem is not null")


def validate_splits(df: DataFrame, bounds: SplitBounds) -> DataFrame:
    found = [tuple(r) for r in split_violations(df, bounds).collect()]
    if found:
        raise ValueError(f"splits do not hold: {found}")
    return df


def summarize(df: DataFrame, label: str = "is_fraud", day: str = "day") -> DataFrame:
    """First/last day, distinct days, rows, positives and rate of all five sections.

    Days are counted in two steps, so no task holds a section's rows.
    """
    per_day = df.groupBy(section_of().alias("section"), day).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.col(label).cast("long")).alias("positives")
    )
    stats = per_day.groupBy("section").agg(
        F.min(day).cast("int").alias("first_day"),
        F.max(day).cast("int").alias("last_day"),
        F.count(F.lit(1)).alias("n_days"),
        F.sum("rows").alias("rows"),
        F.sum("positives").alias("positives"),
    )
    order = literal_table(
        df.sparkSession, [(s, i) for i, s in enumerate(SECTIONS)], "section string, ordinal int"
    )
    return (
        bounded(order, len(SECTIONS))
        .join(stats, "section", "left")
        .select(
            "section",
            "ordinal",
            "first_day",
            "last_day",
            F.coalesce("n_days", F.lit(0)).alias("n_days"),
            F.coalesce("rows", F.lit(0)).alias("rows"),
            F.coalesce("positives", F.lit(0)).alias("positives"),
            F.try_divide(F.col("positives").cast("double"), F.col("rows")).alias("rate"),
        )
    )


def check_summary(summary: DataFrame) -> DataFrame:
    """Refuse a split that holds no positives."""
    empty = [r["section"] for r in summary.where("section <> 'gap' and positives = 0").collect()]
    if empty:
        raise ValueError(f"splits without positives: {empty}")
    return summary


def attach_splits(df: DataFrame, splits: DataFrame, key: str = "id") -> DataFrame:
    """Inner one-to-one join on the key; any change of row count is refused.

    The join runs once: its rows are written to the shared folder and counted on the way, those of
    `df` as they go in and the joined ones as they come out.
    """
    left, out = Observation(), Observation()
    rows = F.count(F.lit(1)).alias("n")
    written = materialise(df.observe(left, rows).join(splits, key).observe(out, rows), "attached")
    # the planner may skip a side whose other side is empty
    before, after = left.get.get("n"), out.get.get("n", 0)
    before = df.count() if before is None or not after else before
    if before != after:
        raise ValueError(f"attaching splits changed {before} rows into {after}")
    return written


def partition_counts(df: DataFrame) -> DataFrame:
    """Rows per split, the purged rows, and the total they add up to."""
    known = F.coalesce(F.col("split").isin(*SECTIONS), F.lit(True))
    section = F.when(known, section_of()).otherwise(F.concat(F.lit("unknown split "), F.col("split")))
    counts = df.groupBy(section.alias("section"), known.alias("_known")).agg(F.count(F.lit(1)).alias("rows"))
    return counts.where(unless(~F.col("_known"), F.col("section"))).drop("_known")


def cut_from_day(df: DataFrame, first: int, day: str = "day") -> DataFrame:
    """Rows from a day on; a cut that drops nothing is refused."""
    if df.where(F.col(day) < first).isEmpty():
        raise ValueError(f"no rows before day {first}: the cut would drop nothing")
    return df.where(F.col(day) >= first)


def order_by_time(df: DataFrame, ts: str = "dt", key: str = "id") -> DataFrame:
    """Rows range-partitioned and sorted by `(ts, id)`: causal order on disk, no global sort task."""
    return df.repartitionByRange(F.col(ts), F.col(key)).sortWithinPartitions(ts, key)


def day_folds(df: DataFrame, folds: int, day: str = "day") -> DataFrame:
    """`(day, fold)`: contiguous blocks of equal width; gaps and remainders are refused."""
    if folds < 2:
        raise ValueError(f"folds={folds}: cross-fitting needs at least two")
    span = df.agg(F.min(day).alias("lo"), F.max(day).alias("hi")).first()
    present = {r[0] for r in df.select(day).distinct().collect()}
    if span["lo"] is None:
        raise ValueError("no days to fold")
    days = range(span["lo"], span["hi"] + 1)
    gaps = [d for d in days if d not in present]
    if gaps:
        raise ValueError(f"days are not contiguous; missing {gaps}")
    if len(days) % folds:
        raise ValueError(f"{len(days)} days do not divide into {folds} folds")
    width = len(days) // folds
    return literal_table(df.sparkSession, [(d, i // width) for i, d in enumerate(days)], f"{day} int, fold int")


def assign_folds(df: DataFrame, folds: int, day: str = "day") -> DataFrame:
    """Fold of each row; one value per day, so arithmetic on the first day suffices."""
    table = day_folds(df, folds, day)
    first = table.agg(F.min(day), F.count(F.lit(1))).first()
    width = first[1] // folds
    return df.withColumn("fold", F.floor((F.col(day) - F.lit(first[0])) / F.lit(width)).cast("int"))


def rolling_center(df: DataFrame, value: str, width: int, order: str = "day", out: str | None = None) -> DataFrame:
    """Centred rolling mean over a per-day table; null until the window is full."""
    half = width // 2
    w = Window.partitionBy(F.lit(0)).orderBy(order).rowsBetween(-half, half)
    full = F.count(value).over(w) == width
    return df.withColumn(out or f"{value}_smooth", F.when(full, F.avg(value).over(w)))
