"""Day bootstraps: whole days are resampled, so rows are reduced to days first."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.functions.lookup import null_safe_join
from riskframe.plans.gates import refuse
from riskframe.plans.ordering import prefix_sums, profile
from riskframe.plans.sizing import bounded, measured


def by_day(
    df: DataFrame, sums: dict[str, Column | str], day: str = "day", keys: Sequence[str] = (), complete: bool = False
) -> DataFrame:
    """Rows and sums per day: the only thing a bootstrap over days needs.

    With `complete`, a null among the summed values ends the job.
    """
    values = {name: F.col(c) if isinstance(c, str) else c for name, c in sums.items()}
    absent = reduce(Column.__or__, [c.isNull() for c in values.values()], F.lit(False))
    days = df.groupBy(*keys, day).agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.sum(c).alias(name) for name, c in values.items()],
        *([F.count_if(absent).alias("_absent")] if complete else []),
    )
    return refuse(days, "_absent", "values to resample are missing") if complete else days


def draw_multiplicities(days: int, resamples: int, seed: int) -> np.ndarray:
    """`(resamples, days)`: how often each day is drawn, with the generator of record."""
    draws = np.random.default_rng(seed).integers(0, days, size=(resamples, days))
    out = np.zeros((resamples, days), dtype="int64")
    np.add.at(out, (np.arange(resamples)[:, None], draws), 1)
    return out


def draws_table(df: DataFrame, day: str, resamples: int, seed: int) -> DataFrame:
    """`(resample, day, times)` for the days present, drawn once on the driver.

    Its size is resamples by days, both parameters; days drawn zero times are left out.
    """
    present = sorted(r[0] for r in df.select(day).distinct().collect())
    if not present:
        raise ValueError("no days to resample")
    times = draw_multiplicities(len(present), resamples, seed)
    resample, index = np.nonzero(times)
    table = pd.DataFrame(
        {
            "resample": resample.astype("int32"),
            day: np.asarray(present, dtype="int32")[index],
            "times": times[resample, index].astype("int32"),
        }
    )
    return df.sparkSession.createDataFrame(table)


def _interval(stat: DataFrame, value: str, interval: float, keys: Sequence[str] = ()) -> DataFrame:
    # one value per resample: the parameter bounds what a task sees
    tail = (1 - interval) / 2
    ends = F.percentile(value, F.array(F.lit(tail), F.lit(1 - tail)))
    return stat.groupBy(*keys).agg(ends.alias("e")).select(
        *keys, F.col("e")[0].alias("low"), F.col("e")[1].alias("high")
    )


def paired_day_bootstrap(
    df: DataFrame, arm: str, reference: str, resamples: int = 2000, interval: float = 0.95, seed: int = 0,
    day: str = "day",
) -> DataFrame:
    """Interval of the difference in cost per 1,000 rows between two costings of one population."""
    days = measured(by_day(df, {"a": arm, "r": reference}, day, complete=True))
    drawn = draws_table(days, day, resamples, seed).join(days, day)
    stat = drawn.groupBy("resample").agg(
        (F.sum((F.col("a") - F.col("r")) * F.col("times")) / F.sum(F.col("rows") * F.col("times")) * 1000).alias("v")
    )
    return _interval(stat, "v", interval).withColumn("excludes_zero", (F.col("high") < 0) | (F.col("low") > 0))


def reduction_interval(
    df: DataFrame, policy: str, reference: str, resamples: int = 2000, interval: float = 0.95, seed: int = 0,
    day: str = "day",
) -> DataFrame:
    """Interval of `1 - policy / reference` on total cost."""
    days = measured(by_day(df, {"p": policy, "r": reference}, day, complete=True))
    drawn = draws_table(days, day, resamples, seed).join(days, day)
    stat = drawn.groupBy("resample").agg(
        (1 - F.try_divide(F.sum(F.col("p") * F.col("times")), F.sum(F.col("r") * F.col("times")))).alias("v")
    )
    return _interval(stat, "v", interval)


def ladder_intervals(
    costs: DataFrame, pairs: Sequence[tuple[str, str]], resamples: int = 2000, interval: float = 0.95, seed: int = 0,
    day: str = "day",
) -> DataFrame:
    """Intervals of several policy pairs from one table `(policy, day, cost)` and one set of draws."""
    names = sorted({p for pair in pairs for p in pair})
    days = measured(
        costs.groupBy(day)
        .pivot("policy", names)
        .agg(F.sum("cost").alias("c"), F.count(F.lit(1)).alias("n"))
    )
    drawn = draws_table(days, day, resamples, seed).join(days, day)
    rows = F.sum(F.col(f"{names[0]}_n") * F.col("times"))
    deltas = [
        (F.sum((F.col(f"{after}_c") - F.col(f"{before}_c")) * F.col("times")) / rows * 1000).alias(f"d{i}")
        for i, (before, after) in enumerate(pairs)
    ]
    stat = drawn.groupBy("resample").agg(*deltas)
    cells = F.array(
        *[
            F.struct(F.lit(a).alias("from_policy"), F.lit(b).alias("to_policy"), F.col(f"d{i}").alias("v"))
            for i, (a, b) in enumerate(pairs)
        ]
    )
    out = _interval(stat.select(F.inline(cells)), "v", interval, ["from_policy", "to_policy"])
    return out.withColumn("excludes_zero", (F.col("high") < 0) | (F.col("low") > 0))


# ---- ranking metrics inside a window ---------------------------------------------------------

# Resamples handled per matrix product, so a task's working set stays in a few megabytes.
CHUNK = 250


def metric_bootstrap(
    df: DataFrame, resamples: int = 2000, interval: float = 0.95, seed: int = 0, window: str = "window",
    day: str = "day", label: str = "is_fraud", score: str = "score",
) -> DataFrame:
    """Day-bootstrap intervals of average precision and ROC area in every window.

    Drawing a day twice multiplies its counts, and running totals are linear in them. So the
    per-day counts of each distinct score are accumulated once along the score, and every
    resample is a weighted sum of those totals: no copy of a row per resample is ever made.
    """
    spans = measured(df.groupBy(window, day).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("long")).alias("p")
    ))
    listed = spans.collect()
    layout: dict[int, list[int]] = {}
    totals: dict[tuple[int, int], tuple[int, int]] = {}
    for r in listed:
        layout.setdefault(r[window], []).append(r[day])
        totals[(r[window], r[day])] = (r["n"], r["p"])
    layout = {w: sorted(days) for w, days in layout.items()}
    width = max(len(days) for days in layout.values())

    # position of a day inside its window
    place = spans.sparkSession.createDataFrame(
        [(w, d, i) for w, days in layout.items() for i, d in enumerate(days)],
        f"{window} int, {day} int, _at int",
    )
    placed = null_safe_join(
        df.select(F.col(window).cast("int").alias(window), F.col(day).cast("int").alias(day), label, score),
        bounded(place, len(listed)),
        [window, day],
    )
    y = F.col(label).cast("long")
    cols = [f"n{i}" for i in range(width)] + [f"p{i}" for i in range(width)]
    steps = placed.groupBy(window, score).agg(
        *[F.count_if(F.col("_at") == i).cast("double").alias(f"n{i}") for i in range(width)],
        *[F.sum(F.when(F.col("_at") == i, y).otherwise(0)).cast("double").alias(f"p{i}") for i in range(width)],
    )
    summed = prefix_sums(steps, score, cols, [window], descending=True, measured_by=profile(df, score))
    drawn = {w: draw_multiplicities(len(days), resamples, seed) for w, days in layout.items()}
    own = {
        w: (np.array([totals[(w, d)][0] for d in days]), np.array([totals[(w, d)][1] for d in days]))
        for w, days in layout.items()
    }

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # one row for each window and resample of a task, however many batches it reads
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for w, rows in batch.groupby(window):
                k = len(layout[w])
                n, p = (rows[[f"{c}{i}" for i in range(k)]].to_numpy() for c in "np")
                cn, cp = (rows[[f"cum_{c}{i}" for i in range(k)]].to_numpy() for c in "np")
                own_sums = sums.setdefault(w, np.zeros((2, resamples)))
                for start in range(0, resamples, CHUNK):
                    times = drawn[w][start : start + CHUNK].T.astype("float64")
                    hits, upto = p @ times, cp @ times
                    seen = cn @ times
                    with np.errstate(divide="ignore", invalid="ignore"):
                        mass = np.where(seen > 0, hits * upto / seen, 0.0).sum(axis=0)
                    pairs = ((n - p) @ times * (upto - hits / 2)).sum(axis=0)
                    own_sums[:, start : start + times.shape[1]] += [mass, pairs]
        for w, (mass, pairs) in sums.items():
            yield pd.DataFrame(
                {window: np.int32(w), "resample": np.arange(resamples, dtype="int32"), "mass": mass, "pairs": pairs}
            )

    needed = summed.select(window, *cols, *[f"cum_{c}" for c in cols])
    parts = needed.mapInPandas(partial, f"{window} int, resample int, mass double, pairs double")
    scale = []
    for w in layout:
        n, p = own[w]
        rows, hits = drawn[w] @ n, drawn[w] @ p
        scale.append(pd.DataFrame({window: np.int32(w), "resample": np.arange(resamples, dtype="int32"), "_n": rows, "_p": hits}))
    sizes = df.sparkSession.createDataFrame(pd.concat(scale))
    stat = (
        parts.groupBy(window, "resample")
        .agg(F.sum("mass").alias("mass"), F.sum("pairs").alias("pairs"))
        .join(sizes, [window, "resample"])
        .select(
            window,
            F.try_divide(F.col("mass"), F.col("_p")).alias("pr"),
            F.try_divide(F.col("pairs"), F.col("_p") * (F.col("_n") - F.col("_p")).cast("double")).alias("roc"),
        )
    )
    tail = (1 - interval) / 2
    ends = F.array(F.lit(tail), F.lit(1 - tail))
    out = stat.groupBy(window).agg(
        F.percentile("pr", ends).alias("a"), F.percentile("roc", ends).alias("b")
    )
    return out.select(
        window,
        F.col("a")[0].alias("pr_auc_low"),
        F.col("a")[1].alias("pr_auc_high"),
        F.col("b")[0].alias("roc_auc_low"),
        F.col("b")[1].alias("roc_auc_high"),
    )
