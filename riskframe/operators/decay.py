"""Performance per window, its reading, and the retraining trigger."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.config import MonitoringConfig, SplitBounds
from riskframe.operators.bootstrap import metric_bootstrap
from riskframe.operators.drift import describe_windows, window_index
from riskframe.operators.ranking import ranking_metrics


def window_table(
    df: DataFrame, width: int, bounds: SplitBounds, stratum: str = "has_identity", resamples: int = 2000,
    interval: float = 0.95, seed: int = 0, label: str = "is_fraud", score: str = "score",
) -> DataFrame:
    """Metrics, mix and bootstrap intervals of every window after training.

    A window that straddles two splits fails the job.
    """
    anchor = bounds.val_fit_start
    cut = window_index(df, width, anchor)
    layout = describe_windows(df, width, anchor)
    one_split = F.when(F.min("split") == F.max("split"), F.min("split")).otherwise(
        F.raise_error(F.concat(F.lit("window straddles "), F.min("split"), F.lit(" and "), F.max("split")))
    )
    mix = cut.groupBy("window").agg(
        one_split.alias("slice"), F.avg(F.col(stratum).cast("double")).alias("stratum_share")
    )
    metrics = ranking_metrics(cut, label, score, ["window"]).withColumnRenamed("n", "scored")
    ends = metric_bootstrap(cut, resamples, interval, seed, label=label, score=score)
    middle = (F.col("first_day") + F.col("last_day")) / 2
    return (
        layout.join(mix, "window")
        .join(metrics, "window")
        .join(ends, "window")
        .withColumn("optimistic", F.col("slice") == "val_fit")
        .withColumn("days_since_training", middle - F.lit(bounds.train_end))
        .drop("scored")
    )


def composition_bound(compositional: float, train_share: float, validation_share: float, spanned: Sequence[float]) -> dict[str, float]:
    """Metric movement per point of mix, and the range of mixes it was measured over."""
    shift = 100 * (train_share - validation_share)
    if shift == 0:
        raise ValueError("the mix did not move between train and validation")
    return {"per_point": compositional / shift, "low": min(spanned), "high": max(spanned)}


def read_windows(table: DataFrame, pr_auc: float, roc_auc: float, per_point: float, low: float) -> DataFrame:
    """`no decline`, `prevalence` or `decline` per window, and whether a decline exceeds the mix."""
    pr_below = F.col("pr_auc_high") < pr_auc
    roc_below = F.col("roc_auc_high") < roc_auc
    reading = F.when(~pr_below, "no decline").when(~roc_below, "prevalence").otherwise("decline")
    mix_bound = 100 * F.greatest(F.lit(low) - F.col("stratum_share"), F.lit(0.0)) * per_point
    return table.withColumns(
        {
            "pr_auc_below_baseline": pr_below,
            "roc_auc_below_baseline": roc_below,
            "reading": reading,
            "mix_bound": mix_bound,
            "beyond_mix": (reading == "decline") & ((F.lit(pr_auc) - F.col("pr_auc")) > mix_bound),
        }
    )


# ---- trigger -------------------------------------------------------------------------------

# Condition numbers, as they are reported.
CONDITIONS = {1: "feature_psi", 2: "score_psi", 3: "pr_auc", 4: "cadence"}


def clock(bounds: SplitBounds, config: MonitoringConfig) -> dict[str, int]:
    """Days on which labels mature and the cadence runs out."""
    return {
        "training_ends": bounds.train_end,
        "deployment": bounds.test_start,
        "maturity_days": bounds.gap_days,
        "calibration_labels_mature_on": bounds.test_start - 1 + bounds.gap_days,
        "baseline_labels_mature_on": bounds.test_end + bounds.gap_days,
        "cadence_fires_on": bounds.test_start + config.cadence_days,
    }


def trigger_windows(windows: DataFrame, bounds: SplitBounds, config: MonitoringConfig) -> DataFrame:
    """Monitoring windows read against the trigger.

    Input `(horizon, first_day, last_day, partial, weighted_psi, score_psi)`; windows before
    deployment are dropped, one that straddles it fails the job, a partial one never fires.
    """
    deployment = bounds.test_start
    straddles = (F.col("first_day") < deployment) & (F.col("last_day") >= deployment)
    checked = F.when(straddles, F.raise_error(F.lit("a window straddles deployment")).cast("int")).otherwise(
        F.col("first_day")
    )
    read = windows.withColumn("first_day", checked).where(F.col("first_day") >= deployment)

    def reaches(c: str, limit: float) -> Column:
        return F.coalesce(F.col(c) >= limit, F.lit(False))

    feature = reaches("weighted_psi", config.limit(config.feature_band))
    score = reaches("score_psi", config.limit(config.score_band)) & (F.col("horizon") == "horizon")
    return read.select(
        "horizon",
        "first_day",
        "last_day",
        "partial",
        F.col("last_day").alias("read_on"),
        "weighted_psi",
        "score_psi",
        feature.alias("feature_reaches"),
        (feature & ~F.col("partial")).alias("feature_fires"),
        score.alias("score_reaches"),
        (score & ~F.col("partial")).alias("score_fires"),
        (F.col("last_day") + bounds.gap_days).alias("labels_mature_on"),
        F.when(F.col("horizon") == "labelled", "inside the baseline").otherwise("no labels").alias("pr_auc_why_not"),
    )


def firings(read: DataFrame, bounds: SplitBounds, config: MonitoringConfig) -> DataFrame:
    """Day each condition first fires `(condition, name, fires_on)`; the cadence always does."""
    cadence = clock(bounds, config)["cadence_fires_on"]
    days = read.agg(
        F.min(F.when(F.col("feature_fires"), F.col("read_on"))).alias("feature_psi"),
        F.min(F.when(F.col("score_fires"), F.col("read_on"))).alias("score_psi"),
    )
    cells = F.array(
        *[
            F.struct(
                F.lit(number).alias("condition"),
                F.lit(name).alias("name"),
                (
                    F.lit(cadence)
                    if name == "cadence"
                    else F.lit(None)
                    if name == "pr_auc"
                    else F.col(name)
                ).cast("int").alias("fires_on"),
            )
            for number, name in CONDITIONS.items()
        ]
    )
    return days.select(F.inline(cells))


def first_firing(fired: DataFrame) -> DataFrame:
    """The earliest condition; on one day the lower number leads."""
    return fired.where("fires_on is not null").agg(
        F.min(F.struct("fires_on", "condition", "name")).alias("m")
    ).select(F.col("m.condition").alias("condition"), F.col("m.name").alias("name"), F.col("m.fires_on").alias("fires_on"))


def firing_window(first: DataFrame, read: DataFrame) -> DataFrame:
    """The window the first firing fell in, if any."""
    day = first.select("fires_on").scalar()
    return read.where((F.col("first_day") <= day) & (F.col("last_day") >= day)).select(
        "horizon", "first_day", "last_day", "partial"
    )


def retrain_layout(first: DataFrame, bounds: SplitBounds) -> DataFrame:
    """Splits a retraining on the firing day would have under the same layout."""
    labelled = F.col("fires_on") - bounds.gap_days
    cal_start = labelled - (bounds.test_start - bounds.val_cal_start) + 1
    fit_start = cal_start - (bounds.val_cal_start - bounds.val_fit_start)
    ends = fit_start - bounds.gap_days - 1
    return first.select(
        F.col("fires_on").alias("trigger_day"),
        labelled.alias("labelled_through"),
        ends.alias("training_ends"),
        fit_start.alias("val_fit_start"),
        (cal_start - 1).alias("val_fit_end"),
        cal_start.alias("val_cal_start"),
        labelled.alias("val_cal_end"),
        (F.col("fires_on") - ends).alias("days_stale"),
    )
