"""Ranking and probability metrics as grouped Spark jobs.

Every metric takes group columns, so all splits, windows or folds are measured in one job.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskframe.functions.lookup import edge_position, null_safe_join
from riskframe.plans.ordering import Profile, prefix_sums, profile, quantiles
from riskframe.plans.selection import Selection, values_at_ranks
from riskframe.plans.sizing import measured


def cumulative_by_score(
    df: DataFrame,
    label: str = "is_fraud",
    score: str = "score",
    groups: Sequence[str] = (),
    weight: str | None = None,
    measured_by: Profile | None = None,
) -> DataFrame:
    """One row per distinct score, highest first, with weighted rows and positives so far."""
    w = F.lit(1).cast("long") if weight is None else F.col(weight).cast("double")
    steps = df.groupBy(*groups, score).agg(
        F.sum(w).alias("n"), F.sum(w * F.col(label).cast("long")).alias("tp")
    )
    seen = measured_by or profile(df, score)
    return prefix_sums(steps, score, ["n", "tp"], groups, descending=True, measured_by=seen)


def ranking_metrics(
    df: DataFrame,
    label: str = "is_fraud",
    score: str = "score",
    groups: Sequence[str] = (),
    weight: str | None = None,
    measured_by: Profile | None = None,
) -> DataFrame:
    """Rows, positives, average precision and ROC area per group.

    Tied scores are one step of the precision-recall staircase and half a pair of the ROC
    area. A group with one class only has neither.
    """
    steps = cumulative_by_score(df, label, score, groups, weight, measured_by)
    neg = F.col("n") - F.col("tp")
    positives, rows = F.max("total_tp"), F.max("total_n")
    precision_mass = F.sum(F.col("tp") * F.col("cum_tp") / F.col("cum_n"))
    pairs = F.sum(neg * (F.col("cum_tp") - F.col("tp") / 2))
    out = steps.groupBy(*groups).agg(
        rows.alias("n"), positives.alias("positives"), precision_mass.alias("_pm"), pairs.alias("_pairs")
    )
    both = (F.col("positives") > 0) & (F.col("positives") < F.col("n"))
    return out.select(
        *groups,
        "n",
        "positives",
        (F.col("positives") / F.col("n")).alias("base_rate"),
        F.when(both, F.try_divide(F.col("_pm"), F.col("positives"))).alias("pr_auc"),
        F.when(
            both, F.try_divide(F.col("_pairs"), F.col("positives") * (F.col("n") - F.col("positives")).cast("double"))
        ).alias("roc_auc"),
    )


def check_two_classes(metrics: DataFrame) -> DataFrame:
    """Refuse a group that holds a single class."""
    single = metrics.where("pr_auc is null")
    count = single.count()
    if count:
        raise ValueError(f"both classes are needed; {count} groups hold one only, for one {single.first().asDict()}")
    return metrics


def pr_curve(df: DataFrame, label: str = "is_fraud", score: str = "score", groups: Sequence[str] = ()) -> DataFrame:
    """Precision and recall at every distinct score."""
    steps = cumulative_by_score(df, label, score, groups)
    return steps.select(
        *groups,
        score,
        (F.col("cum_tp") / F.col("cum_n")).alias("precision"),
        F.try_divide(F.col("cum_tp").cast("double"), F.col("total_tp")).alias("recall"),
    )


# ---- recall under a daily review capacity -------------------------------------------


def recall_at_capacity(
    df: DataFrame,
    capacities: Sequence[float],
    label: str = "is_fraud",
    score: str = "score",
    day: str = "day",
    tiebreak: str = "id",
    groups: Sequence[str] = (),
) -> DataFrame:
    """Recall, reviews, ceiling and ambiguous days per capacity, ranked inside each day.

    The quota is `floor(rows · capacity)`, ties go to the smaller `tiebreak`. Instead of
    ranking rows, each day's cut score is looked up exactly; then only positives are compared
    with it, and only the block tied at the cut is ordered by the tiebreak, a number, date or text.
    Rows without a score come last.
    """
    bad = [c for c in capacities if not 0 < c <= 1]
    if bad:
        raise ValueError(f"capacities must lie in (0, 1], got {bad}")
    per_day = [*groups, day]
    df = df.withColumn(score, F.coalesce(F.col(score).cast("double"), F.lit(float("-inf"))))
    selection = Selection(df, score, per_day, descending=True, sums={"p": F.col(label).cast("long")})

    def quotas(n: Column) -> Column:
        return F.transform(
            F.array(*[F.lit(float(c)) for c in capacities]),
            lambda c: F.struct(c.alias("capacity"), F.floor(n * c).cast("long").alias("quota")),
        )

    def targets(totals: Mapping[str, Column]) -> Column:
        some = F.filter(quotas(totals["n"]), lambda t: t["quota"] > 0)
        return F.transform(some, lambda t: F.struct(t["capacity"].alias("capacity"), t["quota"].alias("quota"), (t["quota"] - 1).alias("rank")))

    cuts = measured(selection.values(targets))
    # the tied block: how far down the tiebreak order the remaining places reach
    split = F.col("before") + F.col("tied") > F.col("quota")
    partial = cuts.where(split).select(
        *per_day, F.col("value").alias(score), "capacity", (F.col("quota") - F.col("before") - 1).alias("rank")
    )
    block = null_safe_join(df.select(*per_day, score, tiebreak, label), partial.select(*per_day, score).distinct(), [*per_day, score], "left_semi")
    inside = values_at_ranks(block, tiebreak, partial, [*per_day, score], sums={"p": F.col(label).cast("long")})
    inside = inside.select(*per_day, "capacity", (F.col("p_before") + F.col("p_tied")).alias("_inside"))
    keys = [*groups, "capacity"]
    caught = (
        null_safe_join(cuts, inside, [*per_day, "capacity"], "left")
        .groupBy(*keys)
        .agg(
            F.sum(F.col("p_before") + F.when(split, F.coalesce("_inside", F.lit(0))).otherwise(F.col("p_tied"))).alias("caught"),
            F.count_if(split).alias("ambiguous_days"),
        )
    )
    whole = selection.group_totals().select(*per_day, "p", F.inline(quotas(F.col("n")))).groupBy(*keys).agg(
        F.sum("quota").alias("reviewed"), F.sum("p").alias("positives"), F.sum(F.least("quota", "p")).alias("_best")
    )
    return _capacity_entries(null_safe_join(whole, caught, keys, "left"), groups)


def _capacity_entries(joined: DataFrame, groups: Sequence[str]) -> DataFrame:
    recall = F.try_divide(F.coalesce("caught", F.lit(0)).cast("double"), F.col("positives"))
    ceiling = F.try_divide(F.col("_best").cast("double"), F.col("positives"))
    return joined.select(
        *groups,
        "capacity",
        "reviewed",
        F.coalesce("caught", F.lit(0)).alias("caught"),
        "positives",
        F.coalesce("ambiguous_days", F.lit(0)).alias("ambiguous_days"),
        recall.alias("recall"),
        ceiling.alias("recall_ceiling"),
        F.try_divide(recall, ceiling).alias("share_of_ceiling"),
    )


def recall_ceiling(df: DataFrame, capacities: Sequence[float], label: str = "is_fraud", day: str = "day", groups: Sequence[str] = ()) -> DataFrame:
    """What ranking on the label itself would catch: quota or positives, whichever is smaller."""
    days = df.groupBy(*groups, day).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("long")).alias("p")
    )
    quotas = days.withColumn("capacity", F.explode(F.array(*[F.lit(float(c)) for c in capacities])))
    best = F.sum(F.least(F.floor(F.col("n") * F.col("capacity")).cast("long"), F.col("p")))
    return quotas.groupBy(*groups, "capacity").agg(
        F.try_divide(best.cast("double"), F.sum("p")).alias("recall_ceiling")
    )


def recall_curve(df: DataFrame, points: int = 25, lowest: float = 0.001, highest: float = 0.1, **kwargs) -> DataFrame:
    """Recall and its ceiling over log-spaced capacities."""
    ratio = (highest / lowest) ** (1 / (points - 1))
    caps = [min(1.0, lowest * ratio**i) for i in range(points)]
    return recall_at_capacity(df, caps, **kwargs).select("capacity", "recall", "recall_ceiling")


def evaluate(
    df: DataFrame,
    capacities: Sequence[float],
    groups: Sequence[str] = ("split",),
    label: str = "is_fraud",
    score: str = "score",
    day: str = "day",
    tiebreak: str = "id",
) -> DataFrame:
    """The whole metric record of every group: ranking metrics and the capacity entries."""
    ranked = ranking_metrics(df, label, score, groups)
    entries = recall_at_capacity(df, capacities, label, score, day, tiebreak, groups)
    fields = [c for c in entries.columns if c not in groups]
    packed = entries.groupBy(*groups).agg(
        F.array_sort(F.collect_list(F.struct(*fields))).alias("recall_at_capacity")
    )
    return null_safe_join(ranked, packed, list(groups))


# ---- probability quality --------------------------------------------------------------


def log_loss(y: str, p: str):
    # Fixed value: double epsilon, the distance probabilities keep from 0 and 1.
    eps = 2.220446049250313e-16
    # greatest and least pass over nulls, so a missing probability has to be caught before
    q = F.when(F.col(p).isNotNull(), F.greatest(F.lit(eps), F.least(F.lit(1 - eps), F.col(p))))
    return -(F.col(y) * F.ln(q) + (1 - F.col(y)) * F.ln(1 - q))


def _binned(df: DataFrame, p: str, bins: int, groups: Sequence[str]) -> DataFrame:
    """Rows with a probability, each in its quantile bin; rows without one are left out."""
    probs = [i / bins for i in range(bins + 1)]
    df = df.where(F.col(p).isNotNull() & ~F.isnan(F.col(p).cast("double")))
    if not groups:
        found = quantiles(df, p, probs).collect()
        edges = sorted({r["value"] for r in found})
        last = max(len(edges) - 2, 0)
        placed = df.withColumn("_at", edge_position(p, edges, "right"))
        return placed.withColumn("bin", F.greatest(F.lit(0), F.least(F.lit(last), F.col("_at") - 1))).drop("_at")
    edges = measured(
        quantiles(df, p, probs, groups).groupBy(*groups).agg(F.array_sort(F.collect_set("value")).alias("_edges"))
    )
    placed = null_safe_join(df, edges, list(groups))
    at = F.size(F.filter("_edges", lambda e: e <= F.col(p)))
    last = F.greatest(F.size("_edges") - 2, F.lit(0))
    return placed.withColumn("bin", F.greatest(F.lit(0), F.least(last, at - 1))).drop("_edges")


def reliability_bins(df: DataFrame, label: str, p: str, bins: int = 10, groups: Sequence[str] = ()) -> DataFrame:
    """Rows, mean probability and positive rate per quantile bin of the probability."""
    return _binned(df, p, bins, groups).groupBy(*groups, "bin").agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg(p).alias("mean_probability"),
        F.avg(F.col(label).cast("double")).alias("rate"),
    )


def expected_calibration_error(bins: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    gap = F.abs(F.col("mean_probability") - F.col("rate"))
    return bins.groupBy(*groups).agg((F.sum(gap * F.col("rows")) / F.sum("rows")).alias("ece"))


def calibration_metrics(df: DataFrame, label: str, p: str, bins: int = 10, groups: Sequence[str] = ()) -> DataFrame:
    """Brier score, log loss and calibration error, per group; everything from one binned pass."""
    y = F.col(label).cast("double")
    per_bin = (
        _binned(df.withColumn("_y", y), p, bins, groups)
        .groupBy(*groups, "bin")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.sum("_y").alias("positives"),
            F.sum(p).alias("_p"),
            F.sum(F.pow(F.col(p) - F.col("_y"), 2)).alias("_b"),
            F.sum(log_loss("_y", p)).alias("_l"),
        )
    )
    n = F.sum("rows")
    return per_bin.groupBy(*groups).agg(
        n.alias("rows"),
        F.sum("positives").cast("long").alias("positives"),
        (F.sum("_b") / n).alias("brier"),
        (F.sum("_l") / n).alias("log_loss"),
        (F.sum(F.abs(F.col("_p") - F.col("positives"))) / n).alias("ece"),
    )


def fold_metrics(df: DataFrame, label: str, p: str, bins: int = 10) -> DataFrame:
    return calibration_metrics(df, label, p, bins, ["fold"])


# ---- mix and spread ---------------------------------------------------------------------


def stratum_shares(df: DataFrame, stratum: str, groups: Sequence[str]) -> DataFrame:
    return df.groupBy(*groups).agg(F.avg(F.col(stratum).cast("double")).alias("share"))


def mix_weights(validation: DataFrame, train_share: float, stratum: str) -> DataFrame:
    """Row weights that give the validation rows the training mix of strata."""
    share = validation.agg(F.avg(F.col(stratum).cast("double"))).first()[0]
    for side, value in (("train", train_share), ("validation", share)):
        if value is None or not 0 < value < 1:
            raise ValueError(f"{side} holds only one stratum; there is no mix to reweight")
    return validation.withColumn(
        "weight",
        F.when(F.col(stratum).cast("boolean"), F.lit(train_share / share)).otherwise(
            F.lit((1 - train_share) / (1 - share))
        ),
    )


def decompose(train: DataFrame, validation: DataFrame, stratum: str, label: str = "is_fraud", score: str = "score") -> DataFrame:
    """Gap in average precision between train and validation, and the part the mix explains."""
    share = train.agg(F.avg(F.col(stratum).cast("double"))).first()[0]
    one = F.lit(1.0)
    sides = [
        ("train", train.withColumn("weight", one)),
        ("raw", validation.withColumn("weight", one)),
        ("reweighted", mix_weights(validation, share, stratum)),
    ]
    parts = [
        f.select(F.lit(name).alias("side"), label, score, "weight") for name, f in sides
    ]
    stacked = parts[0].unionByName(parts[1]).unionByName(parts[2])
    ap = ranking_metrics(stacked, label, score, ["side"], weight="weight")
    values = ap.groupBy().pivot("side", ["train", "raw", "reweighted"]).agg(F.first("pr_auc"))
    gap = F.col("train") - F.col("raw")
    moved = F.col("reweighted") - F.col("raw")
    return values.select(
        F.col("train").alias("train_pr_auc"),
        F.col("raw").alias("validation_pr_auc"),
        F.col("reweighted").alias("reweighted_pr_auc"),
        gap.alias("pooled_gap"),
        moved.alias("compositional"),
        (gap - moved).alias("remainder"),
        F.when(gap > 0, F.try_divide(moved, gap)).alias("share_of_gap"),
    )


def cells(
    df: DataFrame, stratum: str, label: str = "is_fraud", score: str = "score", capacities: Sequence[float] = (),
    day: str = "day", tiebreak: str = "id",
) -> DataFrame:
    """Metrics of every split and the pooled validation, for all rows and for each stratum.

    A row is copied to each cell it belongs to (at most four), then all cells are one job. With
    `capacities`, recall is taken at each within the cell: at the top of the cell's own daily rows.
    """
    sides = F.array_compact(
        F.array(F.col("split"), F.when(F.col("split").isin("val_fit", "val_cal"), F.lit("validation")))
    )
    named = F.when(F.col(stratum).cast("boolean"), F.lit("identity")).otherwise(F.lit("no_identity"))
    spread = (
        df.where(F.col("split").isin("train", "val_fit", "val_cal"))
        .withColumn("side", F.explode(sides))
        .withColumn("stratum", F.explode(F.array(F.lit("all"), named)))
    )
    if capacities:
        return evaluate(spread, capacities, ["side", "stratum"], label, score, day, tiebreak)
    return ranking_metrics(spread, label, score, ["side", "stratum"])


def spread_summary(runs: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    """Mean, sample deviation and range of a metric over repeated runs."""
    return runs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("runs"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        F.min(value).alias("lowest"),
        F.max(value).alias("highest"),
    )


def acceptance(summary: DataFrame, challenger: str, incumbent: str, key: str) -> DataFrame:
    """A challenger is accepted when the gap in means exceeds both spreads together."""
    sides = summary.where(F.col(key).isin(challenger, incumbent))
    row = sides.groupBy().pivot(key, [challenger, incumbent]).agg(
        F.first("mean").alias("mean"), F.first("std").alias("std")
    )
    gap = F.col(f"{challenger}_mean") - F.col(f"{incumbent}_mean")
    noise = F.coalesce(f"{challenger}_std", F.lit(0.0)) + F.coalesce(f"{incumbent}_std", F.lit(0.0))
    return row.select(gap.alias("gap"), noise.alias("noise"), (gap > noise).alias("accepted"))


def delta_vs_reference(runs: DataFrame, value: str, key: str, reference: str) -> DataFrame:
    """Every arm's difference from one named arm."""
    base = runs.where(F.col(key) == reference).agg(F.avg(value).alias("v")).scalar()
    return runs.withColumn("delta", F.col(value) - base)


def floor_summary(deltas: DataFrame, width: str = "width") -> DataFrame:
    """Per number of columns removed or added: largest absolute delta and the deviation."""
    return deltas.groupBy(width).agg(
        F.max(F.abs("delta")).alias("max_abs_delta"), F.stddev_samp("delta").alias("std")
    )


def rank_desc(df: DataFrame, value: str, out: str, groups: Sequence[str] = ()) -> DataFrame:
    """Descending rank of a small summary table, ties sharing their average place."""
    scope = [F.col(g) for g in groups] or [F.lit(0)]
    w = Window.partitionBy(*scope).orderBy(F.col(value).desc())
    ties = F.count(F.lit(1)).over(Window.partitionBy(*scope, value))
    return df.withColumn(out, F.rank().over(w) + (ties - 1) / 2)


