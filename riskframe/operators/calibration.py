"""Probability calibration: Platt and isotonic, cross-fitted by day folds."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.config import Costs
from riskframe.functions.lookup import interpolate
from riskframe.functions.scalar import expit, logit
from riskframe.operators.cost import ev_policy, policy_cost, policy_summary
from riskframe.operators.ranking import calibration_metrics
from riskframe.operators.splits import assign_folds
from riskframe.plans.monotone import apply_blocks, breakpoints, monotone_blocks
from riskframe.session import materialise

# Fixed value: distance scores keep from 0 and 1 before the log-odds are taken.
SCORE_CLIP = 1e-15
METHODS = ("platt", "isotonic")


def clipped_scores(df: DataFrame, score: str = "score", clip: float = SCORE_CLIP) -> DataFrame:
    """How many scores the clip would move."""
    return df.agg(F.count_if((F.col(score) < clip) | (F.col(score) > 1 - clip)).alias("clipped"))


def check_clip(df: DataFrame, score: str = "score", clip: float = SCORE_CLIP) -> None:
    reached = clipped_scores(df, score, clip).first()[0]
    if reached:
        raise ValueError(f"the clip {clip:g} reaches {reached} scores")


def _newton_sums(
    df: DataFrame, z: str, y: str, params: Mapping[object, tuple[float, float]], where: Mapping[object, Column]
) -> DataFrame:
    """Gradient and curvature of the logistic loss, for every parameter set in one pass."""
    label = F.col(y).cast("double")
    aggregates = []
    for i, (key, (a, b)) in enumerate(params.items()):
        p = expit(F.col(z) * a + b)
        parts = {"g": p - label, "gz": (p - label) * F.col(z), "h": p * (1 - p)}
        parts["hz"], parts["hzz"] = parts["h"] * F.col(z), parts["h"] * F.col(z) * F.col(z)
        aggregates += [F.sum(F.when(where[key], v)).alias(f"{n}{i}") for n, v in parts.items()]
    return df.agg(*aggregates)


# Bins per unit of log-odds in the summary that starting values are fitted on.
START_BINS = 64


def _step(sums: tuple[float, ...]) -> tuple[float, float]:
    """Newton step of one fit from its gradient and curvature sums."""
    g, gz, h, hz, hzz = sums
    determinant = h * hzz - hz * hz
    if determinant <= 0:
        raise ValueError("the scores do not vary: the fit is singular")
    return (gz * h - g * hz) / determinant, (g * hzz - gz * hz) / determinant


def _start(summary: np.ndarray) -> tuple[float, float]:
    """Fit on binned scores `(rows, positives, mean log-odds)`: close, at no further pass."""
    n, y, z = summary.T
    if not 0 < y.sum() < n.sum():
        raise ValueError("a calibrator needs both classes")

    def loss(a: float, b: float) -> float:
        t = a * z + b
        return float((n * np.logaddexp(0, t) - y * t).sum())

    a, b = 0.0, float(np.log(y.sum() / (n.sum() - y.sum())))
    current = loss(a, b)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -700, 700)))
        w = n * p * (1 - p)
        g = n * p - y
        da, db = _step((g.sum(), (g * z).sum(), w.sum(), (w * z).sum(), (w * z * z).sum()))
        scale = 1.0
        # the loss is convex: a step is halved until it pays
        while scale > 1e-10 and loss(a - scale * da, b - scale * db) > current:
            scale /= 2
        a, b = a - scale * da, b - scale * db
        current = loss(a, b)
        if max(abs(da), abs(db)) < 1e-10:
            break
    return float(a), float(b)


def _fit_platt_sets(
    df: DataFrame, score: str, y: str, clip: float, where: Mapping[object, Column], steps: int = 25, tolerance: float = 1e-11
) -> dict[object, tuple[float, float]]:
    """Unpenalised two-parameter logistic fits, all stepped together.

    A summary of a few thousand log-odds bins gives starting values; then each exact Newton
    step is one aggregate of five sums per fit, and two or three of them are enough. Only
    bins and sums reach the driver, whatever the number of rows.
    """
    folds = ["fold"] if "fold" in df.columns else []
    prepared = df.select(logit(score, clip).alias("_z"), y, *folds).persist()
    try:
        binned = prepared.groupBy(*folds, F.floor(F.col("_z") * START_BINS).alias("_bin")).agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.col(y).cast("double")).alias("p"), F.avg("_z").alias("z")
        )
        flagged = binned.select(
            *[F.coalesce(c, F.lit(False)).alias(f"w{i}") for i, c in enumerate(where.values())], "n", "p", "z"
        ).toPandas()
        params = {}
        for i, key in enumerate(where):
            part = flagged.loc[flagged[f"w{i}"], ["n", "p", "z"]].to_numpy(dtype="float64")
            if not len(part):
                raise ValueError(f"no rows to fit on for {key!r}")
            params[key] = _start(part)
        for _ in range(steps):
            row = _newton_sums(prepared, "_z", y, params, where).first()
            moved, updated = 0.0, {}
            for i, (key, (a, b)) in enumerate(params.items()):
                da, db = _step(tuple(row[f"{n}{i}"] for n in ("g", "gz", "h", "hz", "hzz")))
                updated[key] = (a - da, b - db)
                moved = max(moved, abs(da) / max(1.0, abs(a)), abs(db) / max(1.0, abs(b)))
            params = updated
            if moved < tolerance:
                break
        else:
            raise ValueError("the fit did not converge")
    finally:
        prepared.unpersist()
    for key, (a, b) in params.items():
        if not (math.isfinite(a) and math.isfinite(b)) or a <= 0:
            raise ValueError(f"slope {a:.4g} for {key!r} would reverse the ranking")
    return params


def fit_platt(df: DataFrame, score: str = "score", y: str = "is_fraud", clip: float = SCORE_CLIP) -> tuple[float, float]:
    return _fit_platt_sets(df, score, y, clip, {"all": F.lit(True)})["all"]


def apply_platt(score: str, a: float | Column, b: float | Column, clip: float = SCORE_CLIP) -> Column:
    return expit(logit(score, clip) * a + b)


def _score_steps(df: DataFrame, score: str, y: str, keys: Sequence[str] = ()) -> DataFrame:
    """Rows and positives per distinct score: all that the monotone fit needs."""
    return df.groupBy(*keys, F.col(score).cast("double").alias("x")).agg(
        F.sum(F.col(y).cast("double")).alias("p"), F.count(F.lit(1)).cast("double").alias("w")
    )


def _usable_steps(df: DataFrame, score: str, y: str, keys: Sequence[str] = ()) -> DataFrame:
    """Steps of scores that are numbers; zeros are one score."""
    usable = df.where(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))
    plain = usable.withColumn(score, F.when(F.col(score) == 0, F.lit(0.0)).otherwise(F.col(score).cast("double")))
    return _score_steps(plain, score, y, keys)


def fit_isotonic(df: DataFrame, score: str = "score", y: str = "is_fraud") -> DataFrame:
    """Blocks of the monotone fit `(lo, hi, p, w)`, on rows collapsed to distinct scores first."""
    return monotone_blocks(_usable_steps(df, score, y))


def isotonic_table(blocks: DataFrame) -> DataFrame:
    """The fit as breakpoints `(score, probability)`."""
    return breakpoints(blocks).select(F.col("x").alias("score"), F.col("value").alias("probability"))


def apply_isotonic(df: DataFrame, score: str, table: tuple[Sequence[float], Sequence[float]] | DataFrame, out: str) -> DataFrame:
    """Linear between breakpoints; `table` holds a few of them, or is a fitted table of blocks."""
    if isinstance(table, DataFrame):
        return apply_blocks(df, score, table, out)
    return interpolate(df, score, table[0], table[1], out)


@dataclass(frozen=True)
class Platt:
    """Logistic curve on the log odds of the clipped score."""

    a: float
    b: float
    clip: float = SCORE_CLIP

    @classmethod
    def fit(cls, df: DataFrame, score: str = "score", y: str = "is_fraud", clip: float = SCORE_CLIP) -> Platt:
        return cls(*fit_platt(df, score, y, clip), clip)

    def apply(self, df: DataFrame, score: str, out: str) -> DataFrame:
        return df.withColumn(out, apply_platt(score, self.a, self.b, self.clip))


@dataclass(frozen=True)
class Isotonic:
    """Monotone curve, linear between its breakpoints: a few of them, or a fitted table of blocks."""

    breakpoints: tuple[tuple[float, ...], tuple[float, ...]] | DataFrame

    @classmethod
    def fit(cls, df: DataFrame, score: str = "score", y: str = "is_fraud", clip: float = SCORE_CLIP) -> Isotonic:
        return cls(fit_isotonic(df, score, y))

    def apply(self, df: DataFrame, score: str, out: str) -> DataFrame:
        return apply_isotonic(df, score, self.breakpoints, out)


# What a calibrator is chosen from by name; each class fits itself and applies what it fitted.
CALIBRATORS = {"platt": Platt, "isotonic": Isotonic}


def cross_fit(
    df: DataFrame, method: str, score: str = "score", y: str = "is_fraud", clip: float = SCORE_CLIP,
    out: str | None = None,
) -> DataFrame:
    """Every row scored by a calibrator fitted on the other folds only."""
    out = out or method
    folds = sorted(r[0] for r in df.select("fold").distinct().collect())
    if method == "platt":
        sets = _fit_platt_sets(df, score, y, clip, {k: F.col("fold") != k for k in folds})
        a = _per_fold({k: v[0] for k, v in sets.items()})
        b = _per_fold({k: v[1] for k, v in sets.items()})
        return df.withColumn(out, apply_platt(score, a, b, clip))
    if method != "isotonic":
        raise ValueError(f"unknown calibration method {method!r}; expected one of {METHODS}")
    # one pass collapses the rows of every fold; a score's steps are those of all folds but one
    own = F.map_from_entries(F.collect_list(F.struct("fold", F.struct("p", "w"))))
    steps = _usable_steps(df, score, y, ["fold"])
    by_score = steps.groupBy("x").agg(F.sum("p").alias("p"), F.sum("w").alias("w"), own.alias("own"))
    held = F.explode(F.array(*[F.lit(k) for k in folds])).alias("held")
    mine = F.try_element_at("own", F.col("held"))
    others = by_score.select("x", "p", "w", "own", held).select(
        F.col("held").cast(dict(df.dtypes)["fold"]).alias("fold"),
        "x",
        (F.col("p") - F.coalesce(mine["p"], F.lit(0.0))).alias("p"),
        (F.col("w") - F.coalesce(mine["w"], F.lit(0.0))).alias("w"),
    )
    return apply_blocks(df, score, monotone_blocks(others.where("w > 0"), ["fold"]), out, ["fold"])


def _per_fold(values: Mapping[int, float]) -> Column:
    chosen = F.lit(None).cast("double")
    for k, v in values.items():
        chosen = F.when(F.col("fold") == k, F.lit(v)).otherwise(chosen)
    return chosen


def select_method(platt: DataFrame, isotonic: DataFrame) -> DataFrame:
    """Isotonic only if its Brier score is lower in every fold; both must cover the same folds."""
    sides = platt.select("fold", F.col("brier").alias("_p")).join(
        isotonic.select("fold", F.col("brier").alias("_i")), "fold", "full_outer"
    )
    both = F.every(F.col("_p").isNotNull() & F.col("_i").isNotNull())
    better = F.every(F.coalesce(F.col("_i") < F.col("_p"), F.lit(False)))
    return sides.agg(
        F.when(~both, F.raise_error(F.lit("the methods cover different folds")).cast("string"))
        .when(better, "isotonic")
        .otherwise("platt")
        .alias("selected")
    )


def cross_fit_report(df: DataFrame, folds: int = 4, bins: int = 10, **kwargs) -> DataFrame:
    """Out-of-fold metrics of both methods and of the raw score, per fold."""
    label, score = kwargs.get("y", "is_fraud"), kwargs.get("score", "score")
    folded = assign_folds(df, folds).select("fold", label, score)
    for method in METHODS:
        folded = cross_fit(folded, method, **kwargs)
    scored = materialise(folded, "out-of-fold")
    long = scored.select(
        "fold",
        label,
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(name).alias("method"), F.col(c).alias("_p"))
                    for name, c in (("uncalibrated", score), *((m, m) for m in METHODS))
                ]
            )
        ),
    )
    return calibration_metrics(long, label, "_p", bins, ["method", "fold"])


def cost_arm(
    df: DataFrame, costs: Costs, capacity: float, method: str = "platt", folds: int = 4, score: str = "score",
    y: str = "is_fraud", amount: str = "amount", day_bound: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """An arm's scores calibrated out of fold and costed: `(decided rows with cost, summary)`."""
    check_clip(df, score)
    scored = cross_fit(assign_folds(df, folds), method, score, y, out="calibrated")
    decided = ev_policy(scored, costs, capacity, "calibrated", amount, day_bound=day_bound)
    decided = decided.withColumn("cost", policy_cost(costs, y, amount))
    return decided, policy_summary(decided, costs, y, amount)
