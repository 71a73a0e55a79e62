"""Parameters: small driver-side values that become literals, column lists and bounds."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

import numpy as np

SPLITS = ("train", "val_fit", "val_cal", "test")
SECTIONS = ("train", "gap", "val_fit", "val_cal", "test")

# Sentinel levels and the three actions, spelled as the data contract spells them.
MISSING = "__missing__"
OTHER = "__other__"
GLOBAL = "__global__"
BASE_VALUE = "__base_value__"
ALLOW, BLOCK, REVIEW = "allow", "block", "review"

SECONDS_PER_DAY = 86_400


@dataclass(frozen=True)
class SplitBounds:
    """Day boundaries of the four splits; train ends `gap_days` before validation begins."""

    train_start: int
    gap_days: int
    val_fit_start: int
    val_cal_start: int
    test_start: int
    test_end: int

    def __post_init__(self) -> None:
        if self.gap_days < 0:
            raise ValueError(f"gap_days={self.gap_days} is negative: train would overlap val_fit")
        starts = (self.train_start, self.val_fit_start, self.val_cal_start, self.test_start)
        if any(a >= b for a, b in zip(starts, starts[1:])):
            raise ValueError(f"split starts must be strictly increasing, got {starts}")
        if self.test_end < self.test_start:
            raise ValueError(f"test_end={self.test_end} leaves the test split empty")
        if self.train_end < self.train_start:
            raise ValueError(f"gap_days={self.gap_days} leaves no training days")

    @property
    def train_end(self) -> int:
        return self.val_fit_start - self.gap_days - 1

    @property
    def ranges(self) -> dict[str, tuple[int, int]]:
        return {
            "train": (self.train_start, self.train_end),
            "val_fit": (self.val_fit_start, self.val_cal_start - 1),
            "val_cal": (self.val_cal_start, self.test_start - 1),
            "test": (self.test_start, self.test_end),
        }

    @property
    def days(self) -> int:
        return self.test_end - self.train_start + 1

    def with_window(self, train_start: int | None = None, gap_days: int | None = None) -> SplitBounds:
        """The same layout with the training window re-cut, for purge and recency arms."""
        return replace(
            self,
            train_start=self.train_start if train_start is None else train_start,
            gap_days=self.gap_days if gap_days is None else gap_days,
        )


# The published layout of the 182-day labelled file.
PUBLISHED_BOUNDS = SplitBounds(1, 30, 121, 141, 161, 182)


@dataclass(frozen=True)
class Costs:
    """Unit costs of the decision policy, in one currency."""

    chargeback_fee: float = 25.0
    false_positive: float = 15.0
    review: float = 1.5
    review_friction: float = 3.0
    version: int = 1

    def __post_init__(self) -> None:
        negative = [
            name
            for name in ("chargeback_fee", "false_positive", "review", "review_friction")
            if getattr(self, name) < 0
        ]
        if negative:
            raise ValueError(f"negative costs: {negative}")


@dataclass(frozen=True)
class Scenario:
    """One point of a cost sweep."""

    assumption: str
    value: float
    is_base: bool
    costs: Costs
    capacity: float


def sweep_scenarios(costs: Costs, capacity: float, grids: Mapping[str, Sequence[float]]) -> list[Scenario]:
    """Each assumption moved alone over its grid, with its base value always on the grid."""
    points = []
    for assumption, grid in grids.items():
        base = capacity if assumption == "review_capacity" else getattr(costs, assumption)
        for value in sorted({round(float(v), 10) for v in grid} | {float(base)}):
            moved = assumption == "review_capacity"
            points.append(
                Scenario(
                    assumption,
                    value,
                    value == base,
                    costs if moved else replace(costs, **{assumption: value}),
                    value if moved else capacity,
                )
            )
    return points


def default_grids() -> dict[str, list[float]]:
    # Ranges of the published sensitivity block.
    return {
        "false_positive": list(np.linspace(5.0, 100.0, 20)),
        "chargeback_fee": list(np.linspace(15.0, 100.0, 10)),
        "review_capacity": [0.005, 0.01, 0.02],
    }


@dataclass(frozen=True)
class RulesConfig:
    """Weights and thresholds of the points engine."""

    # Published weights and thresholds.
    round_step: float = 50.0
    round_min: float = 150.0
    round_max: float = 500.0
    round_weight: int = 2
    tiers: Mapping[str, int] = field(
        default_factory=lambda: {"C": 3, "S": 2, "H": 1, "R": 0, "W": 0}
    )
    quantile: float = 0.99
    percentile_weight: int = 1
    new_card_max: float = 3.0
    new_card_weight: int = 3
    match_product: str = "W"
    match_level: str = "M2"
    match_weight: int = 1
    tiebreaker: float = 0.5
    ecdf_points: int = 1001


@dataclass(frozen=True)
class MonitoringConfig:
    """Windows, bins, bands and the retraining trigger."""

    # Published monitoring settings.
    labelled_width: int = 5
    horizon_width: int = 28
    bins: int = 10
    epsilon: float = 1e-6
    moderate: float = 0.1
    significant: float = 0.25
    report_top: int = 20
    top_k: int = 10
    feature_band: str = "moderate"
    score_band: str = "significant"
    pr_auc_drop: float = 0.10
    cadence_days: int = 90

    def __post_init__(self) -> None:
        if self.epsilon <= 0:
            raise ValueError(f"epsilon must be positive, got {self.epsilon}")
        for name in (self.feature_band, self.score_band):
            if name not in ("moderate", "significant"):
                raise ValueError(f"{name!r} names no band; use moderate or significant")

    def limit(self, band: str) -> float:
        return {"moderate": self.moderate, "significant": self.significant}[band]


def feature_columns(columns: Sequence[str], deny: Sequence[str], drop: Sequence[str] = ()) -> list[str]:
    """Matrix columns minus the deny-list and any named drops; an absent drop is refused."""
    absent = sorted(set(drop) - set(columns))
    if absent:
        raise ValueError(f"cannot drop columns the matrix does not have: {absent}")
    return [c for c in columns if c not in set(deny) and c not in set(drop)]


def resolve_members(columns: Sequence[str], families: Mapping[str, Sequence[str]]) -> dict[str, str]:
    """Column -> family, with every column in exactly one family."""
    placed: dict[str, str] = {}
    for family, members in families.items():
        for column in members:
            if column in placed:
                raise ValueError(f"{column!r} sits in {placed[column]!r} and {family!r}")
            placed[column] = family
    missing = sorted(set(columns) - set(placed))
    if missing:
        raise ValueError(f"columns in no family: {missing}")
    return {c: placed[c] for c in columns}


def check_reason_dictionary(phrases: Mapping[str, str], columns: Sequence[str], nameable: Sequence[str]) -> None:
    """Every nameable column has a phrase, and no phrase names a column the model lacks."""
    missing = sorted(set(nameable) - set(phrases))
    stray = sorted(set(phrases) - set(columns))
    if missing or stray:
        raise ValueError(f"reason dictionary: no phrase for {missing}, stray phrases for {stray}")


def metric_name(metric: str, fraction: float) -> str:
    """A metric at a fraction, named in basis points: recall at 0.01 is `recall_100bp`."""
    points = fraction * 10_000
    if abs(points - round(points)) > 1e-6:
        raise ValueError(f"{fraction} is not a whole number of basis points")
    return f"{metric}_{round(points)}bp"
