"""A points engine: rules as column expressions, constants fitted on train."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.config import RulesConfig
from riskframe.functions import scalar as S
from riskframe.functions.lookup import ecdf_position
from riskframe.plans.ordering import quantiles


@dataclass(frozen=True)
class RuleConstants:
    cuts: Mapping[str, float]
    grid: tuple[float, ...]
    config: RulesConfig

    def __post_init__(self) -> None:
        if len(self.grid) != self.config.ecdf_points or not self.grid:
            raise ValueError(f"the grid holds {len(self.grid)} points, not {self.config.ecdf_points}")
        # a NaN fails this comparison too
        if not all(a <= b for a, b in zip(self.grid, self.grid[1:])):
            raise ValueError("the amount grid is not sorted ascending")
        if not self.cuts:
            raise ValueError("no amount cut per product")

    def to_scalars(self) -> dict:
        return {"cuts": dict(self.cuts), "grid": list(self.grid)}

    @staticmethod
    def from_scalars(values: Mapping, config: RulesConfig) -> RuleConstants:
        missing = {"cuts", "grid"} - set(values)
        if missing:
            raise KeyError(f"constants are missing {sorted(missing)}")
        return RuleConstants(values["cuts"], tuple(values["grid"]), config)


@dataclass(frozen=True)
class Rule:
    """A named source of points; the provenance says whether it was hypothesised or searched."""

    name: str
    provenance: str
    rationale: str
    points: Callable[[RuleConstants], Column]

    def __post_init__(self) -> None:
        if self.provenance not in ("hypothesis", "search"):
            raise ValueError(f"unknown provenance {self.provenance!r}")


def binary_rule(
    name: str, weight: int, provenance: str, rationale: str, predicate: Callable[[RuleConstants], Column]
) -> Rule:
    """A rule worth `weight` when its predicate holds; a null predicate did not fire."""
    return Rule(
        name,
        provenance,
        rationale,
        lambda k: F.coalesce(predicate(k), F.lit(False)).cast("long") * weight,
    )


@dataclass(frozen=True)
class RuleColumns:
    amount: str = "amount"
    product: str = "product"
    new_card: str = "d1"
    match: str = "m4"


def default_rules(config: RulesConfig, columns: RuleColumns = RuleColumns()) -> tuple[Rule, ...]:
    amount, product = F.col(columns.amount), F.col(columns.product)
    return (
        binary_rule(
            "round_amount",
            config.round_weight,
            "hypothesis",
            "round figures inside a band are over-represented among frauds",
            # on the raw amount; the feature family decides roundness on thousandths
            lambda k: (amount % config.round_step == 0) & amount.between(config.round_min, config.round_max),
        ),
        Rule(
            "product_tier",
            "hypothesis",
            "the product separates risk by itself",
            lambda k: S.map_lookup(columns.product, config.tiers, 0).cast("long"),
        ),
        binary_rule(
            "amount_percentile",
            config.percentile_weight,
            "hypothesis",
            "fraud amounts run high within a product",
            lambda k: amount > S.map_lookup(columns.product, k.cuts),
        ),
        binary_rule(
            "new_card",
            config.new_card_weight,
            "search",
            "a card first seen days ago",
            lambda k: (F.col(columns.new_card) > 0) & (F.col(columns.new_card) <= config.new_card_max),
        ),
        binary_rule(
            "product_match",
            config.match_weight,
            "search",
            "a match level that matters within one product only",
            lambda k: (product == config.match_product) & (F.col(columns.match) == config.match_level),
        ),
    )


def fit_rules(train: DataFrame, config: RulesConfig, columns: RuleColumns = RuleColumns()) -> RuleConstants:
    """Per-product amount cut and the amount's quantile grid, from train alone."""
    absent = [c for c in (columns.amount, columns.product) if c not in train.columns]
    if absent:
        raise ValueError(f"train is missing {absent}")
    cuts = {
        r[columns.product]: r["value"]
        for r in quantiles(train, columns.amount, [config.quantile], [columns.product]).collect()
        if r[columns.product] is not None
    }
    grid = quantile_grid(train, columns.amount, config.ecdf_points)
    if not grid:
        raise ValueError("train is empty")
    return RuleConstants(cuts, tuple(grid), config)


def quantile_grid(df: DataFrame, c: str, points: int) -> list[float]:
    """Evenly spaced quantiles from minimum to maximum."""
    probs = [i / (points - 1) for i in range(points)]
    found = quantiles(df, c, probs).collect()
    return [r["value"] for r in sorted(found, key=lambda r: r["prob"])]


def contributions(df: DataFrame, rules: Sequence[Rule], constants: RuleConstants, prefix: str = "") -> DataFrame:
    """One integer column of points per rule."""
    if not rules:
        raise ValueError("no rules: every row would score zero")
    return df.withColumns({f"{prefix}{r.name}": r.points(constants) for r in rules})


def score(
    df: DataFrame,
    rules: Sequence[Rule],
    constants: RuleConstants,
    out: str = "rules_score",
    amount: str = "amount",
) -> DataFrame:
    """Total points plus the amount's position in the training grid, worth less than a point."""
    awarded = contributions(df, rules, constants, "_pt_")
    total = sum((F.col(f"_pt_{r.name}") for r in rules[1:]), F.col(f"_pt_{rules[0].name}"))
    placed = ecdf_position(awarded, amount, constants.grid, "_ecdf")
    return placed.withColumn(out, total + constants.config.tiebreaker * F.col("_ecdf")).drop(
        "_ecdf", *[f"_pt_{r.name}" for r in rules]
    )


# ---- evidence behind a rule ---------------------------------------------------------


def lift(df: DataFrame, predicates: Mapping[str, Column], label: str = "is_fraud", day: str = "day", amount: str = "amount") -> DataFrame:
    """Per predicate: rows, rows a day, rate, lift over the base rate, positive amount."""
    fired = {n: F.coalesce(p, F.lit(False)) for n, p in predicates.items()}
    y = F.col(label).cast("long")
    marked = df.withColumns({f"_f{i}": p.cast("long") for i, p in enumerate(fired.values())})
    per_day = marked.groupBy(day).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(y).alias("p"),
        *[F.sum(f"_f{i}").alias(f"n{i}") for i in range(len(fired))],
        *[F.sum(F.col(f"_f{i}") * y).alias(f"p{i}") for i in range(len(fired))],
        *[F.sum(F.col(f"_f{i}") * y * F.col(amount)).alias(f"a{i}") for i in range(len(fired))],
    )
    cells = F.array(
        *[
            F.struct(
                F.lit(name).alias("rule"),
                F.sum(f"n{i}").alias("rows"),
                F.sum(f"p{i}").alias("positives"),
                F.sum(f"a{i}").alias("positive_amount"),
            )
            for i, name in enumerate(fired)
        ]
    )
    whole = per_day.agg(
        F.count(F.lit(1)).alias("days"), F.sum("n").alias("n"), F.sum("p").alias("p"), cells.alias("cells")
    )
    rate = F.try_divide(F.col("positives").cast("double"), F.col("rows"))
    return whole.select("days", "n", "p", F.inline("cells")).select(
        "rule",
        "rows",
        (F.col("rows") / F.col("days")).alias("rows_per_day"),
        rate.alias("rate"),
        F.try_divide(rate, F.col("p") / F.col("n")).alias("lift"),
        "positive_amount",
    )


def stability(df: DataFrame, predicates: Mapping[str, Column], half_day: int, label: str = "is_fraud", day: str = "day") -> DataFrame:
    """Lift in each half of the days, the weaker half, and the weight it implies (half to even)."""
    fired = {n: F.coalesce(p, F.lit(False)) for n, p in predicates.items()}
    y = F.col(label).cast("double")
    sides = {"a": F.col(day) < half_day, "b": F.col(day) >= half_day, "full": F.lit(True)}
    # the two rates of each side are conditional means over one scan
    aggregates = []
    for s, side in sides.items():
        aggregates.append(F.avg(F.when(side, y)).alias(f"base_{s}"))
        aggregates += [F.avg(F.when(side & p, y)).alias(f"r_{s}_{i}") for i, p in enumerate(fired.values())]
    row = df.agg(*aggregates)
    cells = F.array(
        *[
            F.struct(
                F.lit(name).alias("rule"),
                *[F.try_divide(F.col(f"r_{s}_{i}"), F.col(f"base_{s}")).alias(f"lift_{s}") for s in sides],
            )
            for i, name in enumerate(fired)
        ]
    )
    weakest = F.when(F.col("lift_a") <= F.col("lift_b"), F.col("lift_a")).otherwise(F.col("lift_b"))
    return row.select(F.inline(cells)).withColumns(
        {"weakest_half": weakest, "implied_weight": F.bround(weakest, 0).cast("int")}
    )


def lift_bands(
    df: DataFrame,
    value: str,
    bands: Sequence[tuple[float, float]],
    within: str | None = None,
    label: str = "is_fraud",
) -> DataFrame:
    """Lift per closed band of a column, pooled and, if asked, within each level of another.

    Bands may overlap: a row becomes one row per band that holds it, which the bands bound.
    """
    tagged = F.array_compact(
        F.array(*[F.when(F.col(value).between(lo, hi), F.lit(i)) for i, (lo, hi) in enumerate(bands)])
    )
    y = F.col(label).cast("long")
    keys = [within] if within else []
    base = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("base_n"), F.sum(y).alias("base_p"))
    inside = (
        df.select(*keys, y.alias("_y"), F.explode(tagged).alias("band"))
        .groupBy(*keys, "band")
        .agg(F.count(F.lit(1)).alias("rows"), F.sum("_y").alias("positives"))
    )
    joined = (
        inside.join(base, keys)
        if keys
        else inside.withColumns(
            {"base_n": base.select("base_n").scalar(), "base_p": base.select("base_p").scalar()}
        )
    )
    edges = [F.struct(F.lit(float(lo)).alias("lo"), F.lit(float(hi)).alias("hi")) for lo, hi in bands]
    edge = F.element_at(F.array(*edges), F.col("band") + 1)
    rate = F.col("positives").cast("double") / F.col("rows")
    return joined.select(
        *keys,
        edge["lo"].alias("band_low"),
        edge["hi"].alias("band_high"),
        "rows",
        "positives",
        rate.alias("rate"),
        F.try_divide(rate, F.col("base_p") / F.col("base_n")).alias("lift"),
    )
