"""Additive contributions, their ranking, and reason codes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.config import BASE_VALUE, BLOCK, Costs
from riskframe.functions import scalar as S
from riskframe.functions.lookup import edge_position, null_safe_join
from riskframe.operators.cost import allow_or_block, break_even, review_gain
from riskframe.plans.ordering import quantiles
from riskframe.plans.selection import values_at_ranks
from riskframe.plans.sizing import measured

# Fixed value: largest relative deviation of summed contributions from the margin.
ADDITIVITY_TOLERANCE = 1e-2


def linear_contributions(df: DataFrame, coefficients: Mapping[str, float], means: Mapping[str, float], intercept: float, prefix: str = "c_") -> DataFrame:
    """Log-odds contribution per feature of a linear model, centred so that the base value is
    the margin of the average row."""
    base = intercept + sum(coefficients[c] * means.get(c, 0.0) for c in coefficients)
    built = {
        f"{prefix}{c}": F.lit(b) * (F.col(c).cast("double") - F.lit(means.get(c, 0.0)))
        for c, b in coefficients.items()
    }
    return df.withColumns({**built, BASE_VALUE: F.lit(base)})


def additivity(df: DataFrame, columns: Sequence[str], margin: str) -> DataFrame:
    """Worst relative deviation of the contributions from the margin, and the base value's range."""
    total = sum((F.col(c) for c in columns), F.col(BASE_VALUE))
    mass = sum((F.abs(F.col(c)) for c in columns), F.abs(F.col(BASE_VALUE)))
    return df.agg(
        F.max(F.try_divide(F.abs(total - F.col(margin)), mass)).alias("deviation"),
        F.min(BASE_VALUE).alias("base_low"),
        F.max(BASE_VALUE).alias("base_high"),
    )


def check_additive(df: DataFrame, columns: Sequence[str], margin: str) -> float:
    row = additivity(df, columns, margin).first()
    if row["base_low"] != row["base_high"]:
        raise ValueError("the base value is not constant; a feature stands in its place")
    if row["deviation"] > ADDITIVITY_TOLERANCE:
        raise ValueError(f"contributions miss the margin by {row['deviation']:.3e}")
    return row["deviation"]


def ranking(df: DataFrame, columns: Sequence[str], tiers: Mapping[str, str], prefix: str = "") -> DataFrame:
    """Mean absolute and mean signed contribution per feature, with its tier."""
    absent = [c for c in columns if c not in tiers]
    if absent:
        raise ValueError(f"features in no tier: {absent}")
    row = df.agg(
        *[
            F.struct(
                F.lit(c).alias("feature"),
                F.lit(tiers[c]).alias("tier"),
                F.avg(F.abs(F.col(prefix + c))).alias("mean_abs"),
                F.avg(prefix + c).alias("mean_signed"),
            ).alias(f"c{i}")
            for i, c in enumerate(columns)
        ]
    )
    return row.select(F.inline(F.array(*[f"c{i}" for i in range(len(columns))])))


def tier_shares(ranked: DataFrame) -> DataFrame:
    """Share of the total mean absolute contribution per tier."""
    total = ranked.agg(F.sum("mean_abs")).scalar()
    return ranked.groupBy("tier").agg(F.sum("mean_abs").alias("mass")).select(
        "tier", (F.col("mass") / total).alias("share")
    )


def take_sample(df: DataFrame, rows: int, seed: int, id_: str = "id") -> DataFrame:
    """A fixed-size sample without replacement, the same for any partitioning of the input.

    Ids are ordered by the MD5 of `seed/id`; the cut-off hash is an order statistic, so no row is
    sorted globally.
    """
    hashed = df.withColumn("_h", F.md5(F.concat_ws("/", F.lit(str(seed)), F.col(id_).cast("string"))))
    cut = values_at_ranks(hashed, "_h", lambda _: F.array(F.struct(F.lit(rows - 1).alias("rank"))))
    last = cut.select("value").scalar()
    return hashed.where(F.coalesce(F.col("_h") <= last, F.lit(True))).drop("_h")


# ---- reason codes ------------------------------------------------------------------------------

# The two generic sentences of an unnamed reason.
GENERIC_ONE = (
    "a pre-computed risk indicator supplied with the transaction data, whose definition the "
    "data provider does not publish"
)
GENERIC_MANY = (
    "several pre-computed risk indicators supplied with the transaction data, whose definitions "
    "the data provider does not publish"
)


def top_reasons(columns: Sequence[str], k: int, phrases: Mapping[str, str], prefix: str = "") -> Column:
    """The k largest positive contributors of a row as `array<struct>`; no shuffle."""
    cells = F.array(
        *[
            F.struct(
                (-F.col(prefix + c)).alias("neg"),
                F.lit(i).alias("place"),
                F.lit(c).alias("feature"),
                F.col(prefix + c).alias("contribution"),
                F.lit(phrases.get(c, GENERIC_ONE)).alias("phrase"),
                F.lit(c in phrases).alias("named"),
            )
            for i, c in enumerate(columns)
        ]
    )
    positive = F.filter(cells, lambda x: x["contribution"] > 0)
    ordered = F.slice(F.array_sort(positive), 1, k)
    return F.transform(
        ordered,
        lambda x: F.struct(
            x["feature"].alias("feature"),
            x["contribution"].alias("contribution"),
            x["phrase"].alias("phrase"),
            x["named"].alias("named"),
        ),
    )


def statements(reasons: Column) -> Column:
    """Sentences of a row's reasons: unnamed ones collapse to one line, where the first stood."""
    unnamed = F.size(F.filter(reasons, lambda r: ~r["named"]))
    generic = F.when(unnamed > 1, F.lit(GENERIC_MANY)).otherwise(F.lit(GENERIC_ONE))
    first_unnamed = F.array_position(F.transform(reasons, lambda r: r["named"]), F.lit(False))
    lines = F.transform(
        reasons,
        lambda r, i: F.when(r["named"], r["phrase"]).when(i + 1 == first_unnamed, generic),
    )
    return F.array_compact(lines)


def reason_codes(
    df: DataFrame, columns: Sequence[str], phrases: Mapping[str, str], costs: Costs, k: int = 3, p: str = "p",
    amount: str = "amount", prefix: str = "",
) -> DataFrame:
    """Decision, bar, eligibility and ranked reasons of every row."""
    action = allow_or_block(p, amount, costs)
    return df.withColumns(
        {
            "decision": action,
            "adverse": action == BLOCK,
            "review_eligible": review_gain(p, amount, costs) > 0,
            "break_even": break_even(amount, costs),
            "reasons": top_reasons(columns, k, phrases, prefix),
            "cost_version": F.lit(costs.version),
        }
    ).withColumn("statements", statements(F.col("reasons")))


def summarise_reasons(coded: DataFrame) -> DataFrame:
    """How well declines can be explained: leading reason unnameable, fully generic, any named."""
    some = F.size("reasons") > 0
    any_named = F.exists("reasons", lambda r: r["named"])
    lead = ~F.col("reasons")[0]["named"]
    return coded.where("adverse").agg(
        F.count(F.lit(1)).alias("declines"),
        F.avg(F.when(some, lead.cast("double"))).alias("leading_reason_unnameable"),
        F.avg((some & ~any_named).cast("double")).alias("fully_generic"),
        F.avg(any_named.cast("double")).alias("at_least_one_named"),
    )


def reason_tiers(coded: DataFrame, tiers: Mapping[str, str]) -> DataFrame:
    """Share of every given reason by tier, over declines."""
    each = coded.where("adverse").select(F.explode("reasons.feature").alias("feature"))
    counted = each.groupBy(S.map_lookup("feature", tiers).alias("tier")).agg(F.count(F.lit(1)).alias("n"))
    total = counted.agg(F.sum("n")).scalar()
    return counted.select("tier", (F.col("n") / total).alias("share"))


def select_cases(decided: DataFrame, label: str = "is_fraud", amount: str = "amount", id_: str = "id") -> DataFrame:
    """Blocked rows that illustrate a case: the fraud and the legitimate row nearest the median
    amount of their kind, and the largest fraud."""
    blocked = decided.where(F.col("fallback") == BLOCK)
    kind = F.when(F.col(label).cast("int") == 1, "true_positive").otherwise("false_positive")
    kinds = blocked.select(id_, F.col(amount).alias("_a"), kind.alias("case_name"))
    medians = quantiles(kinds, "_a", [0.5], ["case_name"]).select("case_name", F.col("value").alias("_m"))
    near = null_safe_join(kinds, medians, ["case_name"]).groupBy("case_name").agg(
        F.min_by(id_, F.struct(F.abs(F.col("_a") - F.col("_m")), F.col(id_))).alias(id_)
    )
    largest = kinds.where(F.col("case_name") == "true_positive").agg(
        F.max_by(id_, F.struct(F.col("_a"), -F.col(id_))).alias(id_)
    )
    return near.unionByName(
        largest.where(F.col(id_).isNotNull()).select(F.lit("high_value_catch").alias("case_name"), id_)
    )


def binned_median(df: DataFrame, x: str, y: str, bins: int, by: str | None = None) -> DataFrame:
    """Medians of both axes inside quantile bins of x, per level of `by` if given."""
    probs = [i / bins for i in range(bins + 1)]
    keys = [by] if by else []
    present = df.where(F.col(x).isNotNull())
    if by:
        edges = measured(
            quantiles(present, x, probs, keys).groupBy(*keys).agg(F.array_sort(F.collect_set("value")).alias("_e"))
        )
        placed = null_safe_join(present, edges, keys)
        at = F.size(F.filter("_e", lambda e: e <= F.col(x)))
        last = F.greatest(F.size("_e") - 2, F.lit(0))
    else:
        found = sorted({r["value"] for r in quantiles(present, x, probs).collect()})
        placed = present.withColumn("_at", edge_position(x, found, "right"))
        at, last = F.col("_at"), F.lit(max(len(found) - 2, 0))
    binned = placed.withColumn("bin", F.greatest(F.lit(0), F.least(last, at - 1))).select(*keys, "bin", x, y)
    group = [*keys, "bin"]
    centre = quantiles(binned, x, [0.5], group).select(*group, F.col("value").alias("centre"))
    middle = quantiles(binned, y, [0.5], group).select(*group, F.col("value").alias("median"))
    return null_safe_join(centre, middle, group)


__all__ = [
    "additivity",
    "binned_median",
    "check_additive",
    "linear_contributions",
    "ranking",
    "reason_codes",
    "reason_tiers",
    "select_cases",
    "statements",
    "summarise_reasons",
    "take_sample",
    "tier_shares",
    "top_reasons",
]
