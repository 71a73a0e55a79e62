"""Stability indices of every column in every window."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.config import MISSING, OTHER, Costs, MonitoringConfig
from riskframe.functions import scalar as S
from riskframe.functions.lookup import edge_position, null_safe_join
from riskframe.operators.cost import policy_rates
from riskframe.operators.ranking import rank_desc
from riskframe.plans.gates import unless
from riskframe.plans.ordering import column_quantiles, quantiles
from riskframe.plans.sizing import bounded, measured


# ---- windows -------------------------------------------------------------------------------


def window_index(df: DataFrame, width: int, anchor: int, day: str = "day", out: str = "window", strict: bool = True) -> DataFrame:
    """Fixed-width day windows counted from an anchor; days before it are refused."""
    if width < 1:
        raise ValueError(f"windows must be at least a day wide, got {width}")
    d = F.col(day)
    index = F.floor((d - F.lit(anchor)) / F.lit(width)).cast("int")
    if not strict:
        return df.withColumn(out, index)
    checked = (
        F.when(d.isNull(), F.raise_error(F.lit("a row has no day")).cast("int"))
        .when(d < anchor, F.raise_error(F.lit(f"a day lies before the anchor {anchor}")).cast("int"))
        .otherwise(index)
    )
    return df.withColumn(out, checked)


def describe_windows(df: DataFrame, width: int, anchor: int, day: str = "day") -> DataFrame:
    """First and last day, span, rows and partiality of every window up to the last day seen.

    A window is partial when data ends before it does; empty windows are listed with no rows.
    """
    per_day = df.groupBy(day).agg(F.count(F.lit(1)).alias("n"))
    last = per_day.agg(F.max(day).alias("hi"), F.sum("n").alias("n"))
    frame = last.select(
        F.explode(F.sequence(F.lit(0), F.floor((F.col("hi") - anchor) / width).cast("int"))).alias("window"), "hi"
    )
    rows = window_index(per_day, width, anchor, day).groupBy("window").agg(F.sum("n").alias("n"))
    first = F.col("window") * width + anchor
    end = F.least(first + (width - 1), F.col("hi"))
    return frame.join(rows, "window", "left").select(
        "window",
        first.cast("int").alias("first_day"),
        end.cast("int").alias("last_day"),
        (end - first + 1).cast("int").alias("days"),
        F.coalesce("n", F.lit(0)).alias("rows"),
        (end - first + 1 < width).alias("partial"),
    )


# ---- bins ------------------------------------------------------------------------------------


@dataclass(frozen=True)
class ReferenceBins:
    """Cut points of numeric columns and vocabularies of categorical ones."""

    edges: Mapping[str, tuple[float, ...]]
    levels: Mapping[str, tuple[str, ...]]

    def __post_init__(self) -> None:
        both = set(self.edges) & set(self.levels)
        if both:
            raise ValueError(f"columns binned twice: {sorted(both)}")
        for c, levels in self.levels.items():
            if MISSING not in levels or OTHER not in levels:
                raise ValueError(f"the vocabulary of {c!r} lacks its sentinels")

    @property
    def columns(self) -> list[str]:
        return [*self.edges, *self.levels]

    def sizes(self) -> dict[str, int]:
        return {
            **{c: len(e) + 2 for c, e in self.edges.items()},
            **{c: len(v) for c, v in self.levels.items()},
        }


def quantile_edges(df: DataFrame, columns: Sequence[str], bins: int) -> dict[str, tuple[float, ...]]:
    """Empirical quantile cut points per column, ties merged; each one a value the column holds."""
    if bins < 1:
        raise ValueError(f"need at least one bin, got {bins}")
    infinite = df.agg(*[F.count_if(F.abs(F.col(c).cast("double")) == float("inf")).alias(c) for c in columns]).first()
    found = [c for c in columns if infinite[c]]
    if found:
        raise ValueError(f"infinite values have no quantiles: {found}")
    if bins == 1:
        return {c: () for c in columns}
    table: dict[str, set] = {c: set() for c in columns}
    for r in column_quantiles(df, columns, bins=bins).collect():
        table[r["column"]].add(r["value"])
    return {c: tuple(sorted(v)) for c, v in table.items()}


def reference_bins(
    reference: DataFrame, numeric: Sequence[str], vocabulary: Mapping[str, Sequence[str]], bins: int
) -> ReferenceBins:
    return ReferenceBins(
        quantile_edges(reference, numeric, bins) if numeric else {},
        {c: tuple(v) for c, v in vocabulary.items()},
    )


def binned_cells(df: DataFrame, bins: ReferenceBins, keys: Sequence[str] = ()) -> DataFrame:
    """`(keys…, column, bin)`: numeric bins closed on the right with the missing bin last;
    a categorical value is its position in the vocabulary, null for an unrouted one."""
    cells = []
    for c, edges in bins.edges.items():
        position = F.coalesce(edge_position(c, edges, "left"), F.lit(len(edges) + 1))
        cells.append(F.struct(F.lit(c).alias("column"), position.cast("int").alias("bin")))
    for c, levels in bins.levels.items():
        code = S.map_lookup(c, {v: i for i, v in enumerate(levels)})
        cells.append(F.struct(F.lit(c).alias("column"), code.cast("int").alias("bin")))
    return df.select(*keys, F.inline(F.array(*cells)))


def bin_counts(df: DataFrame, bins: ReferenceBins, keys: Sequence[str] = ()) -> DataFrame:
    """Counts per `(keys…, column, bin)` with empty bins kept at zero.

    One aggregate over unpivoted bin numbers; the full bin list is attached per key. A value that
    was not routed through its vocabulary ends the job.
    """
    counts = binned_cells(df, bins, keys).groupBy(*keys, "column", "bin").agg(F.count(F.lit(1)).alias("n"))
    told = F.concat("column", F.lit(" holds a value that was not routed through its vocabulary"))
    counts = counts.where(unless(F.col("bin").isNull(), told))
    packed = counts.groupBy(*keys, "column").agg(
        F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("_m")
    )
    sizes = S.literal_map(bins.sizes())
    all_bins = F.sequence(F.lit(0), F.element_at(sizes, F.col("column")) - 1)
    return packed.select(*keys, "column", "_m", F.explode(all_bins).alias("bin")).select(
        *keys, "column", "bin", F.coalesce(F.try_element_at("_m", F.col("bin")), F.lit(0)).alias("n")
    )


def numeric_counts(df: DataFrame, c: str, edges: Sequence[float]) -> DataFrame:
    return bin_counts(df, ReferenceBins({c: tuple(edges)}, {})).select("bin", "n")


def categorical_counts(df: DataFrame, c: str, levels: Sequence[str]) -> DataFrame:
    return bin_counts(df, ReferenceBins({}, {c: tuple(levels)})).select("bin", "n")


# ---- indices ----------------------------------------------------------------------------------


def psi(reference: DataFrame, window: DataFrame, epsilon: float, keys: Sequence[str] = (), column: str = "column") -> DataFrame:
    """Stability index per `(keys…, column)` of window counts against reference counts.

    Epsilon is added to both shares of every bin and nothing is renormalised.
    """
    if epsilon <= 0:
        raise ValueError(f"epsilon must be positive, got {epsilon}")
    ref_total = reference.groupBy(column).agg(F.sum("n").alias("_e_total"))
    expected = reference.join(ref_total, column).select(
        column, "bin", (F.col("n") / F.col("_e_total") + epsilon).alias("_e")
    )
    total = window.groupBy(*keys, column).agg(F.sum("n").alias("_a_total"))
    actual = null_safe_join(window, total, [*keys, column]).select(
        *keys, column, "bin", (F.try_divide(F.col("n").cast("double"), F.col("_a_total")) + epsilon).alias("_a")
    )
    joined = actual.join(expected, [column, "bin"])
    return joined.groupBy(*keys, column).agg(
        F.sum((F.col("_a") - F.col("_e")) * F.ln(F.col("_a") / F.col("_e"))).alias("psi")
    )


def column_psi(reference: DataFrame, df: DataFrame, bins: ReferenceBins, epsilon: float, window: str = "window") -> DataFrame:
    """Index, missing and unseen shares and populated bins of every column in every window."""
    sizes, kinds = bins.sizes(), {**{c: "numeric" for c in bins.edges}, **{c: "categorical" for c in bins.levels}}
    missing_at = {
        **{c: len(e) + 1 for c, e in bins.edges.items()},
        **{c: v.index(MISSING) for c, v in bins.levels.items()},
    }
    other_at = {c: v.index(OTHER) for c, v in bins.levels.items()}
    expected = bin_counts(reference, bins).withColumnRenamed("n", "e")
    expected_total = expected.groupBy("column").agg(F.sum("e").alias("e_total"))
    reference_side = bounded(
        expected.join(expected_total, "column"), sum(sizes.values())
    )
    counts = bin_counts(df, bins, [window])
    joined = counts.join(reference_side, ["column", "bin"])
    is_missing = F.col("bin") == F.element_at(S.literal_map(missing_at), F.col("column"))
    is_other = F.col("bin") == S.map_lookup("column", other_at) if other_at else F.lit(False)
    value_bin = F.when(F.element_at(S.literal_map(kinds), F.col("column")) == "numeric", ~is_missing).otherwise(True)
    sums = joined.groupBy(window, "column").agg(
        F.collect_list(F.struct("n", "e")).alias("bins"),
        F.sum("n").alias("n"),
        F.max("e_total").alias("e_total"),
        F.sum(F.when(is_missing, F.col("n")).otherwise(0)).alias("n_missing"),
        F.sum(F.when(is_missing, F.col("e")).otherwise(0)).alias("e_missing"),
        F.sum(F.when(is_other, F.col("n"))).alias("n_other"),
        F.sum(F.when(is_other, F.col("e"))).alias("e_other"),
        F.count_if(value_bin & (F.col("e") > 0)).alias("value_bins"),
    )

    # a column has a dozen bins, or a vocabulary's worth: the list is bounded by the bin table
    def term(acc, b):
        a = b["n"] / F.col("n") + epsilon
        e = b["e"] / F.col("e_total") + epsilon
        return acc + (a - e) * F.ln(a / e)

    return sums.select(
        window,
        "column",
        F.element_at(S.literal_map(kinds), F.col("column")).alias("kind"),
        F.aggregate("bins", F.lit(0.0), term).alias("psi"),
        "value_bins",
        (F.col("e_missing") / F.col("e_total")).alias("missing_share_reference"),
        (F.col("n_missing") / F.col("n")).alias("missing_share"),
        (F.col("e_other") / F.col("e_total")).alias("unseen_share_reference"),
        (F.col("n_other") / F.col("n")).alias("unseen_share"),
    )


def contribution_weights(ranking: DataFrame, supported: Sequence[str], top_k: int) -> list[tuple[str, float]]:
    """The leading supported columns and their renormalised weights."""
    rows = (
        ranking.where(F.col("feature").isin(*supported))
        .orderBy(F.col("mean_abs").desc(), "feature")
        .limit(top_k)
        .collect()
    )
    total = sum(r["mean_abs"] for r in rows)
    return [(r["feature"], r["mean_abs"] / total) for r in rows]


def weighted_psi(table: DataFrame, weights: Sequence[tuple[str, float]], config: MonitoringConfig, window: str = "window") -> DataFrame:
    """Weighted index per window with its band, and how many columns fall in each band."""
    w = S.map_lookup("column", dict(weights))
    named = S.band("psi", config.moderate, config.significant)
    out = table.withColumn("_band", named).groupBy(window).agg(
        F.sum(F.col("psi") * w).alias("weighted_psi"),
        *[F.count_if(F.col("_band") == b).alias(f"columns_{b}") for b in ("stable", "moderate", "significant")],
    )
    return out.withColumn("weighted_band", S.band("weighted_psi", config.moderate, config.significant))


def leading_columns(table: DataFrame, ranking: DataFrame, config: MonitoringConfig, window: str = "window") -> DataFrame:
    """Indices of the highest-ranked columns, in rank order, for the report."""
    lead = contribution_weights(ranking, [r[0] for r in table.select("column").distinct().collect()], config.report_top)
    place = {c: i for i, (c, _) in enumerate(lead)}
    return table.where(F.col("column").isin(*place)).select(
        window,
        S.map_lookup("column", place).alias("place"),
        "column",
        "psi",
        S.band("psi", config.moderate, config.significant).alias("band"),
    )


def score_views(
    df: DataFrame, reference: DataFrame, costs: Costs, capacity: float, config: MonitoringConfig, score: str = "score",
    stratum: str = "has_identity", window: str = "window", day_bound: int | None = None,
) -> DataFrame:
    """Score index, percentiles, mean, stratum share and policy rates of every window."""
    edges = quantile_edges(reference, [score], config.bins)
    bins = ReferenceBins(edges, {})
    index = psi(bin_counts(reference, bins), bin_counts(df, bins, [window]), config.epsilon, [window])
    spread = quantiles(df, score, [0.5, 0.9, 0.99], [window])
    wide = spread.groupBy(window).agg(
        *[F.max(F.when(F.col("prob") == p, F.col("value"))).alias(f"p{round(100 * p)}") for p in (0.5, 0.9, 0.99)]
    )
    means = df.groupBy(window).agg(
        F.avg(score).alias("mean_score"), F.avg(F.col(stratum).cast("double")).alias("stratum_share")
    )
    rates = policy_rates(df, costs, capacity, score, groups=[window], day_bound=day_bound)
    out = index.select(window, F.col("psi").alias("score_psi"))
    for part in (wide, means, rates):
        out = null_safe_join(out, part, [window])
    return out


def leads_decay(weighted: DataFrame, decay: DataFrame, baseline_pr_auc: float) -> DataFrame:
    """Rank correlation of drift and shortfall over full windows, and the drift rank of each
    flagged window. The table has one row per window."""
    joined = weighted.join(
        decay.where(~F.col("partial")).select("window", "pr_auc", "reading"), "window"
    ).withColumn("shortfall", F.lit(baseline_pr_auc) - F.col("pr_auc"))
    ranked = rank_desc(rank_desc(joined, "weighted_psi", "_rx"), "shortfall", "_ry")
    ranked = measured(ranked)
    rho = ranked.agg(F.corr("_rx", "_ry")).scalar()
    return ranked.select(
        "window",
        "reading",
        F.col("_rx").cast("int").alias("psi_rank"),
        (F.col("reading") != "no decline").alias("flagged"),
        rho.alias("spearman"),
    )


__all__ = [
    "ReferenceBins",
    "bin_counts",
    "binned_cells",
    "categorical_counts",
    "column_psi",
    "contribution_weights",
    "describe_windows",
    "leading_columns",
    "leads_decay",
    "numeric_counts",
    "psi",
    "quantile_edges",
    "reference_bins",
    "score_views",
    "weighted_psi",
    "window_index",
]
