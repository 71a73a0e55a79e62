"""Order statistics and running sums over data of any size.

A plain ordered window over a whole table, or over one hot group, lands in one task. Single
ranks are found by radix selection (`plans.selection`). Running sums need every row in order, so
`prefix_sums` first measures its input in one pass (row count and approximate quantile cuts of
the order column) and cuts it into buckets at some of those quantiles, one for every 50,000 rows
or so. Sums per bucket are small enough to accumulate in one place, and exact work happens
inside a bucket only. There is no other way for small inputs: they have one bucket.

Nulls sort first and NaN last in ascending order, as in Spark. Texts are bucketed by their first
bytes after what they all share.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from math import ceil, isfinite
from os.path import commonprefix
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StringType

from riskframe.functions.lookup import bin_by_edges, null_safe_join
from riskframe.plans.selection import Targets, values_at_ranks

# Rows of a bucket, about; fewer buckets are made of less data.
ROWS_PER_BUCKET = 50_000
# Bytes of a text that fit a double exactly.
TEXT_BYTES = 6


def bucket_count(df: DataFrame) -> int:
    """Four buckets a shuffle partition, so that a bucket is well below a task's share."""
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(32, min(4096, 4 * partitions))


class Profile(NamedTuple):
    """What one pass over an order column says about how to process it: rows, bucket cuts, and
    the bytes that all its texts begin with."""

    rows: int
    edges: list[float]
    skip: int = 0


def _axis(df: DataFrame, order: str, skip: int = 0) -> Column:
    """The order column as a double that never decreases along it."""
    kind = df.schema[order].dataType
    if isinstance(kind, StringType):
        head = F.hex(F.substring(F.encode(order, "utf-8"), skip + 1, TEXT_BYTES))
        return F.conv(F.rpad(head, 2 * TEXT_BYTES, "0"), 16, 10).cast("double")
    if isinstance(kind, DateType):
        return F.unix_date(order).cast("double")
    return F.col(order).cast("double")


def _shared_bytes(df: DataFrame, order: str) -> int:
    if not isinstance(df.schema[order].dataType, StringType):
        return 0
    ends = df.agg(F.encode(F.min(order), "utf-8").alias("a"), F.encode(F.max(order), "utf-8").alias("b")).first()
    return len(commonprefix([bytes(ends["a"] or b""), bytes(ends["b"] or b"")]))


def _finite(x: Column) -> Column:
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def _thinned(edges: Sequence[float] | None, rows: int, buckets: int) -> list[float]:
    """Cuts that leave about `ROWS_PER_BUCKET` rows between them."""
    step = max(1, ceil(buckets * ROWS_PER_BUCKET / max(1, rows)))
    return sorted({e for e in (edges or [])[step - 1 :: step] if isfinite(e)})


def profile(df: DataFrame, order: str, buckets: int | None = None) -> Profile:
    """Row count and bucket cuts of an order column, in one aggregate (two for texts)."""
    n = buckets or bucket_count(df)
    probs = [i / n for i in range(1, n)]
    skip = _shared_bytes(df, order)
    row = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.percentile_approx(_finite(_axis(df, order, skip)), probs, 4 * n).alias("e"),
    ).first()
    return Profile(row["n"], _thinned(row["e"], row["n"], n), skip)


def _with_bucket(df: DataFrame, order: str, seen: Profile) -> DataFrame:
    """`_b`: null for nulls, one past the last bucket for NaN."""
    marked = bin_by_edges(df.withColumn("_x", _axis(df, order, seen.skip)), "_x", seen.edges, "right", "_b")
    last = F.lit(len(seen.edges) + 1)
    return marked.withColumn("_b", F.when(F.isnan("_x"), last).otherwise(F.col("_b"))).drop("_x")


def _scope(groups: Sequence[str]) -> list[Column]:
    # a constant stands for "all rows"; only bounded inputs and bucket totals get here ungrouped
    return [F.col(g) for g in groups] or [F.lit(0)]


def _direction(c: str, descending: bool) -> Column:
    return F.col(c).desc() if descending else F.col(c).asc()


def prefix_sums(
    df: DataFrame,
    order: str,
    values: Sequence[str],
    groups: Sequence[str] = (),
    descending: bool = False,
    measured_by: Profile | None = None,
) -> DataFrame:
    """Running totals of `values` along `order`, as `cum_<value>` and `total_<value>`.

    The order column must be unique inside a group (aggregate ties first). Every window over rows
    is confined to a `(group, bucket)` and bucket totals are accumulated apart. `measured_by` may be the profile of the rows `df` was aggregated from.
    """
    seen = measured_by or profile(df, order)
    marked = _with_bucket(df, order, seen)
    keys = [*groups, "_b"]
    inside = Window.partitionBy(*keys).orderBy(_direction(order, descending)).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    whole = Window.partitionBy(*_scope(groups))
    before = whole.orderBy(_direction("_b", descending)).rowsBetween(Window.unboundedPreceding, -1)
    totals = marked.groupBy(*keys).agg(*[F.sum(v).alias(f"_s_{v}") for v in values])
    offsets = totals.select(
        *keys,
        *[F.coalesce(F.sum(f"_s_{v}").over(before), F.lit(0)).alias(f"_o_{v}") for v in values],
        *[F.sum(f"_s_{v}").over(whole).alias(f"total_{v}") for v in values],
    )
    local = marked.withColumns({f"_l_{v}": F.sum(v).over(inside) for v in values})
    joined = null_safe_join(local, offsets, keys)
    return joined.withColumns(
        {f"cum_{v}": F.col(f"_l_{v}") + F.col(f"_o_{v}") for v in values}
    ).drop("_b", *[f"_l_{v}" for v in values], *[f"_o_{v}" for v in values])


def quantile_targets(probs: Sequence[float]) -> Targets:
    """Two neighbouring ranks per probability, for linear interpolation."""

    def build(totals: Mapping[str, Column]) -> Column:
        last = totals["n"] - 1

        def pair(prob: Column) -> Column:
            low = F.floor(prob * last)
            return F.transform(
                F.array(F.lit(0), F.lit(1)),
                lambda step: F.struct(
                    prob.alias("prob"), (prob * last - low).alias("frac"), step.alias("step"),
                    F.least(low + step, last).alias("rank"),
                ),
            )

        return F.flatten(F.transform(F.array(*[F.lit(float(p)) for p in probs]), pair))

    return build


def quantiles(
    df: DataFrame, order: str, probs: Sequence[float], groups: Sequence[str] = ()
) -> DataFrame:
    """Exact linear-interpolated quantiles `(groups…, prob, value)`, one row per probability."""
    present = df.where(F.col(order).isNotNull() & ~F.isnan(F.col(order).cast("double"))).select(*groups, order)
    found = values_at_ranks(present, order, quantile_targets(probs), groups)
    # float rows become double before the interpolation
    low = F.max(F.when(F.col("step") == 0, F.col("value").cast("double")))
    high = F.max(F.when(F.col("step") == 1, F.col("value").cast("double")))
    return found.groupBy(*groups, "prob").agg(
        (low + (high - low) * F.max("frac")).alias("value")
    )


def discrete_targets(bins: int) -> Targets:
    """The ranks of `discrete_quantiles`."""

    def build(totals: Mapping[str, Column]) -> Column:
        steps = F.sequence(F.lit(1), F.lit(bins - 1)) if bins > 1 else F.array().cast("array<int>")

        def place(k: Column) -> Column:
            return F.call_function("div", k * totals["n"] + (bins - 1), F.lit(bins)) - 1

        return F.transform(steps, lambda k: F.struct(k.alias("k"), place(k).alias("rank")))

    return build


def discrete_quantiles(df: DataFrame, order: str, bins: int, groups: Sequence[str] = ()) -> DataFrame:
    """Empirical quantiles `(groups…, k, value)`: the value at position `ceil(k·n / bins)`.

    Positions are integers throughout; a level such as 0.3 held as a float can land a row late.
    """
    found = values_at_ranks(df, order, discrete_targets(bins), groups)
    return found.select(*groups, "k", F.col("value").cast("double").alias("value"))


def long_columns(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Numeric columns as rows `(keys…, column, value)`, without a shuffle."""
    cells = F.array(
        *[
            F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value"))
            for c in columns
        ]
    )
    return df.select(*keys, F.inline(cells))


def column_quantiles(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float] | None = None, bins: int | None = None
) -> DataFrame:
    """Quantiles of many columns in one search, `(column, prob | k, value)`."""
    if (probs is None) == (bins is None):
        raise ValueError("give either probs or bins")
    cells = long_columns(df, columns).withColumnRenamed("value", "_cell").where(~F.isnan("_cell"))
    if probs is not None:
        return quantiles(cells, "_cell", probs, ["column"])
    return discrete_quantiles(cells, "_cell", bins, ["column"])
