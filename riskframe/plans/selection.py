"""Values at given ranks, by radix selection.

Every value has a 63-bit code that never decreases along the order. One scan counts rows by the
high bits of their codes, and a rank falls in one of these counts; a second scan counts by value the
rows of those buckets only. All groups and ranks go together, and sums ahead of a rank come along.
What is put in order is a table of counts: the buckets of a group, or the values of one bucket.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from os.path import commonprefix

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StringType

from riskframe.plans.sizing import bounded

# `(totals) -> array<struct<rank, labels…>>`: totals are columns by name, n the ranked rows of a group.
Targets = Callable[[Mapping[str, Column]], Column]

# Bits of the mantissa in the code of a number, and those left out of a bucket: 4,096 buckets for
# each power of two.
MANTISSA, NUMBER_SHIFT = 51, 39
# Bytes of a text in its code, and bits left out of a bucket: two bytes are kept.
TEXT_BYTES, TEXT_SHIFT = 7, 40


def _coded(df: DataFrame, x: str) -> DataFrame:
    """`df` with `_at`, the bucket of column `x`. Built in steps: each is a column, computed once."""
    kind = df.schema[x].dataType
    if isinstance(kind, StringType):
        ends = df.agg(F.encode(F.min(x), "utf-8").alias("a"), F.encode(F.max(x), "utf-8").alias("b")).first()
        skip = len(commonprefix([bytes(ends["a"] or b""), bytes(ends["b"] or b"")]))
        head = F.hex(F.substring(F.encode(x, "utf-8"), skip + 1, TEXT_BYTES))
        return df.withColumn("_at", F.shiftright(F.conv(F.rpad(head, 2 * TEXT_BYTES, "0"), 16, 10).cast("long"), TEXT_SHIFT))
    axis = (F.unix_date(x) if isinstance(kind, DateType) else F.col(x)).cast("double")
    return number_bucket(df.withColumn("_x", axis), "_x", "_at").drop("_x")


def number_bucket(df: DataFrame, x: str, out: str) -> DataFrame:
    """The high bits of a code that never decreases with a double: sign, power of two, mantissa;
    zeros are one, and NaN is last."""
    one = float(1 << MANTISSA)
    sized = df.withColumn("_size", F.abs(x)).withColumn("_guess", F.floor(F.log2("_size")).cast("double"))
    low, high = F.pow(F.lit(2.0), F.col("_guess")) > F.col("_size"), F.pow(F.lit(2.0), F.col("_guess") + 1) <= F.col("_size")
    sized = sized.withColumn("_guess", F.col("_guess") - low.cast("double") + high.cast("double"))
    fraction = F.col("_size") / F.pow(F.lit(2.0), F.col("_guess")) - 1
    code = ((F.col("_guess") + 1076) * one).cast("long") + F.floor(fraction * one)
    largest = F.lit(2102 << MANTISSA)
    sized = sized.withColumn("_size", F.when(F.col("_size") == float("inf"), largest).otherwise(code))
    signed = F.when(F.isnan(x), F.lit(2103 << MANTISSA)).when(F.col(x) == 0, F.lit(0)).when(F.col(x) > 0, F.col("_size"))
    return sized.withColumn(out, F.shiftright(signed.otherwise(-F.col("_size")), NUMBER_SHIFT)).drop("_size", "_guess")


def _all(keys: Sequence[str]):
    # a constant stands for "all": only tables of counts get here ungrouped
    return Window.partitionBy(*([F.col(k) for k in keys] or [F.lit(0)]))


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which nulls are equal; the left side's keys are kept."""
    other = right.select(*[F.col(c).alias(f"__{c}" if c in keys else c) for c in right.columns])
    on = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    joined = left.join(other, on, how)
    return joined if how == "left_semi" else joined.drop(*[f"__{k}" for k in keys])


class Selection:
    """Rows counted once along `order`, ready to look up ranks.

    Rows whose order is null, or which are not `eligible`, have no rank but count for `rows` and for
    `sums`, a mapping of names to columns.
    """

    def __init__(
        self, df: DataFrame, order: str, groups: Sequence[str] = (), descending: bool = False,
        eligible: Column | None = None, sums: Mapping[str, Column] | None = None,
    ) -> None:
        taken = sorted(set(groups) & {"value", "before", "tied", "rank", "n", "rows"})
        if taken:
            raise ValueError(f"group columns clash with the result's own columns: {taken}")
        self.groups, self.descending, self.sums = list(groups), descending, list(sums or {})
        ranked = F.col(order).isNotNull() if eligible is None else F.coalesce(eligible, F.lit(False)) & F.col(order).isNotNull()
        plain = df.select(*groups, F.when(ranked, F.col(order)).alias("_v"), *[c.alias(f"_s_{s}") for s, c in (sums or {}).items()])
        self.rows = _coded(plain, "_v")
        counts = self.rows.groupBy(*groups, "_at").agg(F.count(F.lit(1)).alias("_n"), *self._summed())
        whole, ahead = _all(groups), self._ahead("_at", groups)
        self.totals = {
            "n": F.sum(F.when(F.col("_at").isNotNull(), F.col("_n"))).over(whole),
            "rows": F.sum("_n").over(whole),
            **{s: F.sum(f"_s_{s}").over(whole) for s in self.sums},
        }
        self.spans = counts.select(
            *groups, "_at", "_n",
            *[F.coalesce(c, F.lit(0)).alias(f"_t_{s}") for s, c in self.totals.items()],
            *[F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(f"_b{c}") for c in self._counted()],
        )
        self.totals = {s: F.col(f"_t_{s}") for s in self.totals}

    def _counted(self) -> list[str]:
        return ["_n", *[f"_s_{s}" for s in self.sums]]

    def _summed(self) -> list[Column]:
        return [F.sum(f"_s_{s}").alias(f"_s_{s}") for s in self.sums]

    def _ahead(self, by: str, keys: Sequence[str]):
        along = F.col(by).desc_nulls_last() if self.descending else F.col(by).asc_nulls_last()
        return _all(keys).orderBy(along).rowsBetween(Window.unboundedPreceding, -1)

    def group_totals(self) -> DataFrame:
        """`(groups…, n, rows, sums…)`: one row for each group; it needs no scan of its own."""
        ends = [F.max(c).alias(s) for s, c in self.totals.items()]
        return self.spans.groupBy(*self.groups).agg(*ends).where("rows is not null")

    def values(self, targets: Targets | DataFrame, bound: int | None = None) -> DataFrame:
        """The value at each wanted 0-based rank, `(groups…, rank, labels…, value, before, tied)`.

        `targets` is a table `(groups…, rank, labels…)`, or a function that makes an array of such
        structs out of a group's totals. `before` rows are strictly ahead of the value and `tied`
        have it; each sum `s` comes as `s_before` and `s_tied`. Ranks beyond the rows have no value.
        With a `bound` on the number of targets, proven by parameters, the buckets that hold them go
        to the rows, and rows are not shuffled.
        """
        spans = self.spans.where("_at is not null")
        if callable(targets):
            wanted = targets(self.totals)
        else:
            labels = [c for c in targets.columns if c not in self.groups]
            packed = F.collect_list(F.struct(*labels)).alias("_targets")
            if self.groups:
                spans = _same(spans, targets.groupBy(*self.groups).agg(packed), self.groups)
            else:
                spans = spans.withColumn("_targets", targets.agg(packed).scalar())
            wanted = F.col("_targets")
        start, end = F.col("_b_n"), F.col("_b_n") + F.col("_n")
        inside = F.filter(wanted, lambda t: (t["rank"] >= start) & (t["rank"] < end))
        ahead = [f"_b{c}" for c in self._counted()]
        hits = spans.select(*self.groups, "_at", *ahead, inside.alias("_targets")).where(F.size("_targets") > 0)
        hits = bounded(hits, bound)
        keys = [*self.groups, "_at"]
        counted = (
            _same(self.rows.where("_v is not null"), hits.select(*keys), keys, "left_semi")
            .groupBy(*keys, "_v")
            .agg(F.count(F.lit(1)).alias("_n"), *self._summed())
        )
        earlier = self._ahead("_v", keys)
        here = counted.select(*keys, "_v", *[
            x for c in self._counted() for x in (F.col(c), F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_in{c}"))
        ])
        met = _same(here, hits, keys)
        before = F.col("_b_n") + F.col("_in_n")
        reached = F.filter("_targets", lambda t: (t["rank"] >= before) & (t["rank"] < before + F.col("_n")))
        return met.select(
            *self.groups, F.inline(reached), F.col("_v").alias("value"), before.alias("before"), F.col("_n").alias("tied"),
            *[(F.col(f"_b_s_{s}") + F.col(f"_in_s_{s}")).alias(f"{s}_before") for s in self.sums],
            *[F.col(f"_s_{s}").alias(f"{s}_tied") for s in self.sums],
        )


def values_at_ranks(
    df: DataFrame, order: str, targets: Targets | DataFrame, groups: Sequence[str] = (), descending: bool = False,
    sums: Mapping[str, Column] | None = None,
) -> DataFrame:
    """The value at each wanted 0-based rank of each group, exactly; see `Selection.values`."""
    return Selection(df, order, groups, descending, sums=sums).values(targets)
