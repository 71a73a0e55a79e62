"""Positions in sorted edges, interpolation, and null-safe lookups."""

from __future__ import annotations

import bisect
import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A search tree of comparisons stays inside generated code up to this many edges.
TREE_EDGES = 64


def _tree(name: str, edges: Sequence[float], right: bool, low: int, high: int) -> str:
    if low == high:
        return str(low)
    mid = (low + high) // 2
    beyond = f"{name} {'>=' if right else '>'} {float(edges[mid])!r}D"
    return (
        f"IF({beyond}, {_tree(name, edges, right, mid + 1, high)}, "
        f"{_tree(name, edges, right, low, mid)})"
    )


def edge_position(c: str, edges: Sequence[float], side: str = "left") -> Column:
    """How many sorted edges lie below a value (`left`), or at or below it (`right`)."""
    if side not in ("left", "right"):
        raise ValueError(f"side must be left or right, got {side!r}")
    if not all(math.isfinite(e) for e in edges):
        raise ValueError("edges must be finite numbers")
    name = f"CAST(`{c}` AS DOUBLE)"
    found = _tree(name, list(edges), side == "right", 0, len(edges))
    return F.expr(f"IF({name} IS NULL OR isnan({name}), CAST(NULL AS INT), {found})")


def bin_by_edges(
    df: DataFrame, c: str, edges: Sequence[float], side: str = "left", out: str = "bin"
) -> DataFrame:
    """`edge_position` as a column, for edge lists of any length.

    Short lists become a comparison tree; long ones go through the bucketizer, which
    searches in the JVM. Its buckets are left-closed, so the other closure is read off the
    negated axis.
    """
    edges = [float(e) for e in edges]
    if not all(math.isfinite(e) for e in edges) or any(a > b for a, b in zip(edges, edges[1:])):
        raise ValueError("edges must be finite and sorted ascending")
    if len(edges) <= TREE_EDGES:
        return df.withColumn(out, edge_position(c, edges, side))
    value = F.col(c).cast("double")
    axis = value if side == "right" else -value
    unique = sorted(set(edges))
    splits = unique if side == "right" else [-e for e in reversed(unique)]
    bucketizer = Bucketizer(
        splits=[float("-inf"), *splits, float("inf")],
        inputCol="_axis",
        outputCol="_bucket",
        handleInvalid="keep",
    )
    usable = value.isNotNull() & ~F.isnan(value)
    marked = df.withColumn("_axis", F.coalesce(F.when(usable, axis), F.lit(0.0)))
    found = F.col("_bucket").cast("int")
    if side == "right":
        counts = [0, *[bisect.bisect_right(edges, e) for e in unique]]
    else:
        # bucket k of the negated axis: k distinct edges lie at or above the value
        counts = [len(edges), *[bisect.bisect_left(edges, e) for e in reversed(unique)]]
    if counts != list(range(len(counts))):
        found = F.element_at(F.array(*[F.lit(n) for n in counts]), found + 1)
    return (
        bucketizer.transform(marked)
        .withColumn(out, F.when(usable, found))
        .drop("_axis", "_bucket")
    )


def interpolate(
    df: DataFrame, c: str, xs: Sequence[float], ys: Sequence[float], out: str
) -> DataFrame:
    """Piecewise-linear interpolation on strictly increasing breakpoints, flat outside."""
    if len(xs) != len(ys) or not xs:
        raise ValueError("breakpoints need as many values as positions")
    if any(a >= b for a, b in zip(xs, xs[1:])):
        raise ValueError("breakpoints must increase strictly")
    x = F.col(c).cast("double")
    if len(xs) == 1:
        return df.withColumn(out, F.when(x.isNotNull(), F.lit(float(ys[0]))))
    binned = bin_by_edges(df, c, xs, "right", "_at")
    at = F.greatest(F.lit(1), F.least(F.lit(len(xs) - 1), F.col("_at")))
    table_x = F.array(*[F.lit(float(v)) for v in xs])
    table_y = F.array(*[F.lit(float(v)) for v in ys])
    x0, x1 = F.element_at(table_x, at), F.element_at(table_x, at + 1)
    y0, y1 = F.element_at(table_y, at), F.element_at(table_y, at + 1)
    inside = y0 + (x - x0) / (x1 - x0) * (y1 - y0)
    value = (
        F.when(F.isnan(x), F.lit(float("nan")))
        .when(x <= xs[0], F.lit(float(ys[0])))
        .when(x >= xs[-1], F.lit(float(ys[-1])))
        .when(x.isNotNull(), inside)
    )
    return binned.withColumn(out, value).drop("_at")


def ecdf_position(df: DataFrame, c: str, grid: Sequence[float], out: str) -> DataFrame:
    """Share of a sorted grid at or below a value."""
    if not len(grid):
        raise ValueError("the grid is empty")
    found = bin_by_edges(df, c, grid, "right", "_at")
    return found.withColumn(out, F.col("_at") / F.lit(float(len(grid)))).drop("_at")


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join that also matches null keys; the left side's key columns are kept.

    A key that one side declares non-null is compared plainly: the result is the same, and a
    partitioning that the side already has can be used.
    """
    if not keys:
        raise ValueError("a join needs at least one key")
    maybe_null = {f.name for f in left.schema if f.nullable} & {f.name for f in right.schema if f.nullable}
    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    condition = None
    for k in keys:
        term = F.col(k).eqNullSafe(F.col(f"__r_{k}")) if k in maybe_null else F.col(k) == F.col(f"__r_{k}")
        condition = term if condition is None else condition & term
    joined = left.join(renamed, condition, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[f"__r_{k}" for k in keys])


def lookup(
    df: DataFrame, table: DataFrame, key: str, values: dict[str, object], table_key: str = "level"
) -> DataFrame:
    """Left join to a fitted table with a default per looked-up column.

    No broadcast is forced: a fitted table grows with its entities, so its measured size
    decides, and a hot key on the shuffled path is split by adaptive skew handling.
    """
    right = table.select(
        F.col(table_key).alias("__lk"), *[F.col(v).alias(f"__v_{v}") for v in values]
    )
    plain = not df.schema[key].nullable or not right.schema["__lk"].nullable
    same = F.col(key) == F.col("__lk") if plain else F.col(key).eqNullSafe(F.col("__lk"))
    joined = df.join(right, same, "left").drop("__lk")
    for name, default in values.items():
        found = F.col(f"__v_{name}")
        joined = joined.withColumn(
            name, found if default is None else F.coalesce(found, _as_column(default))
        ).drop(f"__v_{name}")
    return joined


def _as_column(value: object) -> Column:
    return value if isinstance(value, Column) else F.lit(value)
