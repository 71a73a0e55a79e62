"""Contracts on a table: every violation is reported, then refused together."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Rule:
    """What one column, or every column matching a pattern, must satisfy."""

    column: str
    dtype: T.DataType | None = None
    nullable: bool = True
    isin: tuple = ()
    low: float | None = None
    high: float | None = None
    pattern: bool = False


@dataclass(frozen=True)
class Contract:
    rules: tuple[Rule, ...]
    unique: tuple[tuple[str, ...], ...] = field(default=())


def _expand(df: DataFrame, rules: Sequence[Rule]) -> tuple[list[tuple[str, Rule]], list[str]]:
    import re

    placed, missing = [], []
    for rule in rules:
        names = (
            [c for c in df.columns if re.fullmatch(rule.column, c)]
            if rule.pattern
            else [c for c in df.columns if c == rule.column]
        )
        if not names:
            missing.append(rule.column)
        placed += [(name, rule) for name in names]
    return placed, missing


def validate(df: DataFrame, contract: Contract) -> DataFrame:
    """Violations `(column_name, check_name, n)`; empty when the contract holds.

    Schema checks need no job, row checks share one aggregate, and each unique key is one
    grouped count.
    """
    spark = df.sparkSession
    placed, missing = _expand(df, contract.rules)
    types = {f.name: f.dataType for f in df.schema}
    static = [(c, "missing", 1) for c in missing]
    checks: list[tuple[str, str, Column]] = []
    for name, rule in placed:
        c = F.col(name)
        if rule.dtype is not None and types[name] != rule.dtype:
            static.append((name, "type", 1))
        if not rule.nullable:
            checks.append((name, "null", c.isNull()))
        if rule.isin:
            checks.append((name, "domain", c.isNotNull() & ~c.isin(*rule.isin)))
        if rule.low is not None:
            checks.append((name, "below", c < rule.low))
        if rule.high is not None:
            checks.append((name, "above", c > rule.high))
    schema = "column_name string, check_name string, n bigint"
    parts = [spark.createDataFrame(static, schema)] if static else []
    if checks:
        row = df.agg(*[F.count_if(cond).alias(f"c{i}") for i, (_, _, cond) in enumerate(checks)])
        cells = F.array(
            *[
                F.struct(
                    F.lit(name).alias("column_name"), F.lit(check).alias("check_name"), F.col(f"c{i}").alias("n")
                )
                for i, (name, check, _) in enumerate(checks)
            ]
        )
        parts.append(row.select(F.inline(cells)).where("n > 0"))
    for key in contract.unique:
        surplus = duplicate_keys(df, key).agg(F.sum(F.col("copies") - 1).alias("n"))
        parts.append(
            surplus.where("n > 0").select(F.lit(",".join(key)).alias("column_name"), F.lit("unique").alias("check_name"), "n")
        )
    if not parts:
        return spark.createDataFrame([], schema)
    return reduce(DataFrame.unionByName, parts)


def duplicate_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys held by more than one row `(key…, copies)`."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def enforce(df: DataFrame, contract: Contract) -> DataFrame:
    """`df` itself, once `validate` reports nothing."""
    # one row at most for each column and check, so the report is as long as the contract
    found = validate(df, contract).collect()
    if found:
        raise ValueError("contract violated: " + "; ".join(f"{r[0]} {r[1]} ({r[2]})" for r in found))
    return df
