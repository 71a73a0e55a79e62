"""Refusals that end a job, wherever the optimiser moves a filter.

A `raise_error` inside a value meets every row that the value is computed for, also rows that a
filter elsewhere in the query removes. Here a refusal is a filter over an aggregate of the table it
guards: it cannot slip below the aggregate, and neither column pruning nor a later filter drops it.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unless(found: Column, told: Column | str) -> Column:
    """True, or the end of the job where `found` holds."""
    message = F.lit(told) if isinstance(told, str) else told
    return F.when(F.coalesce(found, F.lit(False)), F.raise_error(message).cast("boolean")).otherwise(F.lit(True))


def refuse(totals: DataFrame, count: str, told: str) -> DataFrame:
    """`totals`, which were aggregated, without the column `count`; the job ends where it is not 0."""
    message = F.concat(F.lit(f"{told}: "), F.col(count).cast("string"), F.lit(" rows"))
    return totals.where(unless(F.col(count) > 0, message)).drop(count)


def gated(df: DataFrame, bad: Mapping[str, Column]) -> DataFrame:
    """`df`, or the end of the job that reads it if a condition of `bad` holds for any of its rows.

    The conditions are counted by an aggregate of their own over `df`, in the same job, which reads
    their columns only. A job that needs an aggregate of `df` anyway should `refuse` on that.
    """
    counts = df.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(f"c{i}") for i, c in enumerate(bad.values())])
    parts = [
        F.when(F.col(f"c{i}") > 0, F.concat(F.lit(f"{told}: "), F.col(f"c{i}").cast("string"), F.lit(" rows")))
        for i, told in enumerate(bad)
    ]
    told = counts.select(F.concat_ws(", ", *parts).alias("told")).scalar()
    return df.where(unless(told != "", told))
