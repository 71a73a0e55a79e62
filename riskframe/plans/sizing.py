"""Size checks that decide how a small side is joined."""

from __future__ import annotations

import threading
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Estimated bytes of one row of a bounded helper table (a few longs and doubles).
ROW_BYTES = 96


def _threshold(df: DataFrame) -> int:
    text = df.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold", "10485760")
    units = {"kb": 1 << 10, "mb": 1 << 20, "gb": 1 << 30, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "b": 1}
    lowered = text.strip().lower()
    for suffix, factor in units.items():
        if lowered.endswith(suffix):
            return int(lowered[: -len(suffix)]) * factor
    return int(lowered)


def bounded(df: DataFrame, rows: int | None) -> DataFrame:
    """`df` with a broadcast hint when its proven row bound fits the session's threshold.

    `rows` comes from the parameters (days in the split layout, points of a sweep), never
    from the data. Without a bound, or beyond the threshold, the planner keeps its own
    choice, which is a shuffled join with adaptive skew handling.
    """
    if rows is not None and rows * ROW_BYTES <= _threshold(df):
        return F.broadcast(df)
    return df


_scope = threading.local()


def _kept() -> list[DataFrame]:
    if not hasattr(_scope, "kept"):
        _scope.kept = []
    return _scope.kept


def measured(df: DataFrame) -> DataFrame:
    """`df` cached, for helper tables that would otherwise be recomputed by each of their readers.

    It is computed when first read, and adaptive planning then joins it by its real size.
    """
    cached = df.persist()
    _kept().append(cached)
    return cached


def release() -> None:
    """Drop this thread's cached helper tables; a result still unread is recomputed."""
    kept = _kept()
    while kept:
        kept.pop().unpersist()


@contextmanager
def caching() -> Iterator[None]:
    """Helper tables made inside are dropped at the end, and only those."""
    outer, _scope.kept = _kept(), []
    try:
        yield
    finally:
        release()
        _scope.kept = outer


def literal_table(spark, rows: list[tuple], schema: str) -> DataFrame:
    """A table of parameters as a local relation: its size is known to the planner."""
    return spark.createDataFrame(rows, schema)
