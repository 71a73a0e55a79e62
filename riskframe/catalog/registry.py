"""Named queries, each with the SQL that must give the same table where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.plans.sizing import release

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# Shared relations of the oracles: the same derivations as catalog.inputs, in SQL.
TXN = """
txn0 AS (
  SELECT event_id AS id,
         CAST(floor(epoch(ts) - epoch(TIMESTAMP '2024-01-01')) AS BIGINT) + 86400 AS dt,
         user_id AS card, value AS amount, event_type AS product,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS addr,
         CASE WHEN (event_id * 7919) % 29 = 0 THEN 1 ELSE 0 END AS is_fraud,
         CAST((event_id * 104729) % 97 AS DOUBLE) / 97.0::DOUBLE AS score
  FROM events),
txn AS (
  SELECT *, CAST(dt // 86400 AS INTEGER) AS day, CAST((dt // 3600) % 24 AS INTEGER) AS hour,
         CAST((dt // 86400) % 7 AS INTEGER) AS weekday
  FROM txn0),
st AS (
  SELECT *, CASE WHEN day BETWEEN 1 AND 10 THEN 'train' WHEN day BETWEEN 16 AND 20 THEN 'val_fit'
                 WHEN day BETWEEN 21 AND 25 THEN 'val_cal' WHEN day BETWEEN 26 AND 30 THEN 'test' END AS split
  FROM txn)
"""

KINDS = {"i": "BIGINT", "s": "VARCHAR", "b": "BOOLEAN"}
# Decimals kept of a double: `f` for ratios and small values, `m` for large sums.
DECIMALS = {"f": 6, "m": 2}


def _columns(spec: str) -> list[tuple[str, str]]:
    return [tuple(part.split(":")) for part in spec.split()]


def _shaped(kind: str, c: Column) -> Column:
    if kind == "i":
        return c.cast("long")
    if kind in DECIMALS:
        return F.round(c.cast("double"), DECIMALS[kind]) + F.lit(0.0)
    return c.cast("string") if kind == "s" else c.cast("boolean")


def shape(df: DataFrame, spec: str) -> DataFrame:
    """Columns in the declared kinds; doubles rounded, since engines add in different orders."""
    return df.select(*[_shaped(kind, F.col(name)).alias(name) for name, kind in _columns(spec)])


def oracle(spec: str, sql: str, ctes: str = TXN) -> str:
    picked = ", ".join(
        f'round(CAST("{n}" AS DOUBLE), {DECIMALS[k]}) + 0.0 AS "{n}"'
        if k in DECIMALS
        else f'CAST("{n}" AS {KINDS[k]}) AS "{n}"'
        for n, k in _columns(spec)
    )
    head = f"WITH {ctes.strip()}, answer AS ({sql})" if ctes else f"WITH answer AS ({sql})"
    return f"{head} SELECT {picked} FROM answer"


def query(name: str, spec: str, sql: str | None = None, ctes: str = TXN) -> Callable[[Query], Query]:
    """Register a query under the columns it returns, with its oracle if it has one."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            release()
            return shape(fn(spark, sf_dir), spec)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = oracle(spec, sql, ctes)
        return fn

    return register
