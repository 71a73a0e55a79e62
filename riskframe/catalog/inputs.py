"""The shared tables read as transaction data (FIXTURES.md, derived fixtures)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.config import SplitBounds
from riskframe.operators.splits import add_time_columns, assign_splits

# Split layout of the 30 days that the events table covers.
BOUNDS = SplitBounds(train_start=1, gap_days=5, val_fit_start=16, val_cal_start=21, test_start=26, test_end=30)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def wall_seconds(ts: str, origin: str) -> Column:
    """Whole seconds since a date, read off the wall-clock fields: no time zone enters."""
    days = F.date_diff(F.to_date(ts), F.to_date(F.lit(origin)))
    return (
        days.cast("long") * 86_400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)
    ).cast("long")


def txn_columns(df: DataFrame) -> DataFrame:
    """Events as transactions; a narrow projection, so pruning still reaches the scan."""
    return df.select(
        F.col("event_id").alias("id"),
        (wall_seconds("ts", "2024-01-01") + 86_400).alias("dt"),
        F.col("user_id").alias("card"),
        F.col("value").alias("amount"),
        F.col("event_type").alias("product"),
        F.get_json_object("props", "$.k").cast("int").alias("addr"),
        (F.pmod(F.col("event_id") * 7919, F.lit(29)) == 0).cast("int").alias("is_fraud"),
        (F.pmod(F.col("event_id") * 104_729, F.lit(97)) / 97.0).cast("double").alias("score"),
    )


def txn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return add_time_columns(txn_columns(table(spark, sf_dir, "events")))


def split_txn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_splits(txn(spark, sf_dir), BOUNDS)


def tied_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as transactions on whole days: many ties per customer."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        wall_seconds("o_orderdate", "1990-01-01").alias("dt"),
        F.col("o_custkey").alias("card"),
        F.col("o_totalprice").alias("amount"),
    )


def wide_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with nulls planted by key arithmetic: two shared patterns and one full column."""
    li = table(spark, sf_dir, "lineitem")
    key = F.col("l_orderkey") * 7 + F.col("l_linenumber")
    first, second = F.pmod(key, F.lit(3)) == 0, F.pmod(key, F.lit(5)) == 0
    return li.select(
        (F.col("l_orderkey") * 1000 + F.col("l_partkey") % 997 * 1 + F.col("l_linenumber") * 100_000_000).alias("row_key"),
        "l_orderkey",
        "l_linenumber",
        F.when(~first, F.col("l_quantity")).alias("v1"),
        F.when(~first, F.col("l_quantity") * 2 + F.col("l_tax")).alias("v2"),
        F.when(~first, F.col("l_discount")).alias("v3"),
        F.when(~second, F.col("l_extendedprice")).alias("v4"),
        F.when(~second, F.col("l_tax")).alias("v5"),
        F.col("l_quantity").alias("v6"),
        (F.pmod(key, F.lit(11)) == 0).cast("int").alias("is_fraud"),
        "l_returnflag",
        "l_linestatus",
    )
